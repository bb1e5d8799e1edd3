"""Product names read into components: brand, strengths, pack, volume, weight, form, flavour, class, maker.

`parse_names` adds one struct. It works in steps, each a projection of built-in functions over the one before, so that
no expression is written twice into the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import words as W
from weftline.functions.normalize import arabic_terms, normalize_name, squeeze, text, tokens

FIELDS = ["brand", "dosage_nums", "dosage_units", "qty", "volume", "weight", "form", "flavor", "imported", "normalized", "brand_variants", "product_class", "is_synthetic", "manufacturer"]
_NONE = "cast(array() as array<string>)"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def canonical_number(c: Column) -> Column:
    """12.50 is 12.5 and 12.0 is 12; without a dot it stays."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^0+(?=\d)", ""), r"0+$", ""), r"\.$", "")
    return F.when(c.contains("."), dotted).otherwise(c)


def _has(words: str, some: list[str]) -> str:
    return f"arrays_overlap({words}, array({_list(some)}))"


def classify(words: Column) -> Column:
    """medicine, device, baby_food, cosmetic or supplement, from a name's words."""
    some = lambda s: F.arrays_overlap(words, F.array(*map(F.lit, s)))
    has = lambda w: F.array_contains(words, w)
    return (
        F.when(has("PRE") & has("FILLED") & has("SYRINGE"), "medicine")
        .when(some(W.DEVICES), "device")
        .when(some(W.BABY_FOOD) & ~some(["BODY", "CREAM", "LOTION"]), "baby_food")
        .when(some(W.COSMETIC), "cosmetic")
        .when(some(W.SUPPLEMENTS), "supplement")
        .otherwise("medicine")
    )


def split_manufacturer(name: Column) -> Column:
    """(base, manufacturer): a known maker in brackets, or else the last known maker among the words, taken out."""
    upper = squeeze(F.upper(text(name)))
    bracket = F.regexp_extract(upper, r"\(([A-Z]+)\)", 1)
    words = tokens(upper)
    known = F.filter(F.transform(words, lambda w, i: F.when(w.isin(W.MANUFACTURERS), i)), lambda i: i.isNotNull())
    at = F.try_element_at(known, F.lit(-1))
    without = F.array_join(F.filter(words, lambda w, i: i != at), " ")
    cut = squeeze(F.regexp_replace(text(name), r"(?i)\s*\([A-Z]+\)\s*", " "))
    return F.when(bracket.isin(W.MANUFACTURERS), F.struct(cut.alias("base"), bracket.alias("manufacturer"))).otherwise(
        F.struct(F.when(at.isNotNull(), without).otherwise(text(name)).alias("base"), F.get(words, at).alias("manufacturer"))
    )


def canonical_form(c: Column) -> Column:
    out = c
    for form, spellings in W.FORM_NAMES.items():
        out = F.when(c.isin(spellings.split()), form).otherwise(out)
    return out


def parse_names(df: DataFrame, name: str, out: str, synthetic: Column | None = None) -> DataFrame:
    """df with the struct `out` of FIELDS. A null or empty name has empty components."""
    keep = df.columns
    d = df.withColumn("_split", split_manufacturer(F.col(name)))
    base = F.col("_split.base")
    d = d.withColumn("_imported", base.rlike(W.IMPORTED))
    d = d.withColumn("_norm", normalize_name(F.when(base.rlike("[؀-ۿ]"), arabic_terms(base)).otherwise(base)))
    n = F.col("_norm")
    d = d.withColumn("_w", tokens(n))
    every = lambda pattern, k: F.regexp_extract_all(n, F.lit(pattern), F.lit(k))
    last = lambda pattern: F.coalesce(F.try_element_at(every(pattern, 1), F.lit(-1)), F.lit(""))
    d = d.withColumns({"_weight": last(W.WEIGHT), "_volume": last(W.VOLUME), "_pack": F.regexp_extract(n, W.PACK, 1)})
    both = F.regexp_extract(n, W.COMBINED_MG_PER_ML, 1)
    per_ml = F.regexp_extract(n, W.MG_PER_ML, 1)
    one = lambda v: F.array(v)
    nums = F.transform(every(W.DOSAGE, 1), lambda x: F.regexp_replace(x, r"\s+", ""))
    d = d.withColumns(
        {
            "_nums": F.when(both != "", one(F.concat(both, F.lit("/"), F.regexp_extract(n, W.COMBINED_MG_PER_ML, 2)))).when(per_ml != "", one(per_ml)).otherwise(nums),
            "_units": F.when((both != "") | (per_ml != ""), one(F.lit("MG/ML"))).otherwise(every(W.DOSAGE, 2)),
        }
    )
    # a brand is the words before the first that has a digit or bounds it
    hard = W.FORM_PREFIXES + W.FORM_WORDS + W.NOISE + W.BRAND_QUALIFIERS
    soft = W.SOFT_DESCRIPTORS + W.CONNECTORS + W.FLAVORS + W.SUPPLEMENTS
    infant = f"(w = 'INF' and i > 0 and not {_has('_w', W.INFUSION)})"
    bound = f"(w in ({_list(hard)}) or {infant} or w = 'GELATIN' or (i > 0 and w in ({_list(soft)})))"
    d = d.withColumn("_stops", F.expr(f"transform(_w, (w, i) -> w rlike '[0-9]' or {bound})"))
    d = d.withColumn("_lead", F.expr("array_join(slice(_w, 1, if(array_position(_stops, true) = 0, size(_w), cast(array_position(_stops, true) as int) - 1)), '')"))
    d = d.withColumn("_rest", F.expr("array_join(transform(filter(arrays_zip(_w, _stops), (x, i) -> i > 0 and not x._stops), x -> x._w), '')"))
    d = d.withColumn(
        "_brand",
        F.expr(f"case when get(_w, 0) in ({_list(W.ACRONYM_BRANDS)}) then get(_w, 0) when _lead <> '' then _lead when get(_w, 0) in ({_list(W.BRAND_QUALIFIERS)}) then _rest else '' end"),
    )
    mended = (F.col("_brand") == "ATOMOXAPEX") & (F.array_join("_nums", "|") == "40") & (F.col("_volume") == "100")
    d = d.withColumns({"_nums": F.when(mended, one(F.lit("4"))).otherwise(F.col("_nums")), "_units": F.when(mended, one(F.lit("MG/ML"))).otherwise(F.col("_units"))})
    d = d.withColumn("_form", F.coalesce(canonical_form(F.expr(f"get(filter(array({_list(W.FORM_ORDER)}), f -> array_contains(_w, f)), 0)")), F.lit("")))
    d = d.withColumn("_form", F.expr(f"if(_form = 'SUSP' and {_has('_w', ['EYE', 'DROPS'])}, 'EYE', _form)"))
    d = d.withColumn("_pack", F.expr("if(size(_nums) = 0 and try_cast(_pack as bigint) >= 100 and array_contains(_w, 'VAGINAL') and _form in ('CAP', 'SUPP'), '', _pack)"))
    # strengths that no unit marks: a pair a / b, or the one number that is not the pack, volume or weight
    slash = F.regexp_replace(F.regexp_extract(n, rf"\b{W.NUMBER}\s*/\s*{W.NUMBER}\b", 0), r"\s+", "")
    numbers = F.transform(every(rf"\b({W.NUMBER})\b", 1), canonical_number)
    used = F.transform(F.filter(F.array("_pack", "_volume", "_weight"), lambda v: v != ""), canonical_number)
    d = d.withColumns({"_slash": slash, "_numbers": numbers, "_used": used})
    count = "size(filter({}, y -> y = x))"
    d = d.withColumn(
        "_left",
        F.expr(f"flatten(transform(array_distinct(_numbers), x -> array_repeat(x, greatest({count.format('_numbers')} - {count.format('_used')}, 0))))"),
    )
    single = "size(_left) = 1 and (_pack <> '' or _form in ('TAB', 'CAP', 'SUPP', 'AMP', 'VIAL', 'SPRAY') or (_volume <> '' and _form in ('SYRUP', 'SUSP')))"
    strong = f"_weight <> '' and ((_form = 'TAB' and {_has('_w', ['EFF', 'EFFERVESCENT'])}) or _form in ('VIAL', 'AMP') or {_has('_w', W.INFUSION)})"
    case = f"case when size(_nums) > 0 then 0 when _slash <> '' then 1 when {single} then 2 when {strong} then 3 else 4 end"
    d = d.withColumn("_case", F.expr(case))
    d = d.withColumns(
        {
            "_nums": F.expr("case _case when 0 then _nums when 1 then array(_slash) when 2 then _left when 3 then array(_weight) else _nums end"),
            "_units": F.expr("case _case when 0 then _units when 1 then array('MG') when 2 then array('MG') when 3 then array('GM') else _units end"),
        }
    )
    d = d.withColumn("_flavor", F.expr(f"coalesce(get(filter(array({_list(W.FLAVORS)}), f -> array_contains(_w, f)), 0), '')"))
    # growing beginnings of the name, up to what ends a brand: connectors are skipped, a soft descriptor is the last
    ends = f"(w rlike '[0-9]' or w in ({_list(W.FORM_PREFIXES + W.FORM_WORDS + W.NOISE)}) or {infant} or (i > 0 and not w in ({_list(W.CONNECTORS)}) and w in ({_list(W.BRAND_QUALIFIERS)})))"
    d = d.withColumn("_ends", F.expr(f"transform(_w, (w, i) -> {ends})"))
    d = d.withColumn("_open", F.expr("slice(_w, 1, if(array_position(_ends, true) = 0, size(_w), cast(array_position(_ends, true) as int) - 1))"))
    d = d.withColumn("_soft", F.expr(f"array_position(transform(_open, (w, i) -> i > 0 and not w in ({_list(W.CONNECTORS)}) and w in ({_list(W.SOFT_DESCRIPTORS)})), true)"))
    d = d.withColumn("_open", F.expr(f"filter(if(_soft = 0, _open, slice(_open, 1, cast(_soft as int))), (w, i) -> i = 0 or not w in ({_list(W.CONNECTORS)}))"))
    grown = "if(size(_open) = 0, " + _NONE + ", transform(sequence(1, size(_open)), k -> array_join(slice(_open, 1, k), '')))"
    d = d.withColumn("_variants", F.expr(f"array_distinct(filter(transform(concat(array(_brand), {grown}), v -> regexp_replace(v, '[^A-Z0-9]', '')), v -> length(v) >= 3))"))
    made = synthetic if synthetic is not None else F.lit(False)
    parsed = F.struct(
        F.col("_brand").alias("brand"),
        F.col("_nums").alias("dosage_nums"),
        F.col("_units").alias("dosage_units"),
        F.col("_pack").alias("qty"),
        F.col("_volume").alias("volume"),
        F.col("_weight").alias("weight"),
        F.col("_form").alias("form"),
        F.col("_flavor").alias("flavor"),
        F.col("_imported").alias("imported"),
        n.alias("normalized"),
        F.col("_variants").alias("brand_variants"),
        classify(F.col("_w")).alias("product_class"),
        made.alias("is_synthetic"),
        F.col("_split.manufacturer").alias("manufacturer"),
    )
    return d.select(*keep, parsed.alias(out))


def parse_distinct(df: DataFrame, name: str, out: str, more: dict[str, Column] | None = None) -> DataFrame:
    """`parse_names` where rows repeat names: each distinct name is parsed once and joined back. more: columns of the name and `out` alone, made as seldom."""
    parsed = parse_names(df.select(F.col(name).alias("_name")).distinct().withColumn(name, F.col("_name")), name, out).withColumns(more or {})
    return df.join(parsed.drop(name), F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def category_queries(p: str) -> Column:
    """Queries that a parsed name's form calls for: brand with volume or strength for liquids, with strength and form for injections."""
    f = lambda x: F.col(f"{p}.{x}")
    strength = F.array_join(F.transform(F.arrays_zip(f("dosage_nums"), f("dosage_units")), lambda z: F.concat(z["dosage_nums"], z["dosage_units"])), " ")
    brand = f("brand")
    liquid = f("form").isin("SYRUP", "SUSP", "SOLUTION") | (f("volume") != "")
    with_ = lambda v, *more: F.when(v != "", F.concat_ws(" ", brand, v, *more))
    queries = F.when(liquid, F.array(with_(f("volume")), with_(strength))).when(f("form").isin("AMP", "VIAL"), F.array(with_(strength, f("form")), with_(strength)))
    none = F.array().cast("array<string>")
    return F.when(brand == "", none).otherwise(F.coalesce(F.array_compact(queries), none))
