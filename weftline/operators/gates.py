"""Gates that a candidate passes, or the reason why it doesn't. Each works on two parsed structs, by name.

`with_facts` first adds to each side, once a row, what the gates ask of it; so pairs only compare.

A reason is null where its gate passes, so gates in order are one coalesce. What a Python function must decide (how
alike two brands are) comes in as a column, computed only for pairs that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import words as W
from weftline.functions.normalize import ARABIC_RANGE, identity_tokens, numeric_tokens, routes, tokens
from weftline.functions.parse import canonical_number


def _set(*some: str) -> Column:
    return F.array(*map(F.lit, some))


def _words(p: str) -> Column:
    return F.col(f"{p}_x.words")


def with_facts(df: DataFrame, p: str) -> DataFrame:
    """df with the struct `<p>_x` of what gates ask of a parsed struct p."""
    d = df.withColumn("_words", tokens(F.col(f"{p}.normalized")))
    facts = F.struct(
        F.col("_words").alias("words"),
        (~F.col(f"{p}.is_synthetic") & F.col(f"{p}.normalized").rlike("[A-Za-z]")).alias("reliable"),
        F.regexp_replace(f"{p}.brand", "[^A-Z0-9]", "").alias("bare"),
        dosage_parts(p).alias("parts"),
        _flat(p).alias("flat"),
        _milligrams(p).alias("mg"),
        numeric_signals(p).alias("signals"),
        routes(F.col("_words")).alias("routes"),
    )
    return d.withColumn(f"{p}_x", facts).drop("_words")


def _has(w: Column, *some: str) -> Column:
    return F.arrays_overlap(w, _set(*some))


def _all(w: Column, *some: str) -> Column:
    return F.size(F.array_intersect(w, _set(*some))) == len(some)


def _same_of(a: Column, b: Column, some: list[str]) -> Column:
    own = lambda w: F.array_sort(F.array_distinct(F.array_intersect(w, _set(*some))))
    return own(a) == own(b)


def _reason(when: Column, name: str) -> Column:
    return F.when(when, name)


def reliable(p: str) -> Column:
    """An English name that was not made up."""
    return F.col(f"{p}_x.reliable")


def bare_brand(p: str) -> Column:
    return F.col(f"{p}_x.bare")


def needs_brand_ratio(d: str, m: str) -> Column:
    """Whether the brand gate asks how alike the brands are: both are there and differ."""
    return (bare_brand(d) != "") & (bare_brand(m) != "") & (bare_brand(d) != bare_brand(m))


def marks_gate(d: str, m: str) -> Column:
    """Strong modifiers, ages and flavour marks must be the same."""
    a, b = _words(d), _words(m)
    kinds = [("different_modifier", W.STRONG_MODIFIERS), ("different_age_group", W.AGE), ("different_flavor", W.FLAVOR_MARKS)]
    return F.when(reliable(d) & reliable(m), F.coalesce(*(_reason(~_same_of(a, b, s), r) for r, s in kinds)))


def brand_gate(d: str, m: str, ratio: Column, maker_ratio: Column, least_prefix: int = 4) -> Column:
    """ratio: of the bare brands, 0 to 100; maker_ratio: of the makers, 0 to 1."""
    a, b = _words(d), _words(m)
    x, y = bare_brand(d), bare_brand(m)
    of = lambda p, f: F.col(f"{p}.{f}")
    makers = of(d, "manufacturer").isNotNull() & of(m, "manufacturer").isNotNull() & (of(d, "manufacturer") != of(m, "manufacturer"))
    maker = F.when(makers & (maker_ratio < 0.85), F.concat(F.lit("different_manufacturer: "), of(d, "manufacturer"), F.lit(" vs "), of(m, "manufacturer")))
    chems = lambda w, p: F.array_sort(F.array_intersect(F.array_distinct(F.concat(w, F.array(of(p, "brand")))), _set(*W.CHEMICALS)))
    chemical = (F.size(chems(a, d)) > 0) & (F.size(chems(b, m)) > 0) & (chems(a, d) != chems(b, m))
    both = (x != "") & (y != "") & (x != y)
    known = _known_variant(d, m, a, b, x, y)
    contained = x.contains(y) | y.contains(x)
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    prefix = F.least(shorter, F.greatest(F.lit(least_prefix), F.floor(shorter * 0.75)))
    co = F.when(F.length(x) >= F.length(y), x == F.concat(F.lit("CO"), y)).otherwise(y == F.concat(F.lit("CO"), x))
    low = ratio < 86
    begins = F.left(x, prefix) != F.left(y, prefix)
    apart = (co & ~known) | (begins & ~contained & low & ~known) | (~contained & low & ~known) | (contained & (longer - shorter > 2) & low & ~known) | (contained & (longer - shorter == 2) & low)
    return F.coalesce(maker, _reason(chemical, "different_brand"), _reason(both & apart, "different_brand"))


def _known_variant(d: str, m: str, a: Column, b: Column, x: Column, y: Column) -> Column:
    """Fixed pairs of brands that are one product."""
    food = (F.col(f"{d}.product_class") == "baby_food") & (F.col(f"{m}.product_class") == "baby_food") & _has(a, "BEBELAC") & _has(b, "BEBELAC")
    every = F.array_union(a, b)
    return (
        F.when(F.array_sort(F.array(x, y)) == _set("EPOETIN", "EPOETINSEDICO"), True)
        .when(food, _has(a, "BEBEJUNIOR") == _has(b, "BEBEJUNIOR"))
        .when(_all(every, "ISIS", "CINNAMON", "GINGER"), _all(a, "ISIS", "CINNAMON") & _all(b, "ISIS", "CINNAMON"))
        .when(_has(a, "CONCOR") & _has(b, "CONCOR"), _has(a, "PLUS") & _has(b, "PLUS"))
        .otherwise(False)
    )


def _optional(modifier: str, a: Column, b: Column) -> Column | None:
    every = F.array_union(a, b)
    rules = {
        "ADVANCE": lambda: _has(a, "MILK") & _has(b, "MILK"),
        "EXTRA": lambda: _has(every, "EMOLLIENT"),
        "NASAL": lambda: _has(a, "SPRAY", "SPRAYS", "DOSES", "DROPS", "DROP", "EYE") & _has(b, "SPRAY", "SPRAYS", "DOSES", "DROPS", "DROP", "EYE"),
        "VAGINAL": lambda: _has(a, "SUPP", "SUPPS", "CAP", "CAPS", "CAPSULE", "CAPSULES") & _has(b, "SUPP", "SUPPS", "CAP", "CAPS", "CAPSULE", "CAPSULES"),
        "R": lambda: _has(every, "PROLONGED"),
        "SR": lambda: _has(every, "RETARD"),
        "MOUTH": lambda: _has(every, "MOUTHWASH") & _has(every, "WASH"),
    }
    return rules[modifier]() if modifier in rules else None


def modifiers_gate(d: str, m: str) -> Column:
    """Import marks, INF against strengths, the other modifiers with their exceptions, insulin kinds, flavours and colours."""
    a, b = _words(d), _words(m)
    of = lambda p, f: F.col(f"{p}.{f}")
    some_dose = (F.size(of(d, "dosage_nums")) > 0) | (F.size(of(m, "dosage_nums")) > 0)
    food = (of(d, "product_class") == "baby_food") | (of(m, "product_class") == "baby_food")
    plain = sorted(set(W.MODIFIERS + W.VITAMINS) - set(W.STRONG_MODIFIERS))
    fl = lambda w: F.transform(w, lambda t: F.when(t == "FL", "LF").otherwise(t))

    def differ(some: list[str], x: Column, y: Column) -> Column:
        only = F.array_union(F.array_except(F.array_intersect(x, _set(*some)), y), F.array_except(F.array_intersect(y, _set(*some)), x))
        excused = [F.when(_optional(k, a, b), F.lit(k)) for k in some if _optional(k, a, b) is not None]
        return F.size(F.array_except(only, F.array_compact(F.array(*excused)))) > 0

    def insulin(p: str, w: Column) -> Column:
        kinds = F.concat(F.array_sort(F.array_intersect(F.array_distinct(w), _set("N", "R"))), F.when(of(p, "normalized").rlike(r"\b70\s*/\s*30\b"), F.array(F.lit("70/30"))).otherwise(F.array().cast("array<string>")))
        return F.when(F.regexp_replace(of(p, "normalized"), " ", "").contains("INSULINAGYPT"), F.array_join(kinds, ",")).otherwise("")

    looks = lambda w: F.array_intersect(w, _set(*sorted(set(W.FLAVORS + W.COLORS))))
    other = (F.size(looks(a)) > 0) & (F.size(looks(b)) > 0) & ~F.arrays_overlap(looks(a), looks(b))
    return F.when(
        reliable(d) & reliable(m),
        F.coalesce(
            _reason(of(d, "imported") != of(m, "imported"), "different_import_status"),
            _reason((_has(a, "INF") != _has(b, "INF")) & some_dose, "different_dosage"),
            _reason(F.when(food, differ(plain + W.BABY_FORMULA_MODIFIERS, fl(a), fl(b))).otherwise(differ(plain, a, b)), "different_modifier"),
            _reason(insulin(d, a) != insulin(m, b), "different_modifier"),
            _reason(other, "different_flavor"),
        ),
    )


def class_gate(d: str, m: str) -> Column:
    x, y = F.col(f"{d}.product_class"), F.col(f"{m}.product_class")
    return _reason((x != y) & (x != "medicine") & (y != "medicine"), "different_product_class")


def dosage_parts(p: str) -> Column:
    return F.filter(F.flatten(F.transform(F.col(f"{p}.dosage_nums"), lambda v: F.split(v, "/"))), lambda v: v != "")


def _flat(p: str) -> Column:
    """Parts of strengths in both spellings."""
    parts = dosage_parts(p)
    return F.array_union(parts, F.transform(parts, canonical_number))


def _milligrams(p: str) -> Column:
    """Strengths in mg, sorted; empty unless every one has a plain number and a unit of weight."""
    scale = lambda u: F.when(u.isin("GM", "G"), 1000.0).when(u == "MG", 1.0).when(u == "MCG", 0.001)
    zipped = F.arrays_zip(F.col(f"{p}.dosage_nums").alias("n"), F.col(f"{p}.dosage_units").alias("u"))
    values = F.transform(zipped, lambda z: F.when(~z["n"].contains("/"), z["n"].try_cast("double") * scale(F.upper(F.replace(z["u"], F.lit(" "), F.lit(""))))))
    whole = (F.size(f"{p}.dosage_nums") == F.size(f"{p}.dosage_units")) & ~F.exists(values, lambda v: v.isNull())
    return F.when(whole, F.array_sort(values)).otherwise(F.array().cast("array<double>"))


def numeric_signals(p: str) -> Column:
    """Numbers of a name that its strengths, pack, volume and weight leave over, as often as they are left."""
    of = lambda f: F.col(f"{p}.{f}")
    numbers = F.transform(F.regexp_extract_all(of("normalized"), F.lit(rf"\b({W.NUMBER})\b"), F.lit(1)), canonical_number)
    used = F.transform(F.concat(dosage_parts(p), F.filter(F.array(of("qty"), of("volume"), of("weight")), lambda v: v != "")), canonical_number)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    left = F.flatten(F.transform(F.array_distinct(numbers), lambda x: F.array_repeat(x, F.greatest(count(numbers, x) - count(used, x), F.lit(0)))))
    return left


def dosage_gate(d: str, m: str) -> Column:
    of = lambda p, f: F.col(f"{p}.{f}")
    x, y = F.col(f"{d}_x.parts"), F.col(f"{m}_x.parts")
    number = lambda v: F.array_sort(F.transform(v, lambda t: t.try_cast("double")))
    sum_of = lambda v: F.aggregate(F.transform(v, lambda t: t.try_cast("double")), F.lit(0.0), lambda s, t: s + t)
    only = lambda v: F.get(v, F.lit(0))
    combined = ((F.size(x) > 1) & (F.size(y) == 1) | (F.size(y) > 1) & (F.size(x) == 1)) & (F.abs(sum_of(x) - sum_of(y)) <= 0.01)
    liquid = of(d, "form").isin(W.LIQUID_DOSE_FORMS) | of(m, "form").isin(W.LIQUID_DOSE_FORMS)

    def per_five(one: Column, two: Column, p: str) -> Column:
        total, volume = only(two).try_cast("double"), F.get(two, F.lit(1))
        fits = (of(p, "volume") == "") | (canonical_number(of(p, "volume")) == canonical_number(volume))
        return (F.size(one) == 1) & (F.size(two) == 2) & fits & (F.abs(F.try_divide(total, volume.try_cast("double")) - only(one).try_cast("double") / 5) <= 0.01)

    primary = ((F.size(x) == 1) & (F.size(y) > 1) | (F.size(y) == 1) & (F.size(x) > 1)) & (only(x) == only(y))
    concor = _all(F.array_union(_words(d), _words(m)), "CONCOR", "PLUS") & (only(x) == only(y))
    mg_d, mg_m = F.col(f"{d}_x.mg"), F.col(f"{m}_x.mg")
    alike = concor | (number(x) == number(y)) | combined | (liquid & (per_five(x, y, m) | per_five(y, x, d) | primary))
    compatible = F.when((F.size(mg_d) > 0) & (F.size(mg_m) > 0), mg_d == mg_m).otherwise(F.coalesce(alike, F.lit(False)))
    both = (F.size(of(d, "dosage_nums")) > 0) & (F.size(of(m, "dosage_nums")) > 0)
    # without strengths on both sides: what numbers are left must be explained by the other's strengths
    sd, sm = F.col(f"{d}_x.signals"), F.col(f"{m}_x.signals")
    within = lambda s, p: F.size(F.array_except(s, F.col(f"{p}_x.flat"))) == 0
    d_asks, m_asks = (F.size(sd) > 0) & (F.size(of(m, "dosage_nums")) > 0), (F.size(sm) > 0) & (F.size(of(d, "dosage_nums")) > 0)
    stages = lambda s: F.array_sort(F.array_intersect(F.array_distinct(s), _set("1", "2", "3", "4", "5")))
    food = (of(d, "product_class") == "baby_food") | (of(m, "product_class") == "baby_food")
    explained = (d_asks & within(sd, m)) | (m_asks & within(sm, d))
    left = F.coalesce(
        _reason(d_asks & ~within(sd, m), "different_dosage"),
        _reason(m_asks & ~within(sm, d), "different_dosage"),
        _reason(food & (stages(sd) != stages(sm)), "different_baby_formula_stage"),
        _reason((F.size(sd) > 0) & (F.size(sm) > 0) & (sd != sm) & ~explained, "different_dosage"),
    )
    return F.when(both, _reason(~compatible, "different_dosage")).otherwise(F.when(reliable(d) & reliable(m), left))


def forms_compatible(x: Column, y: Column) -> Column:
    groups = [W.OCULAR_FORMS, W.LIQUID_FORMS, W.SOLID_FORMS]
    same = (x == "") | (y == "") | (x == y)
    for g in groups:
        same = same | (x.isin(g) & y.isin(g))
    return same


def form_gate(d: str, m: str) -> Column:
    """Form, route, pack, volume, weight, flavour. Two powders of different packs, or two syrups of different volumes, pass at once."""
    of = lambda p, f: F.col(f"{p}.{f}")
    differ = lambda f: (of(d, f) != "") & (of(m, f) != "") & (of(d, f) != of(m, f))
    both_are = lambda form: (of(d, "form") == form) & (of(m, "form") == form)
    r_d, r_m = F.col(f"{d}_x.routes"), F.col(f"{m}_x.routes")
    apart = reliable(d) & reliable(m) & (F.size(r_d) > 0) & (F.size(r_m) > 0) & ~F.arrays_overlap(r_d, r_m)
    dose_as_pack = F.array_contains(F.col(f"{m}_x.flat"), of(d, "qty")) | F.array_contains(F.col(f"{d}_x.flat"), of(m, "qty"))
    return (
        F.when(~forms_compatible(of(d, "form"), of(m, "form")), "different_form")
        .when(apart, "different_route")
        .when(differ("qty") & both_are("POWDER"), None)
        .when(differ("qty") & ~dose_as_pack, "different_quantity")
        .when(differ("volume") & both_are("SYRUP"), None)
        .when(differ("volume"), "different_volume")
        .when(differ("weight"), "different_weight")
        .when(of(d, "flavor") != of(m, "flavor"), "different_flavor")
    )


def components_reason(d: str, m: str, ratio: Column, maker_ratio: Column) -> Column:
    """The first reason why two parsed names are different products; `ok` if there is none."""
    gates = [marks_gate(d, m), brand_gate(d, m, ratio, maker_ratio), modifiers_gate(d, m), class_gate(d, m), dosage_gate(d, m), form_gate(d, m)]
    return F.coalesce(*gates, F.lit("ok"))


def variant_rejection(query_tokens: Column, candidate_tokens: Column, alike: Column, synthetic: Column, arabic: Column) -> Column:
    """Reasons joined by `; `: no identity word of the query in the candidate, or no Arabic mark of what is asked for.

    alike: whether two words of the texts are alike enough; arabic: the Arabic name, its marks as spaces.
    """
    own = identity_tokens(query_tokens)
    missing = (F.size(own) > 0) & ~F.arrays_overlap(own, candidate_tokens) & ~F.coalesce(alike, F.lit(False))
    marks = [
        F.when((arabic != "") & F.array_contains(query_tokens, token) & ~_any_of(arabic, aliases), f"Arabic name missing marker for {token}")
        for token, aliases in W.ARABIC_MARKS.items()
    ]
    calcium = _all(query_tokens, "VITACID", "C") & arabic.contains(W.ARABIC_CALCIUM)
    return F.concat_ws(
        "; ",
        F.when(missing & F.coalesce(synthetic, F.lit(False)), "Synthetic English name missing requested identity token"),
        F.when(missing, "English name missing requested identity token"),
        *marks,
        F.when(calcium, "Arabic name contains calcium for VITACID C query"),
    )


def _any_of(text: Column, some: list[str]) -> Column:
    out = F.lit(False)
    for s in some:
        out = out | text.contains(s)
    return out


def extra_numbers(query: Column, candidate: Column) -> Column:
    """Numbers of the candidate's normalised name that the query's doesn't have, sorted."""
    return F.array_sort(F.array_except(numeric_tokens(candidate), numeric_tokens(query)))


def safe_omission(extra: Column, d: str, m: str) -> Column:
    """Whether the request may leave those numbers out: strength of topicals, pack sizes, volumes of injections, and the like."""
    of = lambda p, f: F.col(f"{p}.{f}")
    known = lambda p, f: of(p, f) != ""
    dosed = lambda p: F.size(of(p, "dosage_nums")) > 0
    every = F.array_union(_words(d), _words(m))
    either = lambda *forms: of(d, "form").isin(*forms) | of(m, "form").isin(*forms)
    both_in = lambda *forms: of(d, "form").isin(*forms) & of(m, "form").isin(*forms)
    within = lambda some: F.size(F.array_except(extra, some)) == 0
    named = F.exists(of(m, "dosage_nums"), lambda n: of(d, "normalized").contains(n))
    shared = F.when(dosed(d) & dosed(m), F.arrays_overlap(of(d, "dosage_nums"), of(m, "dosage_nums"))).otherwise(dosed(m) & named)
    volumes = F.regexp_extract_all(of(m, "normalized"), F.lit(rf"{W.NUMBER}\s*(?:MG|MCG|IU)\s*/\s*({W.NUMBER})\s*ML"), F.lit(1))
    volumes = F.concat(volumes, F.filter(F.array(of(m, "volume")), lambda v: v != ""))
    cosmetic = (of(d, "product_class") == "cosmetic") & (of(m, "product_class") == "cosmetic")
    rules = [
        _all(every, "CONCOR", "PLUS") & dosed(d) & dosed(m),
        ~dosed(d) & dosed(m) & ~(known(d, "volume") & known(m, "volume") & (of(d, "volume") != of(m, "volume"))) & (cosmetic | either("CREAM", "GEL", "LOTION", "OINT", "SOLUTION", "SPRAY")),
        dosed(d) & known(m, "qty") & ~known(d, "qty") & F.array_contains(extra, of(m, "qty")) & of(m, "form").isin("TAB", "CAP") & both_in("", "TAB", "CAP"),
        dosed(d) & dosed(m) & known(m, "volume") & F.array_contains(extra, of(m, "volume")) & ~known(d, "volume") & both_in("AMP", "VIAL"),
        ~dosed(d) & dosed(m) & _all(every, "VITACID", "C") & _has(every, "EFF", "EFFERVESCENT") & ~(known(d, "qty") & known(m, "qty") & (of(d, "qty") != of(m, "qty"))) & both_in("", "TAB"),
        shared & (F.size(volumes) > 0) & within(volumes),
        shared & known(m, "qty") & within(F.array(of(m, "qty"))),
        either("PEN", "CARTRIDGE") & ~(dosed(d) & dosed(m) & (F.array_sort(of(d, "dosage_nums")) != F.array_sort(of(m, "dosage_nums")))),
        (of(d, "product_class") == "baby_food") & F.when(known(m, "qty"), F.array_contains(extra, of(m, "qty"))).otherwise(F.arrays_overlap(numeric_tokens(of(m, "normalized")), extra)),
        dosed(m) & either("CREAM", "GEL", "LOTION", "SOLUTION", "SPRAY", "DROPS", "OINTMENT", "EYE") & F.array_contains(of(m, "dosage_units"), "%"),
    ]
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(r, F.lit(False))
    return out


def acceptance(rejection: Column, extra: Column, omitted: Column, orderable: Column, score: Column) -> Column:
    """(accepted, reason): after the rejections, numbers that were not asked for, then whether the candidate can be ordered."""
    numbers = F.concat(F.lit("unrequested numeric token: "), F.array_join(extra, ", "))
    no_id = F.lit("Candidate missing orderable storeProductId")
    ok = F.when(F.size(extra) == 0, F.lit("No extra numeric tokens")).otherwise("Extra numeric tokens represent safe omission")
    passed = (F.size(extra) == 0) | omitted
    reason = (
        F.when(rejection != "", rejection)
        .when(passed & ~orderable, no_id)
        .when(~passed & ~orderable & (score >= 9), no_id)
        .when(~passed, numbers)
        .otherwise(ok)
    )
    return F.struct(((rejection == "") & passed & orderable).alias("accepted"), reason.alias("reason"))


def orderable_id(*ids: Column) -> Column:
    """The first id that is neither blank nor a word for nothing; null without any."""
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "none", "nan", "null"), F.trim(c))
    return F.coalesce(*(clean(c.cast("string")) for c in ids))


def not_arabic(c: Column) -> Column:
    return ~c.rlike(f"[{ARABIC_RANGE}]")
