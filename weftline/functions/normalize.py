"""Text normalisers. Each has its own rules; none is another's special case, so they are kept apart.

All are Column expressions of built-in functions. Null reads as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import words as W

ARABIC_RANGE = _ARABIC = "؀-ۿ"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", "")


def normalize_text(c: Column) -> Column:
    """Upper-case letters and digits, parted where they meet; a thousands dot and a zero read as O are mended."""
    x = F.upper(F.regexp_replace(text(c), r"(?<=\d)[Oo](?=\b|[^A-Za-z0-9])", "0"))
    return squeeze(_rewrite(x, [(r"(\d)\.(\d{3})(?=\D|$)", "$1$2"), (r"(?<=\d)(?=[A-Z])|(?<=[A-Z])(?=\d)", " "), (r"[^A-Z0-9]+", " ")]))


def tokens(normalized: Column) -> Column:
    """Words of a text with single spaces; none gives an empty array."""
    return F.array_remove(F.split(normalized, " "), "")


# Fixed values.
#: What happens to an English name, in order, after it is upper-cased.
NAME_RULES: list[tuple[str, str]] = [
    (r"^[+*.]+\s*(?:IMP|IMPORTED)?\s*", ""),
    ("_", " "),
    (r"\\", " / "),
    (r"-+", " "),
    (r"[()]", " "),
    (r"(?<=\d)O(?=\d)", "0"),
    (r"\bFORET\b", "FORTE"),
    (r"\b(?:SYRP|SYP)\b", "SYRUP"),
    (r"\bVAG\b", "VAGINAL"),
    (r"\*", " / "),
    (r"(?<=\d)O(?=\s*ML\b)", "0"),
    (r"(?<=%)([A-Z])", " $1"),
    (r"([A-Z])(?=\d)", "$1 "),
    (r"(?<=\d)([A-Z])", " $1"),
    (r"\b(\d+)\s*M\b(?!\s*\.)", "$1 MG"),
    (r"\b(\d+)\s*M\s*/", "$1 MG /"),
    (r"\bANDOFLOZIN XR 25 MG\s*/\s*100 MG\b", "ANDOFLOZIN XR 25 / 1000 MG"),
    (r"\b([BD])\s+(3|6|12)\b", "$1$2"),
    (r"\s*[\\/]\s*", " / "),
    (r"(\d)\.(\d{3})\s*(I\.?U\.?|IU|MCG|MG)", "$1$2 $3"),
    (r"(?<!\d)\.(\d+)", "0.$1"),
    (r"\.(?!\d)", " "),
    (r"(?<!\d)\.", " "),
    (r"\b([DESCMX])\s+R\b", "$1R"),
    (r"\bUNITS?\b", "IU"),
]


def normalize_name(c: Column) -> Column:
    """A product name before it is parsed: noise and marks away, units, strengths and numbers in one spelling."""
    return squeeze(_rewrite(F.upper(F.trim(text(c))), NAME_RULES))


def normalize_arabic(c: Column) -> Column:
    """Without vowel marks; one letter for each family of alef, waw, ya and ta; other marks become spaces."""
    x = F.regexp_replace(F.trim(text(c)), "[ً-ٰٟ]", "")
    x = F.translate(x, "إأآٱىؤئة", "اااايويه")
    return squeeze(F.regexp_replace(x, rf"(?U)[^\w\s{_ARABIC}]", " "))


def arabic_terms(c: Column) -> Column:
    """Arabic digits, units and forms by their English names."""
    x = F.translate(text(c), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    return _rewrite(x, [(rf"(?U)\b(?:{arabic})\b", f" {english} ") for english, arabic in W.ARABIC_TERMS.items()])


def canonical_tokens(c: Column) -> Column:
    """The distinct words of a name, each by its canonical spelling."""
    x = _rewrite(F.upper(text(c)), [(r"(?<=\d)(?=[A-Z])|(?<=[A-Z])(?=\d)", " "), (r"[^A-Z0-9]+", " ")])
    names = F.create_map(*(F.lit(v) for kv in W.TOKEN_NAMES.items() for v in kv))
    return F.array_distinct(F.transform(tokens(x), lambda t: F.coalesce(F.try_element_at(names, t), t)))


def normalize_code(c: Column) -> Column:
    x = F.lower(F.trim(text(c)))
    return F.when(x.isin("nan", "none"), "").otherwise(F.regexp_replace(x, r"\.0$", ""))


def normalize_item_name(c: Column) -> Column:
    return squeeze(F.lower(text(c)))


def display_code(c: Column) -> Column:
    return F.regexp_replace(F.trim(text(c)), r"\.0$", "")


def _clean_token(t: Column) -> Column:
    """Without marks at its edges; the dot after a number stays."""
    t = F.regexp_replace(t, r"^[.,;:!?،؛]+", "")
    bare = F.regexp_replace(t, r"[.,;:!?،؛]+$", "")
    dotted = F.regexp_extract(t, r"(?U)^([\d.%]*\d[\d.%]*\.)[.,;:!?،؛]*$", 1)
    return F.when(dotted != "", dotted).otherwise(bare)


def normalize_prevented_name(c: Column) -> Column:
    cleaned = F.transform(tokens(squeeze(F.lower(text(c)))), _clean_token)
    return F.array_join(F.array_remove(cleaned, ""), " ")


def hint_key(code: Column, name: Column) -> Column:
    """The key of saved decisions."""
    blank = lambda x: F.when(F.lower(x).isin("nan", "none", "null"), "").otherwise(x)
    k = F.upper(F.regexp_replace(blank(squeeze(text(code))), r"\.0$", ""))
    n = F.upper(blank(squeeze(F.regexp_replace(F.lower(text(name)), rf"[^a-z0-9{_ARABIC}]+", " "))))
    return F.struct(k.alias("code_key"), n.alias("name_key"))


def arabic_display(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(text(c)), rf"(?U)[^\w{_ARABIC}]+", " "))


def store_name(c: Column) -> Column:
    """Arabic letters, spaces and brackets alone."""
    return squeeze(F.regexp_replace(text(c), rf"[^{_ARABIC}\s()]", ""))


def header_name(c: Column) -> Column:
    return F.lower(squeeze(text(c)))


def reason_code(c: Column) -> Column:
    """What stands before a colon, its words joined by underscores."""
    x = F.regexp_replace(F.lower(F.split_part(text(c), F.lit(":"), F.lit(1))), r"[^\p{L}\p{N}]+", "_")
    return F.regexp_replace(x, r"^_+|_+$", "")


def file_label(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)[^\w-]", "")


def dom_id(c: Column) -> Column:
    return F.left(F.regexp_replace(text(c), r"[^A-Za-z0-9]+", "-"), F.lit(48))


def numeric_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(\d+)")))


def blank_to_null(c: Column) -> Column:
    x = F.trim(c.cast("string"))
    return F.when(~F.lower(x).isin("", "nan", "none", "null"), x)


def identity_tokens(normalized_tokens: Column) -> Column:
    """Words that name a product: longer than one letter, no number, no form or unit."""
    return F.filter(F.array_distinct(normalized_tokens), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$") & ~t.isin(W.GENERIC_TOKENS))


def name_manufacturer(c: Column) -> Column:
    """The last word of a name that is neither a number nor generic."""
    named = F.filter(tokens(normalize_text(c)), lambda t: ~t.rlike(r"^\d+$") & ~t.isin(W.GENERIC_TOKENS))
    return F.try_element_at(named, F.lit(-1))


def candidate_manufacturer(name: Column, company: Column, supplier: Column) -> Column:
    """The company's first word, or the supplier's, or what the name says."""
    first = lambda c: F.get(tokens(normalize_text(c)), F.lit(0))
    return F.when(text(company) != "", first(company)).when(text(supplier) != "", first(supplier)).otherwise(name_manufacturer(name))


def search_queries(name: Column, category: Column | None = None, most: int = 24) -> Column:
    """Queries for an item, best first: those of its category, its name, ever shorter beginnings, its first word with each pair of neighbours."""
    none = F.array().cast("array<string>")

    def of_words(name: Column, normal: Column, raw: Column, norm: Column) -> Column:
        lead = [F.array_join(F.slice(t, 1, n), " ") for n in (4, 3, 2, 1) for t in (raw, norm)]
        base = F.when(F.size(norm) > 0, norm).otherwise(raw)
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(base) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(base, F.lit(0)), F.array_join(F.slice(base, i + 1, 2), " ")))
        pairs = F.when(F.size(base) > 2, windows).otherwise(none)
        return F.slice(distinct_ignoring_case(F.concat(none if category is None else category, F.array(name, normal, *lead), pairs)), 1, most)

    both = lambda name, normal: F.struct(name.alias("name"), normal.alias("normal"), tokens(squeeze(name)).alias("raw"), tokens(normal).alias("norm"))
    parts = let(F.trim(text(name)), lambda n: let(normalize_text(n), lambda x: both(n, x)))
    return let(parts, lambda p: of_words(p["name"], p["normal"], p["raw"], p["norm"]))


def distinct_ignoring_case(values: Column) -> Column:
    """Non-blank values in order, each the first of its spellings. One pass, which carries what it has seen."""
    none = F.array().cast("array<string>")

    def add(seen: Column, value: Column) -> Column:
        new = lambda v: (v != "") & ~F.array_contains(seen["low"], F.lower(v))
        more = lambda v: F.struct(F.concat(seen["out"], F.array(v)).alias("out"), F.concat(seen["low"], F.array(F.lower(v))).alias("low"))
        return let(F.trim(text(value)), lambda v: F.when(new(v), more(v)).otherwise(seen))

    return F.aggregate(values, F.struct(none.alias("out"), none.alias("low")), add, lambda x: x["out"])


def routes(words: Column) -> Column:
    """IM, IV and SC among the words, also where their letters stand apart."""
    some = lambda *w: F.array(*map(F.lit, w))
    spelled = [F.when(F.size(F.array_intersect(words, some(a, b))) == 2, a + b) for a, b in ("IM", "IV", "SC")]
    return F.array_union(F.array_intersect(words, some(*W.ROUTES)), F.array_compact(F.array(*spelled)))


def fallback_query(c: Column) -> Column:
    """A query with zeros read as O mended, letters and digits apart."""
    return squeeze(_rewrite(F.trim(text(c)), [(r"(?<=\d)[Oo](?=\b|[^A-Za-z0-9])", "0"), (r"([A-Za-z])(?=\d)", "$1 "), (r"(?<=\d)([A-Za-z])", " $1")]))


def plausible_row(arabic_name: Column, query: Column) -> Column:
    """Whether a page's row shares a number with the query, if that has any."""
    q = numeric_tokens(fallback_query(query))
    return (F.size(q) == 0) | F.arrays_overlap(q, numeric_tokens(arabic_name))


def synthetic_name(query: Column, arabic_name: Column) -> Column:
    """An English name for a page's row: the query where the row has its numbers, else its words with the row's numbers."""
    q = fallback_query(query)
    asked, there = numeric_tokens(q), F.regexp_extract_all(text(arabic_name), F.lit(r"(\d+)"))
    made = F.array_join(F.concat(F.filter(tokens(q), lambda t: ~t.rlike(r"\d")), there), " ")
    whole = (F.size(asked) > 0) & (F.size(F.array_except(asked, there)) == 0)
    return F.when(whole | (made == ""), q).otherwise(made)


def candidate_source(store_product_id: Column, synthetic: Column) -> Column:
    return F.when(text(store_product_id).startswith("dom-row-") | F.coalesce(synthetic, F.lit(False)), "dom_fallback").otherwise("site_api")


def major_name_change(saved: Column, current: Column) -> Column:
    """Whether two names share less than half of the longer one's words."""
    a, b = (F.array_distinct(tokens(normalize_text(c))) for c in (saved, current))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return (F.size(a) > 0) & (F.size(b) > 0) & (share < 0.5)
