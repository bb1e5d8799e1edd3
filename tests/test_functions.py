import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions import similarity as S
from weftline.functions import verdict as V
from weftline.functions.parse import category_queries, parse_names

CASES = [
    (N.normalize_text, "Panadol 6O ml", "PANADOL 60 ML"),
    (N.normalize_text, "vit 200.000iu/5ML", "VIT 200000 IU 5 ML"),
    (N.normalize_text, None, ""),
    (N.normalize_name, "* imp Augmentin-1GM (14)TAB", "AUGMENTIN 1 GM 14 TAB"),
    (N.normalize_name, "CONCOR 5MG20 TABS", "CONCOR 5 MG 20 TABS"),
    (N.normalize_name, "X .5 MG FORET SYP", "X 0.5 MG FORTE SYRUP"),
    (N.normalize_name, "Y 200.000 I.U X R", "Y 200000 I U XR"),
    (N.normalize_arabic, "أَدوية  الشُّربة!", "ادويه الشربه"),
    (N.arabic_terms, "٥٠ مجم", "50  MG "),
    (N.normalize_code, " 123.0 ", "123"),
    (N.normalize_code, "NaN", ""),
    (N.normalize_item_name, "  A   b ", "a b"),
    (N.normalize_prevented_name, "Drug, 10.000. (x) ;; 0.3%.", "drug 10.000. (x) 0.3%."),
    (N.reason_code, "Semantic token conflict: a vs b", "semantic_token_conflict"),
    (N.file_label, "a/b c-d_1", "abc-d_1"),
    (N.dom_id, "a/b c", "a-b-c"),
    (N.header_name, "  Item   Code", "item code"),
    (N.store_name, "مخزن A (١)", "مخزن (١)"),
    (N.arabic_display, "كلمة-أخرى", "كلمة أخرى"),
]


def test_scalar_cases(spark):
    for f, raw, want in CASES:
        d = spark.createDataFrame([(raw,)], "x string").select(f(F.col("x")).alias("y"))
        assert d.first().y == want, (f.__name__, raw)


def test_search_queries(spark):
    d = spark.createDataFrame([("One two three four Five",)], "x string")
    got = d.select(N.search_queries(F.col("x")).alias("q")).first().q
    assert got[:5] == ["One two three four Five", "One two three four", "One two three", "One two", "One"]
    assert got[5:] == ["ONE TWO THREE", "ONE THREE FOUR", "ONE FOUR FIVE"][1:] and len(got) <= 24


PARSED = [
    ("PANADOL EXTRA 500 MG 24 TABS", dict(brand="PANADOL", dosage_nums=["500"], dosage_units=["MG"], qty="24", form="TAB", product_class="medicine")),
    ("AUGMENTIN 457 MG / 5 ML SUSP 70 ML", dict(brand="AUGMENTIN", dosage_nums=["457"], dosage_units=["MG/ML"], volume="70", form="SUSP")),
    ("CO 5/12.5MG/5ML SYRUP", dict(dosage_nums=["5/12.5"], dosage_units=["MG/ML"])),
    ("IMP BETADINE 10 % SOLUTION 120ML", dict(imported=True, dosage_nums=["10"], dosage_units=["%"], volume="120", form="SOLUTION")),
    ("CONCOR 5 30 TAB", dict(brand="CONCOR", dosage_nums=["5"], dosage_units=["MG"], qty="30")),
    ("CEFOTAX 1 GM VIAL", dict(brand="CEFOTAX", weight="1", form="VIAL", dosage_nums=["1"], dosage_units=["GM"])),
    ("METHYL FOLATE 30 CAP ORCHIDIA", dict(brand="METHYLFOLATE", manufacturer="ORCHIDIA", qty="30", form="CAP")),
    ("METHYL FOLATE (ORA) 30 CAPS", dict(manufacturer="ORA", brand_variants=["METHYLFOLATE", "METHYL"])),
    ("NAN MILK 1 400 GM", dict(product_class="baby_food", weight="400")),
    ("SYRINGE 3 ML", dict(product_class="device")),
    ("باندول ٥٠٠ مجم قرص", dict(dosage_nums=["500"], form="TAB")),
    (None, dict(brand="", dosage_nums=[], qty="", form="", normalized="", product_class="medicine", manufacturer=None, imported=False)),
]


def test_parse(spark):
    d = parse_names(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(PARSED)], "i int, name string"), "name", "p")
    got = {r.i: r.p for r in d.collect()}
    for i, (name, want) in enumerate(PARSED):
        for k, v in want.items():
            assert got[i][k] == v, (name, k, got[i][k], v)


def test_category_queries(spark):
    d = parse_names(spark.createDataFrame([("AUGMENTIN 5 MG SYRUP 70 ML",), ("CEFOTAX 500 MG VIAL",), ("ASPIRIN 5 MG TAB",)], "name string"), "name", "p")
    assert [r[0] for r in d.select(category_queries("p")).collect()] == [["AUGMENTIN 70", "AUGMENTIN 5MG"], ["CEFOTAX 500MG VIAL", "CEFOTAX 500MG"], []]


words = st.text("ABC ", max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_similarity_properties(a, b):
    assert S.common_subsequence(a, b) == lcs(a, b)
    for f in (S.ratio, S.token_sort_ratio, S.token_set_ratio, S.partial_token_sort_ratio):
        assert 0 <= f(a, b) <= 100 and abs(f(a, b) - f(b, a)) < 1e-9
    assert S.ratio(a, a) == 100 and S.token_sort_ratio(a, a) == 100
    assert S.token_set_ratio(a, b) >= (100 if set(a.split()) & set(b.split()) and set(a.split()) <= set(b.split()) else 0)


def test_similarity_columns(spark):
    d = spark.createDataFrame([("AB CD", "CD AB"), ("COAVAZIR", "AVAZIR"), (None, "x")], "a string, b string")
    got = [tuple(round(x, 3) for x in r.s) for r in d.select(S.similarities(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0][1] == 100 and got[0][2] == 100
    assert got[1][0] == 85.714 and got[1][4] == round(difflib.SequenceMatcher(None, "COAVAZIR", "AVAZIR").ratio(), 3)
    assert got[2][0] == 0
    assert [r[0] for r in d.select(S.may_reach(86, F.col("a"), F.col("b"))).collect()[:2]] == [True, False]


@pytest.mark.parametrize(
    "answer,want",
    [
        ('{"is_correct": true, "confidence": 0.9, "reason": "r"}', (True, None, 0.9)),
        ('text ```json\n{"is_correct": false, "confidence": 1}\n``` more', (False, None, 1.0)),
        ('so {"is_correct": true, "confidence": 0.7,} yes', (True, None, 0.7)),
        ('{"decision": "match", "best_index": 3', (None, "match", 0.5)),
        ('{"is_correct": true, "reason": "it was cut', (True, None, None)),
        ('{"is_correct": TRUE, "x": [1, {', (True, None, 0.5)),
        ("no json", None),
        (None, None),
    ],
)
def test_repair_json(spark, answer, want):
    v = spark.createDataFrame([(answer,)], "a string").select(V.repair_json(F.col("a")).alias("v")).first().v
    assert (v and (v.is_correct, v.decision, v.confidence)) == want


def test_verdicts(spark):
    d = spark.createDataFrame([(True, "accept", 0.99, "ok", ["Different Dosage"]), (True, "accept", 0.99, "", ["different_form"]), (True, " Reject", 0.99, "", None), (None, "", None, None, None)], "c boolean, d string, s double, r string, h array<string>")
    got = [tuple(r.v) for r in d.select(V.resolve_conflicts(*map(F.col, "cdsrh")).alias("v")).collect()]
    assert got == [(False, 0.55, "hard_conflict_override(different_dosage); ok"), (True, 0.72, ""), (False, 0.6, "decision_reject_override"), (False, 0.0, "")]
    x = spark.createDataFrame([("different brand, identical",), ("identical",), ("",)], "t string")
    assert [r[0] for r in x.select(V.infer_correct(F.col("t"))).collect()] == [False, True, False]
    c = spark.createDataFrame([("2", ["a", "b"]), ("9", ["a"]), ("x", ["a"])], "i string, c array<string>").select(V.chosen_candidate(F.col("i"), F.col("c"), F.lit(0.9)).alias("v"))
    assert [tuple(r.v) for r in c.collect()] == [("b", 0.9), (None, 0.5), (None, 0.5)]
    y = spark.createDataFrame([('{"a": 1}',), ("{bad",), ('{"a": 1, "b": 2}',)], "t string").select(V.required_fields(F.col("t"), ["a", "b"]))
    assert [r[0] for r in y.collect()] == ["missing_fields:b", "invalid_json", "ok"]
    z = spark.createDataFrame([(3725,), (184,), (0,), (90000,)], "s int").select(V.duration_text(F.col("s")))
    assert [r[0] for r in z.collect()] == ["1h 2m 5s", "3m 4s", "0s", "1d 1h"]
    w = spark.createDataFrame([("90",), ("1700000060",), ("2023-11-14T22:14:20Z",), ("soon",), (None,)], "s string").select(V.reset_text(F.col("s"), F.lit(1_700_000_000)))
    assert [r[0] for r in w.collect()] == ["1m 30s", "1m", "1m", "soon", ""]
    m = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}',), ('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}]}',)], "t string")
    assert [r[0] for r in m.select(V.response_content(F.col("t"))).collect()] == ["hi", "ab"]


def test_ai_outcomes(spark):
    kind = "struct<is_correct: boolean, confidence: double, decision: string, hard_conflicts: array<string>>"
    yes, soft, no = (True, 0.95, "accept", []), (True, 0.85, "accept", []), (False, 0.95, "reject", [])
    rows = [
        (yes, None, None, "", "ai_verified"),
        (soft, None, yes, "", "ai_verified"),
        ((True, 0.85, "accept", ["different_form"]), None, None, "", "ai_rejected"),
        (yes, None, no, "", "ai_review_rejected"),
        (no, yes, yes, "", "ai_search_accepted"),
        (no, soft, no, "", "ai_review_rejected"),
        (no, (True, 0.5, "accept", []), None, "", "ai_low_confidence"),
        (None, yes, yes, "component mismatch", "ai_rejected"),
        (None, None, None, "", "ai_rejected"),
    ]
    d = spark.createDataFrame(rows, f"v {kind}, s {kind}, r {kind}, l string, want string")
    for r in d.select("want", V.ai_outcome("v", "s", "r", F.col("l")).alias("got")).collect():
        assert r.got == r.want
    cases = [("ai_confirmed", "ok", True, True, 0.9, "ai_confirmed"), ("ai_confirmed", "ok", True, True, 0.5, "ai_review_rejected"), ("ai_found", "different_form", False, True, 0.9, "ai_review_rejected"), ("ai_found", "ok", False, True, 0.1, "ai_found_reviewed"), ("ai_rejected", "ok", False, False, 0.9, "ai_rejected_reviewed"), ("ai_found", "ok", False, False, 0.7, "ai_found_kept_low_confidence_review"), ("ai_found", "ok", False, False, 0.8, "ai_review_rejected"), ("ai_rejected", "ok", False, True, 0.8, "ai_review_search")]
    d = spark.createDataFrame(cases, "f string, c string, a boolean, r boolean, s double, want string")
    for r in d.select("want", V.review_state(*map(F.col, "fcars")).alias("got")).collect():
        assert r.got == r.want
    f = spark.createDataFrame([(False, "", False, 1, 1.0), (True, "http_500", False, 1, 1.0), (True, "", True, 1, 1.0), (True, "", False, 0, 1.0), (True, "", False, 1, 0.1), (True, "", False, 1, 0.95)], "f boolean, e string, p boolean, b int, c double")
    assert [r[0] for r in f.select(V.search_failure(*map(F.col, "fepbc"))).collect()] == ["no_ai_result", "http_500", "invalid_json", "best_index_0", "confidence_below_threshold", "no_record"]


def test_fallback_names(spark):
    d = spark.createDataFrame([("ABC 5OO mg", "دواء 500"), ("ABC 10MG", "دواء 20 x 30"), ("ABC", "دواء")], "q string, a string")
    assert [r[0] for r in d.select(N.plausible_row(F.col("a"), F.col("q"))).collect()] == [False, False, True]
    assert [r[0] for r in d.select(N.synthetic_name(F.col("q"), F.col("a"))).collect()][1:] == ["ABC MG 20 30", "ABC"]
    assert d.select(N.major_name_change(F.lit("A B C"), F.lit("A X Y")), N.major_name_change(F.lit("A B"), F.lit("A B C"))).first()[:] == (True, False)
    assert d.select(N.candidate_source(F.lit("dom-row-1"), F.lit(False)), N.candidate_source(F.lit("5"), F.lit(None).cast("boolean"))).first()[:] == ("dom_fallback", "site_api")


def test_prompt_text(spark):
    d = parse_names(spark.createDataFrame([("* IMP CEFOTAX 500 MG I M VIAL",)], "name string"), "name", "p")
    line = d.select(V.component_context("p").alias("x")).first().x
    assert line == "normalized='CEFOTAX 500 MG I M VIAL', brand='CEFOTAX', dosage=500, qty='-', volume='-', weight='-', form='VIAL', flavor='-', class='medicine', route='IM', imported=yes"
    q = spark.createDataFrame([("FreeUsageLimitError: x", "", "", "", "", "60", "1m"), ("other", "", "", "", "", "60", "1m")], "error_body string, quota_reset_day string, quota_reset_day_in string, quota_reset_in string, quota_remaining_day string, retry_after string, retry_after_in string")
    got = [r[1:5] for r in V.quota_hints(q).collect()]
    assert got == [("60", "1m", "1m", "0"), ("", "", "", "")]


def test_words_that_are_alike(spark):
    """Against a loop over every pair of words: beginnings, and 85 % by longest blocks."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(9)
    word = lambda: "".join(r.choice("ABC") for _ in range(r.randrange(1, 9)))
    rows = [(i, [word() for _ in range(r.randrange(0, 4))], [word() for _ in range(r.randrange(0, 4))]) for i in range(300)] + [(300, None, ["AAAA"]), (301, ["AAAAAAAB"], ["AAAAAAAC"])]
    d = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    got = {x.id: x.v for x in d.select("id", S.any_alike(F.col("a"), F.col("b")).alias("v")).collect()}
    for i, a, b in rows:
        pairs = [(p, q) for p in a or [] for q in b if len(p) >= 4 and len(q) >= 4]
        assert got[i] == any(p.startswith(q) or q.startswith(p) or SequenceMatcher(None, p, q).ratio() >= 0.85 for p, q in pairs)
    assert 0 < sum(got.values()) < 300
