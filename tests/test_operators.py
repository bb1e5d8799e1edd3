import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.parse import parse_names
from weftline.functions.similarity import similarity
from weftline.operators import allocate as A
from weftline.operators import blocking as B
from weftline.operators import decide as D
from weftline.operators import exclusions as X
from weftline.operators import gates as G
from weftline.operators import providers as P
from weftline.operators import reports as R
from weftline.operators import review as V
from weftline.operators import running
from weftline.operators import scoring as SC
from weftline.operators import upsert as U
from weftline.shared import Scratch

GATES = [
    ("PANADOL 500 MG 24 TAB", "PANADOL 500 MG 24 TABLETS", "ok"),
    ("PANADOL 500 MG 24 TAB", "PANADOL EXTRA 500 MG 24 TAB", "different_modifier"),
    ("BRUFEN KIDS 100 ML SYRUP", "BRUFEN 100 ML SYRUP", "different_age_group"),
    ("VITACID MINT 20 TAB", "VITACID 20 TAB", "different_flavor"),
    ("COAVAZIR 5 MG 30 TAB", "AVAZIR 5 MG 30 TAB", "different_brand"),
    ("ASPIRIN 100 MG 30 TAB", "CONCOR 100 MG 30 TAB", "different_brand"),
    ("CAL MAG CALCIUM 30 TAB", "CAL MAG ZINC 30 TAB", "different_brand"),
    ("* IMP LIPITOR 10 MG 30 TAB", "LIPITOR 10 MG 30 TAB", "different_import_status"),
    ("LIPITOR XR 10 MG 30 TAB", "LIPITOR 10 MG 30 TAB", "different_modifier"),
    ("LIPITOR 10 MG 30 TAB", "LIPITOR 20 MG 30 TAB", "different_dosage"),
    ("LIPITOR 0.01 GM VIAL", "LIPITOR 10 MG VIAL", "ok"),
    ("AUGMENTIN 1 GM VIAL", "AUGMENTIN 1000 MG VIAL", "ok"),
    ("LIPITOR 10 MG 30 TAB", "LIPITOR 10 MG 30 CREAM", "different_form"),
    ("CEFO 500 MG IM VIAL", "CEFO 500 MG IV VIAL", "different_route"),
    ("LIPITOR 10 MG 30 TAB", "LIPITOR 10 MG 20 TAB", "different_quantity"),
    ("BRUFEN 5 MG CREAM 50 ML", "BRUFEN 5 MG CREAM 20 ML", "different_volume"),
    ("BRUFEN SYRUP 100 ML", "BRUFEN SYRUP 120 ML", "ok"),
    ("BRUFEN CREAM 50 GM", "BRUFEN CREAM 20 GM", "different_weight"),
    ("METHYL FOLATE 30 CAP ORCHIDIA", "METHYL FOLATE 30 CAP PHARCO", "different_manufacturer: ORCHIDIA vs PHARCO"),
]


def test_component_gates(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(GATES)], "i int, a string, b string")
    d = G.with_facts(G.with_facts(parse_names(parse_names(d, "a", "d"), "b", "m"), "d"), "m")
    ratio = F.when(G.needs_brand_ratio("d", "m"), similarity("ratio", G.bare_brand("d"), G.bare_brand("m"))).otherwise(100.0)
    d = d.withColumns({"ratio": ratio, "maker": similarity("sequence", F.col("d.manufacturer"), F.col("m.manufacturer"))})
    got = {r.i: r.reason for r in d.select("i", G.components_reason("d", "m", F.col("ratio"), F.col("maker")).alias("reason")).collect()}
    assert [(a, b, got[i]) for i, (a, b, _) in enumerate(GATES)] == [x for x in GATES]


def test_acceptance(spark):
    rows = [("", [], True, True, 5.0), ("bad", [], True, True, 5.0), ("", ["20"], False, True, 5.0), ("", ["20"], False, False, 9.0), ("", ["20"], True, True, 1.0), ("", [], True, False, 1.0)]
    d = spark.createDataFrame(rows, "r string, x array<string>, o boolean, i boolean, s double")
    got = [tuple(r.v) for r in d.select(G.acceptance(*map(F.col, "rxois")).alias("v")).collect()]
    assert got == [
        (True, "No extra numeric tokens"),
        (False, "bad"),
        (False, "unrequested numeric token: 20"),
        (False, "Candidate missing orderable storeProductId"),
        (True, "Extra numeric tokens represent safe omission"),
        (False, "Candidate missing orderable storeProductId"),
    ]


def test_safe_omission(spark):
    rows = [("BRUFEN CREAM", "BRUFEN 5 % CREAM", ["5"], True), ("LIPITOR 10 MG TAB", "LIPITOR 10 MG 30 TAB", ["30"], True), ("LIPITOR TAB", "LIPITOR 10 MG 30 TAB", ["10", "30"], False), ("CEFO 500 MG VIAL", "CEFO 500 MG 5 ML VIAL", ["5"], True)]
    d = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, a string, b string, x array<string>")
    d = G.with_facts(G.with_facts(parse_names(parse_names(d, "a", "d"), "b", "m"), "d"), "m")
    assert [r.s for r in d.select("i", G.safe_omission(F.col("x"), "d", "m").alias("s")).orderBy("i").collect()] == [r[3] for r in rows]


def test_lexical(spark):
    d = spark.createDataFrame([(["MINT", "PLUS"], ["CINNAMON", "EXTRA"]), (["A"], ["A", "BRAND"]), (["A", "PLUS"], ["A", "PLUS"])], "q array<string>, c array<string>")
    got = [r[0] for r in d.select(SC.lexical_rejection(F.col("q"), F.col("c"), extra_brand_tokens=True)).collect()]
    assert got == ["Semantic token conflict: MINT vs CINNAMON", "Candidate has unrequested brand token: BRAND", ""]
    p = [tuple(r.p) for r in d.select(SC.penalties(F.col("q"), F.col("c")).alias("p")).collect()]
    assert p[0] == (-4.0, -3.0, -10.0) and p[2] == (0.0, 0.0, 0.0)
    f = d.select(SC.lexical_facts(F.col("q")).alias("q"), SC.lexical_facts(F.col("c")).alias("c"))
    assert [tuple(r.p) for r in f.select(SC.penalties_of("q", "c").alias("p")).collect()] == p


CANDIDATE = "item_id int, score double, exact int, overlap double, numeric int, available_quantity int, products_count int, discount double, negative_price double, store_product_id string, accepted boolean, reason string, component_reason string"


def candidate(item, score, key, accepted=True, reason="fine", component="ok"):
    return (item, float(score), 0, 0.5, 0, 1, 1, 0.0, -1.0, key, accepted, reason, component)


def test_decisions(spark):
    rows = [candidate(1, 5, "a"), candidate(1, 4, "b"), candidate(2, 5, "a"), candidate(2, 5, "b"), candidate(3, 9, "a", False, "no good"), candidate(3, 3, "c", False, "worse")]
    d = spark.createDataFrame(rows, CANDIDATE)
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "item_id int")
    got = {r.item_id: (r.store_product_id, r.reason) for r in D.decide_items(items, D.decide(d)).collect()}
    assert got == {1: ("a", "Accepted best candidate because fine."), 2: (None, "Ambiguous accepted candidates: a, b"), 3: (None, "no good"), 4: (None, "No search candidates were returned.")}


def test_top_k(spark):
    rows = [candidate(1, 9, "a", component="different_form"), candidate(1, 8, "b"), candidate(1, 7, "c", False, "x"), candidate(1, 6, "d"), candidate(1, 5, "e")]
    got = {r.store_product_id: (r.accepted, r.reason) for r in D.check_top(spark.createDataFrame(rows, CANDIDATE), k=2).collect()}
    assert got == {"a": (False, "Semantic token conflict: different_form"), "b": (True, "fine"), "c": (False, "x"), "d": (True, "fine"), "e": (False, "Skipped by candidate top-k optimization")}


def greedy(offers, qty, mode, least):
    """One offer after the other, as a shop would: (offer_ord, ordered)."""
    tier = lambda o: round(o["discount"] / 0.3)
    keys = {
        "first_available": lambda o: (-o["offer_ord"],),
        "max_available": lambda o: (o["available"], tier(o), -o["priority"], -o["offer_ord"]),
        "max_discount": lambda o: (tier(o), -o["priority"], o["available"], -o["offer_ord"]),
    }
    top = max((o["discount"] for o in offers if o["available"] > 0), default=0)
    used, out = set(), []
    while qty > 0:
        need = max([least] + [o["discount"] for o, _ in out]) if mode == "max_discount" else least
        ok = [o for o in offers if o["offer_ord"] not in used and o["available"] > 0 and o["discount"] >= need - 0.001]
        if not ok:
            break
        best = max(ok, key=keys[mode])
        n = min(qty, best["available"])
        out.append((best, n))
        used.add(best["offer_ord"])
        qty -= n
        if mode == "max_discount" and best["discount"] < top - 0.5:
            break
    return sorted((o["offer_ord"], n) for o, n in out)


@pytest.mark.parametrize("hot", [200_000, 2])
@pytest.mark.parametrize("mode", ["first_available", "max_available", "max_discount"])
def test_allocation_equals_a_loop(spark, mode, hot):
    r = random.Random(7)
    offers, demand = [], []
    for p in range(150):
        demand.append((p, r.randrange(1, 60) if p else 900))
        for k in range(r.randrange(0, 9) if p else 400):  # product 0 has 40 % of all offers
            offers.append(dict(product_id=p, offer_ord=k, available=r.choice([0, 5, 10, 20]), discount=r.choice([0.0, 9.7, 9.85, 10.0, 10.1, 10.4, 20.0]), priority=r.choice([1, 2, 999])))
    o = spark.createDataFrame([tuple(x.values()) for x in offers], "product_id int, offer_ord int, available int, discount double, priority int")
    d = spark.createDataFrame(demand, "product_id int, qty int")
    got = {}
    for x in A.allocate(d, o, mode, least=5.0, hot=hot).collect():
        got.setdefault(x.product_id, []).append((x.offer_ord, x.ordered))
    for p, qty in demand:
        assert sorted(got.get(p, [])) == greedy([x for x in offers if x["product_id"] == p], qty, mode, 5.0), (p, qty)


def test_running_sums_of_a_hot_group_run_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "b", None, "c"]), i, r.randrange(-9, 10)) for i in range(600)]
    d = spark.createDataFrame(rows, "g string, k int, x int").repartition(3)
    split = running.ranged(d, ["g"], [F.col("k")], Scratch(spark))
    got = {x.k: (x.s, x.m, x._part) for x in running.before(split, ["g"], {"s": F.col("x")}, {"m": F.col("x")}).collect()}
    seen: dict = {}
    for g, k, x in sorted(rows, key=lambda v: v[1]):
        earlier = seen.setdefault(g, [])
        assert got[k][:2] == (sum(earlier), max(earlier) if earlier else None)
        earlier.append(x)
    assert len({got[k][2] for g, k, _ in rows if g == "hot"}) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_discounts(spark):
    rows = ['{"discountPercent": "12%"}', '{"store": {"discount": 0.12}}', '{"salePrice": 80, "retailPrice": "100"}', "{}", '{"discount": {"percent": 7}}']
    d = spark.createDataFrame([(x,) for x in rows], "p string").withColumn("v", A.first_discount(F.col("p")))
    assert [round(r[0], 6) for r in d.select(A.discount_percent(F.col("v"))).collect()] == [12, 12, 20, -1, 7]
    shown = spark.createDataFrame([("12,5",), ("0.12",), ("0.5%",), ("",), ("none",), ("20.0",)], "x string").select(A.format_discount(F.col("x")))
    assert [r[0] for r in shown.collect()] == ["12.5%", "12%", "0.5%", "", "none", "20%"]
    split = spark.createDataFrame([("a | b | c", "5% | 20% | 7%")], "s string, d string").select(*A.split_selections(F.col("s"), F.col("d"), 3)).first()
    assert tuple(split) == ("b", "20%", "c", "7%", "a", "5%")


def test_prevented(spark):
    items = spark.createDataFrame([(1, "10.0", "Drug A"), (2, "11", "drug b."), (3, "12", ""), (4, "13", "x"), (5, "", "y")], "i int, code string, name string")
    blocked = spark.createDataFrame([("10", None), ("", "DRUG  B"), ("12", "other"), ("13", "z")], "code string, name string")
    assert sorted(r.i for r in X.without_prevented(items, blocked).collect()) == [4, 5]


def test_upserts(spark):
    rows = [("a", 1, "n1", 10), ("a", 2, "n2", 20), ("b", 3, "m", 30)]
    d = spark.createDataFrame(rows, "k string, seq int, name string, v int")
    assert sorted(tuple(r) for r in U.upsert(d, ["k"], "seq", ["name"]).collect()) == [("a", 2, "n1", 20), ("b", 3, "m", 30)]
    human = d.withColumn("h", F.col("seq") == 1)
    assert sorted((r.k, r.v) for r in U.upsert_keeping(human, ["k"], "seq", F.col("h")).collect()) == [("a", 10), ("b", 30)]
    u = U.union_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")])
    assert u.columns == ["a", "b"] and u.count() == 2
    items = spark.createDataFrame([(1, "5.0", "A  b"), (2, "5", "a b"), (3, None, " ")], "o int, code string, name string")
    assert [r.o for r in U.distinct_items(items, "o").collect()] == [1]


def test_chunks_and_pages(spark):
    for n, workers in ((10, 4), (3, 5), (0, 3), (7, 1), (23, 6)):
        d = spark.range(n).repartition(3)
        got = [r.chunk for r in R.chunks(d, [F.asc("id")], workers).orderBy("id").collect()]
        small, extra = divmod(n, workers)
        assert got == [w + 1 for w in range(workers) for _ in range(small + (w < extra))]
    d = spark.range(120).repartition(5)
    assert [r.page for r in R.pages(d, [F.desc("id")]).orderBy(F.desc("id")).collect()] == [i // 50 + 1 for i in range(120)]
    assert [r.id for r in R.page(d, [F.asc("id")], 3).collect()] == list(range(100, 120))


def test_numbers_of_wide_rows(spark):
    """Columns that the order doesn't know, many partitions: each number once, each row with its own."""
    d = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"), (F.col("id") % 5).alias("k"), F.repeat(F.col("id").cast("string"), 80).alias("wide"), F.lit(1).alias("place")).repartition(13)
    got = R.numbered(d, [F.col("k"), F.desc("id")]).collect()
    assert sorted(r.n for r in got) == list(range(1, 20_001)) and set(got[0].asDict()) == {"id", "k", "wide", "place", "n"}
    order = sorted(got, key=lambda r: r.n)
    assert [(r.k, -r.id) for r in order] == sorted((r.k, -r.id) for r in order)
    assert R.numbered(d.limit(0), [F.col("id")]).collect() == []


def test_nested_census(spark):
    rows = [('{"a": {"b": [1, {"c": "x"}]}, "d": null}',), ('{"a": 3}',), ("[1]",), ("no json",), (None,)]
    got = {(r.path, r.type): r.n for r in R.field_census(spark.createDataFrame(rows, "p string"), "p").collect()}
    assert got == {("a", "OBJECT"): 1, ("a", "BIGINT"): 1, ("d", "VOID"): 1, ("a.b", "ARRAY"): 1, ("a.b[]", "BIGINT"): 1, ("a.b[]", "OBJECT"): 1, ("a.b[].c", "STRING"): 1, ("[]", "BIGINT"): 1}


def test_empty_reports(spark):
    none = spark.createDataFrame([], "status string, matched string, manual_review_required string, deterministic_match_found string, ai_status string")
    row = R.quality_counts(none).withColumn("p", R.rate(F.col("auto_matched"), F.col("total"))).first()
    assert row.total == 0 and row.p == 0.0
    assert R.distribution(none, "status").count() == 0 and R.grouped_counts(none, ["status"]).count() == 0


def test_providers(spark):
    rows = [("p1", True, "", "", "", 1, 2, 1.5, "1K", 1), ("p2", False, "http_429", "", "", 1, 1, 1.0, "", 2), ("p3", False, "TimeoutError", "", "", 1, 1, 1.0, "", 3), ("p4", False, "", "404", "", 1, 1, 1.0, "", 4)]
    d = spark.createDataFrame(rows, "provider string, ok boolean, error_type string, http_status string, error_message string, rotation_tier int, quality_rank int, elapsed_s double, rate_remaining_requests string, seq int")
    got = P.ranked_health(d).orderBy("rotation_rank").collect()
    assert [(r.provider, r.health_status, r.fallback_tier) for r in got] == [("p1", "working", 0), ("p3", "degraded", 1), ("p2", "quota-limited", 2), ("p4", "model-not-accessible", 4)]
    assert got[0].rotation_score == 30 + 70 + 50 + 18.5
    assert [P.model_tier(F.lit(r), F.lit(7)) is not None for r in range(1, 8)]
    t = spark.range(1, 8).select(P.model_tier(F.col("id"), F.lit(7)).alias("t"))
    assert [r.t for r in t.collect()] == [1, 1, 1, 2, 2, 3, 3]
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3), (2, "z", 4)], "tier int, provider string, o int")
    assert [r.o for r in P.round_robin(a, 3, "tier", "provider", "o").orderBy("position").collect()] == [1, 3, 2]


def test_review(spark):
    rows = [(None, "", "0", ""), ("m", "", "85.4", ""), ("m", "ai_confirmed", "50", "different_form"), ("m", "", "95", "ok"), ("m", "", "x", "nan")]
    d = spark.createDataFrame(rows, "n string, v string, s string, c string").select(V.review_reason(*map(F.col, "nvsc")).alias("r"))
    assert [r.r for r in d.collect()] == ["no_match_found", "uncertain_score(85)", "low_confidence_ai_match; component:different_form", "needs_review", "needs_review"]
    o = spark.createDataFrame([(1, "a", False, 90.0, 3), (1, "b", False, 95.0, 4), (1, "c", True, 0.0, 1), (1, "a", True, 0.0, 2)], "item_id int, name string, accepted boolean, similarity double, position int")
    assert V.review_options(o).first().options == ["b", "a", "c"]


def test_blocking(spark):
    a = parse_names(spark.createDataFrame([(1, "PANADOL 500 MG 24 TAB"), (2, "XY 5")], "i int, n string"), "n", "d")
    b = parse_names(spark.createDataFrame([(7, "PANADOL 500 MG 20 TAB"), (8, "PANDA 10 MG")], "j int, n string"), "n", "m")
    got = B.pairs_by_keys(a, "i", B.component_keys("d"), b, "j", B.component_keys("m"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 2)]
    assert sorted((r.i, r.j) for r in B.pairs_by_keys(a, "i", B.prefix_keys("d"), b, "j", B.prefix_keys("m")).collect()) == [(1, 7), (1, 8)]
    p = spark.createDataFrame([("ABCDEFGHI", "ABCDEX"), ("AB", "AB"), ("X", "Y")], "a string, b string")
    assert [r[0] for r in p.select(B.longest_shared_prefix(F.col("a"), F.col("b"))).collect()] == [5, 2, 0]
