"""Queries of gates, rejections, review rules and the cascade. Registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions import words as W
from weftline.functions.parse import parse_names
from weftline.operators import blocking as B
from weftline.operators import cascade as C
from weftline.operators import decide as D
from weftline.operators import gates as G
from weftline.operators import providers as P
from weftline.operators import review as RV
from weftline.operators import scoring as SC
from weftline.plans.queries import _in, catalogue, demand, query, sql_canonical, t
from weftline.plans.texts import pick, pick_sql
from weftline.shared import Scratch

#: What the gates say of a pair that differs in one part alone; the parts stand in `gate_reasons`, in this order.
REASONS = "ok different_brand different_modifier different_dosage different_form different_quantity different_age_group different_flavor different_import_status ok ok different_modifier different_volume different_weight different_route ok ok".split()


@query(f"SELECT p_partkey, CASE WHEN p_partkey % {len(REASONS)} = 5 AND p_size IN (20, 30) THEN 'ok' ELSE {pick_sql('p_partkey', REASONS)} END AS reason FROM part")
def gate_reasons(spark, sf_dir):
    """Names that differ from one another in one part: brand, modifier, strength, form, pack, age, flavour, import, unit, route ...

    A pack that is the other's strength is no other pack."""
    p = t(spark, sf_dir, "part")
    n, size = F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.col("p_size")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    base = s(n, " ", size, " MG 20 TABLETS")
    same = F.lit(None)
    syrup, drops, cream = (lambda x, form=form, unit=unit: s(n, f" {form} {x} {unit}") for form, unit in (("SYRUP", "ML"), ("EYE DROPS", "ML"), ("CREAM", "GM")))
    left = [same] * 9 + [s(n, " 5/160 MG 20 TABLETS"), s(n, " 500 MCG 20 TABLETS"), same, drops(10), cream(30), s(n, " ", size, " MG AMP IM"), s(n, " POWDER 10 SACHETS"), syrup(60)]
    right = [
        base,
        s("ZORVEX ", size, " MG 20 TABLETS"),
        s(n, " EXTRA ", size, " MG 20 TABLETS"),
        s(n, " ", size + 1, " MG 20 TABLETS"),
        s(n, " ", size, " MG VIAL"),
        s(n, " ", size, " MG 30 TABLETS"),
        s(n, " ", size, " MG 20 TABLETS KIDS"),
        s(n, " ", size, " MG 20 TABLETS LEMON"),
        s(n, " ", size, " MG 20 TABLETS IMPORTED"),
        s(n, " 165 MG 20 TABLETS"),
        s(n, " 0.5 MG 20 TABLETS"),
        s(n, " ", size, " MG 20 TABLETS XR"),
        drops(15),
        cream(60),
        s(n, " ", size, " MG AMP IV"),
        s(n, " POWDER 12 SACHETS"),
        syrup(120),
    ]
    k = (F.col("p_partkey") % len(REASONS) + 1).cast("int")
    pairs = p.select("p_partkey", F.coalesce(F.element_at(F.array(*left), k), base).alias("d_name"), F.element_at(F.array(*right), k).alias("m_name"))
    scratch = Scratch(spark)
    d, m = (scratch.save(C.names(pairs, f"{p}_name", p), p) for p in "dm")
    found = C.judged(pairs.select("d_name", "m_name").distinct(), d, m).select("d_name", "m_name", "reason")
    return pairs.join(found, ["d_name", "m_name"]).select("p_partkey", "reason")


#: Pairs of names, what the second has more, and whether the request may leave that out.
OMISSIONS = [
    ("ZETA CREAM", "ZETA 5 % CREAM", "5", True),
    ("ZETA 500 MG TAB", "ZETA 500 MG 20 TAB", "20", True),
    ("ZETA 500 MG", "ZETA 250 MG", "250", False),
    ("ZETA 40 MG AMP", "ZETA 40 MG 2 ML AMP", "2", True),
    ("ZETA PEN", "ZETA 300 IU PEN", "300", True),
    ("ZETA", "ZETA 7", "7", False),
    ("CONCOR PLUS 5 MG", "CONCOR 10 MG", "10", True),
    ("NAN MILK", "NAN 2 MILK", "2", True),
    ("VITACID C EFF", "VITACID C 500 MG EFF", "500", True),
    ("ZETA 10 MG SPRAY", "ZETA 20 MG TAB", "20", False),
]


@query(f"SELECT p_partkey, {pick_sql('p_partkey', [x[3] for x in OMISSIONS])} AS safe FROM part")
def safe_omissions(spark, sf_dir):
    """Distinct pairs of names are judged once."""
    k = F.col("p_partkey")
    p = t(spark, sf_dir, "part").select(k, *(pick(k, [x[i] for x in OMISSIONS]).alias(c) for i, c in enumerate(("a", "b", "x"))))
    d = p.select("a", "b", "x").distinct()
    d = G.with_facts(parse_names(d, "a", "d"), "d")
    d = G.with_facts(parse_names(d, "b", "m"), "m")
    return p.join(d.select("a", "b", "x", G.safe_omission(F.array("x"), "d", "m").alias("safe")), ["a", "b", "x"]).select("p_partkey", "safe")


Q_TAILS, C_TAILS = ["", " lemon gel", " mint", " syrup max"], ["", " ORANGE GEL", " MAX", " NEWWORD PLUS", " CLOVE DROPS LEMON"]


def _lexical_reasons() -> str:
    pairs = []
    for g in W.CONFLICTS:
        q, c = (f"list_intersect({x}, [{_in(g)}])" for x in ("q", "c"))
        pairs.append(f"CASE WHEN list_sort({q}) = list_sort({c}) THEN [] ELSE flatten(list_transform({q}, lambda x: list_transform(list_filter({c}, lambda y: y <> x), lambda y: x || ' vs ' || y))) END")
    found = f"list_sort(flatten([{', '.join(pairs)}]))"
    extra = f"list_sort(list_filter(c, lambda y: y IN ({_in(W.DISTINGUISHING_TOKENS)}) AND NOT list_contains(q, y)))"
    brand = f"list_sort(list_filter(c, lambda y: NOT list_contains(q, y) AND NOT regexp_full_match(y, '[0-9]+') AND y NOT IN ({_in(W.SAFE_EXTRA_TOKENS)})))"
    names = f"SELECT p_partkey, {sql_canonical('p_name || ' + pick_sql('p_partkey', Q_TAILS))} AS q, {sql_canonical('p_name || ' + pick_sql('p_partkey', C_TAILS))} AS c FROM part"
    return f"""WITH n AS ({names}), x AS (SELECT *, {found} AS f, {extra} AS e, {brand} AS b FROM n)
SELECT p_partkey, CASE WHEN len(f) > 0 THEN 'Semantic token conflict: ' || array_to_string(f, ', ') WHEN len(e) > 0 THEN 'Candidate has unrequested distinguishing token: ' || array_to_string(e, ', ') ELSE '' END AS plain,
 CASE WHEN len(f) > 0 THEN 'Semantic token conflict: ' || array_to_string(f, ', ') WHEN len(b) > 0 THEN 'Candidate has unrequested brand token: ' || array_to_string(b, ', ') WHEN len(e) > 0 THEN 'Candidate has unrequested distinguishing token: ' || array_to_string(e, ', ') ELSE '' END AS strict FROM x"""


@query(_lexical_reasons())
def lexical_rejections(spark, sf_dir):
    k = F.col("p_partkey")
    d = t(spark, sf_dir, "part").select(k, N.canonical_tokens(F.concat("p_name", pick(k, Q_TAILS))).alias("q"), N.canonical_tokens(F.concat("p_name", pick(k, C_TAILS))).alias("c"))
    return d.select("p_partkey", SC.lexical_rejection(F.col("q"), F.col("c")).alias("plain"), SC.lexical_rejection(F.col("q"), F.col("c"), True).alias("strict"))


_MARKS, _ARABIC_NAMES = ["", " EFF", " VAG", " C VITACID"], ["", "فوار كالسيوم", "دش مهبل", "اسم اخر"]


@query(
    f"""WITH x AS (SELECT p_partkey, string_split(upper(p_name) || {pick_sql("p_partkey", _MARKS)}, ' ') AS q, CASE WHEN p_size % 3 = 0 THEN ['OTHER', 'WORD'] ELSE string_split(upper(p_name), ' ') END AS c, p_size % 4 = 0 AS alike, p_partkey % 5 = 0 AS made, {pick_sql("p_partkey // 4", _ARABIC_NAMES)} AS a FROM part),
y AS (SELECT *, len(list_intersect(list_filter(q, lambda w: len(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_in(W.GENERIC_TOKENS)})), c)) = 0 AND NOT alike AS missing FROM x)
SELECT p_partkey, concat_ws('; ', CASE WHEN missing AND made THEN 'Synthetic English name missing requested identity token' END, CASE WHEN missing THEN 'English name missing requested identity token' END,
 CASE WHEN a <> '' AND list_contains(q, 'EFF') AND NOT contains(a, 'فوار') THEN 'Arabic name missing marker for EFF' END, CASE WHEN a <> '' AND list_contains(q, 'VAG') AND NOT contains(a, 'مهبل') THEN 'Arabic name missing marker for VAG' END,
 CASE WHEN list_contains(q, 'VITACID') AND contains(a, 'كالسيوم') THEN 'Arabic name contains calcium for VITACID C query' END) AS reasons FROM y"""
)
def variant_rejections(spark, sf_dir):
    k = F.col("p_partkey")
    q = F.split(F.concat(F.upper("p_name"), pick(k, _MARKS)), " ")
    c = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("OTHER"), F.lit("WORD"))).otherwise(F.split(F.upper("p_name"), " "))
    return t(spark, sf_dir, "part").select("p_partkey", G.variant_rejection(q, c, F.col("p_size") % 4 == 0, k % 5 == 0, pick(F.floor(k / 4), _ARABIC_NAMES)).alias("reasons"))


@query(
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Semantic token conflict' ELSE '' END AS r, CASE WHEN user_id % 3 = 0 THEN [] WHEN user_id % 3 = 1 THEN ['5'] ELSE ['20', '7'] END AS extra, user_id % 2 = 0 AS omitted, event_id % 3 <> 0 AS orderable, value / 6 AS score FROM events),
y AS (SELECT *, len(extra) = 0 OR omitted AS passed FROM x)
SELECT event_id, r = '' AND passed AND orderable AS accepted, CASE WHEN r <> '' THEN r WHEN passed AND NOT orderable THEN 'Candidate missing orderable storeProductId' WHEN NOT passed AND NOT orderable AND score >= 9 THEN 'Candidate missing orderable storeProductId'
 WHEN NOT passed THEN 'unrequested numeric token: ' || array_to_string(extra, ', ') WHEN len(extra) = 0 THEN 'No extra numeric tokens' ELSE 'Extra numeric tokens represent safe omission' END AS reason FROM y"""
)
def acceptance_reasons(spark, sf_dir):
    u = F.col("user_id")
    none = F.array().cast("array<string>")
    extra = F.when(u % 3 == 0, none).when(u % 3 == 1, F.array(F.lit("5"))).otherwise(F.array(F.lit("20"), F.lit("7")))
    r = F.when(F.col("event_type") == "error", "Semantic token conflict").otherwise("")
    d = t(spark, sf_dir, "events").select("event_id", G.acceptance(r, extra, u % 2 == 0, F.col("event_id") % 3 != 0, F.col("value") / 6).alias("a"))
    return d.select("event_id", "a.accepted", "a.reason")


METHODS = ["component_index", "brand_index", "fuzzy", "token_set_ratio"]


@query(
    f"""WITH x AS (SELECT event_id, event_type <> 'error' AS matched, value + 40 AS s, {pick_sql("user_id", METHODS)} AS m, {pick_sql("event_id", ["ok", "", "NaN", "different_form"])} AS why FROM events)
SELECT event_id, matched, matched AS p_all, matched AND NOT (m = 'component_index' AND s >= 100) AS p_exact, matched AND (s < 90 OR m IN ('fuzzy', 'brand_index')) AS p_fuzzy, matched AND s < 90 AS p_low, s / 140 < 0.5 OR why = 'different_form' AS second_look,
 event_id % 9 IN (0, 2, 4) AS flag FROM x"""
)
def verify_policies(spark, sf_dir):
    """Which matches each policy verifies, which rows get a second look, what reads as yes."""
    k = F.col("event_id")
    name, s, m = F.when(F.col("event_type") != "error", "x"), (F.col("value") + 40).cast("string"), pick(F.col("user_id"), METHODS)
    why = pick(k, ["ok", "", "NaN", "different_form"])
    of = lambda policy: RV.verify_policy(policy, name, s, m, 90.0)
    yes = pick(k, [" Yes ", "n", "1", "0", "TRUE", "", None, "2", "off"])
    return t(spark, sf_dir, "events").select("event_id", RV.matched(name).alias("matched"), of("all").alias("p_all"), of("all-non-exact").alias("p_exact"), of("fuzzy").alias("p_fuzzy"), of("low").alias("p_low"), RV.ai_review_rows((F.col("value") + 40) / 140, why, 0.5).alias("second_look"), RV.is_flag(yes).alias("flag"))


STATUSES = ["no-results", "matched-but-unavailable", "not-orderable", "manufacturer-mismatch", "manual-review-required", "matched", ""]
AI_STATUSES = [None, "ai_rejected", "ai_review_rejected", "ai_low_confidence", "ai_verified"]


@query(
    f"""WITH x AS (SELECT event_id, {pick_sql("event_id", STATUSES)} AS s, {pick_sql("user_id", AI_STATUSES)} AS a, CASE WHEN event_id % 13 = 0 THEN 'missing storeProductId' ELSE '' END AS safe, event_type IN ('view', 'click') AS searched, event_type = 'error' AS verified, {pick_sql("event_id", ["why", ""])} AS r, {pick_sql("user_id", ["", "why not", "wh"])} AS o FROM events),
y AS (SELECT *, concat_ws(' | ', nullif(r, ''), CASE WHEN o <> '' AND NOT contains(r, o) THEN o END) AS j FROM x)
SELECT event_id, CASE WHEN safe <> '' THEN 'candidate_not_orderable' WHEN s = 'matched-but-unavailable' THEN 'matched_but_not_available' WHEN s = 'not-orderable' THEN 'candidate_not_orderable' WHEN s = 'manufacturer-mismatch' THEN 'manufacturer_mismatch'
 WHEN coalesce(a, s) IN ('ai_review_rejected', 'ai_low_confidence', 'ai_rejected') THEN a WHEN s IN ('no-results', 'manual-review-required') THEN 'no_decisive_match' ELSE coalesce(a, s) END AS category,
 CASE WHEN a IS NULL THEN CASE WHEN s <> '' THEN 'summary_status' ELSE '' END WHEN a = 'ai_review_rejected' THEN 'ai_review' WHEN a IN ('ai_rejected', 'ai_low_confidence') THEN CASE WHEN searched THEN 'ai_search' WHEN verified THEN 'ai_verify' ELSE 'ai_final' END
 WHEN s IN ('manufacturer-mismatch', 'matched-but-unavailable', 'not-orderable') THEN 'deterministic_match' ELSE 'summary_status' END AS phase,
 concat_ws(' | ', nullif(j, ''), 'hard_conflicts: Form, brand') AS detail, CASE WHEN user_dec AND NOT again THEN false ELSE s IN ('no-results', 'manual-review-required', 'not-orderable', 'matched-but-unavailable', 'manufacturer-mismatch') END AS needed
FROM (SELECT y.*, event_id % 3 = 0 AS user_dec, event_id % 2 = 0 AS again FROM y)"""
)
def review_categories(spark, sf_dir):
    """Category, phase and detail of an item in review, and whether it stays there."""
    k, u, e = F.col("event_id"), F.col("user_id"), F.col("event_type")
    s, a = pick(k, STATUSES), pick(u, AI_STATUSES)
    conflicts = F.array(*map(F.lit, ("Form", "brand", "FORM")))
    detail = RV.review_detail(pick(k, ["why", ""]), [pick(u, ["", "why not", "wh"])], conflicts)
    return t(spark, sf_dir, "events").select(
        "event_id",
        RV.review_category(s, a, F.when(k % 13 == 0, "missing storeProductId").otherwise("")).alias("category"),
        RV.blocking_phase(s, a, e.isin("view", "click"), e == "error").alias("phase"),
        detail.alias("detail"),
        RV.review_needed(s, F.when(k % 3 == 0, "corrected"), k % 2 == 0).alias("needed"),
    )


@query(
    """WITH x AS (SELECT event_id, event_type <> 'error' AS found, user_id % 2 = 0 AS ok, CASE WHEN user_id % 3 = 0 THEN 'high_token_overlap' ELSE 'Component mismatch: a' END AS why, value / 50 AS o, event_id % 3 / 2.0 AS n FROM events)
SELECT event_id, NOT (found AND ok AND why = 'high_token_overlap' AND o >= 1 AND n IN (0, 1)) AS logged, NOT ok AND (o * 8 >= 12 AND why <> 'Component mismatch: a') AS recognised, CASE WHEN user_id2 = 0 THEN CASE WHEN found THEN 'not-orderable' ELSE 'no-results' END ELSE 'failed' END AS failure
FROM (SELECT x.*, event_id % 5 AS user_id2 FROM x)"""
)
def log_and_failure(spark, sf_dir):
    """Decisions logged in full, candidates recognised without an id, the status of failures."""
    k, u = F.col("event_id"), F.col("user_id")
    found, ok = F.col("event_type") != "error", u % 2 == 0
    why = F.when(u % 3 == 0, "high_token_overlap").otherwise("Component mismatch: a")
    o = F.col("value") / 50
    reason = F.when(k % 5 == 0, "x No decisive match found").otherwise("boom")
    return t(spark, sf_dir, "events").select("event_id", RV.needs_full_log(found, ok, why, o, k % 3 / 2.0).alias("logged"), RV.recognised_without_id(why, o * 8, ok).alias("recognised"), RV.failure_status(reason, F.when(found, "not-orderable")).alias("failure"))


_WHY = ["ok", "different_brand", "different_form", "different_quantity", "different_modifier", "different_dosage", "different_import_status"]


@query(
    f"""WITH x AS (SELECT event_id, {pick_sql("event_id", _WHY)} AS w, value AS s, CASE WHEN user_id % 3 = 0 THEN 100 WHEN user_id % 3 = 1 THEN 0 ELSE round(value, 2) END AS b, user_id % 2 = 0 AS med FROM events)
SELECT event_id, b::DOUBLE AS likeness, CASE w WHEN 'ok' THEN true WHEN 'different_brand' THEN b >= 80 WHEN 'different_quantity' THEN b >= 86 WHEN 'different_modifier' THEN NOT med OR s >= 75 WHEN 'different_import_status' THEN true ELSE false END AS reviewable FROM x"""
)
def reviewable_mismatches(spark, sf_dir):
    """Mismatches that a person may be shown: denied and allowed reasons, how alike the brands are."""
    k, u = F.col("event_id"), F.col("user_id")
    a = F.when(u % 3 == 1, "").otherwise("PANADOL")
    b = F.when(u % 3 == 0, "PANA-DOL EXTRA").otherwise("OTHER")
    likeness = C.brand_likeness(a, b, F.round("value", 2))
    return t(spark, sf_dir, "events").select("event_id", likeness.alias("likeness"), C.reviewable(pick(k, _WHY), likeness, F.col("value"), F.when(u % 2 == 0, "medicine").otherwise("device")).alias("reviewable"))


@query(
    """WITH x AS (SELECT event_id, user_id, event_type IN ('view', 'click') AS passed, event_type <> 'error' AS rev, value AS s FROM events),
y AS (SELECT *, sum((NOT passed AND rev AND s >= 68)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM x)
SELECT event_id, user_id AS item_id FROM y WHERE (passed AND s >= 80) OR (NOT passed AND rev AND s >= 68 AND n <= 8)"""
)
def search_eligibility(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("item_id"), F.col("event_id").alias("position"), F.col("event_type").isin("view", "click").alias("passed"), (F.col("event_type") != "error").alias("reviewable"), F.col("value").alias("score"))
    return RV.search_eligible(e).select("event_id", "item_id")


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) <= 500 AS searched, props FROM events WHERE event_type = 'error'")
def search_limit(spark, sf_dir):
    """The first unmatched items go to the search, the others are skipped: a split in a total order."""
    e = t(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "value", "props")
    return RV.split_at(e, [F.asc("value"), F.asc("event_id")], 500, "searched").drop("value")


@query()
def link_cascade(spark, sf_dir):
    """Each demanded item's row by the cascade: component keys, brands' beginnings, then three scorers."""
    d = demand(spark, sf_dir).select("item_id", F.col("query").alias("name"), F.col("item_price").alias("price"))
    c = catalogue(spark, sf_dir).select("row_id", F.col("candidate").alias("name"), "price")
    return C.cascade(d, c)


def _misspelt(spark, sf_dir):
    """Demand whose names are shortened, misspelt or cut, so that every stage has work."""
    k = F.col("p_partkey")
    n = F.upper("p_name")
    name = F.concat(F.when(k % 4 == 0, n).when(k % 4 == 1, F.regexp_replace(n, "^(...)", "$1Q")).when(k % 4 == 2, F.concat(F.lit("NEW "), n)).otherwise(F.left(n, F.lit(2))), F.lit(" "), F.when(k % 4 == 3, "").otherwise(F.concat("p_size", F.lit("MG"))))
    return t(spark, sf_dir, "part").select(k.alias("item_id"), F.trim(name).alias("name"), F.col("p_retailprice").alias("price"))


@query()
def link_cascade_in_turn(spark, sf_dir):
    """The detailed cascade over demand with shortened and misspelt names."""
    c = catalogue(spark, sf_dir).select("row_id", F.col("candidate").alias("name"), "price")
    return C.cascade(_misspelt(spark, sf_dir), c, in_turn=True)


@query()
def ai_search_candidates(spark, sf_dir):
    c = catalogue(spark, sf_dir).select("row_id", F.col("candidate").alias("name"), "price", (F.col("row_id") % 997).cast("string").alias("store_product_id"))
    return C.search_candidates(_misspelt(spark, sf_dir), c)


@query(
    """WITH a AS (SELECT DISTINCT user_id AS item_id, event_id % 20 AS row_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id AS item_id, event_id % 20 AS row_id FROM events WHERE event_type <> 'error')
SELECT item_id, row_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.item_id = b.item_id AND a.row_id = b.row_id) THEN 'component' ELSE 'brand' END AS source FROM b"""
)
def candidate_union(spark, sf_dir):
    """Pairs of two sources, each of the first that has it."""
    e = t(spark, sf_dir, "events")
    of = lambda d: d.select(F.col("user_id").alias("item_id"), (F.col("event_id") % 20).alias("row_id")).distinct()
    return B.union_sources([("component", of(e.filter("event_type = 'view'"))), ("brand", of(e.filter("event_type <> 'error'")))], "item_id", "row_id")


@query(
    """WITH c AS (SELECT event_id, user_id AS item_id, CASE WHEN event_id % 4 <> 0 THEN 's' || event_id % 50 END AS sid, event_type AS name, event_id % 7 AS q FROM events),
k AS (SELECT DISTINCT user_id AS item_id, CASE WHEN user_id % 2 = 0 THEN 's' || user_id % 50 END AS cid, 'Click' AS cname FROM events), h AS (SELECT c.*, CASE WHEN sid = cid THEN 0 WHEN cid IS NULL AND name = 'click' THEN 1 END AS hit FROM c JOIN k USING (item_id))
SELECT item_id, event_id, 999.0::DOUBLE AS score FROM h WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hit, q, event_id) = 1"""
)
def forced_match_by_id_or_name(spark, sf_dir):
    """What a saved decision names by id, else by name, whatever it scores."""
    e = t(spark, sf_dir, "events")
    c = e.select("event_id", F.col("user_id").alias("item_id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), F.col("event_id") % 50)).alias("store_product_id"), F.col("event_type").alias("name_en"), (F.col("event_id") % 7).alias("query_ord"), F.col("event_id").alias("row_index"))
    k = e.select(F.col("user_id").alias("item_id")).distinct().select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("s"), F.col("item_id") % 50)).alias("correct_id"), F.lit("Click").alias("correct_name"))
    return D.forced_match(c, k).select("item_id", "event_id", "score")


def _candidates(spark, sf_dir):
    return t(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("item_id"),
        F.concat(F.lit("s"), F.col("event_id") % 9).alias("store_product_id"),
        F.concat("event_type", F.lit(" "), F.col("event_id") % 3).alias("name_en"),
        F.lit(None).cast("string").alias("name_ar"),
        (F.col("event_id") % 5).alias("query_ord"),
        F.col("event_id").alias("row_index"),
        F.col("value").alias("similarity"),
        F.when(F.col("event_type") == "view", "different_form").otherwise("ok").alias("component_reason"),
    )


_CAND = "SELECT event_id, user_id AS item_id, 's' || event_id % 9 AS sid, event_type || ' ' || event_id % 3 AS name, event_id % 5 AS q, value AS sim, event_type <> 'view' AS ok FROM events"


@query(f"SELECT event_id, item_id FROM ({_CAND}) QUALIFY row_number() OVER (PARTITION BY item_id, sid, name ORDER BY q, event_id) = 1")
def candidates_once(spark, sf_dir):
    return D.distinct_candidates(_candidates(spark, sf_dir)).select("event_id", "item_id")


@query(f"SELECT event_id, item_id FROM ({_CAND}) c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id % 40 = c.item_id AND 's' || l.doc_id % 9 = c.sid)")
def blocked_candidates(spark, sf_dir):
    gone = t(spark, sf_dir, "labels").filter("toxic = 1").select((F.col("doc_id") % 40).alias("item_id"), F.concat(F.lit("s"), F.col("doc_id") % 9).alias("store_product_id"))
    return D.without_rejected(_candidates(spark, sf_dir), gone).select("event_id", "item_id")


@query(f"SELECT event_id, item_id, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, event_id) AS n FROM ({_CAND})) WHERE n <= 5 AND ok")
def recovery_candidates(spark, sf_dir):
    return D.recovery_set(_candidates(spark, sf_dir)).select("event_id", "item_id", "rank")


@query(
    """SELECT event_id, user_id AS item_id FROM events WHERE value >= 12 AND user_id % 10 / 10.0 >= 0.4 AND event_id % 4 <> 0 AND event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1"""
)
def aggressive_picks(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    c = e.select("event_id", F.col("user_id").alias("item_id"), F.col("value").alias("score"), (F.col("user_id") % 10 / 10).alias("overlap"), F.when(F.col("event_id") % 4 != 0, F.lpad("event_id", 9, "0")).alias("store_product_id"), (F.col("event_type") != "error").alias("shares_brand"), *(F.lit(0).alias(x) for x in ("exact", "numeric", "available_quantity", "products_count", "discount", "negative_price")))
    return D.aggressive_pick(c, least_overlap=0.4).select("event_id", "item_id")


_HEALTH = """SELECT event_id, 'p' || user_id % 9 AS provider, 'm' || event_id % 5 AS model, event_id AS seq, event_type = 'view' AS ok, CASE event_type WHEN 'view' THEN 'working' WHEN 'signup' THEN 'quota-limited' WHEN 'click' THEN 'degraded' WHEN 'error' THEN 'permission-failed' ELSE 'failed' END AS s,
 user_id % 4 AS tier, user_id % 6 AS rank, floor(value) / 10 AS took, user_id % 3 * 500.0 AS quota FROM events"""


def _health(spark, sf_dir):
    e, u = F.col("event_type"), F.col("user_id")
    return t(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("p"), u % 9).alias("provider"),
        F.concat(F.lit("m"), F.col("event_id") % 5).alias("model"),
        F.col("event_id").alias("seq"),
        (e == "view").alias("ok"),
        F.when(e == "click", "null_content").alias("error_type"),
        F.when(e == "signup", "429").when(e == "error", "403").alias("http_status"),
        F.lit(None).cast("string").alias("error_message"),
        (u % 4).alias("rotation_tier"),
        (u % 6).alias("quality_rank"),
        (F.floor("value") / 10).alias("elapsed_s"),
        F.when(u % 3 == 1, "500").when(u % 3 == 2, "1K").otherwise("0").alias("rate_remaining_requests"),
        F.lit("json").alias("mode"),
    )


@query(
    f"""WITH h AS ({_HEALTH}), x AS (SELECT *, CASE s WHEN 'working' THEN 0 WHEN 'degraded' THEN 1 WHEN 'quota-limited' THEN 2 WHEN 'permission-failed' THEN 3 ELSE 5 END AS f, coalesce(nullif(tier, 0), 3) AS t, nullif(rank, 0) AS q, nullif(took, 0) AS l FROM h)
SELECT event_id, s AS health_status, f AS fallback_tier, CASE WHEN ok THEN round_even(greatest(0, 40 - t * 10) + greatest(0, 80 - coalesce(q, 100) * 5) + least(quota, 1000) / 20 + greatest(0, 20 - coalesce(l, 20)), 2) ELSE 0 END::DOUBLE AS score,
 row_number() OVER (ORDER BY f, t, coalesce(q, 999), quota DESC, coalesce(l, 9999), provider, seq) AS rotation_rank FROM x"""
)
def health_ranks(spark, sf_dir):
    """Providers' answers by health, with advice, score and place."""
    return P.ranked_health(_health(spark, sf_dir)).select("event_id", "health_status", "fallback_tier", F.col("rotation_score").alias("score"), "rotation_rank")


@query(
    f"""WITH h AS ({_HEALTH}), g AS (SELECT provider, model, min({{'k': CASE WHEN ok THEN 0 WHEN s = 'permission-failed' THEN 3 ELSE 2 END, 'q': seq}}) AS h FROM h WHERE tier < 3 GROUP BY ALL), a AS (SELECT DISTINCT 'p' || user_id % 11 AS provider, 'm' || event_id % 5 AS model FROM events)
SELECT provider, model, row_number() OVER (ORDER BY coalesce(h.k, 1), coalesce(h.q, ord), ord) AS position FROM (SELECT *, substr(provider, 2)::BIGINT * 10 + substr(model, 2)::BIGINT AS ord FROM a) LEFT JOIN g USING (provider, model)"""
)
def attempts_by_health(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 11).alias("p"), (F.col("event_id") % 5).alias("m")).distinct()
    a = e.select(F.concat(F.lit("p"), "p").alias("provider"), F.concat(F.lit("m"), "m").alias("model"), (F.col("p") * 10 + F.col("m")).alias("ord"))
    return P.by_health(a, _health(spark, sf_dir).filter("rotation_tier < 3"), ["provider", "model"], "ord").select("provider", "model", "position")


@query(f"SELECT provider, model, row_number() OVER (ORDER BY f) AS position FROM (SELECT provider, model, min(seq) AS f FROM ({_HEALTH}) WHERE ok GROUP BY ALL)")
def healthy_pairs(spark, sf_dir):
    return P.healthy_combinations(_health(spark, sf_dir), ["provider", "model"]).select("provider", "model", "position")


@query(
    f"""SELECT event_id, (event_id - 3) % 5 + CASE WHEN event_id < 3 THEN 5 ELSE 0 END AS turn, tier < 2 OR (tier = 2 AND rank <= 3) AS kept, failures::BIGINT AS failures, failures >= 2 AS disabled
FROM (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY provider, model ORDER BY seq) AS failures FROM ({_HEALTH}))"""
)
def rotation_and_disabling(spark, sf_dir):
    """A list from a cursor on, attempts not weaker than the primary one, and combinations that failures disable."""
    h = P.rotated(_health(spark, sf_dir), "event_id", 3, 5)
    strong = P.not_stronger(h, 2, 3).select("event_id", F.lit(True).alias("kept"))
    d = P.disabled_after(h, ["provider", "model"], "seq").join(strong, "event_id", "left")
    return d.select("event_id", "turn", F.coalesce("kept", F.lit(False)).alias("kept"), "failures", "disabled")


@query(
    """WITH f AS (SELECT user_id % 40 AS model, ts AS "at", count(*) AS n, max(CASE WHEN value > 90 THEN 3600 ELSE 0 END) AS asked FROM events WHERE event_type = 'error' GROUP BY ALL),
w AS (SELECT *, least(sum(n) OVER (PARTITION BY model ORDER BY epoch_us("at") RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 3)::BIGINT AS failures FROM f)
SELECT model, "at", failures, "at" + to_seconds(greatest(CASE WHEN failures >= 3 THEN 7200 ELSE 0 END, asked)) AS until FROM w WHERE failures >= 3 OR asked > 0"""
)
def failures_timed_out(spark, sf_dir):
    """When models are out: for two hours after the third failure of a day, or as long as an answer asks."""
    return P.timed_out(attempts_of(t(spark, sf_dir, "events")), ["model"], "ts", 3, 86_400, 7_200)


def attempts_of(events):
    return events.select((F.col("user_id") % 40).alias("model"), "ts", (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") > 90, 3600).alias("retry_after"))
