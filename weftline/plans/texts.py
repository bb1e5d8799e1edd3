"""Queries of the text functions: names in Arabic, makers, payloads, answers of models. Registered beside those of `queries`.

Sample values stand in a list and are picked by a key, alike in Spark and in SQL; what SQL gives is worked out from them by
its own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions import similarity as S
from weftline.functions import verdict as V
from weftline.functions import words as W
from weftline.functions.parse import parse_distinct
from weftline.operators import allocate as A
from weftline.operators import gates as G
from weftline.operators import providers as P
from weftline.operators import review as RV
from weftline.operators import scoring as SC
from weftline.plans.queries import _in, query, r6, sql_normalize, t

SPACE = r"[ \t\n\x0B\f\r]+"


def pick(key: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_text(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def pick_sql(key: str, values: list) -> str:
    return f"([{', '.join(map(sql_text, values))}])[({key}) % {len(values)} + 1]"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


ARABIC = ["إبْرَة أحمد", "آلةُ  ٱلقياس", "دواء-مستورد (جديد)", "قهوى شؤون مئة", "كريم 50 جم!", "Plain_text 5", "  حقنة؛ وريد  ", ""]
TERMS = ["كريم ٥٠ جم", "شراب ١٢٠ مل", "لبن ٤٠٠ جرام", "دواء ٢٠ قرص ٥ مجم", "نقط ١٠ مللي", "مرهم جيل بخاخ", "امبول فيال كبسول", "حليب ٩ دهان"]
_LETTERS = r"\p{L}\p{N}\p{M}_\x{0600}-\x{06FF}"


def _terms_sql(x: str) -> str:
    case = " ".join(f"WHEN t IN ({_in([a for a in arabic.split('|') if ' ' not in a and chr(92) not in a])}) THEN '{english}'" for english, arabic in W.ARABIC_TERMS.items() if any(" " not in a and chr(92) not in a for a in arabic.split("|")))
    return f"array_to_string(list_transform(string_split(translate({x}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), ' '), lambda t: CASE {case} ELSE t END), ' ')"


@query(
    f"""WITH x AS (SELECT p_partkey, {pick_sql("p_partkey", ARABIC)} AS a, {pick_sql("p_partkey", TERMS)} AS b FROM part)
SELECT p_partkey, {squeeze_sql(f"regexp_replace(translate(regexp_replace(trim(a), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), 'إأآٱىؤئة', 'اااايويه'), '[^{_LETTERS} ]', ' ', 'g')")} AS normal, {_terms_sql("b")} AS terms,
 {squeeze_sql(f"regexp_replace(trim(a), '[^{_LETTERS}]+', ' ', 'g')")} AS display, {squeeze_sql(r"regexp_replace(a, '[^\x{0600}-\x{06FF}() ]', '', 'g')")} AS store FROM x"""
)
def arabic_names(spark, sf_dir):
    """Normal form, English terms, display form and store name of Arabic texts."""
    k = F.col("p_partkey")
    a, b = pick(k, ARABIC), pick(k, TERMS)
    return t(spark, sf_dir, "part").select("p_partkey", N.normalize_arabic(a).alias("normal"), N.squeeze(N.arabic_terms(b)).alias("terms"), N.arabic_display(a).alias("display"), N.store_name(a).alias("store"))


@query(
    f"""SELECT doc_id, md5(lower({squeeze_sql("text")})) AS header, md5(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]', '', 'g')) AS label, left(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), 48) AS dom,
 coalesce(nullif(nullif(lower(trim(lang)), 'en'), ''), 'none') AS lang FROM documents"""
)
def labels_of_texts(spark, sf_dir):
    """Header, file label and page id of whole texts; a language of `en` or blank reads as none."""
    d = t(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") == "en", "NaN").otherwise(F.col("lang"))
    x = F.col("text")
    return d.select("doc_id", F.md5(N.header_name(x)).alias("header"), F.md5(N.file_label(x)).alias("label"), N.dom_id(x).alias("dom"), F.coalesce(N.blank_to_null(lang), F.lit("none")).alias("lang"))


COMPANIES, SUPPLIERS = [None, "", "Eva Pharma co", "GSK-Egypt", None], [None, "pharco 2 ltd", ""]
_SAVED = "p_name || ' ' || p_size || 'mg ' || " + pick_sql("p_partkey", ["", "extra tab", "new words here", "mg"])
_NOW = pick_sql("p_partkey // 4", ["'same'", "'other'"])


@query(
    f"""WITH x AS (SELECT p_partkey, p_name || ' ' || p_size || ' tab' AS name, {pick_sql("p_partkey", COMPANIES)} AS company, {pick_sql("p_partkey", SUPPLIERS)} AS supplier, {_SAVED} AS saved,
 CASE WHEN p_partkey % 8 < 5 THEN p_name ELSE 'else' END || ' ' || p_size || 'mg' AS current, string_split(p_name, ' ') AS w, list_transform(string_split(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END, ' '), lambda y: lower(y) || 's') AS v FROM part),
n AS (SELECT *, {sql_normalize("coalesce(company, '')")} AS c, {sql_normalize("coalesce(supplier, '')")} AS s, string_split({sql_normalize("name")}, ' ') AS nw, list_distinct(list_filter(string_split({sql_normalize("saved")}, ' '), lambda y: y <> '')) AS sw, list_distinct(string_split({sql_normalize("current")}, ' ')) AS cw FROM x)
SELECT p_partkey, CASE WHEN c <> '' THEN string_split(c, ' ')[1] WHEN s <> '' THEN string_split(s, ' ')[1] ELSE list_filter(nw, lambda y: NOT regexp_full_match(y, '[0-9]+') AND y NOT IN ({_in(W.GENERIC_TOKENS)}))[-1] END AS maker,
 len(list_intersect(sw, cw)) / greatest(len(sw), len(cw), 1) < 0.5 AS renamed,
 len(list_filter(w, lambda a: len(a) >= 4 AND len(list_filter(v, lambda b: len(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a)))) > 0)) > 0 AS alike FROM n"""
)
def maker_and_name_changes(spark, sf_dir):
    """Makers from company, supplier or name; names that changed; words that are alike."""
    k = F.col("p_partkey")
    p = t(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" "), "p_size", F.lit(" tab"))
    saved = F.concat("p_name", F.lit(" "), "p_size", F.lit("mg "), pick(k, ["", "extra tab", "new words here", "mg"]))
    current = F.concat(F.when(k % 8 < 5, F.col("p_name")).otherwise("else"), F.lit(" "), "p_size", F.lit("mg"))
    other = F.transform(F.split(F.when(k % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), " "), lambda w: F.concat(F.lower(w), F.lit("s")))
    d = p.select(k, N.candidate_manufacturer(name, pick(k, COMPANIES), pick(k, SUPPLIERS)).alias("maker"), N.major_name_change(saved, current).alias("renamed"), F.split("p_name", " ").alias("a"), other.alias("b"))
    return d.select("p_partkey", "maker", "renamed", S.any_alike(F.col("a"), F.col("b")).alias("alike"))


ASKED = ["Panadol500mg 2O tab", "Cream 50 gm", "plain name", "Vit C1000", "a1b 2"]
SHOWN = ["بانادول 500 مجم 20", "كريم 50 جم", "اسم", "فيتامين 1000 20", None, "حقنة 2"]


@query(
    rf"""WITH x AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({pick_sql("p_partkey", ASKED)}, '([0-9])[Oo]($|[^A-Za-z0-9])', '\1' || '0' || '\2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')) AS q,
 coalesce({pick_sql("p_partkey", SHOWN)}, '') AS a, CASE WHEN p_partkey % 3 = 0 THEN 'dom-row-' || p_size ELSE 's' || p_size END AS id FROM part),
y AS (SELECT *, list_distinct(regexp_extract_all(q, '([0-9]+)', 1)) AS asked, regexp_extract_all(a, '([0-9]+)', 1) AS there FROM x),
z AS (SELECT *, array_to_string(list_concat(list_filter(string_split(q, ' '), lambda w: NOT regexp_matches(w, '[0-9]')), there), ' ') AS made FROM y)
SELECT p_partkey, q AS query, len(asked) = 0 OR len(list_intersect(asked, there)) > 0 AS plausible, CASE WHEN (len(asked) > 0 AND len(list_intersect(asked, there)) = len(asked)) OR made = '' THEN q ELSE made END AS name,
 CASE WHEN starts_with(id, 'dom-row-') OR p_partkey % 5 = 0 THEN 'dom_fallback' ELSE 'site_api' END AS source FROM z"""
)
def page_rows(spark, sf_dir):
    """Rows of a page: whether they can be meant, the English name they get, and where a candidate came from."""
    k = F.col("p_partkey")
    q, a = pick(k, ASKED), pick(k, SHOWN)
    there = F.coalesce(a, F.lit(""))
    id_ = F.concat(F.when(k % 3 == 0, "dom-row-").otherwise("s"), "p_size")
    return t(spark, sf_dir, "part").select("p_partkey", N.fallback_query(q).alias("query"), N.plausible_row(there, q).alias("plausible"), N.synthetic_name(q, a).alias("name"), N.candidate_source(id_, k % 5 == 0).alias("source"))


ROUTE_TAILS = [" IM", " I M", " IV SC", " I V", " S C 5", "", " IM I V"]


@query(
    f"""WITH x AS (SELECT p_partkey, string_split(upper(p_name) || {pick_sql("p_partkey", ROUTE_TAILS)}, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(['IM', 'IV', 'SC'], lambda r: list_contains(w, r) OR (list_contains(w, r[1]) AND list_contains(w, r[2])))), '/') AS routes FROM x"""
)
def route_signals(spark, sf_dir):
    w = F.split(F.concat(F.upper("p_name"), pick(F.col("p_partkey"), ROUTE_TAILS)), " ")
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(N.routes(w)), "/").alias("routes"))


@query(
    """WITH x AS (SELECT p_partkey, p_partkey % 3 AS k, p_size, p_retailprice % 130 AS s FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 > 0 OR p_size % 2 > 0 THEN 1.0 ELSE -1.5 END::DOUBLE AS availability, least(s, 100)::DOUBLE AS shown,
 round(0.25::DOUBLE * least(1, greatest(0, s / 20)) + 0.22::DOUBLE * CASE WHEN k <> 2 THEN 1.0 ELSE 0.5 END + 0.22::DOUBLE * CASE WHEN k <> 1 THEN 1.0 ELSE 0.3 END + 0.13::DOUBLE * (p_partkey % 2 = 0)::INT + 0.05::DOUBLE * CASE WHEN p_size % 2 > 0 THEN 0.8 ELSE 0.4 END + 0.13::DOUBLE * (p_partkey % 5 <> 0)::INT, 6) AS confidence FROM x"""
)
def match_confidence(spark, sf_dir):
    """Availability bonus, score as shown, confidence of a match whose brand or strength may differ."""
    k = F.col("p_partkey")
    p, brand = t(spark, sf_dir, "part"), F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    asked = F.concat(brand, F.lit(" "), "p_size", F.lit(" MG 20 TABLETS"))
    got = F.concat(F.when(k % 3 == 2, "ZETA QUX").otherwise(brand), F.lit(" "), F.col("p_size") + F.when(k % 3 == 1, 1).otherwise(0), F.lit(" MG 20 TABLETS"))
    d = p.select(k, "p_size", (F.col("p_retailprice") % 130).alias("s"), asked.alias("a"), got.alias("b"))
    d = parse_distinct(parse_distinct(d, "a", "d"), "b", "m")
    sure = SC.confidence(F.col("s"), "d", "m", k % 2 == 0, F.col("p_size") % 2, k % 5 == 0)
    return d.select("p_partkey", SC.availability_bonus(F.col("p_size") % 3, F.col("p_size") % 2).cast("double").alias("availability"), SC.display_score(F.col("s")).alias("shown"), r6(sure).alias("confidence"))


@query(
    """WITH x AS (SELECT event_id, event_id % 7 AS k, user_id AS u FROM events)
SELECT event_id, CASE k WHEN 0 THEN u::VARCHAR WHEN 1 THEN u || '%' WHEN 2 THEN (u + 1)::VARCHAR WHEN 3 THEN 'a' || u WHEN 4 THEN round_even((200.0 - u % 50) / 200 * 0 + (u % 50) / 200.0 * 100, 2)::DOUBLE::VARCHAR END AS discount,
 CASE k WHEN 0 THEN 'storeProductId:' || u WHEN 1 THEN 'storeId:' || u WHEN 2 THEN 'id:' || u WHEN 3 THEN 'storeName:shop:' || event_id % 3 ELSE 'storeName::' || event_id % 3 END AS identity,
 CASE k WHEN 3 THEN 'shop' WHEN 5 THEN 'owner' WHEN 6 THEN 'firm' END AS company FROM x WHERE k <> 4 OR u % 50 > 0"""
)
def payload_offers(spark, sf_dir):
    """The first discount, the identity and the company that an offer's JSON gives, wherever it stands."""
    k, u = F.col("event_id") % 7, F.col("user_id").cast("string")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    body = (
        F.when(k == 0, s('{"discountPercent": ', u, ', "discount": 99, "storeProductId": "', u, '"}'))
        .when(k == 1, s('{"store": {"discount": "', u, '%"}, "storeId": "', u, '"}'))
        .when(k == 2, s('{"discount": {"percentage": ', (F.col("user_id") + 1).cast("string"), '}, "id": ', u, "}"))
        .when(k == 3, s('{"discount": "", "cashDiscount": "a', u, '", "storeName": "shop"}'))
        .when(k == 4, s('{"retailPrice": "200", "salePrice": ', (200 - F.col("user_id") % 50).cast("string"), "}"))
        .when(k == 5, F.lit('{"seller": {"name": "owner"}, "retailPrice": 5}'))
        .otherwise(F.lit('{"companyName": "firm", "store": {"name": "no"}}'))
    )
    d = t(spark, sf_dir, "events").filter((k != 4) | (F.col("user_id") % 50 > 0)).withColumn("body", body)
    return d.select("event_id", A.first_discount(F.col("body")).alias("discount"), A.offer_identity(F.col("body"), (F.col("event_id") % 3).cast("string")).alias("identity"), A.enrich_company(F.col("body")).alias("company"))


@query(
    """SELECT o_orderkey, CASE WHEN k = 0 OR a <= 0 THEN '' ELSE CASE WHEN b >= a THEN '+' ELSE '-' END || printf('%.2f', abs(b - a)) || ' (' || printf('%.1f', abs(b - a) / a * 100) || '%)' END AS delta
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, floor(o_totalprice) AS a, floor(o_totalprice) + (o_custkey % 64 - 32) * 0.25 AS b FROM orders)"""
)
def price_deltas(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    a = F.floor("o_totalprice").cast("double")
    old = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(a)
    return o.select("o_orderkey", F.coalesce(A.price_delta(old, a + (F.col("o_custkey") % 64 - 32) * 0.25), F.lit("")).alias("delta"))


RESETS = ["", "90", "1700003600", "2023-11-14T22:23:20Z", "soon", "0"]
QUOTAS = ["1,200", "3K", "2.5M", "x", None, " 7 "]


@query(
    f"""SELECT event_id, {pick_sql("event_id", ["", "1m 30s", "1h", "10m", "soon", "0s"])} AS reset, {pick_sql("event_id", [1200.0, 3000.0, 2500000.0, None, None, 7.0])}::DOUBLE AS quota,
 CASE WHEN event_id % 3 = 0 THEN 'a' || user_id WHEN event_id % 3 = 1 THEN 'b' || user_id ELSE '' END AS header FROM events"""
)
def quota_texts(spark, sf_dir):
    """How long until a limit resets, how much is left, and which header says so."""
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    a, b = F.when(k % 3 == 0, F.concat(F.lit(" a"), u)).otherwise(" "), F.when(k % 3 < 2, F.concat(F.lit("b"), u)).otherwise("")
    heads = F.create_map(F.lit("X-Limit-Left"), a, F.lit("x-left"), b)
    return t(spark, sf_dir, "events").select("event_id", V.reset_text(pick(k, RESETS), F.lit(1700000000)).alias("reset"), P.quota_number(pick(k, QUOTAS)).alias("quota"), P.first_header(heads, ["x-limit-left", "X-Left"]).alias("header"))


PHRASES = ["", " It is the Same Product.", " clearly a DIFFERENT DOSAGE, same brand", " identical", " mismatch"]
BODIES = ["", "Rate limit reached", "error: MODEL_NOT_FOUND", "x"]
STATUSES = [200, 429, 401, 404, 500, 400, 403]


@query(
    f"""WITH d AS (SELECT doc_id, lower(text || {pick_sql("doc_id", PHRASES)}) AS x, lower({pick_sql("doc_id", BODIES)}) AS b, {pick_sql("doc_id", STATUSES)} AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(x, '{"|".join(V.NO_PHRASES)}') THEN false ELSE regexp_matches(x, '{"|".join(V.YES_PHRASES)}') END AS correct,
 CASE WHEN s = 429 OR contains(b, 'rate limit') THEN 'rate_limited' WHEN s IN (401, 403) THEN 'auth_failed' WHEN s = 404 OR contains(b, 'model_not_found') THEN 'model_not_found' WHEN s >= 500 THEN 'server_error' WHEN s >= 400 THEN 'bad_request' ELSE '' END AS code FROM d"""
)
def answer_texts(spark, sf_dir):
    """What whole free texts say of a match, and what a failed call was."""
    k = F.col("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", V.infer_correct(F.concat("text", pick(k, PHRASES))).alias("correct"), V.api_error_code(pick(k, STATUSES), pick(k, BODIES)).alias("code"))


@query(
    """SELECT conv_id, turn, 'Turn ' || turn || ' of ' || conv_id || ': {role}' AS prompt, CASE WHEN turn % 3 = 0 THEN 'plain ' || conv_id WHEN turn % 3 = 1 THEN 'a' || conv_id || 'b' END AS content,
 CASE WHEN length(text) <= 6 THEN '***' ELSE '...' || right(text, 6) END AS masked, array_to_string(CASE WHEN turn % 2 = 0 THEN ['a', 'b'] ELSE [role] END, '|') AS parts FROM conversations"""
)
def prompt_texts(spark, sf_dir):
    """Templates filled, chat answers read, secrets masked, comma lists split."""
    c, k = t(spark, sf_dir, "conversations"), F.col("turn") % 3
    who = F.col("conv_id").cast("string")
    plain = F.concat(F.lit('{"choices": [{"message": {"content": "plain '), who, F.lit('"}}]}'))
    parts = F.concat(F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": "a'), who, F.lit('"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}'))
    body = F.when(k == 0, plain).when(k == 1, parts).otherwise('{"choices": []}')
    lists = F.when(F.col("turn") % 2 == 0, " a, b,,a ").otherwise(F.concat(F.lit(","), "role", F.lit(", ")))
    return c.select("conv_id", "turn", V.render("Turn {turn} of {conv}: {role}", {"turn": F.col("turn"), "conv": who}).alias("prompt"), V.response_content(body).alias("content"), V.mask(F.col("text")).alias("masked"), F.array_join(V.split_list(lists), "|").alias("parts"))


@query(
    """WITH x AS (SELECT event_id, event_type AS e, user_id % 7 - 1 AS best, value / 100 AS sure FROM events)
SELECT event_id, CASE WHEN e = 'error' THEN 'no_ai_result' WHEN e = 'click' THEN 'timeout' WHEN e = 'view' THEN 'invalid_json' WHEN best = 0 THEN 'best_index_0' WHEN sure < 0.9 THEN 'confidence_below_threshold' ELSE 'no_record' END AS failure,
 CASE WHEN best BETWEEN 1 AND 3 THEN ['x', 'y', 'z'][best] END AS candidate, CASE WHEN best BETWEEN 1 AND 3 THEN sure ELSE least(sure, 0.5) END AS confidence, CASE WHEN event_id % 2 = 0 THEN e WHEN event_id % 3 = 0 THEN 'second' ELSE '' END AS model FROM x"""
)
def search_failures(spark, sf_dir):
    """Why a search by a model found nothing, whom it chose, and which model it was."""
    e, best, sure = F.col("event_type"), F.col("user_id") % 7 - 1, F.col("value") / 100
    c = V.chosen_candidate(best.cast("string"), F.array(*map(F.lit, "xyz")), sure)
    d = t(spark, sf_dir, "events").select("event_id", V.search_failure(e != "error", F.when(e == "click", "timeout"), e == "view", best, sure).alias("failure"), c.alias("c"), V.first_filled(F.when(F.col("event_id") % 2 == 0, e), F.when(F.col("event_id") % 3 == 0, "second")).alias("model"))
    return d.select("event_id", "failure", "c.candidate", "c.confidence", "model")


@query(
    """WITH x AS (SELECT event_id, event_type = 'error' AS hit, CASE WHEN user_id % 2 = 0 THEN 'r' || user_id ELSE '' END AS after, CASE WHEN user_id % 3 = 0 THEN 'day' ELSE '' END AS day FROM events)
SELECT event_id, CASE WHEN hit AND after <> '' AND day = '' THEN after ELSE day END AS quota_reset_day, CASE WHEN hit AND after <> '' AND day = '' THEN 'in' ELSE '' END AS quota_reset_day_in, CASE WHEN hit AND after <> '' THEN 'in' ELSE '' END AS quota_reset_in, CASE WHEN hit THEN '0' ELSE '' END AS quota_remaining_day FROM x"""
)
def quota_hints_filled(spark, sf_dir):
    u = F.col("user_id")
    after = F.when(u % 2 == 0, F.concat(F.lit("r"), u)).otherwise("")
    d = t(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "x FreeUsageLimitError y").otherwise("other").alias("error_body"),
        after.alias("retry_after"),
        F.when(after != "", "in").otherwise("").alias("retry_after_in"),
        F.when(u % 3 == 0, "day").otherwise("").alias("quota_reset_day"),
        *(F.lit("").alias(c) for c in ("quota_reset_day_in", "quota_reset_in", "quota_remaining_day")),
    )
    return V.quota_hints(d).select("event_id", "quota_reset_day", "quota_reset_day_in", "quota_reset_in", "quota_remaining_day")


@query(
    """SELECT p_partkey, '7. ' || n || ' /  (score=' || printf('%.1f', p_size / 2.0) || ', 5 EGP)
   parsed: normalized=''' || n || ''', brand=''' || upper(replace(p_name, ' ', '')) || ''', dosage=' || p_size || ', qty=''20'', volume=''-'', weight=''-'', form=''TAB'', flavor=''-'', class=''medicine'', route=''' || CASE WHEN p_partkey % 2 = 0 THEN 'IM' ELSE '-' END || ''', imported=no'
 || CASE WHEN p_partkey % 3 = 0 THEN '
   rule_review: candidate entered AI review despite different_form; accept only if the products are truly equivalent' ELSE '' END AS line
FROM (SELECT *, upper(replace(p_name, ' ', '')) || ' ' || p_size || ' MG 20 TABLETS' || CASE WHEN p_partkey % 2 = 0 THEN ' IM' ELSE '' END AS n FROM part)"""
)
def candidate_lines(spark, sf_dir):
    """A candidate with its parsed parts as lines of a prompt."""
    k = F.col("p_partkey")
    name = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit(" "), "p_size", F.lit(" MG 20 TABLETS"), F.when(k % 2 == 0, " IM").otherwise(""))
    d = parse_distinct(t(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("n")), "n", "d", {"context": V.component_context("d")})
    why = F.when(k % 3 == 0, "different_form").otherwise("ok")
    return d.select("p_partkey", V.candidate_line(F.lit(7), F.col("n"), F.lit(None), F.col("p_size") / 2, F.lit(", 5 EGP"), F.col("context"), why).alias("line"))


_VERDICTS = ["ai_confirmed", "ai_corrected", "ai_found", "ai_rejected"]


@query(
    f"""WITH x AS (SELECT event_id, {pick_sql("event_id", _VERDICTS)} AS first, {pick_sql("user_id", ["ok", "", "different_form"])} AS why, event_id % 11 = 0 AS failed, event_type IN ('view', 'click') AS right_, value / 100 AS sure FROM events)
SELECT event_id, CASE WHEN failed THEN CASE WHEN right_ AND sure >= 0.75 THEN 'ai_confirmed' ELSE 'ai_review_rejected' END WHEN why NOT IN ('', 'ok') THEN 'ai_review_rejected' WHEN (first <> 'ai_rejected') = right_ THEN first || '_reviewed'
 WHEN sure < 0.75 THEN first || '_kept_low_confidence_review' WHEN first <> 'ai_rejected' THEN 'ai_review_rejected' ELSE 'ai_review_search' END AS state,
 CASE WHEN event_id % 6 = 0 THEN 'missing storeProductId' WHEN why <> 'ok' THEN 'component mismatch: ' || why ELSE '' END AS unsafe FROM x"""
)
def review_states(spark, sf_dir):
    """How a second review leaves a decision, and whether a model's choice is safe."""
    k, why = F.col("event_id"), pick(F.col("user_id"), ["ok", "", "different_form"])
    state = V.review_state(pick(k, _VERDICTS), why, k % 11 == 0, F.col("event_type").isin("view", "click"), F.col("value") / 100)
    return t(spark, sf_dir, "events").select("event_id", state.alias("state"), V.local_safety(F.when(k % 6 != 0, "s"), why).alias("unsafe"))


@query(
    """WITH x AS (SELECT p_partkey, p_partkey % 4 AS k, p_name || ' one two' AS saved, CASE WHEN p_size % 3 = 0 THEN 'quite another thing' ELSE p_name || ' one' END AS current FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'product id differs' WHEN k = 1 THEN 'manufacturer differs' WHEN current = 'quite another thing' THEN 'name differs' ELSE '' END AS problem,
 CASE WHEN k = 0 THEN 'Semantic token x' WHEN k = 1 THEN 'too low' WHEN k = 2 THEN 'Brand y' ELSE '' END AS rejection, k IN (0, 2) OR p_partkey % 7 = 0 AS skipped FROM x"""
)
def saved_matches(spark, sf_dir):
    """Whether a saved match still fits, and whether a new one saves itself."""
    k = F.col("p_partkey") % 4
    p = t(spark, sf_dir, "part")
    rejection = pick(F.col("p_partkey"), ["Semantic token x", "too low", "Brand y", ""])
    current = F.when(F.col("p_size") % 3 == 0, "quite another thing").otherwise(F.concat("p_name", F.lit(" one")))
    problem = RV.saved_match_problem(F.when(k != 3, "a"), F.when(k == 0, "b").when(k == 1, "a").otherwise(""), k == 1, F.concat("p_name", F.lit(" one two")), current)
    return p.select("p_partkey", problem.alias("problem"), rejection.alias("rejection"), RV.skips_auto_save(rejection, F.col("p_partkey") % 7 == 0).alias("skipped"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'p' || user_id ELSE 's' END AS id FROM events")
def orderable_ids(spark, sf_dir):
    k = F.col("event_id") % 3
    a = F.when(k == 0, " NaN ").when(k == 1, "").otherwise(" s ")
    b = F.when(k == 1, F.concat(F.lit("p"), "user_id")).otherwise("none")
    return t(spark, sf_dir, "events").select("event_id", G.orderable_id(a, b).alias("id"))
