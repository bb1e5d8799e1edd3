"""Queries of sources, sinks, keyed tables and small reports. Those that write use the shared folder. Registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import exclusions as X
from weftline.operators import reports as R
from weftline.operators import review as RV
from weftline.operators import upsert as U
from weftline.plans.queries import query, t
from weftline.plans.texts import pick, pick_sql
from weftline.shared import Scratch
from weftline.sources import sheets as SH
from weftline.sources import tables as T
from weftline.sources.paged import before_the_end, stored_pages
from weftline.streaming import resume

# ---------------------------------------------------------------- files


@query(
    "SELECT lower(p_name) AS name_en, p_partkey::VARCHAR AS product_id, 's' || p_partkey AS store_product_id, coalesce(CASE WHEN p_size % 2 = 0 THEN 'a \"b\", c' END, '') AS company, p_retailprice::VARCHAR AS sale_price, '' AS discount, '' AS name_ar, '' AS retail_price, '' AS available_quantity, '' AS products_count FROM part"
)
def export_round_trip(spark, sf_dir):
    """Products in the export's fields, written as tab text and read again: quotes, commas and nulls come through."""
    p = t(spark, sf_dir, "part")
    d = p.select(F.lower("p_name").alias("name_en"), F.col("p_partkey").alias("product_id"), F.concat(F.lit("s"), "p_partkey").alias("store_product_id"), F.when(F.col("p_size") % 2 == 0, 'a "b", c').alias("company"), F.col("p_retailprice").alias("sale_price"), F.lit(1).alias("_private"))
    path = Scratch(spark).path("export")
    T.write_text_table(T.export_rows(d), path, sep="\t")
    return T.blanks_for_nulls(T.read_text_table(spark, path, sep="\t"))


@query(
    """WITH x AS (SELECT p_partkey AS k, lower(p_name) AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE (p_partkey % 40)::VARCHAR END AS code, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE p_size END AS q FROM part)
SELECT code, name, q::INT AS qty FROM x WHERE q >= 1"""
)
def demand_workbook(spark, sf_dir):
    """A demand list as workbooks: title rows before the header, Arabic headers, codes ending in .0, quantities with commas."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(k % 40, F.lit(".0")))
    qty = F.when(k % 4 == 0, "x").when(k % 4 == 1, "1,000").otherwise(F.col("p_size").cast("string"))
    rows = p.select(code.alias("كود الصنف"), F.concat(F.lit(" "), F.lower("p_name")).alias("اسم الصنف"), F.lit("note").alias("note"), qty.alias("الكمية"))
    path = Scratch(spark).path("demand")
    SH.write_workbooks(rows, path, above=[["Demand of the day"], [None, "two"]], most_rows=10_000)
    return SH.read_demand(spark, path).select("code", "name", "qty")


@query("SELECT 'k' || p_partkey AS code, p_name AS name, 1 AS qty FROM part")
def match_only_workbook(spark, sf_dir):
    """A list without quantities: each row asks for one."""
    path = Scratch(spark).path("items")
    SH.write_workbooks(t(spark, sf_dir, "part").select(F.concat(F.lit("k"), "p_partkey").alias("code"), F.col("p_name").alias("name")), path, order=[F.col("code")])
    return SH.read_demand(spark, path, match_only=True).select("code", "name", "qty")


@query("SELECT * FROM (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation) UNION ALL BY NAME SELECT * FROM (SELECT r_regionkey AS k, r_name, r_regionkey::VARCHAR || 'x' AS note FROM region)")
def evolving_append(spark, sf_dir):
    """Two appends with different columns to one table; old files stay as they are."""
    path = Scratch(spark).path("appends")
    T.append_evolving(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), path)
    T.append_evolving(t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name", F.concat("r_regionkey", F.lit("x")).alias("note")), path)
    return T.read_evolving(spark, path)


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier")
def worker_merge(spark, sf_dir):
    """Files of three workers under the union of their columns."""
    s, scratch, paths = t(spark, sf_dir, "supplier"), Scratch(spark), []
    for k in range(3):
        paths.append(scratch.path(f"worker_{k}"))
        part = s.filter(F.col("s_suppkey") % 3 == k)  # a worker's share
        T.write_text_table(part.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")) if k == 0 else part.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), paths[-1])
    return T.merge_worker_parts(spark, paths).select("id", "name", "nation")


@query(
    """WITH f AS (SELECT user_id % 25 AS part, string_agg(event_id || ' ' || props || chr(10), '' ORDER BY event_id) AS text FROM events GROUP BY ALL)
SELECT part, text, coalesce(sum(strlen(text)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f"""
)
def text_merge(spark, sf_dir):
    """Workers' text files as one: where each begins in the merged text. The parts that are written, one after another, are that text."""
    scratch = Scratch(spark)
    e = t(spark, sf_dir, "events").select(F.format_string("%02d", F.col("user_id") % 25).alias("part"), "event_id", F.concat_ws(" ", "event_id", "props").alias("line"))
    path = scratch.path("texts")
    e.repartition("part").sortWithinPartitions("part", "event_id").select("part", "line").write.partitionBy("part").text(path)
    d = T.merge_texts(spark, path)
    return d.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "text", "start")


@query("SELECT user_id::VARCHAR AS item_code, event_type AS item_name, user_id || '::' || event_type AS item_key, max(event_id) AS line FROM events GROUP BY ALL")
def jsonl_candidates(spark, sf_dir):
    """JSON lines, appended to in the order of time; the last line of each item holds."""
    path = Scratch(spark).path("candidates")
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_code"), F.col("event_type").alias("item_name"), F.col("event_id").alias("line"))
    e.repartitionByRange("line").sortWithinPartitions("line").write.json(path)
    return T.last_candidates(spark, path).select("item_code", "item_name", "item_key", "line")


@query(
    """WITH q AS (SELECT 0 AS k, '' AS c UNION ALL SELECT i, chr(64 + i::INT) FROM range(1, 27) r(i) UNION ALL SELECT 26 + i, substr('ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئى', i::INT, 1) FROM range(1, 36) r(i)),
f AS (SELECT p_partkey, k, c FROM part JOIN q ON c = '' OR starts_with(upper(p_name), c) OR contains(upper(p_name), ' ' || c))
SELECT p_partkey, count(*) AS queries, min(k) FILTER (WHERE c <> '')::INT AS first_ord, arg_min(c, k) FILTER (WHERE c <> '') AS first_query FROM f GROUP BY p_partkey"""
)
def catalogue_fan_out(spark, sf_dir):
    """Which of the listing's queries find each product, by the letters its words begin with; the first of them brings it."""
    found = T.found_by_queries(t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    named = F.col("query") != ""
    return found.groupBy("p_partkey").agg(F.count("*").alias("queries"), F.min(F.when(named, F.col("query_ord"))).alias("first_ord"), F.min_by("query", F.when(named, F.col("query_ord"))).alias("first_query"))


@query(
    """WITH x AS (SELECT user_id % 5 AS q, event_id % 30 AS page, event_id FROM events), n AS (SELECT x.*, CASE WHEN q % 3 = 1 THEN 7 ELSE 20 + q END AS stop FROM x)
SELECT 'q ' || q AS query, page::INT AS page, count(*) AS listed, min(event_id) AS first_id, max(event_id) AS last_id FROM n WHERE page < stop GROUP BY ALL"""
)
def paged_catalogue(spark, sf_dir):
    """Stored pages of each query up to its first empty one, or its last by the answer's own count, read by ranges of pages."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("q"), (F.col("event_id") % 30).alias("page"), "event_id")
    names = F.transform(F.array_sort(F.collect_list("event_id")), lambda k: F.struct(k.cast("string").alias("productNameEn")))
    body = F.to_json(F.struct(F.when((F.col("q") % 3 == 1) & (F.col("page") == 7), F.array().cast("array<struct<productNameEn:string>>")).otherwise(names).alias("data"), (20 + F.col("q")).alias("totalPages")))
    path = Scratch(spark).path("pages")
    e.groupBy("q", "page").agg(body.alias("payload")).select(F.concat(F.lit("q "), "q").alias("query"), "page", "payload").write.partitionBy("query", "page").text(path)
    d = before_the_end(stored_pages(spark, path, pages_a_task=16, most_pages=32))
    d = T.payload_rows(d, "payload").select("query", "page", F.col("name_en").cast("long").alias("id"))
    return d.groupBy("query", "page").agg(F.count("*").alias("listed"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, max(event_id // 2000) AS batch, count(*) AS seen FROM events GROUP BY user_id")
def resumed_upsert(spark, sf_dir):
    """Batches that come again change nothing: each user's newest row, the batch that brought it, and how many rows came."""
    table, schema = Scratch(spark).path("saved"), "user_id long, event_id long, event_type string"
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / 2000).alias("part"))
    resume.append_many_once(e, table, "part")
    resume.append_many_once(e.filter("part % 2 = 0"), table, "part")
    rows = resume.read(spark, table, schema)
    return rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.max("batch").alias("batch"), F.count("*").alias("seen"))


@query("SELECT to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey})::VARCHAR AS snapshot FROM nation")
def json_snapshots(spark, sf_dir):
    return t(spark, sf_dir, "nation").select(T.snapshot_json(["n_regionkey", "n_name", "n_nationkey"]).alias("snapshot"))


@query(
    """SELECT user_id::VARCHAR AS item_code_key, event_type AS item_name_key, event_id AS seq, 's' || event_id % 7 AS correct_store_product_id FROM events WHERE value > 30 AND event_id % 7 > 0
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""
)
def accepted_hints(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    d = e.select(F.col("user_id").cast("string").alias("item_code_key"), F.col("event_type").alias("item_name_key"), F.col("event_id").alias("seq"), F.when(F.col("value") > 30, 1).otherwise(0).alias("approved"), F.when(k == 0, " nan ").otherwise(F.concat(F.lit("s"), k)).alias("correct_store_product_id"))
    return T.accepted_hints(d).select("item_code_key", "item_name_key", "seq", "correct_store_product_id")


@query(
    """WITH x AS (SELECT event_id AS seq, user_id % 50 AS k, event_type AS n FROM events)
SELECT k::VARCHAR AS item_code_key, '' AS item_name_key, max(seq) AS seq, arg_min(n, seq) AS item_code, arg_min(n || '!', seq) AS item_name, min(seq) AS created_at, arg_max(n, seq) AS decision FROM x GROUP BY k"""
)
def decision_store(spark, sf_dir):
    """Old decisions, then new ones put in: the newest of each key, under its first names and time."""
    e = t(spark, sf_dir, "events")
    d = e.select((F.col("user_id") % 50).cast("string").alias("item_code_key"), F.lit("").alias("item_name_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("item_code"), F.concat("event_type", F.lit("!")).alias("item_name"), F.col("event_id").alias("created_at"), F.col("event_type").alias("decision"))
    return T.save_decisions(d.filter("seq % 2 = 0"), d.filter("seq % 2 = 1"))


@query("SELECT max_by('f' || event_id, ts) AS path FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def newest_report(spark, sf_dir):
    """The newest report that is not too old."""
    e = t(spark, sf_dir, "events")
    files = e.select(F.concat(F.lit("f"), "event_id").alias("path"), F.col("ts").alias("modificationTime"))
    return T.newest_within(files, F.lit(e.agg(F.max("ts")).first()[0]), 3600)


@query("SELECT user_id, arg_max('run_' || event_id || '/summary.csv', {'ts': ts, 'p': 'run_' || event_id || '/summary.csv'}) AS path FROM events WHERE event_type <> 'view' GROUP BY user_id")
def newest_of_files(spark, sf_dir):
    """Of each run's files the last written; of those written at one time the last by name."""
    e = t(spark, sf_dir, "events").filter("event_type <> 'view'")
    return T.newest_by(e.select("user_id", F.concat(F.lit("run_"), "event_id", F.lit("/summary.csv")).alias("path"), F.col("ts").alias("modificationTime")), ["user_id"])


# ---------------------------------------------------------------- keyed tables

_CODES = [" A1.0", "a1", None, "B 2", "nan", "c3"]


@query(
    f"""WITH x AS (SELECT p_partkey, regexp_replace(lower(trim(coalesce({pick_sql("p_size", _CODES)}, ''))), '\\.0$', '') AS c, lower(trim(p_name)) AS n, p_partkey % 7 = 0 AS blank FROM part),
y AS (SELECT p_partkey, CASE WHEN c IN ('nan', 'none') THEN '' ELSE c END AS c, CASE WHEN blank THEN '' ELSE n END AS n FROM x)
SELECT p_partkey FROM y WHERE c <> '' OR n <> '' QUALIFY row_number() OVER (PARTITION BY c, n ORDER BY p_partkey) = 1"""
)
def items_once(spark, sf_dir):
    """Items once by normalised code and name; those with neither go."""
    p = t(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_size"), _CODES).alias("code"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.initcap("p_name")).alias("name"))
    return U.distinct_items(p, "p_partkey").select("p_partkey")


@query(f"SELECT min(p_partkey) AS p_partkey FROM (SELECT p_partkey, lower(trim(coalesce({pick_sql('p_size', _CODES)}, ''))) AS c, p_name AS n FROM part WHERE p_partkey % 7 > 0) GROUP BY c, n")
def names_once(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_size"), _CODES).alias("code"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.initcap("p_name"), F.lit(" "))).alias("name"))
    return U.distinct_names(p, "p_partkey").select("p_partkey")


@query(
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS n, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS s, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size::VARCHAR END AS p FROM part)
SELECT min(p_partkey) AS p_partkey, count(*) AS copies FROM x WHERE n <> '' OR s <> '' OR p <> '' GROUP BY n, CASE WHEN s <> '' THEN s ELSE p END"""
)
def export_rows_once(spark, sf_dir):
    """Export rows once by names and id; rows that are all blank go."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("name_ar"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_name")).alias("name_en"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("store_product_id"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_size").cast("string")).alias("product_id"))
    return U.distinct_export_rows(p, "p_partkey").select("p_partkey", "copies")


@query("SELECT count(*) - count(DISTINCT lower(p_name) || p_type) AS removed FROM part")
def removed_duplicates(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"), "p_type")
    return U.removed(p, U.keep_first(p, ["n", "p_type"], "p_partkey"))


@query(
    "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = orders.o_custkey AND b.o_orderstatus = 'P')"
)
def add_and_remove(spark, sf_dir):
    """A list of prevented items: new ones added where they are absent, others taken out."""
    o = t(spark, sf_dir, "orders")
    known = t(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select("c_custkey")
    new = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    gone = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return U.remove_keys(U.add_if_absent(known, new, ["c_custkey"]), gone, ["c_custkey"])


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def row_set_union(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return U.union_distinct(li.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")), li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")))


@query("SELECT p_partkey, array_to_string(list_concat(['first', p_type], list_filter(string_split(p_name, ' '), lambda x: x <> 'first' AND x <> p_type)), '|') AS queries FROM part")
def queries_prepended(spark, sf_dir):
    q = U.prepend_distinct(F.array(F.lit("first"), "p_type"), F.concat(F.split("p_name", " "), F.array(F.lit("first"))))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(q, "|").alias("queries"))


@query("SELECT event_id FROM events WHERE event_id >= 9000")
def rows_after(spark, sf_dir):
    return U.after_row(t(spark, sf_dir, "events"), 9000, "event_id").select("event_id")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id AND l.quality = 1)")
def undecided_items(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.concat("user_id", F.lit(".0")).alias("code"), F.lit("An Item").alias("name"))
    saved = t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("code_key"), F.lit("AN ITEM").alias("name_key"))
    return X.without_decisions(e, saved).select("event_id")


@query(
    """WITH m AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS t FROM events WHERE event_type <> 'view' GROUP BY user_id), i AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'CLICK' ELSE 'mine' END AS n FROM events GROUP BY user_id)
SELECT user_id AS item_id, array_to_string(list_concat([n], list_filter(coalesce(t, []), lambda x: x <> lower(n))), '|') AS names FROM i LEFT JOIN m USING (user_id)"""
)
def cart_removal_names(spark, sf_dir):
    """Names under which an item may stand in the cart."""
    e = t(spark, sf_dir, "events").withColumnRenamed("user_id", "item_id")
    items = e.select("item_id").distinct().withColumn("name", F.when(F.col("item_id") % 2 == 0, "CLICK").otherwise("mine"))
    d = X.removal_names(items, e.filter("event_type <> 'view'").select("item_id", F.col("event_type").alias("product_name")))
    return d.select("item_id", F.array_join("names", "|").alias("names"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS lang, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def decisions_overlaid(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(-1).alias("quality"))
    s = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"), "quality")
    return RV.overlay_decisions(d, s, ["doc_id"], ["lang", "quality"])


# ---------------------------------------------------------------- reports


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS matched, count(*) FILTER (lang IS NULL OR lang <> 'en') AS not_matched, round_even(count(*) FILTER (lang = 'en') * 100.0 / count(*), 1)::DOUBLE AS matched_pct FROM documents")
def match_totals(spark, sf_dir):
    return R.match_stats(t(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "x").alias("matched_name")))


@query("SELECT value, count(*) AS n FROM (SELECT coalesce(trim(CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN ' ' || source END), '') AS value FROM documents) GROUP BY value")
def value_counts_with_null(spark, sf_dir):
    k = F.col("doc_id") % 3
    v = F.when(k == 0, F.col("lang")).when(k == 1, F.concat(F.lit(" "), "source"))
    return R.distribution(t(spark, sf_dir, "documents").select(v.alias("v")), "v")


@query("SELECT CASE WHEN user_id % 4 < 2 THEN 'brand_index' WHEN user_id % 4 = 2 THEN 'token_set_ratio' ELSE 'no_match' END AS method, count(*) AS n FROM events GROUP BY 1")
def method_counters(spark, sf_dir):
    m = pick(F.col("user_id"), ["component_index", "brand_index", "token_set_ratio", "no_match"])
    return R.method_counts(t(spark, sf_dir, "events").select(m.alias("m")), "m")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS corrected, count(*) FILTER (quality IS NULL OR quality <> 1) AS remaining FROM labels")
def review_progress(spark, sf_dir):
    return RV.progress(t(spark, sf_dir, "labels"), F.col("quality") == 1)


@query("SELECT user_id, event_type AS field, round(sum(greatest(coalesce(CASE WHEN event_id % 5 > 0 THEN value - 20 END, 0), 0)), 4) AS seconds FROM events GROUP BY ALL")
def timing_sums(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), F.when(F.col("event_id") % 5 > 0, F.col("value") - 20).alias("v"))
    return R.timing_totals(e, ["user_id"], "field", "v").withColumn("seconds", F.round("seconds", 4))


@query("SELECT user_id, bool_or(event_type = 'error' AND value > 90) AS any_missing, count(*) FILTER (event_type = 'error' AND value > 90) AS n FROM events GROUP BY user_id")
def any_diagnostic(spark, sf_dir):
    """Whether any diagnostic of an item says that an identity is missing."""
    says = F.when((F.col("event_type") == "error") & (F.col("value") > 90), "English name missing requested identity token").otherwise("fine")
    return R.any_says(t(spark, sf_dir, "events").withColumn("d", says), ["user_id"], "d", "missing requested identity")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_first(spark, sf_dir):
    return R.row_range(t(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 1, 50).select("event_id")


@query(
    """SELECT path, type, count(*) AS n FROM (SELECT unnest([{'path': 'a', 'type': 'OBJECT'}, {'path': 'a.b', 'type': 'BIGINT'}, {'path': 'a.c', 'type': CASE WHEN user_id % 2 = 0 THEN 'STRING' ELSE 'VOID' END}, {'path': 'l', 'type': 'ARRAY'}, {'path': 'l[]', 'type': 'OBJECT'}, {'path': 'l[].x', 'type': 'BOOLEAN'}, {'path': 'l[]', 'type': 'BIGINT'}], recursive := true) FROM events) GROUP BY ALL"""
)
def nested_census(spark, sf_dir):
    """Every dotted path of nested payloads."""
    c = F.when(F.col("user_id") % 2 == 0, '"s"').otherwise("null")
    body = F.concat(F.lit('{"a": {"b": '), "user_id", F.lit(', "c": '), c, F.lit('}, "l": [{"x": true}, 7]}'))
    return R.field_census(t(spark, sf_dir, "events").select(body.alias("p")), "p")


@query(
    """SELECT event_id, 'matching' AS step, 'component' AS phase, CASE WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS decision, 'c' || user_id AS candidate_name, '' AS ai_result, '' AS final_match FROM events"""
)
def trace_row_builder(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumns({"drug_code": F.col("event_id"), "drug_name": F.lit("x"), "seq": F.col("event_id")})
    d = R.trace_rows(e, "matching", "component", F.when(F.col("value") > 50, "accepted").otherwise("rejected"), candidate_name=F.concat(F.lit("c"), "user_id"))
    return d.select(F.col("drug_code").alias("event_id"), "step", "phase", "decision", "candidate_name", "ai_result", "final_match")


@query(
    """SELECT event_id, event_type <> 'error' AS ai_enabled, CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS ai_status, true AS ai_verified, event_id % 2 = 0 AS ai_searched, event_id % 3 = 0 AS ai_reviewed, CASE WHEN event_id % 3 = 0 THEN value END AS ai_review_confidence,
 CASE WHEN user_id % 2 = 0 THEN 'm1' WHEN event_id % 2 = 0 THEN 'm2' WHEN event_id % 3 = 0 THEN 'm3' ELSE '' END AS ai_model, 'p' AS ai_provider FROM events"""
)
def ai_summary_fields(spark, sf_dir):
    k = F.col("event_id")
    one = lambda model: F.struct(F.col("value").alias("confidence"), model.alias("model_used"), F.lit("p").alias("provider_used"))
    e = t(spark, sf_dir, "events").withColumns({"v": one(F.when(F.col("user_id") % 2 == 0, "m1").otherwise("")), "s": F.when(k % 2 == 0, one(F.lit("m2"))), "r": F.when(k % 3 == 0, one(F.lit("m3")))})
    return e.select("event_id", *RV.ai_fields(F.when(F.col("event_type") != "error", F.col("event_type")), F.col("v"), F.col("s"), F.col("r")))


@query(
    """SELECT p.p_partkey AS item_id, upper(p_name) AS item_name, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'fallback' END) AS matched_product_name_en, '' AS matched_product_name_ar, p_size AS winner_product_id, 's' || p_size AS winner_store_product_id, p_size * 2 AS winner_available_quantity,
 p_retailprice::VARCHAR AS winner_sale_price, 7.5::DOUBLE AS winner_purchase_price, 'b' AS store_1, '20%' AS discount_1, 'a' AS store_2, '5%' AS discount_2, p_size % 3 <> 0 AS matched, p_size % 3 <> 0 AND p_size % 5 = 0 AS blocked_match, 'q1 | q2' AS queries, p_size / 10.0 AS elapsed_seconds FROM part p"""
)
def order_result_rows(spark, sf_dir):
    """The wide row of an item: itself, its match, the stores chosen, queries and times."""
    p = t(spark, sf_dir, "part")
    candidate = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name_en"), F.lit("fallback").alias("name_en_fallback"), F.lit(None).cast("string").alias("name_ar"), F.col("p_size").alias("product_id"), F.concat(F.lit("s"), "p_size").alias("store_product_id"), (F.col("p_size") * 2).alias("available_quantity"), F.lit(None).cast("double").alias("retail_price"), F.col("p_retailprice").alias("public_price"), F.lit(1.0).alias("price"), F.lit(2.0).alias("selling_price"), F.lit(7.5).alias("sale_price"))
    items = p.select(F.col("p_partkey").alias("item_id"), F.upper("p_name").alias("item_name"))
    won = p.select(F.col("p_partkey").alias("item_id"), candidate.alias("winner"), F.lit("a | b").alias("stores"), F.lit("5% | 20%").alias("discounts"), (F.col("p_size") % 3 != 0).alias("found"), (F.col("p_size") % 5 == 0).alias("review"))
    tail = p.select(F.col("p_partkey").alias("item_id"), F.array(F.lit("q1"), F.lit("q2")).alias("queries"), (F.col("p_size") / 10).alias("elapsed_seconds"))
    return RV.order_results(items, won, tail, stores=2).select(
        *("item_id item_name matched_product_name_en matched_product_name_ar winner_product_id winner_store_product_id winner_available_quantity winner_sale_price winner_purchase_price store_1 discount_1 store_2 discount_2 matched blocked_match queries elapsed_seconds").split()
    )


@query("SELECT c_custkey, floor((row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) / 50)::BIGINT + 1 AS page, repeat(c_name || c_mktsegment, 12) AS payload FROM customer")
def paginate_wide(spark, sf_dir):
    """Pages whose rows carry wide columns that the order doesn't know."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.repeat(F.concat("c_name", "c_mktsegment"), 12).alias("payload"))
    return R.pages(c, [F.desc("c_acctbal"), F.asc("c_custkey")]).drop("c_acctbal")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, ntile(7) OVER (ORDER BY o_orderdate, o_orderkey)::INT AS chunk FROM orders")
def chunk_assignment_wide(spark, sf_dir):
    d = R.chunks(t(spark, sf_dir, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 7)
    return d.select("o_orderkey", "o_orderpriority", "o_totalprice", "chunk")


@query("SELECT o_orderkey, l.lines::BIGINT AS lines FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey")
def bucketed_lookup(spark, sf_dir):
    """Orders against a stored table of what was decided about them, which keeps its buckets: only the orders move."""
    scratch = Scratch(spark)
    li = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    saved = li.select(F.col("l_orderkey").cast("string").alias("code_key"), F.concat(F.lit("ORDER "), F.col("l_orderkey") % 7).alias("name_key"), "lines")
    name = "decisions_" + scratch.root.rsplit("-", 1)[1]
    store = T.bucketed(saved, name, scratch.path("decisions"), max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    items = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"), F.concat(F.lit(" order "), F.col("o_orderkey") % 7).alias("name"))
    return X.with_decisions(items, store).select("o_orderkey", "lines")
