"""Summaries of runs: counts, rates, distributions, histograms, timings, traces, pages, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import text
from weftline.shared import Scratch

# Statuses that a run summary counts.
STATUS_COUNTS = {"no_results": "no-results", "matched_but_unavailable": "matched-but-unavailable", "not_orderable": "not-orderable"}
AI_COUNTS = {"ai_verified": "ai_verified", "ai_searched": "ai_search_accepted", "ai_reviewed": "ai_review_rejected", "ai_rejected": "ai_rejected", "ai_low_confidence": "ai_low_confidence"}
TRACE_FIELDS = "step phase decision reject_rule ai_result candidate_name final_match error_stage error_code selection_reason provider_used model_used ai_model".split()
AI_RESULT_STEPS = ["ai_verify_result", "ai_search_result", "ai_review_result"]


def flag(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin("true", "1", "yes")


def quality_counts(summary: DataFrame) -> DataFrame:
    """One row of conditional counts, in one pass."""
    is_ = lambda c, v: F.trim(text(F.col(c))) == v
    review = flag(F.col("manual_review_required"))
    counts = {
        "total": F.lit(True),
        "auto_matched": flag(F.col("matched")) & ~review,
        "manual_review_required": review,
        "deterministic_matched": flag(F.col("deterministic_match_found")),
        **{k: is_("status", v) for k, v in STATUS_COUNTS.items()},
        **{k: is_("ai_status", v) for k, v in AI_COUNTS.items()},
    }
    return summary.agg(*(F.count_if(v).alias(k) for k, v in counts.items()))


def rate(part: Column, whole: Column) -> Column:
    """Per cent to one place, half to even; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part * 100.0 / whole, 1))


def distribution(df: DataFrame, value: str, blanks: bool = True) -> DataFrame:
    """value, n: most frequent first, then by value."""
    d = df.select(F.trim(text(F.col(value))).alias("value"))
    d = d if blanks else d.filter("value <> ''")
    return d.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def grouped_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of each dimension's non-blank values: one pass, each row unpivoted."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.trim(text(F.col(c))).alias("value")) for c in dimensions)))
    return df.select(rows.alias("r")).select("r.*").filter("value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def score_bucket(score: Column) -> Column:
    s = score.try_cast("double")
    return F.when(s >= 100, "100").when(s >= 95, "95-99").when(s >= 90, "90-94").when(s >= 80, "80-89").when(s >= 70, "70-79").when(s < 70, "<70")


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    return df.select(score_bucket(F.col(score)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def match_stats(df: DataFrame, name: str = "matched_name") -> DataFrame:
    hit = F.count_if(text(F.col(name)) != "")
    d = df.agg(F.count("*").alias("total"), hit.alias("matched"))
    return d.withColumns({"not_matched": F.col("total") - F.col("matched"), "matched_pct": rate(F.col("matched"), F.col("total"))})


def method_counts(df: DataFrame, method: str) -> DataFrame:
    """Component and brand hits are one kind."""
    kind = F.when(F.col(method).isin("component_index", "brand_index"), "brand_index").otherwise(F.col(method))
    return df.groupBy(kind.alias("method")).agg(F.count("*").alias("n"))


def seconds(c: Column) -> Column:
    return F.trim(text(c)).try_cast("double")


def unaccounted(elapsed: str, details: list[str]) -> Column:
    spent = reduce(lambda a, b: a + b, (F.coalesce(seconds(F.col(c)), F.lit(0.0)) for c in details))
    return F.greatest(F.lit(0.0), F.coalesce(seconds(F.col(elapsed)), F.lit(0.0)) - spent)


def timing_breakdown(df: DataFrame, elapsed: str, match: str, details: list[str]) -> DataFrame:
    """metric, value to three places; details that no row has are left out."""
    there = seconds(F.col(elapsed)).isNotNull()
    spent = lambda c: F.coalesce(F.avg(seconds(F.col(c))), F.lit(0.0))
    values = {
        "Average total seconds": spent(elapsed),
        "Average match seconds": spent(match),
        "Max total seconds": F.max(seconds(F.col(elapsed))),
        "Min total seconds": F.min(seconds(F.col(elapsed))),
        **{f"Average {c}": F.avg(seconds(F.col(c))) for c in details},
        "Average unaccounted seconds": F.coalesce(F.avg(F.when(there, unaccounted(elapsed, details))), F.lit(0.0)),
    }
    one = df.agg(*(F.bround(v, 3).alias(f"v{i}") for i, v in enumerate(values.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"v{i}").alias("value")) for i, k in enumerate(values))))
    return one.select(rows.alias("r")).select("r.*").filter("value is not null")


def slowest(df: DataFrame, elapsed: str, details: list[str], tie: str, most: int = 15) -> DataFrame:
    d = df.withColumns({"_s": seconds(F.col(elapsed)), "unaccounted_seconds": F.bround(unaccounted(elapsed, details), 3)})
    return d.filter("_s is not null").orderBy(F.desc("_s"), F.asc(tie)).limit(most).drop("_s")


def any_says(df: DataFrame, keys: list[str], column: str, phrase: str) -> DataFrame:
    """Whether any diagnostic of a key holds a phrase, and how many do."""
    hit = F.contains(text(F.col(column)), F.lit(phrase))
    return df.groupBy(*keys).agg(F.bool_or(hit).alias("any_missing"), F.count_if(hit).alias("n"))


def timing_totals(df: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """Sums of non-negative seconds by key and timing field."""
    return df.groupBy(*keys, field).agg(F.sum(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))).alias("seconds"))


def ai_outcome(result: Column) -> Column:
    """What an AI result says of the match: matched, rejected or empty. Reviewed and kept results count as their base."""
    base = F.regexp_replace(text(result), "(_reviewed|_kept_low_confidence_review)$", "")
    suffixed = text(result) != base
    kept = text(result).endswith("_kept_low_confidence_review")
    plain = F.when(base.isin("ai_rejected", "ai_review_rejected", "not_found"), "rejected").when(base.isin("ai_found", "ai_corrected", "ai_review_corrected", "ai_confirmed"), "matched")
    after = F.when(base.isin("ai_found", "ai_corrected", "ai_confirmed"), "matched").when(kept & (base == "ai_rejected"), "rejected")
    return F.coalesce(F.when(suffixed, after).otherwise(plain), F.lit(""))


def trace_summary(trace: DataFrame, seq: str = "seq") -> DataFrame:
    """One row an item of a trace: its last final row, AI result, rejection and candidate decide its status and reason.

    All are `max_by` of the running number under a condition, so an item's rows never meet in full.
    """
    t = lambda c: text(F.col(c))
    last = lambda what, when: F.max_by(what, F.when(when, F.col(seq)))
    row = F.struct(*(t(c).alias(c) for c in ("error_stage", "error_code", "reject_rule", "selection_reason", "candidate_name", "final_match")))
    rejected = (t("decision") == "rejected") | (t("reject_rule") != "")
    final = t("step") == "final"
    ai = t("step").isin(AI_RESULT_STEPS)
    named = F.when(t("candidate_name") != "", t("candidate_name")).when((t("final_match") != "") & (t("final_match") != "NONE"), t("final_match"))
    model = F.coalesce(F.when(t("model_used") != "", t("model_used")), t("ai_model"))
    maker = F.when((t("provider_used") != "") | (model != ""), F.regexp_replace(F.concat(t("provider_used"), F.lit("/"), model), "^/+|/+$", ""))
    d = trace.filter((t("drug_code") != "") | (t("drug_name") != "")).groupBy(t("drug_code").alias("code"), t("drug_name").alias("drug_name"))
    d = d.agg(
        last(row, final).alias("final"),
        last(row, rejected).alias("rejected"),
        last(row, F.lit(True)).alias("any"),
        last(F.struct(t("ai_result").alias("ai_result"), t("candidate_name").alias("candidate_name")), ai).alias("ai"),
        last(t("ai_result"), t("ai_result") != "").alias("ai_action"),
        last(named, named.isNotNull()).alias("named"),
        last(maker, maker.isNotNull()).alias("maker"),
    )
    says = ai_outcome(F.col("ai.ai_result"))
    status = (
        F.when(F.col("ai").isNotNull() & (says == "rejected"), "no_match")
        .when(F.col("ai").isNotNull() & (says == "matched"), "matched")
        .when(F.col("final").isNotNull(), F.when(F.col("final.final_match") != "NONE", "matched").otherwise("no_match"))
        .otherwise("unknown")
    )
    match = (
        F.when(F.col("ai").isNotNull() & (says == "rejected"), "NONE")
        .when(F.col("ai").isNotNull() & (says == "matched"), F.when(F.col("ai.candidate_name") != "", F.col("ai.candidate_name")).otherwise(F.coalesce("named", F.lit(""))))
        .otherwise(F.coalesce("final.final_match", F.lit("")))
    )
    d = d.withColumns({"status": status, "match": match, "why": F.coalesce("rejected", "final", "any")})
    first = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs), F.lit(""))
    return d.select(
        "code",
        "drug_name",
        F.col("status").alias("final_status"),
        F.col("match").alias("final_match"),
        F.when((F.col("why.error_stage") == "") & (F.col("status") == "no_match"), "matching").otherwise(F.col("why.error_stage")).alias("failure_stage"),
        first("why.error_code", "why.reject_rule", "why.selection_reason").alias("primary_reason"),
        F.coalesce("rejected.candidate_name", F.lit("")).alias("best_rejected_candidate"),
        F.coalesce("ai_action", F.lit("")).alias("ai_action"),
        F.coalesce("maker", F.lit("")).alias("ai_provider_model"),
    )


def numbered(df: DataFrame, order: list[Column], out: str = "n") -> DataFrame:
    """Numbers rows from 1 in a total order, without one task for all of them: ranges in order, counts of those before.

    The ranged rows are written once, each with its range and its place there, and both the counts and the numbers come
    from that table: ranges made twice need not agree. `order` must be total, so that reruns deal rows alike.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # so that no column of df is named as one of ours
    place = F.monotonically_increasing_id()  # the range's number above 33 bits, the row's place in it below
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).toDF(*names).withColumn("place", place)
    ranged = Scratch(df.sparkSession).save(ranged, "ranged").withColumn("part", F.shiftright("place", 33))
    before = ranged.groupBy("part").agg(F.count("*").alias("rows"))  # a row a range
    before = before.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(before.drop("rows")), "part").select(*names, number.alias("number")).toDF(*df.columns, out)


def pages(df: DataFrame, order: list[Column], size: int = 50) -> DataFrame:
    return numbered(df, order, "_n").withColumn("page", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page, 1-based: Spark keeps only as many rows a task as the pages up to it hold."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def row_range(df: DataFrame, order: list[Column], start: int, end: int, most: int | None = None) -> DataFrame:
    """Rows start to end, 1-based, both included, then at most so many."""
    n = end - start + 1 if most is None else min(most, end - start + 1)
    return df.orderBy(*order).offset(start - 1).limit(n)


def chunks(df: DataFrame, order: list[Column], workers: int) -> DataFrame:
    """`chunk` 1 to workers, contiguous, sizes apart by one at most, the first ones larger; a row each if there are fewer rows."""
    d = numbered(df, order, "_n")
    small, extra = divmod(df.count(), workers)
    edge = extra * (small + 1)
    chunk = F.when(F.col("_n") <= edge, F.floor((F.col("_n") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("_n") - 1 - edge) / max(1, small)))
    return d.withColumn("chunk", (chunk + 1).cast("int")).drop("_n")


def field_census(payloads: DataFrame, payload: str) -> DataFrame:
    """path, type, n: every dotted path of JSON objects with the types found there; items of arrays stand under `path[]`.

    One pass a level: each turn opens the objects and arrays that the one before it found, until none is left.
    """
    pairs = "map<string,variant>"
    level = payloads.select(F.lit("").alias("path"), F.try_parse_json(F.col(payload)).alias("v"))
    found, scratch = None, Scratch(payloads.sparkSession)
    while True:
        kind = F.schema_of_variant("v")
        inner = F.when(kind.startswith("OBJECT"), F.map_entries(F.expr(f"try_variant_get(v, '$', '{pairs}')")))
        items = F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
        at = lambda k: F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit("."), k))
        opened = F.coalesce(F.transform(inner, lambda e: F.struct(at(e["key"]).alias("path"), e["value"].alias("v"))), F.transform(items, lambda x: F.struct(F.concat("path", F.lit("[]")).alias("path"), x.alias("v"))))
        level = level.select(F.explode(opened).alias("e")).select("e.*")
        level = scratch.save(level.withColumn("v", F.to_json("v")), "level")
        level = level.withColumn("v", F.parse_json("v"))
        counts = level.select("path", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("type")).groupBy("path", "type").agg(F.count("*").alias("n"))
        if level.isEmpty():
            return counts if found is None else found
        found = counts if found is None else found.unionByName(counts)


def trace_rows(df: DataFrame, step: str, phase: str, decision: Column, **fields: Column) -> DataFrame:
    """Trace rows of one kind: the fixed columns of `trace_summary`, blanks for what a kind doesn't say."""
    given = {"step": F.lit(step), "phase": F.lit(phase), "decision": decision, **fields}
    return df.select("drug_code", "drug_name", "seq", *(text(given.get(c, F.lit(""))).alias(c) for c in TRACE_FIELDS))
