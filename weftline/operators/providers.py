"""Model providers as data: health, rank, tiers, round-robin budgets, cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import text
from weftline.operators.reports import numbered

# Tier and advice of each health status.
TIERS = {"working": 0, "degraded": 1, "quota-limited": 2, "permission-failed": 3, "model-not-accessible": 4, "failed": 5}
ADVICE = {
    "working": "use-first",
    "degraded": "late-retry",
    "quota-limited": "last-choice-quota",
    "permission-failed": "last-choice-permission",
    "model-not-accessible": "last-choice-model-access",
    "failed": "last-choice",
}
PERMANENT = ["permission-failed", "model-not-accessible"]
COOLDOWN_ERRORS = ["rate_limited", "invalid_json", "null_content"]
#: Seconds from which a wait that an answer asks for puts its provider out at once.
LONG_WAIT = 60
QUOTAS = ["rate_remaining_requests", "quota_remaining_day", "quota_remaining_minute", "rate_remaining_tokens"]


def health_status(ok: Column, error_type: Column, http: Column, message: Column) -> Column:
    e, h, m = text(error_type), text(http), F.lower(text(message))
    shape = e.isin("response_not_json", "response_shape", "null_content", "TimeoutError") | e.contains("invalid_json") | e.startswith("missing_fields:")
    gone = (h == "404") | (e == "http_404") | m.contains("model_not_found") | m.contains("does not exist") | m.contains("no such model")
    return (
        F.when(F.coalesce(ok, F.lit(False)), "working")
        .when(shape, "degraded")
        .when((h == "429") | (e == "http_429"), "quota-limited")
        .when((h == "403") | (e == "http_403"), "permission-failed")
        .when(gone, "model-not-accessible")
        .otherwise("failed")
    )


def of_status(values: dict, status: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[status]


def quota_number(c: Column) -> Column:
    """1,200, 3K or 2.5M as a number; null if it is none."""
    x = F.upper(F.trim(F.replace(text(c), F.lit(","), F.lit(""))))
    scale = F.when(x.endswith("K"), 1e3).when(x.endswith("M"), 1e6).otherwise(1.0)
    return F.regexp_replace(x, "[KM]$", "").try_cast("double") * scale


def ranked_health(df: DataFrame) -> DataFrame:
    """df with status, tier, advice, score, and rank by tier, rotation tier, quality, quota, latency and provider."""
    status = health_status(F.col("ok"), F.col("error_type"), F.col("http_status"), F.col("error_message"))
    quota = F.coalesce(*(quota_number(F.col(c)) for c in QUOTAS if c in df.columns), F.lit(0.0))
    d = df.withColumns({"health_status": status, "_quota": quota})
    d = d.withColumns({"fallback_tier": of_status(TIERS, F.col("health_status")), "rotation_recommendation": of_status(ADVICE, F.col("health_status"))})
    at_least = lambda x: F.greatest(F.lit(0.0), x)
    tier, quality = F.coalesce(F.nullif("rotation_tier", F.lit(0)), F.lit(3)), F.nullif("quality_rank", F.lit(0))
    score = at_least(40.0 - tier * 10) + at_least(80.0 - F.coalesce(quality, F.lit(100)) * 5) + F.least(F.col("_quota"), F.lit(1000.0)) / 20 + at_least(20.0 - F.coalesce(F.nullif("elapsed_s", F.lit(0.0)), F.lit(20.0)))
    d = d.withColumn("rotation_score", F.when(F.col("ok"), F.bround(score, 2)).otherwise(0.0))
    order = [F.asc("fallback_tier"), tier, F.coalesce(quality, F.lit(999)), F.desc("_quota"), F.coalesce(F.nullif("elapsed_s", F.lit(0.0)), F.lit(9999.0)), F.asc("provider"), F.asc("seq")]
    return numbered(d, order, "rotation_rank").drop("_quota")


def model_tier(rank: Column, models: Column) -> Column:
    """Thirds of a provider's models, the first ones larger."""
    return F.when(models <= 0, 3).when(rank <= F.floor((models + 2) / 3), 1).when(rank <= F.floor((models * 2 + 2) / 3), 2).otherwise(3)


def round_robin(df: DataFrame, budget: int, tier: str, provider: str, order: str) -> DataFrame:
    """Within a tier each provider's n-th attempt goes before any (n+1)-th; the first `budget` of them, numbered."""
    d = df.withColumn("_round", F.row_number().over(Window.partitionBy(tier, provider).orderBy(order)))
    first = F.min(order).over(Window.partitionBy(tier, provider))
    d = d.withColumn("_first", first).orderBy(tier, "_round", "_first").limit(budget)
    return d.withColumn("position", F.row_number().over(Window.orderBy(tier, "_round", "_first"))).drop("_round", "_first")


def by_health(attempts: DataFrame, health: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Attempts, healthy first, then untested, failed for now, failed for good; one row each, numbered by `position`."""
    h = health.filter("mode = 'json'").withColumn("_s", health_status(F.col("ok"), F.col("error_type"), F.col("http_status"), F.col("error_message")))
    kind = F.when(F.col("ok"), 0).when(F.col("_s").isin(PERMANENT), 3).otherwise(2)
    h = h.groupBy(*keys).agg(F.min(F.struct(kind.alias("kind"), F.col("seq").alias("seq"))).alias("h"))
    d = attempts.join(h, keys, "left")
    d = d.withColumns({"_kind": F.coalesce("h.kind", F.lit(1)), "_seq": F.coalesce("h.seq", F.col(order))}).drop("h")
    return numbered(d, [F.col("_kind"), F.col("_seq"), F.col(order)], "position").drop("_kind", "_seq")


def cooldowns(attempts: DataFrame, threshold: int = 2) -> DataFrame:
    """Providers to leave out: so many failures of some kinds, or one with a wait of a minute or more."""
    wait = F.regexp_extract(text(F.col("reason")), r"retry_after=(\d+)", 1).try_cast("bigint")
    now = (F.col("error_code") == "rate_limited") & (wait >= LONG_WAIT)
    d = attempts.filter(F.col("error_code").isin(COOLDOWN_ERRORS) & ~text(F.col("provider")).isin("", "default"))
    d = d.groupBy("provider").agg(F.count("*").alias("failures"), F.max(F.coalesce(now, F.lit(False))).alias("immediate"))
    return d.filter(F.col("immediate") | (F.col("failures") >= threshold))


def timed_out(attempts: DataFrame, keys: list[str], ts: str, limit: int = 2, memory: int = 600, wait: int = 300) -> DataFrame:
    """keys, at, failures, until: each time at which a combination fails for the `limit`-th time in `memory` seconds, which puts it out for `wait` seconds,
    or is told to wait a minute or more, which puts it out for that. Failures that are `memory` seconds old are forgotten.

    attempts: keys, ts, ok, retry_after (seconds; null: none). Failures at one time are one row; failures counts up to `limit`. Rows
    without a time, and successes, put nothing out.
    """
    asked = F.coalesce(F.col("retry_after").cast("long"), F.lit(0))
    d = attempts.filter(~F.coalesce("ok", F.lit(True)) & F.col(ts).isNotNull()).groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    d = d.agg(F.count("*").alias("_n"), F.max(F.when(asked >= LONG_WAIT, asked)).alias("_asked"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-memory * 1_000_000 + 1, 0)
    d = d.withColumn("failures", F.least(F.sum("_n").over(w), F.lit(limit)))
    most = F.greatest(F.when(F.col("failures") >= limit, F.lit(wait)).cast("long"), F.col("_asked"))
    as_ts = lambda c: F.timestamp_micros(c).cast(attempts.schema[ts].dataType)
    return d.filter(most.isNotNull()).select(*keys, as_ts(F.col("_at")).alias("at"), "failures", as_ts(F.col("_at") + most * 1_000_000).alias("until"))


def disabled_after(attempts: DataFrame, keys: list[str], seq: str, limit: int = 2) -> DataFrame:
    """Each combination's failures so far, and whether they have disabled it."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    d = attempts.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(w))
    return d.withColumn("disabled", F.col("failures") >= limit)


def not_stronger(attempts: DataFrame, tier: int, rank: int) -> DataFrame:
    """Attempts no weaker than a primary one: those at or before it by tier and rank."""
    return attempts.filter((F.col("rotation_tier") < tier) | ((F.col("rotation_tier") == tier) & (F.col("quality_rank") <= rank)))


def rotated(df: DataFrame, position: str, start: int, n: int) -> DataFrame:
    """A list from a cursor on: positions 0 to n - 1 as they come after `start`."""
    return df.withColumn("turn", F.pmod(F.col(position) - start, F.lit(n)))


def healthy_combinations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct combinations that answered in JSON, in the order first seen."""
    d = df.filter("ok and mode = 'json'").groupBy(*keys).agg(F.min("seq").alias("_seq"))
    return numbered(d, [F.col("_seq")], "position").drop("_seq")


def first_header(headers: Column, names: list[str]) -> Column:
    """The first header, of a map, that is not blank, whatever its letters' case."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.coalesce(*(F.when(F.trim(text(F.try_element_at(low, F.lit(n.lower())))) != "", F.trim(F.try_element_at(low, F.lit(n.lower())))) for n in names), F.lit(""))
