"""From scored candidates to one decision an item: ranks, top-k checks, ambiguity, reasons, early stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import normalize_text, text

#: All downwards; the last parts equal candidates.
ORDER = ["score", "exact", "overlap", "numeric", "available_quantity", "products_count", "discount", "negative_price", "store_product_id"]


def by_order(columns: list[str] | None = None) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns or ORDER]


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order. Spark turns the filter on the rank into a limit a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def distinct_candidates(df: DataFrame, item: str = "item_id") -> DataFrame:
    """Candidates that several queries found, once an item: by id and normalised names, the first query and row kept."""
    d = df.withColumns({"_en": normalize_text(F.col("name_en")), "_ar": normalize_text(F.col("name_ar")), "_id": text(F.col("store_product_id"))})
    return first_of_each(d, [item, "_id", "_en", "_ar"], [F.asc("query_ord"), F.asc("row_index")]).drop("_en", "_ar", "_id")


def ranked(df: DataFrame, item: str = "item_id", order: list[Column] | None = None, most: int | None = None, out: str = "rank") -> DataFrame:
    d = df.withColumn(out, F.row_number().over(Window.partitionBy(item).orderBy(*(order or by_order()))))
    return d if most is None else d.filter(F.col(out) <= most)


def check_top(df: DataFrame, component_reason: str = "component_reason", k: int = 5, item: str = "item_id") -> DataFrame:
    """Accepted candidates in order are checked by their components until k have passed; those after are skipped.

    Needs: accepted, reason, the ORDER columns and the component reason (`ok` if it passes) of each candidate.
    """
    w = Window.partitionBy(item).orderBy(*by_order())
    passes = F.col("accepted") & (F.col(component_reason) == "ok")
    before = F.coalesce(F.sum(F.when(passes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = df.withColumn("_before", before)
    reason = (
        F.when(~F.col("accepted"), F.col("reason"))
        .when(F.col("_before") >= k, "Skipped by candidate top-k optimization")
        .when(F.col(component_reason) != "ok", F.concat(F.lit("Semantic token conflict: "), F.col(component_reason)))
        .otherwise(F.col("reason"))
    )
    return d.withColumn("reason", reason).withColumn("accepted", passes & (F.col("_before") < k)).drop("_before")


def decide(df: DataFrame, item: str = "item_id") -> DataFrame:
    """One row an item: the best accepted candidate's id and score, or null and why.

    Accepted candidates that equal the best in all but their id make it ambiguous. One aggregation finds the best of
    each kind, so no item's candidates meet in one place but as partial maxima.
    """
    key = F.struct(*(F.col(c) for c in ORDER[:-1]))
    whole = F.struct(*(F.col(c) for c in ORDER))
    best = df.groupBy(item).agg(
        F.max(F.when(F.col("accepted"), F.struct(whole.alias("key"), F.col("reason")))).alias("a"),
        F.max(F.struct(whole.alias("key"), F.col("reason"))).alias("any"),
        F.count("*").alias("candidates"),
    )
    ties = df.filter("accepted").groupBy(item, key.alias("_key")).agg(F.collect_set("store_product_id").alias("_ids"))
    ties = ties.groupBy(item).agg(F.max_by("_ids", "_key").alias("ids"))
    d = best.join(ties, item, "left")
    unclear = F.size("ids") > 1
    reason = (
        F.when(F.col("a").isNull(), F.coalesce(F.col("any.reason"), F.lit("Best candidate was rejected by acceptance rules.")))
        .when(unclear, F.concat(F.lit("Ambiguous accepted candidates: "), F.array_join(F.array_sort("ids"), ", ")))
        .otherwise(F.concat(F.lit("Accepted best candidate because "), F.col("a.reason"), F.lit(".")))
    )
    won = lambda c: F.when(~F.coalesce(unclear, F.lit(False)), F.col(f"a.key.{c}"))
    return d.select(item, won("store_product_id").alias("store_product_id"), won("score").alias("score"), reason.alias("reason"), "candidates")


def decide_items(items: DataFrame, decisions: DataFrame, item: str = "item_id") -> DataFrame:
    """Every item, those without candidates too."""
    d = items.join(decisions, item, "left")
    return d.withColumn("reason", F.coalesce("reason", F.lit("No search candidates were returned."))).withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def first_decisive(df: DataFrame, item: str = "item_id", least_confidence: float = 0.95, enough: int = 3) -> DataFrame:
    """Per item the first query after which searching stops: an exact name, enough confidence, or so many queries with a match."""
    stop = F.col("matched") & (F.col("exact_name") | (F.col("confidence") >= least_confidence) | (F.col("query_ord") + 1 >= enough))
    return df.filter(stop).groupBy(item).agg(F.min("query_ord").alias("query_ord"))


def aggressive_pick(df: DataFrame, item: str = "item_id", least_score: float = 12.0, least_overlap: float = 0.45) -> DataFrame:
    """The best orderable candidate, accepted or not, that shares a brand word and has score and overlap enough."""
    ok = (F.col("score") >= least_score) & (F.col("overlap") >= least_overlap) & F.col("store_product_id").isNotNull() & F.col("shares_brand")
    return first_of_each(df.filter(ok), [item], by_order())


def higher_rejected(df: DataFrame, item: str = "item_id") -> DataFrame:
    """The best rejected candidate of each item, where it scores above the best accepted one."""
    d = df.groupBy(item).agg(F.max(F.when(F.col("accepted"), F.col("score"))).alias("accepted_score"), F.max(F.when(~F.col("accepted"), F.struct("score", "store_product_id", "reason"))).alias("r"))
    d = d.filter("r is not null and (accepted_score is null or r.score > accepted_score)")
    return d.select(item, F.col("r.store_product_id").alias("store_product_id"), F.col("r.score").alias("score"), F.col("r.reason").alias("reason"))


def forced_match(candidates: DataFrame, decisions: DataFrame, item: str = "item_id") -> DataFrame:
    """Candidates that a saved decision names by id, else by name; of each item the first by query and row, at score 999."""
    d = candidates.join(decisions.select(item, F.col("correct_id"), F.col("correct_name")), item)
    by_id = F.col("store_product_id") == F.col("correct_id")
    by_name = normalize_text(F.col("name_en")) == normalize_text(F.col("correct_name"))
    hit = F.when(by_id, 0).when(F.coalesce(F.col("correct_id"), F.lit("")).eqNullSafe("") & by_name, 1)
    d = d.withColumn("_hit", hit).filter("_hit is not null")
    return first_of_each(d, [item], [F.asc("_hit"), F.asc("query_ord"), F.asc("row_index")]).withColumn("score", F.lit(999.0)).drop("_hit")


def without_rejected(candidates: DataFrame, rejected: DataFrame, item: str = "item_id") -> DataFrame:
    return candidates.join(rejected.select(item, "store_product_id"), [item, "store_product_id"], "left_anti")


def choose_source(df: DataFrame, item: str = "item_id", query: str = "query_ord") -> DataFrame:
    """Rows of the service, unless none of a query's can be ordered and the page has some: then the page's."""
    w = Window.partitionBy(item, query)
    api, page = F.col("source") == "api", F.col("source") == "page"
    any_of = lambda c: F.max(F.when(c, 1).otherwise(0)).over(w) == 1
    d = df.withColumns({"_api": any_of(api & F.col("orderable")), "_page": any_of(page)})
    return d.filter(F.when(F.col("_api") | ~F.col("_page"), api).otherwise(page)).drop("_api", "_page")


def best_unorderable(df: DataFrame, item: str = "item_id") -> DataFrame:
    """Of each item the first candidate refused for having no id, else the best rejected one without an id."""
    exact = F.col("reason") == "Candidate missing orderable storeProductId"
    d = df.filter(exact | (~F.col("accepted") & F.col("store_product_id").isNull()))
    return first_of_each(d.withColumn("_exact", exact), [item], [F.desc("_exact"), F.desc("score"), F.asc("row_index")]).drop("_exact")


def recovery_set(df: DataFrame, item: str = "item_id", k: int = 5) -> DataFrame:
    """For items whose match was refused: their k most alike names whose components fit, to choose from."""
    return ranked(df, item, [F.desc("similarity"), F.asc("row_index")], k).filter("component_reason = 'ok'")
