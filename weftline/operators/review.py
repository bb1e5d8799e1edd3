"""What a person must look at, and why: review predicates, reasons, categories, statuses, saved choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import blank_to_null, major_name_change, text
from weftline.functions.verdict import first_filled
from weftline.operators.allocate import split_selections
from weftline.operators.reports import numbered

# Fixed values.
FUZZY_METHODS = ["fuzzy", "brand_index"]
LATE_MATCHES = ["ai_confirmed", "ai_corrected", "ai_found"]


def matched(name: Column) -> Column:
    return text(name) != ""


def needs_review(name: Column, score: Column, component_reason: Column, least: float = 90.0) -> Column:
    """No match, a score below the threshold, or a component reason."""
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return ~matched(name) | (s < least) | (text(component_reason) != "")


def review_reason(name: Column, verified: Column, score: Column, component_reason: Column) -> Column:
    s = score.try_cast("double")
    base = (
        F.when(~matched(name), "no_match_found")
        .when(verified == "ai_rejected", "ai_rejected_match")
        .when(verified == "ai_review_rejected", "ai_review_rejected_match")
        .when(verified.isin(LATE_MATCHES), "low_confidence_ai_match")
        .when(s < 90, F.format_string("uncertain_score(%.0f)", F.bround(s, 0)))
    )
    component = F.when(~F.lower(text(component_reason)).isin("", "nan", "ok"), F.concat(F.lit("component:"), component_reason))
    joined = F.concat_ws("; ", base, component)
    return F.when(joined == "", "needs_review").otherwise(joined)


def verify_policy(policy: str, name: Column, score: Column, method: Column, threshold: float) -> Column:
    """Which matches a policy sends to verification: all, all-non-exact, fuzzy, or those of low score."""
    s = score.try_cast("double")
    low = F.coalesce(s < threshold, F.lit(False))
    rules = {
        "all": F.lit(True),
        "all-non-exact": ~F.coalesce((method == "component_index") & (s >= 100), F.lit(False)),
        "fuzzy": low | F.coalesce(method.isin(FUZZY_METHODS), F.lit(False)),
    }
    return matched(name) & rules.get(policy, low)


def ai_review_rows(confidence: Column, component_reason: Column, least: float) -> Column:
    """Rows for a second look: no confidence at all, too little, or a component reason. One predicate, so each row once."""
    c = confidence.try_cast("double")
    return F.coalesce(c < least, F.lit(False)) | ~F.lower(text(component_reason)).isin("", "ok", "nan")


def search_eligible(df: DataFrame, item: str = "item_id", order: str = "position") -> DataFrame:
    """Candidates for an AI search: passed with score 80 or more, or reviewable with 68 or more, the first eight of these."""
    reviewable = ~F.col("passed") & F.col("reviewable") & (F.col("score") >= 68)
    nth = F.sum(F.when(reviewable, 1).otherwise(0)).over(Window.partitionBy(item).orderBy(order))
    return df.withColumn("_nth", nth).filter((F.col("passed") & (F.col("score") >= 80)) | (reviewable & (F.col("_nth") <= 8))).drop("_nth")


def summary_status(reason: Column, unmatched_status: Column) -> Column:
    """Status of a skipped item, from what its reason says; unmatched_status: what its candidates say, or null."""
    low = F.lower(text(reason))
    says = lambda *some: _any(low, some)
    return (
        F.when(says("no matching product found", "no decisive match found", "no decisive api match found"), F.coalesce(unmatched_status, F.lit("no-results")))
        .when(says("manual review"), "manual-review-required")
        .when(says("unavailable", "out of stock"), "matched-but-unavailable")
        .when(says("not orderable", "missing storeproductid", "cart button disabled"), "not-orderable")
        .otherwise("skipped")
    )


def failure_status(reason: Column, unmatched_status: Column) -> Column:
    hit = text(reason).contains("No matching product found") | text(reason).contains("No decisive match found")
    return F.when(hit, F.coalesce(unmatched_status, F.lit("no-results"))).otherwise("failed")


def recognised_without_id(reason: Column, score: Column, has_id: Column) -> Column:
    """A rejected candidate that was recognised but can't be ordered."""
    low = F.lower(text(reason))
    hard = _any(low, ("component mismatch", "identity token", "different_brand", "semantic token"))
    return ~has_id & (low.contains("candidate missing orderable storeproductid") | (~hard & ((low.contains("unrequested numeric") & (score >= 9)) | (score >= 12))))


def _any(c: Column, some) -> Column:
    out = F.lit(False)
    for s in some:
        out = out | c.contains(s)
    return out


def review_category(status: Column, ai_status: Column, safety: Column) -> Column:
    either = F.coalesce(blank_to_null(ai_status), status)
    return (
        F.when(safety == "missing storeProductId", "candidate_not_orderable")
        .when(status == "matched-but-unavailable", "matched_but_not_available")
        .when(status == "not-orderable", "candidate_not_orderable")
        .when(status == "manufacturer-mismatch", "manufacturer_mismatch")
        .when(either.isin("ai_review_rejected", "ai_low_confidence", "ai_rejected"), either)
        .when(status.isin("no-results", "manual-review-required"), "no_decisive_match")
        .otherwise(either)
    )


def review_detail(reason: Column, more: list[Column], conflicts: Column) -> Column:
    """The reason, the first other reason that it doesn't hold, and the distinct hard conflicts."""
    base = text(reason)
    other = F.coalesce(*(F.when((text(m) != "") & ~base.contains(text(m)), m) for m in more))
    joined = F.concat_ws(" | ", F.when(base != "", base), other)
    lowered = F.transform(conflicts, F.lower)
    once = F.filter(conflicts, lambda c, i: F.array_position(lowered, F.lower(c)) == i + 1)
    named = F.when(F.size(once) > 0, F.concat(F.lit("hard_conflicts: "), F.array_join(once, ", ")))
    return F.concat_ws(" | ", F.when(joined != "", joined), F.when(~joined.contains(named), named))


def blocking_phase(status: Column, ai_status: Column, searched: Column, verified: Column) -> Column:
    return (
        F.when(ai_status.isNull(), F.when(text(status) != "", "summary_status").otherwise(""))
        .when(ai_status == "ai_review_rejected", "ai_review")
        .when(ai_status.isin("ai_rejected", "ai_low_confidence"), F.when(searched, "ai_search").when(verified, "ai_verify").otherwise("ai_final"))
        .when(status.isin("manufacturer-mismatch", "matched-but-unavailable", "not-orderable"), "deterministic_match")
        .otherwise("summary_status")
    )


def is_flag(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin("1", "true", "yes", "y")


def selection_decision(not_matching: Column, correction: Column, approved: Column) -> Column:
    """What a reviewer chose: not matching goes before a written correction, that before approval."""
    return F.when(is_flag(not_matching), "not_matching").when(F.trim(text(correction)) != "", "corrected").when(is_flag(approved), "approved_match").otherwise("")


def review_needed(status: Column, decision: Column, again: Column) -> Column:
    """Whether an item stays in review: a saved decision ends it unless asked for again."""
    return F.when((text(decision) != "") & ~again, False).otherwise(status.isin("no-results", "manual-review-required", "not-orderable", "matched-but-unavailable", "manufacturer-mismatch"))


def overlay_decisions(rows: DataFrame, decisions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with saved values in place of their own."""
    saved = decisions.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    d = rows.join(saved, keys, "left")
    return d.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def review_options(df: DataFrame, item: str = "item_id", least: float = 80.0, most: int = 10) -> DataFrame:
    """item, options: names to choose from, near misses first by score, then the others in order; each once."""
    order = F.struct(F.when(~F.col("accepted") & (F.col("similarity") >= least), 0).otherwise(1).alias("g"), F.when(~F.col("accepted") & (F.col("similarity") >= least), -F.col("similarity")).otherwise(0.0).alias("s"), F.col("position").alias("p"))
    d = df.groupBy(item, "name").agg(F.min(order).alias("o"))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy("o"))).filter(F.col("_n") <= most)
    return d.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("options"))


def progress(df: DataFrame, corrected: Column) -> DataFrame:
    d = df.agg(F.count("*").alias("total"), F.count_if(corrected).alias("corrected"))
    return d.withColumn("remaining", F.col("total") - F.col("corrected"))


def needs_full_log(found: Column, accepted: Column, reason: Column, overlap: Column, numeric_overlap: Column) -> Column:
    """Whether a decision is logged in full: all but accepted matches by full overlap."""
    plain = found & accepted & (reason == "high_token_overlap") & (overlap >= 1) & numeric_overlap.isin(0.0, 1.0)
    return ~F.coalesce(plain, F.lit(False))


def saved_match_problem(saved_id: Column, current_id: Column, maker_conflict: Column, saved_name: Column, current_name: Column) -> Column:
    """Why a saved decision no longer fits its candidate; empty if it does."""
    other = (text(saved_id) != "") & (text(current_id) != "") & (saved_id != current_id)
    return F.when(other, "product id differs").when(F.coalesce(maker_conflict, F.lit(False)), "manufacturer differs").when(major_name_change(saved_name, current_name), "name differs").otherwise("")


def skips_auto_save(rejection: Column, maker_conflict: Column) -> Column:
    """Whether a match is not saved by itself: a rejection that speaks of a conflict, or makers that differ."""
    return F.lower(text(rejection)).rlike("conflict|manufacturer|brand|semantic") | F.coalesce(maker_conflict, F.lit(False))


def ai_fields(status: Column, verify: Column, search: Column, review: Column) -> list[Column]:
    """AI columns of a summary row, from result structs of confidence, model_used and provider_used."""
    there = lambda r: r.isNotNull()
    return [
        status.isNotNull().alias("ai_enabled"),
        text(status).alias("ai_status"),
        there(verify).alias("ai_verified"),
        there(search).alias("ai_searched"),
        there(review).alias("ai_reviewed"),
        review["confidence"].alias("ai_review_confidence"),
        first_filled(*(r["model_used"] for r in (verify, search, review))).alias("ai_model"),
        first_filled(*(r["provider_used"] for r in (verify, search, review))).alias("ai_provider"),
    ]


def winner_fields(candidate: str) -> list[Column]:
    """Columns of the chosen candidate, a struct. The sale price is the public one, the purchase price the one it is sold at."""
    of = lambda f: F.col(f"{candidate}.{f}")
    return [
        first_filled(of("name_en"), of("name_en_fallback")).alias("matched_product_name_en"),
        text(of("name_ar")).alias("matched_product_name_ar"),
        of("product_id").alias("winner_product_id"),
        of("store_product_id").alias("winner_store_product_id"),
        of("available_quantity").alias("winner_available_quantity"),
        first_filled(*(of(f).cast("string") for f in ("retail_price", "public_price", "price", "selling_price"))).alias("winner_sale_price"),
        of("sale_price").alias("winner_purchase_price"),
    ]


def order_results(items: DataFrame, won: DataFrame, tail: DataFrame, stores: int = 5, item: str = "item_id") -> DataFrame:
    """Wide rows: the item, its match (`winner`, a struct), the stores chosen as columns, whether review holds it back, and queries and times.

    won: item, winner, stores, discounts (texts `a | b`), found, review; tail: item, queries (array), and times.
    """
    w = won.select(item, *winner_fields("winner"), *split_selections(F.col("stores"), F.col("discounts"), stores), F.col("found").alias("matched"), (F.col("found") & F.col("review")).alias("blocked_match"))
    t = tail.withColumn("queries", F.array_join("queries", " | "))
    return items.join(w, item, "left").join(t, item, "left")


def split_at(df: DataFrame, order: list[Column], most: int, out: str) -> DataFrame:
    """Whether a row is among the first so many in a total order: those are worked on, the rest are skipped."""
    return numbered(df, order, "_at").withColumn(out, F.col("_at") <= most).drop("_at")
