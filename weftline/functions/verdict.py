"""Answers of language models as data: repaired JSON, contradictions resolved, outcomes of verify, search and review.

No model is called here; their texts and results are input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.normalize import let, routes, text, tokens

VERDICT = "is_correct boolean, decision string, best_index string, confidence double, reason string, hard_conflicts array<string>"
# Conflicts that refuse a match, those that only lower its confidence, and phrases of free text.
REFUSING = "different_active_ingredient different_concentration different_dosage different_route different_strength".split()
LOWERING = "different_age_group different_brand different_flavor different_form different_pack_size different_quantity different_volume".split()
NO_PHRASES = ["different brand", "not the same", "mismatch", "incorrect", "wrong match", "different product", "different dosage", "different form", "different quantity"]
YES_PHRASES = ["same product", "correct match", "identical", "is_correct", "matching", "same brand", "same dosage"]


def repair_json(answer: Column) -> Column:
    """The verdict of an answer as a struct, or null.

    Tried in order: the whole text, a fenced block, the first flat object, the text from its first brace with what
    closes it; each also without commas before a closing bracket. Last, single fields by pattern. A search verdict
    without confidence has 0.5.
    """
    def of(x: Column) -> Column:
        pieces = [x, F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(x, r"(?s)(\{[^{}]*\})", 1)]
        tries = [p for piece in pieces for p in (piece, F.regexp_replace(piece, r",\s*([}\]])", "$1"))]
        whole = [let(p, lambda t: F.when(F.json_object_keys(t).isNotNull(), F.from_json(t, VERDICT))) for p in tries]
        return F.coalesce(*whole, let(F.regexp_extract(x, r"(?s)(\{.*)", 1), lambda start: F.when(start != "", F.coalesce(_closed(start), _verdict_fields(start)))))

    def sure(found: Column) -> Column:
        searched = found["decision"].isNotNull() | found["best_index"].isNotNull()
        return F.when(found.isNotNull(), found.withField("confidence", F.coalesce(found["confidence"], F.when(searched, 0.5))))

    return let(let(text(answer), of), sure)


def _closed(start: Column) -> Column:
    """A cut-off object with what closes it."""
    return F.coalesce(*(let(F.concat(start, F.lit(end)), lambda t: F.when(F.json_object_keys(t).isNotNull(), F.from_json(t, VERDICT))) for end in ("}", '"}', '"\n}')))


def _verdict_fields(start: Column) -> Column:
    """Single fields by pattern, where none of the tries is JSON."""
    get = lambda pattern: F.nullif(F.regexp_extract(start, pattern, 1), F.lit(""))
    found = F.struct(get(r'(?i)"is_correct"\s*:\s*(true|false)').alias("right"), get(r'"decision"\s*:\s*"([^"]*)"').alias("decision"), get(r'"best_index"\s*:\s*(\d+)').alias("best"))

    def verdict(f: Column) -> Column:
        right, decision, best = f["right"], f["decision"], f["best"]
        whole = F.struct(
            (F.lower(right) == "true").alias("is_correct"),
            F.when(right.isNull(), F.coalesce(decision, F.lit(""))).alias("decision"),
            F.when(right.isNull(), F.coalesce(best, F.lit("0"))).alias("best_index"),
            F.coalesce(get(r'"confidence"\s*:\s*([\d.]+)').try_cast("double"), F.lit(0.5)).alias("confidence"),
            F.coalesce(get(r'"reason"\s*:\s*"([^"]*)"'), F.lit("")).alias("reason"),
            F.lit(None).cast("array<string>").alias("hard_conflicts"),
        )
        return F.when(right.isNotNull() | decision.isNotNull() | best.isNotNull(), whole)

    return let(found, verdict)


def infer_correct(answer: Column) -> Column:
    """Of free text: refused if a phrase refuses, else accepted if one accepts, else refused."""
    low = F.lower(text(answer))
    some = lambda ps: low.rlike("|".join(ps))
    return F.when(some(NO_PHRASES), False).when(some(YES_PHRASES), True).otherwise(False)


def resolve_conflicts(is_correct: Column, decision: Column, confidence: Column, reason: Column, conflicts: Column) -> Column:
    """(is_correct, confidence, reason) without contradictions: refusing conflicts, lowering ones, then a decision to reject."""
    names = F.array_distinct(F.transform(F.coalesce(conflicts, F.array().cast("array<string>")), lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))))
    among = lambda some: F.array_sort(F.array_intersect(names, F.array(*map(F.lit, some))))
    right, sure, why = F.coalesce(is_correct, F.lit(False)), F.coalesce(confidence, F.lit(0.0)), text(reason)
    critical = right & (F.size(among(REFUSING)) > 0)
    lowered = right & ~critical & (F.size(among(LOWERING)) > 0)
    rejected = right & ~critical & (F.lower(F.trim(text(decision))) == "reject")
    sure = F.when(critical, F.least(sure, F.lit(0.55))).when(lowered, F.least(sure, F.lit(0.72))).otherwise(sure)
    sure = F.when(rejected, F.least(sure, F.lit(0.6))).otherwise(sure)
    note = F.when(critical, F.concat(F.lit("hard_conflict_override("), F.array_join(among(REFUSING), ", "), F.lit(")"))).when(rejected, "decision_reject_override")
    why = F.when(note.isNull(), why).otherwise(F.concat_ws("; ", note, F.when(why != "", why)))
    return F.struct((right & ~critical & ~rejected).alias("is_correct"), sure.alias("confidence"), why.alias("reason"))


def chosen_candidate(best_index: Column, candidates: Column, confidence: Column, most: int = 5) -> Column:
    """(candidate, confidence): the candidate that a 1-based index names among the first few; a bad index caps confidence at 0.5."""
    i = best_index.try_cast("int")
    ok = (i >= 1) & (i <= F.least(F.size(candidates), F.lit(most)))
    return F.struct(F.when(ok, F.get(candidates, i - 1)).alias("candidate"), F.when(F.coalesce(ok, F.lit(False)), confidence).otherwise(F.least(confidence, F.lit(0.5))).alias("confidence"))


def ai_outcome(verify: str, search: str, review: str, local_rejection: Column, accept: float = 0.9, soft: float = 0.8, reviewing: bool = True) -> Column:
    """Where verify, search and review results leave an item. They are structs of is_correct, confidence, decision and
    hard_conflicts, or null; local_rejection says why the match that search found can't be used, or nothing.

    A verdict is accepted at `accept`, or from `soft` on where a review model stands behind it and it says accept
    without conflicts. A review that refuses ends either way.
    """
    of = lambda p, f: F.col(f"{p}.{f}")
    true = lambda c: F.coalesce(c, F.lit(False))
    right = lambda p: true(of(p, "is_correct"))
    sure = lambda p: F.coalesce(of(p, "confidence"), F.lit(0.0))
    nothing = lambda p: F.coalesce(F.size(of(p, "hard_conflicts")), F.lit(0)) <= 0
    soft_ok = lambda p: F.lit(reviewing) & right(p) & true(of(p, "decision") == "accept") & nothing(p) & (sure(p) >= soft) & (sure(p) < accept)
    refused = F.lit(reviewing) & F.col(review).isNotNull() & ~right(review)
    verified = right(verify) & ((sure(verify) >= accept) | soft_ok(verify))
    return (
        F.when(verified, F.when(refused, "ai_review_rejected").otherwise("ai_verified"))
        .when(F.col(search).isNull(), "ai_rejected")
        .when((sure(search) < accept) & ~soft_ok(search), "ai_low_confidence")
        .when(text(local_rejection) != "", "ai_rejected")
        .when(refused, "ai_review_rejected")
        .otherwise("ai_search_accepted")
    )


def local_safety(store_product_id: Column, component_reason: Column) -> Column:
    """Why a model's choice can't be used: it can't be ordered, or its components differ; empty if it can."""
    return F.when(store_product_id.isNull(), "missing storeProductId").when(component_reason != "ok", F.concat(F.lit("component mismatch: "), component_reason)).otherwise("")


#: Confidence from which a review overrides the first model.
OVERRIDE = 0.75


def review_state(first: Column, component_reason: Column, api_failed: Column, review_right: Column, review_confidence: Column) -> Column:
    """How a second model's review leaves a first decision (ai_confirmed, ai_corrected, ai_found or ai_rejected).

    Tried in order: a failed first call (the review decides alone, and only with confidence; a failure is never taken
    for a confirmation), components that differ, agreement, disagreement.
    """
    said_yes = first.isin("ai_confirmed", "ai_corrected", "ai_found")
    sure = review_confidence >= OVERRIDE
    kept = F.concat(first, F.lit("_kept_low_confidence_review"))
    return (
        F.when(api_failed, F.when(review_right & sure, "ai_confirmed").otherwise("ai_review_rejected"))
        .when(~component_reason.isin("", "ok"), "ai_review_rejected")
        .when(said_yes == review_right, F.concat(first, F.lit("_reviewed")))
        .when(~sure, kept)
        .when(said_yes, "ai_review_rejected")
        .otherwise("ai_review_search")
    )


def search_failure(found: Column, error_code: Column, parse_failed: Column, best_index: Column, confidence: Column, accept: float = 0.9) -> Column:
    """Why an AI search gave no match."""
    return (
        F.when(~found, "no_ai_result")
        .when(text(error_code) != "", error_code)
        .when(F.coalesce(parse_failed, F.lit(False)), "invalid_json")
        .when(F.coalesce(best_index, F.lit(0)) == 0, "best_index_0")
        .when(confidence < accept, "confidence_below_threshold")
        .otherwise("no_record")
    )


def first_filled(*values: Column) -> Column:
    """The first value that is not blank: of verify, search and review, which model or provider answered."""
    return F.coalesce(*(F.when(text(v) != "", v) for v in values), F.lit(""))


def quota_hints(df: DataFrame, body: str = "error_body") -> DataFrame:
    """Blank quota columns filled from retry_after, where the error's text says that a free quota ran out."""
    hit = text(F.col(body)).contains("FreeUsageLimitError")
    fill = lambda c, v, when=F.lit(True): F.when(hit & when & (text(F.col(c)) == ""), v).otherwise(F.col(c))
    has = lambda c: text(F.col(c)) != ""
    after = {
        "quota_reset_day": fill("quota_reset_day", F.col("retry_after"), has("retry_after")),
        "quota_reset_day_in": F.when(hit & has("retry_after") & ~has("quota_reset_day"), F.col("retry_after_in")).otherwise(F.col("quota_reset_day_in")),
        "quota_reset_in": fill("quota_reset_in", F.col("retry_after_in"), has("retry_after_in")),
        "quota_remaining_day": fill("quota_remaining_day", F.lit("0")),
    }
    return df.withColumns(after)


def required_fields(answer: Column, required: list[str]) -> Column:
    """`ok`, `invalid_json`, or `missing_fields:a,b`."""
    keys = F.json_object_keys(text(answer))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    return F.when(keys.isNull(), "invalid_json").when(F.size(missing) > 0, F.concat(F.lit("missing_fields:"), F.array_join(missing, ","))).otherwise("ok")


def response_content(payload: Column) -> Column:
    """A chat answer's text: a string, or its text parts joined."""
    body = F.get_json_object(payload, "$.choices[0].message.content")
    parts = F.from_json(body, "array<struct<type: string, text: string>>")
    return F.when(body.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")).otherwise(body)


def api_error_code(status: Column, body: Column) -> Column:
    low = F.lower(text(body))
    return (
        F.when((status == 429) | low.contains("rate limit"), "rate_limited")
        .when(status.isin(401, 403), "auth_failed")
        .when((status == 404) | low.contains("model_not_found"), "model_not_found")
        .when(status >= 500, "server_error")
        .when(status >= 400, "bad_request")
        .otherwise("")
    )


def duration_text(s: Column) -> Column:
    """`1d 2h 3m 4s`, without parts that are zero; `0s` for nothing."""
    whole = F.greatest(F.rint(s).cast("bigint"), F.lit(0))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    parts = F.concat_ws(" ", part(F.floor(whole / 86400), "d"), part(F.floor(whole % 86400 / 3600), "h"), part(F.floor(whole % 3600 / 60), "m"), part(whole % 60, "s"))
    return F.when(parts == "", "0s").otherwise(parts)


def reset_text(value: Column, now: Column) -> Column:
    """How long until a limit resets: seconds, an epoch, or an ISO time; other text as it is. now: epoch seconds."""
    raw = F.trim(text(value))
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("double"))
    at = F.unix_timestamp(F.try_to_timestamp(raw))
    left = F.when(number > 1_000_000_000, number - now).when(number.isNotNull(), number).otherwise(at - now)
    return F.when(raw == "", "").otherwise(F.when(left.isNotNull(), duration_text(left)).otherwise(raw))


def mask(secret: Column) -> Column:
    return F.when(F.length(secret) <= 6, "***").otherwise(F.concat(F.lit("..."), F.right(secret, F.lit(6))))


def split_list(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), ""))


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with its `{name}` places filled."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), text(v))
    return out


def component_context(p: str) -> Column:
    """A parsed name as one line for a prompt."""
    of = lambda f: F.col(f"{p}.{f}")
    or_dash = lambda c: F.when(c == "", "-").otherwise(c)
    route = F.array_join(F.array_sort(routes(tokens(of("normalized")))), "/")
    line = "normalized='%s', brand='%s', dosage=%s, qty='%s', volume='%s', weight='%s', form='%s', flavor='%s', class='%s', route='%s', imported=%s"
    known = [or_dash(of(f)) for f in ("qty", "volume", "weight", "form", "flavor")]
    return F.format_string(line, of("normalized"), of("brand"), or_dash(F.array_join(of("dosage_nums"), "/")), *known, of("product_class"), or_dash(route), F.when(of("imported"), "yes").otherwise("no"))


def candidate_line(position: Column, name_en: Column, name_ar: Column, score: Column, prices: Column, context: Column, review_reason: Column) -> Column:
    """A numbered candidate for a prompt, with its parsed components and what the rules hold against it."""
    against = F.when(text(review_reason).isin("", "ok"), "").otherwise(F.concat(F.lit("\n   rule_review: candidate entered AI review despite "), review_reason, F.lit("; accept only if the products are truly equivalent")))
    return F.concat(position.cast("string"), F.lit(". "), text(name_en), F.lit(" / "), text(name_ar), F.format_string(" (score=%.1f", score), text(prices), F.lit(")\n   parsed: "), context, against)
