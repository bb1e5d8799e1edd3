"""Operator 1: quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit a rule. A policy is a
versioned mask over those bits, so a new policy, or the ablation of one, never reads the texts again.

Null or empty text: zero words, zero everywhere, fails `few_words`. Repeated rows are judged row by row. Very long
texts are measured whole, in the row's own task; ties can't be, as every row is judged by itself. An empty table gives an empty ledger. Only doc_id and text are read; other columns, whatever their names, are
left out of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import word_list

#: Bit of each rule, and when it fails. Integer arithmetic only, so that results are exact.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 8 * word_chars"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("exclaims", "n_exclaims > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeat_words"]
#: Versions are never changed, only added.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["dup_lines"] | BIT["exclaims"] | BIT["short_words"] | BIT["long_words"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]


def _without(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements, and fail_bits (long)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("w", word_list(F.col("t")))
    d = d.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _without(F.col("t"), "!").alias("n_exclaims"),
    )
    # 3-word windows by hash and position; equal hashes are neighbours once sorted
    d = d.withColumn(
        "win",
        F.expr(
            "transform(if(n_words < 3, array(), sequence(0, cast(n_words - 3 as int))),"
            " i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, cast(i as int) as p))"
        ),
    )
    d = d.withColumn("some", F.expr("size(array_distinct(win.h)) < size(win)"))
    d = d.withColumn("s", F.expr("if(some, sort_array(win), slice(win, 1, 0))")).drop("w", "win")
    d = d.withColumn(
        "again",
        F.expr("sort_array(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h), x -> x.p))"),
    )
    d = d.withColumn(
        "n_repeat_words",
        F.expr("aggregate(transform(again, (p, i) -> least(3, coalesce(get(again, i + 1) - p, 3))), 0L, (a, x) -> a + x)"),
    )
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), 1 << i).otherwise(0).cast("long"))
    return d.select("doc_id", *MEASURES).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """The ledger with base_failed and kept, both from the bits alone."""
    fails = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return led.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE | POLICIES[version]))


def ablation(led: DataFrame, version: str) -> DataFrame:
    """A row for each rule of the policy: rejected by it, and by it alone (what dropping the rule would bring back).

    Rows meet in one count for each pattern of bits, at most 2 ** len(RULES) of them, whatever the size of the corpus.
    """
    mask = POLICIES[version]
    seen = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask))
    r = seen.withColumn("r", F.explode(rules)).select("bits", "count", "r.*")
    total = lambda when: F.sum(F.when(when, F.col("count")).otherwise(0)).alias
    return r.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("rejected"),
        total(F.col("bits") == F.col("bit"))("rejected_alone"),
        F.sum("count").alias("of"),
    )
