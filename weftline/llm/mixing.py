"""Operator 4: mixing sources to target weights by Pareto order sampling.

Each source gets a word target (weights share `share` of all words, no source over `most` times its size). Of
every document of a source, floor(target / size) whole copies are certain. What is left of the target is drawn
without replacement: documents are ranked by random odds u / (1 - u) over inclusion odds p / (1 - p) and taken
in that order until the words are reached; one closing document, the best fit to the remaining gap, may follow.

Null or empty text: size 0, nothing taken. Null source: a source of its own, last in order. Repeated ids: rows of one id
share a draw and stand in a row by size; ties in all are taken alike. Very long texts count by all their words. Empty table:
empty result. Extra columns are ignored by `plan`; `mix` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, Scratch

WEIGHTS = (5.0, 2.0, 1.0)
#: Ranks are first counted in so many bins a source, so that no task orders a whole source.
BINS = 4096
#: A table of sources goes to every task if it has no more rows than this; else Spark joins it as it sees fit.
FEW_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^"))).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row a source, from (source, size). Null sources last, the rest by code point.

    Only the sums, one row a source, are ordered. With sources in order of most * size / weight, those before some
    place are held at their most and the others share what is left by weight. The level (words a unit of weight)
    rises up to the place where that fits and falls after it, so it is the largest one.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("k", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "k")
    everything = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("held", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("held")) / F.col("open_weight"))
    s = s.withColumn("level", F.max("level").over(everything))
    level = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return s.select("source", "source_size", level.alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from the id alone: reruns and other partitionings draw alike."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 48)


def odds(doc_id: Column, p: Column, seed: str) -> Column:
    """Random odds over inclusion odds: the lowest are drawn first. Null where nothing is drawn."""
    u = uniform(doc_id, seed)
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def bin_of(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * BINS).cast("int")


def planned(docs: DataFrame, scratch: Scratch, seed: str, doc_id: str, text: str, source: str, **how) -> tuple[DataFrame, bool]:
    """The plan with what decided it, and whether sources are few."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    d = scratch.save(d, "sizes")  # texts are read once; ids, sources and sizes from here on
    t = scratch.save(targets(d, **how), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    few = t.count() <= FEW_SOURCES

    def of_source(rows: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
        """rows with the columns of their source: sources has a row for each, at most, under s2."""
        return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("s2")), how).drop("s2")

    d = of_source(d, t.withColumnsRenamed({"source": "s2"}), "inner")
    d = d.withColumn("certain", F.floor(ratio)).withColumn("p", ratio - F.col("certain"))
    d = d.withColumn("rank", odds(F.col("doc_id"), F.col("p"), seed)).withColumn("left", F.col("target") - F.col("certain") * F.col("source_size"))
    d = d.withColumn("bin", bin_of(F.col("rank")))
    # words of each bin, then the words before it: at most BINS rows a source
    draw = d.filter("p > 0 and size > 0")
    bins = draw.groupBy("source", "bin", "left").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the one bin of a source in which its target falls
    edge = bins.filter("before < left and before + words >= left").select(
        F.col("source").alias("s2"), F.col("bin").alias("edge_bin"), F.col("before").alias("edge_before")
    )
    d = of_source(d, edge)
    inside = (F.col("bin") == F.col("edge_bin")) & (F.col("size") > 0)
    running = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = d.filter(inside).withColumn("upto", F.col("edge_before") + F.sum("size").over(running))
    at_edge = at_edge.withColumn("drawn", F.col("upto") <= F.col("left"))
    rest = d.filter(~F.coalesce(inside, F.lit(False)))
    rest = rest.withColumn("upto", F.lit(None).cast("long")).withColumn(
        "drawn", F.coalesce((F.col("p") > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))), F.lit(False))
    )
    d = scratch.save(at_edge.unionByName(rest), "drawn")
    # the closing document: it brings the words nearest to the target, if it brings them nearer at all
    gap = d.groupBy("source", "left").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("got"))
    gap = gap.select(F.col("source").alias("s2"), (F.col("left") - F.col("got")).alias("gap"))
    near = of_source(d.filter("not drawn and p > 0 and size > 0"), gap, "inner")
    near = near.withColumn("off", F.abs(F.col("gap") - F.col("size"))).filter("off < gap")
    close = near.groupBy("source").agg(F.min(F.struct("off", "rank", "doc_id", "size")).alias("c"))
    close = close.select(F.col("source").alias("s2"), F.col("c.doc_id").alias("c_id"), F.col("c.size").alias("c_size"), F.col("c.rank").alias("c_rank"))
    d = of_source(d, close)
    closing = ~F.col("drawn") & F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("size") == F.col("c_size")) & F.col("c_rank").isNotNull()
    d = d.withColumn("closing", F.coalesce(closing, F.lit(False)))
    return d.withColumn("copies", (F.col("certain") + F.when(F.col("drawn") | F.col("closing"), 1).otherwise(0)).cast("long")), few


def plan(docs: DataFrame, seed: str = "mix-1", doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies to take), taken (their words)."""
    d, _ = planned(docs, Scratch(docs.sparkSession), seed, doc_id, text, source, **how)
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix-1", doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the plan takes it; rows alike in id, size and source are taken alike.

    A source's draw ends at one place in the order of its ranks. So a row of a source for each, sent to every task where they
    are few, says of every document what becomes of it, and no text is shuffled; else documents are joined with their sources.
    """
    d, few = planned(docs, Scratch(docs.sparkSession), seed, doc_id, text, source, **how)
    place = F.struct("rank", "doc_id", "size")
    one = {c: F.first(c) for c in ("certain", "p", "edge_bin")}
    ends = {"last": F.max(F.when(F.col("drawn") & (F.col("size") > 0), place)), "close": F.max(F.when(F.col("closing"), place))}
    s = d.groupBy("source").agg(*(x.alias(f"s_{c}") for c, x in {**one, **ends}.items())).withColumnRenamed("source", "s_source")
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs is named as one of the plan's
    id_, words, from_ = (F.col(names[docs.columns.index(c)]) for c in (doc_id, text, source))
    d = docs.toDF(*names).withColumn("s_size", size_of(words))
    d = d.join(F.broadcast(s) if few else s, from_.eqNullSafe(F.col("s_source")))
    d = d.withColumn("s_rank", odds(id_, F.col("s_p"), seed))
    own = F.struct(F.col("s_rank").alias("rank"), id_.alias("doc_id"), F.col("s_size").alias("size"))
    empty = F.col("s_edge_bin").isNull() | (bin_of(F.col("s_rank")) < F.col("s_edge_bin"))
    drawn = (F.col("s_p") > 0) & F.when(F.col("s_size") > 0, own <= F.col("s_last")).otherwise(empty)
    extra = F.coalesce(drawn, F.lit(False)) | F.coalesce(own == F.col("s_close"), F.lit(False))
    d = d.withColumn("s_copies", (F.col("s_certain") + extra.cast("int")).cast("int")).filter("s_copies > 0")
    return d.withColumn("s_n", F.explode(F.sequence(F.lit(1), F.col("s_copies")))).select(*names).toDF(*docs.columns)
