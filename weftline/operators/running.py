"""Running sums and maxima over groups of any size: no group is one task's.

Rows are dealt to ranges of group and order and written once, with their places. Sums run within the part of a group that a range has; a
group that several ranges share has a row for each of them, from which what came before a range follows. A range's borders are crossed by two
groups at most, so these rows are at most two a range, and they go to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.shared import Scratch


def ranged(df: DataFrame, group: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """df by ranges of group and order, with `_part`, the range, and `_place`, which rises along the order. A group's order must be total."""
    by = [*(F.col(g) for g in group), *order]
    d = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    return scratch.save(d, "ranged").withColumn("_part", F.shiftright("_place", 33))


def before(rows: DataFrame, group: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """rows of `ranged`, or some of them, with the sums (0 at first) and maxima (null at first) of the rows of their group before them."""
    sums, maxima = sums or {}, maxima or {}
    of = {n: (F.sum(c), True) for n, c in sums.items()} | {n: (F.max(c), False) for n, c in maxima.items()}
    inside = Window.partitionBy("_part", *group).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *group).agg(*(x.alias(f"_of_{n}") for n, (x, _) in of.items()))
    parts = parts.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).filter("_ranges > 1")
    total = {n: F.sum(f"_of_{n}").over(earlier) if add else F.max(f"_of_{n}").over(earlier) for n, (_, add) in of.items()}
    edge = parts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), *(c.alias(f"_before_{n}") for n, c in total.items()))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    d = rows.withColumns({f"_in_{n}": x.over(inside) for n, (x, _) in of.items()}).join(F.broadcast(edge), same, "left")
    for n, (_, add) in of.items():
        a, b = F.col(f"_before_{n}"), F.col(f"_in_{n}")
        d = d.withColumn(n, F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if add else F.greatest(a, b))
    return d.drop("_p", *(f"_g{i}" for i in range(len(group))), *(f"{k}{n}" for n in of for k in ("_before_", "_in_")))
