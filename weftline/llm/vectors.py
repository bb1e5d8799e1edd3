"""What the operators on embeddings share: whole numbers for components, exact distances, sums, and joins with hot keys.

A component x becomes floor(1024 * x), x as double, held within `bound(dim)` either way, so that every distance of two vectors fits 64 bits
(for 64 components that is 131,072 in x).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than so small a share of all rows is hot; there are never more such keys than 1 / share.
HOT = 1 / 1000


def bound(dim: int) -> int:
    """Components of dim vectors up to this, squared differences of which sum to less than 2 ** 62."""
    return 1 << max(1, (62 - math.ceil(math.log2(max(dim, 1)))) // 2 - 1)


def finite(embedding: Column) -> Column:
    """True for vectors that are there and have neither null nor non-finite components."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(whole, F.lit(False))


def whole_numbers(embedding: Column, dim: int) -> Column:
    most = F.lit(float(bound(dim)))
    return F.transform(embedding, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * 1024))).cast("int"))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A batch's column of vectors as rows of 64-bit numbers."""
    return np.asarray(vectors.flatten()).astype(np.int64).reshape(-1, dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b: exact whole numbers, as float64 where that holds them, else as int64."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * top * top < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T)) + (b * b).sum(1)[None, :]


def totals(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of each group, with their number in front: groups x (1 + width), exact."""
    out = np.zeros((groups, 1 + rows.shape[1]), np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    if len(order):
        out[group[order[starts]]] = np.add.reduceat(np.column_stack([np.ones(len(rows), np.int64), rows])[order], starts)
    return out


def with_key(rows: DataFrame, keyed: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined (inner, nulls are equal) with keyed, which has a row for each key and in `n` how many rows have it, of `total`.

    Hot keys, of which there are 1 / HOT at most whatever the data, go to every task; the others meet in a shuffle, where
    none has more than a share HOT of the rows. keyed's other columns must not be named as those of rows.
    """
    k = keyed.withColumnRenamed(key, "key_of")
    hot, other = k.filter(F.col(n) > total * HOT).drop(n), k.filter(F.col(n) <= total * HOT).drop(n)
    same = rows[key].eqNullSafe(F.col("key_of"))
    some = rows.join(F.broadcast(hot), same).drop("key_of")
    rest = rows.join(F.broadcast(hot.select("key_of")), same, "left_anti").join(other, same).drop("key_of")
    return some.unionByName(rest)
