"""Operator 13: clusters of vectors by Lloyd's method over their distinct values.

Components become whole numbers (`vectors`). Equal vectors are one row with a multiplicity: grouped with sums in the task first,
so that a vector which a third of all rows hold is no single task's work. Each round reads the distinct vectors once, assigns them and adds weighted
whole numbers, a row for each cluster and component from every task; centroids, k of them, are all that the driver holds. In the end the
assignments are joined back to the ids by the vectors themselves, the few hot ones apart (`vectors.with_key`).

Dropped: vectors that are null, have another number of components than `dim`, or hold null or non-finite ones. Components are held within
the bound of `vectors`. A null id counts as an empty text in the draw of the first centroids, and is returned as null; ids that are equal are drawn in
the order of their vectors. Repeated rows are rows each. Fewer vectors than clusters make as many clusters. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, tidy
from weftline.llm.vectors import finite, matrix, squared, totals, whole_numbers, with_key

DIM, CLUSTERS, ROUNDS, SEED = 64, 8, 10, "3"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest) and the squared distance, for every row."""
    d = squared(x, centroids)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def _sums(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        out = np.zeros((len(centroids), 1 + dim), np.int64)
        for b in batches:
            x, n = matrix(b.column("v"), dim), np.asarray(b.column("n")).astype(np.int64)
            weighted = totals(np.column_stack([n, x * n[:, None]]), nearest(x, centroids)[0], len(centroids))
            out += weighted[:, 1:]
        rows = np.flatnonzero(out[:, 0])
        columns = [np.repeat(rows, 1 + dim), np.tile(np.arange(1 + dim), len(rows)), out[rows].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "place", "value"])

    return run


def _assigned(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = nearest(matrix(b.column("v"), dim), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), pa.array(at.astype(np.int32)), pa.array(d)], ["v", "n", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """Vectors of the ids whose hash with the seed is smallest, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.orderBy(rank, "v").limit(clusters).select("v").collect()]


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round over distinct vectors v of multiplicity n."""
    dim = centroids.shape[1]
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)
    sums = distinct.select("v", "n").mapInArrow(tidy(_sums(sent, dim)), "cluster long, place long, value long")
    sums = sums.groupBy("cluster", "place").agg(F.sum("value").alias("value")).toPandas().to_numpy(np.int64)  # clusters x (1 + dim) at most
    sent.destroy()
    now = np.zeros((len(centroids), 1 + dim), np.int64)
    now[sums[:, 0], sums[:, 1]] = sums[:, 2]
    full = now[:, 0] > 0
    out = centroids.copy()
    out[full] = now[full, 1:] // now[full, :1]
    return out


def cluster(rows: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia and inertia of every kept vector, and the centroids."""
    scratch = Scratch(rows.sparkSession)
    kept = rows.filter(finite(F.col(embedding)) & (F.size(embedding) == dim))
    d = scratch.save(kept.select(F.col(vec_id).alias("vec_id"), whole_numbers(F.col(embedding), dim).alias("v")), "vectors")
    distinct = scratch.save(d.groupBy("v").agg(F.count("*").alias("n")), "distinct")
    centroids = np.array(first_centroids(d, clusters, seed), np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    assigned = scratch.save(distinct.mapInArrow(tidy(_assigned(sent, dim)), distinct.select("v", "n").schema.add("cluster", "integer").add("distance", "long")), "assigned")
    scratch.drop(distinct)
    sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("inertia")).collect()}
    out = with_key(d, assigned, "v", sum(r["n"] for r in sums.values())).select("vec_id", "cluster", "distance")
    own = of_cluster([sums[c]["inertia"] if c in sums else 0 for c in range(len(centroids))], "long")
    return out.select("*", own.alias("cluster_inertia"), F.lit(sum(r["inertia"] for r in sums.values())).cast("long").alias("inertia")), centroids


def of_cluster(values: list, kind: str) -> Column:
    """The value of each row's cluster."""
    return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
