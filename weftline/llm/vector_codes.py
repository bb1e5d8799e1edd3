"""Operator 11: product codes of vectors, whose nearest entries are found in annuli of norms.

Components become whole numbers (`vectors`), vectors are cut into equal parts, and each part has a codebook of at most 256 entries that
a few rounds of Lloyd's method fit. The nearest entry of a part lies no farther from it in norm than in distance: entries are sorted by norm once a
codebook, those of about the part's own norm give a first best distance, binary search finds the interval of norms that it allows, both
ends included, and only entries of that annulus are measured, exactly. Parts are worked on in blocks of like norms, so
that a block's annulus is one slice of the sorted entries and one product of matrices.

A round reads the written vectors once and sums in the task: 256 entries a part, their numbers and components, whatever the rows.

Dropped: vectors that are null, or hold null or non-finite components, or have another number of components than `dim` (by default the number that
most others have among those that `parts` divides; of equally common ones the smaller; empty vectors never). Components are held within the bound of
`vectors`. Null ids come last in order, and ids that are equal by their vectors; repeated rows are coded one by one. Fewer vectors than entries
make as many entries. Null labels are one label. An empty table gives no rows. Columns other than the three are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, tidy
from weftline.llm.vectors import finite, matrix, squared, totals, whole_numbers, with_key

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts of like norm that are measured at once, and entries around their norm that give the first best distance.
BLOCK, FIRST = 256, 8


class Annuli:
    """The entries of one codebook in the order of their norms. `met` counts the distances that were measured."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.met = 0

    def _measured(self, parts: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        ring = np.sort(self.order[lo:hi])  # by number, so that the first of the nearest has the lowest
        d = squared(parts, self.entries[ring])
        self.met += d.size
        at = d.argmin(1)
        return ring[at], d[np.arange(len(parts)), at]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lowest) and the squared distance to it, for every part."""
        own = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        by_norm = np.argsort(own, kind="stable")
        for i in range(0, len(parts), BLOCK):
            rows = by_norm[i : i + BLOCK]
            block, norm = parts[rows], own[rows]
            lo = max(0, int(np.searchsorted(self.norms, norm[0])) - FIRST // 2)
            _, best = self._measured(block, min(lo, max(0, len(self.norms) - FIRST)), max(FIRST, int(np.searchsorted(self.norms, norm[-1])) + FIRST // 2))
            reach = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (1 + norm + reach)  # rounding never leaves an entry of the annulus out
            lo = int(np.searchsorted(self.norms, (norm - reach - slack).min(), "left"))
            hi = int(np.searchsorted(self.norms, (norm + reach + slack).max(), "right"))
            index[rows], distance[rows] = self._measured(block, lo, hi)
        return index, distance


def _sums(books, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books.value]
        width = dim // len(annuli)
        out = np.zeros((len(annuli), len(annuli[0].entries), 1 + width), np.int64)
        for b in batches:
            x = matrix(b.column(0), dim)
            for p, a in enumerate(annuli):
                own = x[:, p * width : (p + 1) * width]
                out[p] += totals(own, a.nearest(own)[0], len(a.entries))
        part, entry = np.nonzero(out[:, :, 0])
        rows = out[part, entry]
        n = rows.shape[1]
        columns = [np.repeat(part, n), np.repeat(entry, n), np.tile(np.arange(n), len(rows)), rows.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "value"])

    return run


def _coded(books, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books.value]
        width = dim // len(annuli)
        for b in batches:
            x = matrix(b.column("v"), dim)
            found = [a.nearest(x[:, p * width : (p + 1) * width]) for p, a in enumerate(annuli)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            columns = [b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def fitted(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of vectors (vec_id, v), a matrix of whole numbers for each part; no entries if there are no vectors."""
    if entries > 256:
        raise ValueError("a code is a byte: at most 256 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    books = [np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)]
    for _ in range(rounds if len(start) else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        sums = vectors.select("v").mapInArrow(tidy(_sums(sent, dim)), "part long, entry long, place long, value long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).toPandas().to_numpy(np.int64)  # parts x entries x (1 + width) at most
        sent.destroy()
        now = np.zeros((parts, len(start), 1 + dim // parts), np.int64)
        now[sums[:, 0], sums[:, 1], sums[:, 2]] = sums[:, 3]
        for p, e in zip(*np.nonzero(now[:, :, 0]), strict=True):
            books[p][e] = now[p, e, 1:] // now[p, e, 0]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def commonest_size(rows: DataFrame, embedding: str, parts: int) -> int | None:
    n = rows.filter(finite(F.col(embedding))).groupBy(F.size(embedding).alias("size")).count().filter(f"size > 0 and size % {parts} = 0")
    best = n.orderBy(F.desc("count"), "size").first()
    return best and best["size"]


def codes(rows: DataFrame, dim: int | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error and label_error of every kept vector, and the codebooks."""
    scratch = Scratch(rows.sparkSession)
    dim = dim or commonest_size(rows, embedding, parts) or parts
    kept = rows.filter(finite(F.col(embedding)) & (F.size(embedding) == dim))
    d = scratch.save(kept.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole_numbers(F.col(embedding), dim).alias("v")), "vectors")
    books = fitted(d, dim, parts, entries, rounds)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = d.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    coded = scratch.save(d.mapInArrow(tidy(_coded(sent, dim)), kinds), "coded")
    scratch.drop(d)
    sums = scratch.save(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    return with_key(coded, sums, "label", total), books
