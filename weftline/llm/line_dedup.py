"""Operator 3: line dedup by pairwise alignment.

1. A line is known by its words (runs of blanks count as one). Lines of LEAST_WORDS words or more point to other
   documents; shorter ones only take part in alignments.
2. Of documents whose lines are all alike only the first takes part; a later one is aligned with itself.
3. Lines find the pairs: each holder but the first meets the line's first holder and the holder before it, so pairs are
   never more than twice the lines. Where a line of a document was in none of its aligned blocks, the document meets the
   line's earlier holders one by one, until the line is in a block or none is left. Every pair is aligned by patience diff
   over its full lines: lines that both hold once are anchors, the longest increasing chain of them is kept, and equal
   lines between anchors extend the blocks. A stretch without such lines is aligned by a longest common subsequence.
4. Aligned blocks go from the later document, if one of their lines has LEAST_WORDS words. Blocks are found on the
   input, not on what is left, so the order of pairs doesn't matter. Repeats within one document stay.

Null or empty text: no lines, nothing removed. Null doc_id: left as it is. Rows that share a doc_id stand in order of
their texts' hashes; repeated rows count once and are treated alike. Very long texts are read whole; an alignment holds two
documents' line hashes, and a longest common subsequence is halved where it would take too much. Ties (equally long chains or
subsequences) are settled by the first found, alike in every run. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, plain_words, slices, text_key, tidy

LEAST_WORDS = 4
#: Bits that an alignment by longest common subsequence holds at once.
BITS = 1 << 28


def line_hashes(text: str | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each \\n-split line: a hash of its words (0: none), and whether it has words enough to point."""
    split = [plain_words(x) for x in text.split("\n")] if text else []
    h = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) or 1 if w else 0 for w in split), np.uint64, len(split))
    return h.view(np.int64), np.fromiter((len(w) >= least for w in split), bool, len(split))


def _lined(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            lines, long, points, same = [], [], [], []
            for t in b.column(2).to_pylist():
                h, far = line_hashes(t, least)
                lines.append(h.tobytes())
                long.append(np.packbits(far).tobytes())
                points.append(np.unique(h[far]))
                same.append(xxhash.xxh3_128_digest(lines[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.binary()), pa.array(long, pa.binary()), pa.array(points, pa.list_(pa.int64())), pa.array(same, pa.binary())], ["doc_id", "key", "lines", "long", "points", "same"])

    return run


def _increasing(later: list[int]) -> list[int]:
    """Places of a longest increasing run, by piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(later)
    for i, x in enumerate(later):
        k = bisect.bisect_left(tops, x)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [x], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, blanks left out: a row of bits for each of a, halved where they take too much."""
    both = (set(a) & set(b)) - {0}
    at_a, at_b = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    stack, found = [(0, len(at_a), 0, len(at_b))], []
    while stack:
        a0, a1, b0, b1 = stack.pop()
        i, j = a1 - a0, b1 - b0
        if not i or not j:
            continue
        own, other = [a[x] for x in at_a[a0:a1]], [b[x] for x in at_b[b0:b1]]
        if i > 1 and i * j > BITS:
            mid = i // 2
            left, right = _lengths(own[:mid], other), _lengths(own[: mid - 1 : -1], other[::-1])[::-1]
            cut = int(np.argmax(left + right))
            stack += [(a0, a0 + mid, b0, b0 + cut), (a0 + mid, a1, b0 + cut, b1)]
            continue
        rows = list(_rows(own, other))
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append((at_a[a0 + i], at_b[b0 + j]))
    return found


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Before and after each of a: bits of b, zero where the longest common subsequence up to there grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    s = full
    yield s
    for x in a:
        u = s & where.get(x, 0)
        s = (s + u | s - u) & full
        yield s


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of a and each beginning of b."""
    last = 0
    for last in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal, non-blank lines of a and b, in order."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n_a, n_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(b[b0:b1], b0) if x and n_b[x] == 1 and n_a[x] == 1}
        once = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where]
        anchors = [once[k] for k in _increasing([j for _, j in once])]
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
        else:
            found += [(a0 + i, b0 + j) for i, j in longest_common(a[a0:a1], b[b0:b1])]
    return sorted(p for p in found if a[p[0]])


def common_lines(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> list[int]:
    """Lines of b in blocks aligned with a that hold at least one line that points."""
    pairs = patience(a.tolist(), b.tolist())
    out: list[int] = []
    i = 0
    while i < len(pairs):
        j = i + 1
        while j < len(pairs) and pairs[j][0] == pairs[j - 1][0] + 1 and pairs[j][1] == pairs[j - 1][1] + 1:
            j += 1
        block = [q for _, q in pairs[i:j]]
        if far[block].any():
            out += block
        i = j
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair: the later document's lines that go, and the pointing lines among them by their hashes."""
    for b in batches:
        gone, met = [], []
        for first, lines, long in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            own = np.frombuffer(lines, np.int64)
            far = np.unpackbits(np.frombuffer(long, np.uint8), count=len(own)).astype(bool)
            gone.append(common_lines(np.frombuffer(first, np.int64), own, far))
            at = np.array(gone[-1], np.int64)
            met.append(np.unique(own[at[far[at]]]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int64())), pa.array(met, pa.list_(pa.int64()))], ["doc_id", "key", "gone", "met"])


def _previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted holders of lines, each with the one before it in its task; edge: 1 where a task begins, 2 its last row again."""
    names, last = ["line", "doc_id", "key", "prev_id", "prev_key", "edge"], None
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    for b in (b for b in batches if b.num_rows):
        own = [np.asarray(b.column(i)) for i in range(3)]
        line, prev_id, prev_key = (np.concatenate([[x[0] if last is None else last[i]], x[:-1]]) for i, x in enumerate(own))
        none = line != own[0]
        edge = np.zeros(len(line), np.int32)
        if last is None:
            none[0], edge[0] = True, 1
        last = [x[-1] for x in own]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(prev_id, pa.int64(), mask=none), pa.array(prev_key.astype(np.int32), pa.int32(), mask=none), pa.array(edge)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v if v is None else int(v)], k) for v, k in zip([*last, None, None, 2], kinds, strict=True)], names)


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            n_lines, n_removed, kept = [], [], []
            for t, blocks, common in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                lines = t.split("\n") if t else []
                gone = {i for x in blocks or () for i in x}
                if common:
                    h, far = line_hashes(t, least)
                    gone |= set(np.flatnonzero(np.isin(h, np.array(common, np.int64)) & far).tolist())
                n_lines.append(len(lines))
                n_removed.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])

    return run


_GONE = "doc_id long, key int, gone array<long>, met array<long>"
_OWN, _PREV = ["doc_id", "key"], ["prev_id", "prev_key"]


def _align(lined: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of an own and a previous document: what goes from the own one. lined: one row a document."""
    prev = lined.select(F.col("doc_id").alias("prev_id"), F.col("key").alias("prev_key"), F.col("lines").alias("first_lines"))
    pairs = pairs.join(prev, _PREV).join(lined.select(*_OWN, "lines", "long"), _OWN)
    return pairs.select(*_OWN, "first_lines", "lines", "long").mapInArrow(tidy(_aligned), _GONE)


def _held(points: DataFrame) -> DataFrame:
    return points.groupBy("line").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")


def _by_first(lined: DataFrame, rare: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What goes if each line names its first holder alone, and lines of more than `rare` holders are blocks of their own."""
    points = lined.select(F.struct("doc_id", "key").alias("doc"), F.explode("points").alias("line"))
    met = points.join(scratch.save(_held(points), "held"), "line").filter("doc > first")
    met = scratch.save(met.select("doc", "first", "line", (F.col("n") <= rare).alias("rare")), "met")
    pairs = met.filter("rare").select("doc.*", F.col("first.doc_id").alias("prev_id"), F.col("first.key").alias("prev_key")).distinct()
    gone = _align(lined.dropDuplicates(_OWN), pairs)
    return gone, met.filter("not rare").select("doc.*", "line").groupBy("doc_id", "key").agg(F.collect_set("line").alias("common"))


def _chain(met: DataFrame, scratch: Scratch) -> DataFrame:
    """line, its holders but the first, and the holder before each; a line's holders may lie in many tasks."""
    spark = met.sparkSession
    kinds = "line long, doc_id long, key int, prev_id long, prev_key int, edge int"
    sorted_ = met.select("line", *_OWN).repartitionByRange("line", *_OWN).sortWithinPartitions("line", *_OWN)
    chain = scratch.save(sorted_.mapInArrow(tidy(_previous), kinds), "chain")
    edges = sorted(tuple(r) for r in chain.filter("edge > 0").select("line", *_OWN, "edge").collect())  # two a task
    joined = [(*b[:3], *a[1:3], 0) for a, b in zip(edges, edges[1:], strict=False) if a[3] == 2 and b[3] == 1 and a[0] == b[0]]
    return chain.filter("prev_id is not null").unionByName(spark.createDataFrame(joined, kinds)).drop("edge")


def _by_all(lined: DataFrame, scratch: Scratch) -> DataFrame:
    """What goes by copies, by each line's first and previous holder, then by earlier holders for lines that none has met."""
    lined = lined.filter("size(points) > 0")
    heads = lined.groupBy("same").agg(F.min(F.struct(*_OWN)).alias("head")).select("head.*")
    heads = scratch.save(heads, "heads")
    copies = lined.join(heads, _OWN, "left_anti").select(*_OWN, F.col("lines").alias("first_lines"), "lines", "long")
    gone = [copies.mapInArrow(tidy(_aligned), _GONE).dropDuplicates(_OWN)]
    own = scratch.save(lined.join(heads, _OWN).dropDuplicates(_OWN), "own")
    points = own.select(F.struct(*_OWN).alias("doc"), F.explode("points").alias("line"))
    met = scratch.save(points.join(_held(points), "line").select("line", "doc.*", "first"), "met")
    chain = _chain(met, scratch)
    first = met.select(*_OWN, F.col("first.doc_id").alias("prev_id"), F.col("first.key").alias("prev_key")).filter("doc_id != prev_id or key != prev_key")
    left, pairs = chain, first.unionByName(chain.select(*_OWN, *_PREV))
    before = chain.select("line", F.col("doc_id").alias("prev_id"), F.col("key").alias("prev_key"), F.col("prev_id").alias("next_id"), F.col("prev_key").alias("next_key"))
    while True:
        gone.append(scratch.save(_align(own, pairs.distinct()).filter("size(gone) > 0"), "aligned"))
        done = gone[-1].select(*_OWN, F.explode("met").alias("line")).distinct()
        left = left.join(done, ["line", *_OWN], "left_anti").join(before, ["line", *_PREV])
        left = scratch.save(left.select("line", *_OWN, F.col("next_id").alias("prev_id"), F.col("next_key").alias("prev_key")), "left")
        if left.isEmpty():
            break
        pairs = left.select(*_OWN, *_PREV)
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, rare: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text. rare: where given, lines name their first holders alone (`_by_first`)."""
    scratch = Scratch(docs.sparkSession)
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    d = all_docs.filter("doc_id is not null")
    lined = d.mapInArrow(tidy(_lined(least)), "doc_id long, key int, lines binary, long binary, points array<long>, same binary")
    lined = scratch.save(lined, "lined")
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("gone", "array<array<long>>"), ("common", "array<long>"))}
    gone, common = (_by_all(lined, scratch), None) if rare is None else _by_first(lined, rare, scratch)
    gone = gone.filter("size(gone) > 0").groupBy("doc_id", "key").agg(F.collect_set("gone").alias("gone"))
    found = d.join(gone, _OWN, "left")
    found = found.join(common, _OWN, "left") if common is not None else found.withColumn("common", nothing["common"])
    found = found.select("doc_id", "text", "gone", "common")
    rest = all_docs.filter("doc_id is null").select("doc_id", "text", *nothing.values())
    kinds = "doc_id long, n_lines long, n_removed long, kept_text string"
    return found.mapInArrow(tidy(_cut(least)), kinds).unionByName(rest.mapInArrow(tidy(_cut(least)), kinds))
