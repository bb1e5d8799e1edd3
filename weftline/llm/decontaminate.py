"""Operator 8: benchmark decontamination by suffix arrays over the training texts.

A shard is up to 8 MB of documents, or one of them. Words outside the benchmark's vocabulary end every match, so a shard's
array holds the suffixes of its runs of benchmark words. Runs are named by prefix doubling, together with the test texts:
equal stretches of 1, 2, 4, ... words have equal numbers, in order. So the array is sorted by its last numbers, every test
suffix is found in it by binary search of its own number, and the common prefix of two suffixes takes one comparison a
doubling: no step grows with the length of a match. Doubling ends where no test stretch stands in the shard.

A test suffix that matches as far as a window marks the words of all suffixes that begin so. Searched the other way, each
training suffix has its longest verbatim match, and each document its longest and where it lies.

The benchmark is a stated query set: equal rows of it are one, very long items are cut into pieces that overlap by a window less a word,
and it is sent out in blocks of bounded size; each shard meets one block after the other, so its size may grow without limit. No
document leaves its task: there is no shuffle of texts.

Null or empty text: no words. An item shorter than a window, but not empty, is one window; items without words are
never found. Rows of the benchmark that share an item_id are one item; those without an id mark words, but are not counted
or listed. Repeated documents are judged row by row; of equally long matches (ties) a document gets that which begins first,
with one of the items that hold it; of an item in pieces, within one piece. Very long texts are a shard of their own, and very long matches cost no more than
short ones. Without documents or items the result is empty, or clean. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, tidy

WINDOW = 10
#: Bytes of benchmark text that are sent to tasks at once.
BLOCK_BYTES = 16 << 20
#: Bytes of an item beyond which it is cut into pieces, as a share of a block.
PIECE = 0.125
#: Bytes of training text in a shard, or one document.
SHARD_BYTES = 8 << 20
#: Pairs of a document and an item that are put together at once.
PAIRS = 1 << 22
#: Blocks that run in one stage; then the state is written.
CHAIN = 4
#: Lower-cases A-Z and blanks what parts words, below 0x80.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def doubled(t: np.ndarray, n: int, rest: np.ndarray) -> list[np.ndarray]:
    """Numbers of the stretches of 1, 2, 4, ... words that begin at each place of t: equal for equal ones, and in order.

    t: training runs up to n, test texts after, a zero behind each; rest: how many words each place has before the next
    zero. The last list is the first in which no whole stretch of the tests is one of the training runs.
    """
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int32)
    levels, width = [dense(t)], 1
    while True:
        rank = levels[-1]
        most = int(rank.max(initial=0)) + 1
        here = np.zeros(most, bool)
        here[rank[:n][rest[:n] >= width]] = True
        if not here[rank[n:][rest[n:] >= width]].any():
            return levels
        ahead = np.zeros(len(t), np.int64)
        ahead[: max(0, len(t) - width)] = rank[width:] + 1
        levels.append(dense(rank.astype(np.int64) * (most + 1) + ahead))
        width *= 2


def shared_length(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places from a and from b on are alike, up to what the levels tell."""
    d, size = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + d, b + d
        ok = (x < size) & (y < size)
        same = levels[k][np.where(ok, x, 0)] == levels[k][np.where(ok, y, 0)]
        d += (ok & same).astype(np.int64) << k
    return d


def search(levels: list[np.ndarray], order: np.ndarray, wanted: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted suffix its longest match among those of `order`, which are sorted, and which of them (its place in order)."""
    if not len(order) or not len(wanted):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.searchsorted(levels[-1][order], levels[-1][wanted])
    near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)])
    length = np.stack([np.minimum(shared_length(levels, wanted, order[x]), rest[wanted]) for x in near])
    best = length.argmax(axis=0)
    own = np.arange(len(wanted))
    return length[best, own], near[best, own]


def stretches(levels: list[np.ndarray], n: int, rest: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in order: the number of its group, of suffixes whose first `depth` words are the same. Groups are runs of order."""
    k = min(depth.bit_length() - 1, len(levels) - 1)
    step = [1 << k] * (depth >> k)  # of whole doublings, the last one set back so that all are covered
    new = np.zeros(len(order), bool)
    new[:1] = True
    starts = np.unique(np.minimum(np.cumsum([0, *step]), depth - (1 << k)))
    for at in starts:
        x = levels[k][np.minimum(order + at, len(levels[k]) - 1)]
        new[1:] |= x[1:] != x[:-1]
    short = rest[order] < depth  # stands alone
    new |= short
    new[1:] |= short[:-1]
    return np.cumsum(new) - 1


class Block:
    """Test suffixes of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        split = [(i, w) for i, t in items if (w := item_words(t))]
        self.ids = [i for i, _ in split]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        tests, starts, need, item = [], [], [], []
        for k, (_, ws) in enumerate(split):
            starts += range(len(tests), len(tests) + len(ws))
            need += [min(window, len(ws))] * len(ws)
            item += [k] * len(ws)
            tests += [self.vocab[w] for w in ws] + [0]
        self.tests, self.starts, self.need, self.item = (np.array(x, np.int64) for x in (tests, starts, need, item))
        self.item_at = np.zeros(len(self.tests), np.int64)  # of each place of tests
        self.item_at[self.starts] = self.item

    def shard(self, docs: list[list[bytes]]):
        """Of each document: mask of hit words, items found, longest match (words, item, start)."""
        get = self.vocab.get
        ids = [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)) for ws in docs]
        flat = np.concatenate([x for d in ids for x in (d, [0])] or [np.zeros(0, np.int64)]).astype(np.int64)
        first = np.cumsum([0] + [len(d) + 1 for d in ids])
        known = np.concatenate([[0], (flat != 0).astype(np.int8), [0]])
        edge = np.diff(known)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # the runs alone, a zero after each; back: where each word of them lies in flat
        length = b - a + 1
        back = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum())) if len(a) else np.zeros(0, np.int64)
        n = len(back)
        t = np.concatenate([np.where(back < len(flat), flat[np.minimum(back, max(len(flat) - 1, 0))], 0) if n else back, self.tests])
        zero = np.flatnonzero(t == 0)
        rest = zero[np.searchsorted(zero, np.arange(len(t)))] - np.arange(len(t)) if len(t) else t
        found: list[set[str]] = [set() for _ in docs]
        best = [(0, None, None)] * len(docs)
        mask = np.zeros(len(flat) + 1, np.int64)
        if n and len(self.starts):
            levels = doubled(t, n, rest)
            at, tests = np.flatnonzero(t[:n]), self.starts + n
            order = at[np.argsort(levels[-1][at], kind="stable")]
            longest, place = search(levels, order, tests, rest)
            for depth in np.unique(self.need[longest >= self.need]).tolist():
                full = np.flatnonzero((self.need == depth) & (longest >= depth))
                group = stretches(levels, n, rest, order, depth)
                hit = np.divmod(np.unique(group[place[full]] * len(self.ids) + self.item[full]), len(self.ids))  # group and item
                wanted = np.zeros(int(group[-1]) + 1, bool)
                wanted[hit[0]] = True
                some = np.flatnonzero(wanted[group])
                np.add.at(mask, back[order[some]], 1)
                np.add.at(mask, back[order[some]] + depth, -1)
                # documents of each group, once; then each with each item of the group
                doc_of = np.searchsorted(first, back[order[some]], "right") - 1
                whose = np.divmod(np.unique(group[some] * len(docs) + doc_of), len(docs))
                lo, hi = np.searchsorted(whose[0], hit[0], "left"), np.searchsorted(whose[0], hit[0], "right")
                ends, i = np.cumsum(hi - lo), 0
                while i < len(ends):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                    count = (hi - lo)[i:j]
                    d = whose[1][np.repeat(lo[i:j] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                    pairs = np.unique(d * len(self.ids) + np.repeat(hit[1][i:j], count))
                    for d, item in zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist(), strict=True):
                        if self.ids[item] is not None:
                            found[d].add(self.ids[item])
                    i = j
            # the other way: each training suffix's longest match, of which each document's first of the longest
            by_rank = tests[np.argsort(levels[-1][tests], kind="stable")]
            matched, which = search(levels, by_rank, at, rest)
            doc = np.searchsorted(first, back[at], "right") - 1
            rank = np.lexsort([at, -matched, doc])
            for k in rank[np.unique(doc[rank], return_index=True)[1]].tolist():
                item = self.ids[self.item_at[by_rank[which[k]] - n]]
                best[doc[k]] = (int(matched[k]), item, int(back[at[k]] - first[doc[k]]))
        hit = np.cumsum(mask) > 0
        return [(hit[first[d] : first[d] + len(ids[d])], sorted(found[d]), best[d]) for d in range(len(docs))]


_STATE = "n_words long, hits binary, items array<string>, longest long, longest_item string, longest_start long"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_STATE_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]


def _met(block, text: str):
    """Rows go through with their other columns as they are; the state, which stands last, takes in one more block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text), SHARD_BYTES)):
            old = {c: b.column(c).to_pylist() for c in _STATE_NAMES}
            docs = [item_words(t) for t in b.column(text).to_pylist()]
            state: list[list] = [[] for _ in _STATE_NAMES]
            for k, (mask, found, best) in enumerate(own.shard(docs)):
                if old["hits"][k]:
                    mask = mask | np.unpackbits(np.frombuffer(old["hits"][k], np.uint8), count=len(mask)).astype(bool)
                best = max(best, (old["longest"][k] or 0, old["longest_item"][k], old["longest_start"][k]), key=lambda x: x[0])
                row = (len(docs[k]), np.packbits(mask).tobytes() if mask.any() else b"", sorted({*(old["items"][k] or []), *found}), *best)
                for column, v in zip(state, row, strict=True):
                    column.append(v)
            new = [pa.array(x, kind) for x, kind in zip(state, _STATE_KINDS, strict=True)]
            rest = [b.column(i) for i in range(b.num_columns - len(new))]
            yield pa.RecordBatch.from_arrays([*rest, *new], b.schema.names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in b.column("hits").to_pylist()]
        items = [sorted(set(x or [])) for x in b.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        keep = [b.column(c) for c in ("longest", "longest_item", "longest_start")]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(n, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n], pa.bool_()), *keep],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_start"],
        )


def _pieces(window: int, most: int):
    """Items as they are, or, beyond so many bytes, cut between words, every piece with the last words, less than a window, of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, SHARD_BYTES)):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(text) * 4 <= most or len(text.encode("utf-8", "surrogatepass")) <= most:
                    rows.append((item, text))
                    continue
                words = item_words(text)
                ends = np.cumsum([len(w) + 1 for w in words])
                i = 0
                while i < len(words):
                    j = max(i + window, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
                    rows.append((item, b" ".join(words[i:j]).decode("utf-8", "surrogatepass")))
                    i = j - window + 1 if j < len(words) else len(words)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["item_id", "text"])

    return run


def _searched(d: DataFrame, text: str, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """d, whose columns are none of the state's, and the state after all blocks of the benchmark."""
    spark = d.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text <> ''").distinct()
    items = scratch.save(items.mapInArrow(tidy(_pieces(window, max(1, int(block_bytes * PIECE)))), "item_id string, text string").distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for x in _STATE.split(", "):
        name, kind = x.split()
        d = d.withColumn(name, F.lit(None).cast(kind))
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(Block([tuple(r) for r in own], window))
        d = d.mapInArrow(tidy(_met(block, text)), d.schema)
        if k % CHAIN == CHAIN - 1 and k + 1 < blocks:
            d = scratch.save(d, "met")
    return d


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match of each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = _searched(d, "text", benchmark, window, block_bytes)
    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_start long"
    return d.mapInArrow(tidy(_summed), kinds)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no window of the benchmark, with all their columns; each is judged in place, without a shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs is named as one of the state's
    d = _searched(docs.toDF(*names), names[docs.columns.index("text")], benchmark, window, block_bytes)
    return d.filter(F.octet_length("hits") == 0).select(*names).toDF(*docs.columns)
