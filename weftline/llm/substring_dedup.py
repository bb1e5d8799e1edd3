"""Operator 6: substring dedup by suffix trees over prefix partitions.

A suffix matters only as deep as a window (20 words). Its partition is the variable-length prefix that ends with the
least-hashed run of GRAM words of the window: equal windows have equal prefixes, whatever stands around them, so every
deep node of the whole corpus's tree lies within one partition. The suffixes of one text that share that run are
consecutive and go together as one spot: (first start, how many). Partitions are named by the hash of the run.

1. Spots of every text; partitions of one spot hold no repeat and end here.
2. Partitions of up to GROUP spots go, many to a bundle, to tasks that build their subtrees: leaves in order, depths of
   the nodes between neighbours. The leaves below a node of window depth are the places of one repeat.
3. A larger partition is split by lengthening its prefix to the whole window, where a node's leaves need no tree: their
   earliest place is one partial aggregation.
4. A text loses the words of each window that is a leaf below a deep node, but for the earliest leaf.

Words are compared themselves; hashes only deal them out, save for step 3 (128 bits).

Null or empty text, or fewer words than a window: nothing is removed. Very long texts are read whole, in slices of many
windows; of equal windows (ties) the one of the smallest document, then key, then start stays. Rows that share a doc_id stand in order of their
texts' hashes; repeated rows count once and are all treated alike. Null doc_id: left as it is, and no source of repeats.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, coded, plain_words, slices, stretch_hashes, text_key, tidy, word_spans

WINDOW, GRAM = 20, 8
#: Spots of a partition that a tree takes; spots that a task's bundle of partitions has on average.
GROUP, BUNDLE = 1000, 8192
SLICE_BYTES = 4 << 20


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n words, from the words' hashes."""
    at = np.arange(max(0, len(h) - n + 1))
    return stretch_hashes(h, at, at + n)


def least_runs(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window of h: where its least-hashed run of gram words starts, the leftmost of equals."""
    g = run_hashes(h, gram)
    wide = window - gram + 1
    at, have = np.arange(len(g)), 1
    while have < wide:
        step = min(have, wide - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(g[b] < g[a], b, a), have + step
    return at[: max(0, len(h) - window + 1)]


def _spots(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, SLICE_BYTES):
                raw, first, last, length = word_spans(b.column(2))
                ends = np.cumsum(length)
                h = stretch_hashes(raw, first, last)
                if len(h) < window:
                    continue
                at = least_runs(h, window, gram)
                doc = np.repeat(np.arange(len(length)), length)[: len(at)]
                start = np.arange(len(at))
                ok = start + window <= ends[doc]
                at, doc, start = at[ok], doc[ok], start[ok]
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, bool))
                n = np.diff(np.concatenate([new, [len(at)]]))
                g, doc = run_hashes(h, gram)[at[new]], doc[new]
                lo = start[new] - (ends - length)[doc]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(lo), pa.array(n.astype(np.int32))], ["run", "doc_id", "key", "lo", "n"])

    return run


def _flat_spots(spots: pa.Array) -> tuple[np.ndarray, ...]:
    """run, lo, n, hot of all spots, and whose they are."""
    f = spots.flatten()
    return *(np.asarray(f.field(c)) for c in ("run", "lo", "n", "hot")), np.repeat(np.arange(len(spots)), np.asarray(pc.list_value_length(spots)))


def _texts_of_spots(window: int):
    """The words of each small spot, as they stand in the text: what its bundle needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2, SLICE_BYTES)):
            raw, first, last, length = word_spans(b.column(2))
            runs, lo, n, hot, doc = _flat_spots(b.column(3))
            runs, lo, n, doc = (x[~hot] for x in (runs, lo, n, doc))
            at = (np.cumsum(length) - length)[doc] + lo
            whole_text = raw.tobytes()
            words = [whole_text[i:j] for i, j in zip(first[at].tolist(), last[at + n + window - 2].tolist(), strict=True)]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(runs), b.column(0).take(rows), b.column(1).take(rows), pa.array(lo), pa.array(words, pa.binary())], ["run", "doc_id", "key", "lo", "words"])

    return run


def _long_prefixes(window: int, most: int = 100_000):
    """The whole window, as 128 bits, of the suffixes of the large partitions: the earliest place of each in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int, int]] = {}
        for b in (part for whole in batches for part in slices(whole, 2)):
            _, lo, n, hot, whose = _flat_spots(b.column(3))
            lo, n, whose = lo[hot].tolist(), n[hot].tolist(), whose[hot]
            here = b.take(pa.array(np.unique(whose)))
            ids = dict(zip(np.unique(whose).tolist(), zip(*(here.column(k).to_pylist() for k in range(2)), map(plain_words, here.column(2).to_pylist()), strict=True), strict=True))
            for k in range(len(lo)):
                doc, key, words = ids[int(whose[k])]
                for i in range(lo[k], lo[k] + n[k]):
                    prefix, place = xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), (doc, key, i)
                    if place < first.setdefault(prefix, place):
                        first[prefix] = place
                if len(first) > most:
                    yield _places(first)
                    first = {}
        if first:
            yield _places(first)

    def _places(first: dict[bytes, tuple[int, int, int]]) -> pa.RecordBatch:
        doc, key, start = zip(*first.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(doc, pa.int64()), pa.array(key, pa.int32()), pa.array(start, pa.int64())], ["prefix", "doc_id", "key", "start"])

    return run


def subtrees(flat: np.ndarray, length: np.ndarray, order: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the trees over all suffixes of window words or more, cut at that depth, in order; and the depth of
    the node between each leaf and the one before it. flat: the rows' words by number, end to end. A leaf is (row,
    start in the row); equal suffixes stand in the order that the keys of their rows give, then by start.
    """
    n = np.maximum(length - window + 1, 0)
    row = np.repeat(np.arange(len(length)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(length) - length)[row] + start
    columns = [flat[base + d] for d in range(window)]
    bits = max(1, int(flat.max(initial=1)).bit_length())
    packed = [reduce(lambda a, c: a << bits | c, columns[d : d + 63 // bits], np.zeros(len(base), np.int64)) for d in range(0, window, 63 // bits)]
    place = np.lexsort([start, *(k[row] for k in reversed(order)), *reversed(packed)])
    depth = np.zeros(len(place), np.int64)
    same = np.ones(max(0, len(place) - 1), bool)
    for c in columns:
        c = c[place]
        same &= c[1:] == c[:-1]
        depth[1:] += same
    return np.stack([row[place], start[place]], axis=1), depth


def _repeats(window: int):
    """Of a bundle: for each spot with later places of repeats, which of its suffixes are such (bits from its first)."""

    def run(bundle: pa.Table) -> pa.Table:
        doc, key, lo = (np.asarray(bundle.column(c)) for c in ("doc_id", "key", "lo"))
        _, codes, length = coded(bundle.column("words").combine_chunks(), lower=False)
        leaves, depth = subtrees(codes, length, [doc, key, lo], window)
        row, start = leaves[:, 0], leaves[:, 1]
        first = np.maximum.accumulate(np.where(depth < window, np.arange(len(depth)), 0))  # of the node's leaves
        later = (doc[row] != doc[row[first]]) | (key[row] != key[row[first]]) | (lo[row] + start != lo[row[first]] + start[first])
        bits = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(bits, row[later], np.int64(1) << start[later])
        some = np.flatnonzero(bits)
        return pa.table({"doc_id": doc[some], "key": key[some], "lo": lo[some], "bits": bits[some]})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            n_words, n_removed, kept = [], [], []
            for t, later, hot, firsts in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                words = plain_words(t)
                gone = np.zeros(len(words) + 1, np.int64)
                starts = [s["lo"] + i for s in later or () for i in range(s["bits"].bit_length()) if s["bits"] >> i & 1]
                own = set(firsts or ())
                starts += [x for s in hot or () for x in range(s["lo"], s["lo"] + s["n"]) if x not in own]
                if starts:
                    at = np.array(starts)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words_kept = [words[i] for i in np.flatnonzero(stay)]
                else:
                    words_kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(words_kept))
                kept.append(b" ".join(words_kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, one space between them)."""
    scratch = Scratch(docs.sparkSession)
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    d = all_docs.filter("doc_id is not null")
    spots = scratch.save(d.mapInArrow(tidy(_spots(window, gram)), "run long, doc_id long, key int, lo long, n int"), "spots")
    sizes = spots.groupBy("run").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = scratch.save(sizes, "sizes")
    total, most = sizes.agg(F.sum(F.when(F.col("m") <= group, F.col("m"))), F.max("m")).first()
    own = spots.join(sizes, "run").select("doc_id", "key", F.struct("run", "lo", "n", (F.col("m") > group).alias("hot")).alias("s"))
    own = scratch.save(own.groupBy("doc_id", "key").agg(F.collect_set("s").alias("spots")), "own")  # a set: of repeated rows, once
    scratch.drop(spots, sizes)
    # the texts are dealt by document once; each use below reads the same exchange
    met = d.join(own, ["doc_id", "key"]).select("doc_id", "key", "text", "spots")
    words = met.mapInArrow(tidy(_texts_of_spots(window)), "run long, doc_id long, key int, lo long, words binary")
    words = words.withColumn("bundle", F.pmod("run", F.lit(max(1, (total or 0) // BUNDLE))))
    later = words.groupBy("bundle").applyInArrow(_repeats(window), "doc_id long, key int, lo long, bits long")
    later = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "bits")).alias("later"))
    found = d.join(later, ["doc_id", "key"], "left")
    if (most or 0) > group:
        whole = met.mapInArrow(tidy(_long_prefixes(window)), "prefix binary, doc_id long, key int, start long")
        firsts = whole.groupBy("prefix").agg(F.min(F.struct("doc_id", "key", "start")).alias("f")).select("f.*")
        firsts = firsts.groupBy("doc_id", "key").agg(F.collect_list("start").alias("firsts"))
        hot = own.select("doc_id", "key", F.expr("filter(spots, s -> s.hot)").alias("hot")).filter("size(hot) > 0")
        found = found.join(hot, ["doc_id", "key"], "left").join(firsts, ["doc_id", "key"], "left")
    else:
        found = found.withColumn("hot", F.lit(None).cast("array<struct<lo:bigint,n:int>>")).withColumn("firsts", F.lit(None).cast("array<bigint>"))
    kinds = "doc_id long, n_words long, n_removed long, kept_text string"
    out = found.select("doc_id", "text", "later", "hot", "firsts").mapInArrow(tidy(_cut(window)), kinds)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in found.select("later", "hot", "firsts").dtypes]
    return out.unionByName(all_docs.filter("doc_id is null").select("doc_id", "text", *nothing).mapInArrow(tidy(_cut(window)), kinds))
