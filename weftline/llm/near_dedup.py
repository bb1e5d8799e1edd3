"""Operator 2: MinHash near-duplicates, confirmed on full shingle sets.

1. Every text gives its distinct word shingles (64-bit hashes), and the minima of many universal hashes
   (a * x + b mod 2^64, upper half). Equal sets collapse to one representative, the smallest doc_id.
2. Bands of the signature are buckets. In each bucket every representative meets the smallest one (its hub); of
   its hubs each representative keeps the one whose signature agrees best. Linked pairs are joined to components.
3. Buckets that still hold several components are compared in full: the members outside the bucket's largest
   component against all its members, in blocks, so that no link between different texts is lost and no list of
   all pairs is ever made. Signatures are compared first, full sets after; a pair is judged in the first band it shares.
4. Components come from alternating large-star and small-star. Rows that share a doc_id are linked through it.

Null or empty text, or one without words: no shingles, linked with nothing. Null doc_id: never linked, null
component. Repeated rows and rows that share a doc_id, whatever their texts, count as one document and have one component.
Very long texts are shingled whole; blocks of pairs are bounded in bytes, so that one long text is a block of its own. Ties
(equal sets) collapse to the smallest doc_id. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordHashes, gram_hashes, lower_words, tidy

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Signatures of texts at the threshold agree in `share * HASHES` places on average; those seven deviations below are let go,
#: which at the threshold is rarer by far than to share no band.
DEVIATIONS = 7.0
#: Strays and members of a bucket that are compared at once, by their number and on average by their bytes.
BLOCK_STRAYS, BLOCK_MEMBERS, BLOCK_BYTES = 128, 512, 4 << 20
#: Bytes of shingles and signatures that a task's bundle of blocks holds on average.
BUNDLE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, HASHES, np.uint64)


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle."""
    h = hashes.array(lower_words(text))
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else h


def signature(x: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(out, (_A[:, None] * x[None, i : i + 512] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            size, key, sig = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, n, hashes)
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        ids = np.repeat(np.asarray(b.column(0), np.int64), BANDS)
        rows = np.ascontiguousarray(sig.reshape(len(sig) * BANDS, ROWS)).astype(np.uint64)
        band = np.tile(np.arange(BANDS, dtype=np.uint64), len(sig))
        key = gram_hashes_of_rows(np.concatenate([band[:, None], rows], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(band.astype(np.int32))], ["key", "rep", "band"])


def gram_hashes_of_rows(x: np.ndarray) -> np.ndarray:
    return gram_hashes(x.reshape(-1), x.shape[1])[:: x.shape[1]]


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, sets = [], []
            for i, t, key in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingles(t, n, hashes)
                if xxhash.xxh3_128_digest(s.tobytes()) == key:
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, hub and in how many places their signatures agree."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).sum(axis=1).astype(np.int32))], ["rep", "hub", "same"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            ok = [_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(percent: int):
    """Links across components in one bundle of (bucket, block of strays, block of members)."""
    least = HASHES * percent / 100 - DEVIATIONS * (HASHES * percent / 100 * (1 - percent / 100)) ** 0.5

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, unit in pdf.groupby(["key", "sb", "mb"], sort=False):
            band = int(unit["band"].iloc[0])
            side = []
            for stray in (True, False):
                u = unit[unit["stray"] == stray]
                sig = np.frombuffer(b"".join(u["sig"]), np.uint32).reshape(-1, HASHES)
                side.append((u["rep"].to_numpy(), u["comp"].to_numpy(), sig, [np.frombuffer(x, np.uint64) for x in u["shingles"]]))
            (ids, comp, sig, sets), (m_ids, m_comp, m_sig, m_sets) = side
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while c in joined:
                    c = joined[c]
                return c

            for i in range(len(ids)):
                same = m_sig == sig[i]
                can = (m_comp != comp[i]) & (same.sum(axis=1) >= least)
                for j in np.flatnonzero(can & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)):
                    p, q = root(int(comp[i])), root(int(m_comp[j]))
                    if p != q and _similar(sets[i], m_sets[j], percent):
                        joined[p] = q
                        found.append((int(ids[i]), int(m_ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) of every id in edges (a, b): comp is the smallest id reachable."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = scratch.save(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.save(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(e, large)
        e, old = small, mark
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == old or not mark[0]:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_docs = scratch.save(d.mapInArrow(tidy(_signed(words)), "doc_id long, n_shingles long, set_key binary, sig binary"), "signed")
    some = all_docs.filter("n_shingles > 0 and doc_id is not null")
    reps = scratch.save(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "reps")
    # a doc_id with several texts links their classes
    several = all_docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi"))
    several = scratch.save(several.filter("lo <> hi").select("doc_id"), "several")
    same_id = some.select("doc_id", "set_key").join(several, "doc_id").join(reps.select("set_key", "rep"), "set_key")
    same_id = scratch.save(same_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same_id")
    bands = reps.select("rep", "sig").mapInArrow(tidy(_bands), "key long, rep long, band int")
    bands = scratch.save(bands.distinct(), "bands")
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = scratch.save(bands.join(scratch.save(hubs, "hubs"), "key"), "members")
    scratch.drop(bands)
    # full sets of those that share a bucket at all
    wanted = members.select("rep").distinct().join(reps.select("rep", "set_key"), "rep")
    sets = d.join(wanted, d.doc_id == wanted.rep).select("doc_id", "text", "set_key").mapInArrow(tidy(_sets(words)), "id long, shingles binary")
    sets = scratch.save(sets.dropDuplicates(["id", "shingles"]), "sets")
    sigs = reps.select("rep", "sig")
    # each with the hub that agrees best
    pairs = members.filter("rep <> hub").select("rep", "hub").distinct()
    pairs = pairs.join(sigs, "rep").join(sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    best = pairs.select("rep", "hub", "sig", "hub_sig").mapInArrow(tidy(_agreeing), "rep long, hub long, same int")
    best = best.groupBy("rep").agg(F.max(F.struct("same", "hub")).alias("b")).select("rep", F.col("b.hub").alias("hub"))
    best = scratch.save(best, "best")
    of = lambda name, other: sets.select(F.col("id").alias(name), F.col("shingles").alias(other))
    first = best.join(of("rep", "x"), "rep").join(of("hub", "y"), "hub").select("rep", "hub", "x", "y")
    first = scratch.save(first.mapInArrow(tidy(_confirmed(percent)), "a long, b long"), "first")
    scratch.drop(best)
    first = first.unionByName(same_id)
    comp = scratch.save(components(first, scratch), "comp")
    # buckets that hold several components still
    m = members.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).drop("hub")
    m = placed = scratch.save(m, "placed")
    each = m.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    m = m.join(scratch.save(mixed.select("key", F.col("top.comp").alias("top")), "mixed"), "key").withColumn("stray", F.col("comp") != F.col("top"))
    # of the buckets that are left: how many strays and members, and how many bytes they have
    m = scratch.save(m.join(reps.groupBy("rep").agg(F.sum(8 * F.col("n") + 4 * HASHES).alias("bytes")), "rep"), "left")
    scratch.drop(placed)
    own = lambda c: F.sum(F.when(F.col("stray"), c).otherwise(0))
    sizes = m.groupBy("key").agg(own(F.lit(1)).alias("s"), own(F.col("bytes")).alias("s_bytes"), F.count("*").alias("m"), F.sum("bytes").alias("m_bytes"))
    parts = lambda n, rows, size: F.ceil(F.greatest(F.col(n) / rows, F.col(size) / BLOCK_BYTES))
    sizes = sizes.select("key", parts("s", BLOCK_STRAYS, "s_bytes").alias("nsb"), parts("m", BLOCK_MEMBERS, "m_bytes").alias("nmb"))
    m = m.join(sizes, "key")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    strays = m.filter("stray").withColumn("sb", block("nsb")).withColumn("mb", F.explode(F.expr("sequence(0L, nmb - 1)")))
    whole = m.withColumn("stray", F.lit(False)).withColumn("mb", block("nmb")).withColumn("sb", F.explode(F.expr("sequence(0L, nsb - 1)")))
    units = scratch.save(strays.unionByName(whole).select("key", "band", "sb", "mb", "rep", "comp", "stray", "bytes"), "units")
    held = units.agg(F.sum("bytes")).first()[0]
    bundles = max(1, (held or 0) // BUNDLE_BYTES)
    units = units.join(sigs, "rep").join(of("rep", "shingles"), "rep")
    units = units.withColumn("bundle", F.pmod(F.xxhash64("key", "sb", "mb"), F.lit(bundles)))
    second = scratch.save(units.groupBy("bundle").applyInPandas(_blocks(percent), "a long, b long"), "second")
    scratch.drop(members, sets)
    final = scratch.save(components(first.unionByName(second), scratch), "final")
    # every document has its class, every class its component
    classes = reps.select("set_key", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("set_key", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
    out = all_docs.drop("sig").join(classes, "set_key", "left")
    if not several.isEmpty():  # rows without words have no class of their own
        by_id = final.join(several, F.col("id") == F.col("doc_id")).select("doc_id", F.col("comp").alias("id_comp"))
        out = out.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "id_comp"))
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    out = out.select("doc_id", "n_shingles", own("class_id").alias("class_id"), own("component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with all columns: that of the smallest doc_id. Rows without an id stay.

    Of rows that share a kept doc_id the first by the hash of their text stays; only such rows, not whole tables,
    are ordered.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs, words, percent).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = scratch.save(found.select(F.col("doc_id").alias("kept_id"), (F.col("n") > 1).alias("again")), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    single = d.join(found.filter("not again"), doc_id.cast("long") == F.col("kept_id"), "left_semi")
    many = d.join(found.filter("again"), doc_id.cast("long") == F.col("kept_id"), "left_semi")
    first = Window.partitionBy(doc_id.cast("long")).orderBy(F.xxhash64(text), text)
    many = many.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    return single.unionByName(many).unionByName(d.filter(doc_id.isNull())).toDF(*docs.columns)
