"""Operator 9: token ids in fixed-width bit-packed blocks.

Documents are dealt by range of doc_id and sorted, so that shards and blocks hold ascending ids. A block is a row
of the written table: its shard and place, how many ids stand before it in the shard, the documents it holds and
their lengths, and the payload: every id in the fewest bits that the vocabulary needs, 64 ids to `bits` words of
64 bits. A block ends with the document that fills it, so a document is read from one block. Spark's own writer
commits the files, on whatever store the folder is.

Null or empty text: no ids but the end id. Null doc_id: first in order. Repeated ids: a document each, by text.
A very long text is encoded whole and ends its block, which is as long as it asks for; equal rows (ties) stand next to each other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, tidy

END_ID = 0
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Chunks whose ids a task keeps; those beyond are encoded anew in each batch.
KEPT = 400_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 8 << 20
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"{_WHITE} ({_WHITE}|$)|^ ({_WHITE}|$)| \\x00"
_EDGE = re.compile(r"(?<=\S)(?= )")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids at a time to `bits` little-endian words; the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    x = np.zeros((groups, 64), np.uint64)
    x.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= x[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on; only their groups are touched."""
    g0, g1 = start // 64, -(-(start + n) // 64)
    y = np.frombuffer(payload, "<u8", (g1 - g0) * bits, g0 * bits * 8).reshape(-1, bits)
    out = np.empty((len(y), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        v = y[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (y[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = v & mask
    return out.reshape(-1)[start - g0 * 64 :][:n]


class Encoder:
    """Whole texts through the tokenizer, each distinct chunk once a batch.

    A text is cut before its spaces. No token of a byte-level vocabulary crosses such an edge, unless white space
    stands on both sides of the space; texts with such a run are cut only where a visible character precedes. So a
    text's ids are those of its chunks one after another. A chunk that is one space and a word is known by the
    word; any other by itself after a zero character, and a text with a word that begins so is cut the second way.
    """

    def __init__(self, path: str, keep: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(words.values()) + 1, bool)
        self.opens[[i for w, i in words.items() if w.startswith("\u0120")]] = True  # tokens that begin with a space
        self.keep, self.kept = keep, {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks end to end, and where each chunk's end. Chunks of a space and a word go in long strings."""
        plain = np.array([c[:1] not in ("", "\0") for c in chunks], bool)
        run = self.tokenizer.encode_batch_fast
        joined = [f" {c}" for c, p in zip(chunks, plain, strict=True) if p]
        bulk = run(["".join(joined[i : i + 5000]) for i in range(0, len(joined), 5000)], add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in bulk)])
        starts = np.append(np.flatnonzero(self.opens[flat]), len(flat))
        assert len(starts) == len(joined) + 1
        rest = [np.array(e.ids, np.uint32) for e in run([c[1:] if c else " " for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False)]
        lengths = np.zeros(len(chunks), np.int64)
        lengths[plain], lengths[~plain] = np.diff(starts), [len(x) for x in rest]
        out = np.empty(int(lengths.sum()), np.uint32)
        whose = np.repeat(plain, lengths)
        out[whose], out[~whose] = flat, np.concatenate([np.zeros(0, np.uint32), *rest])
        return out, np.cumsum(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mark, nothing = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        pieces = pc.split_pattern(pc.binary_join_element_wise(mark, texts, nothing), " ")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        if odd.any():
            cut = pa.array([[f"\0{c}" for c in _EDGE.split(t)] for t in texts.filter(pa.array(odd)).to_pylist()], pieces.type)
            place = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            pieces = pa.concat_arrays([pieces.filter(pa.array(~odd)), cut]).take(pa.array(place))
        coded = pieces.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        at = np.fromiter((self.kept.get(c, -1) for c in chunks), np.int64, len(chunks))
        fresh = np.flatnonzero(at < 0)
        ids, ends = self.ids, self.ends
        if len(fresh):
            new = [chunks[i] for i in fresh]
            at[fresh] = len(ends) + np.arange(len(fresh))
            got, got_ends = self._encode_new(new)
            ids, ends = np.concatenate([ids, got]), np.concatenate([ends, got_ends + len(ids)])
            if room := max(0, self.keep - len(self.kept)):
                self.kept.update(zip(new[:room], at[fresh[:room]].tolist(), strict=True))
                self.ends = ends[: len(self.kept)]
                self.ids = ids[: self.ends[-1]]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        codes = at[np.asarray(coded.indices)]
        n = ends[codes] - starts[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(starts[codes] - total[:-1], n) + np.arange(total[-1])]
        return out, np.diff(total[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(pieces)))])])


@functools.cache
def own_encoder(path: str) -> Encoder:
    """One a Python worker: what it has learned of common words serves the worker's later tasks too."""
    return Encoder(path)


def _blocks(path: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = own_encoder(path), TaskContext.get().partitionId()
        block, before, docs, parts, held = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, docs, parts, held
            ids = np.concatenate(parts)
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([bits], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([pack(ids, bits)], pa.binary())]
            block, before, docs, parts, held = block + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "before", "bits", "n_ids", "doc_ids", "lengths", "payload"])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                ids, lengths = encoder.encode(part.column(1))
                for doc, own in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    docs.append(doc)
                    parts.append(np.concatenate([own, end]))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def write_files(docs: DataFrame, tokenizer: str, path: str, vocabulary: int, end_id: int = END_ID) -> None:
    """Writes the block table of all documents to path."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the hash parts rows that share an id, so that a hot id is no single task
    d = d.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    kinds = "shard int, block long, before long, bits int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    d.mapInArrow(tidy(_blocks(tokenizer, bits_for(vocabulary), end_id)), kinds).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids = unpack(r["payload"], r["bits"], 0, r["n_ids"])
            ends = np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(starts + r["before"], pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                ["shard", "block", "offset", "in_shard", "doc_id", "n_tokens", "ids_crc32"],
            )


def read_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and where each document lies: shard, block, offset."""
    blocks = spark.read.parquet(path)
    # one row a shard, in order: the ids of the shards before it
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    rows = blocks.select("shard", "block", "before", "bits", "n_ids", "doc_ids", "lengths", "payload")
    rows = rows.mapInArrow(tidy(_read), "shard int, block long, offset long, in_shard long, doc_id long, n_tokens long, ids_crc32 long")
    out = rows.join(shards, "shard")
    return out.select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "offset")


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files, to the shared folder if no path is given, and reads every document back from them."""
    path = path or Scratch(docs.sparkSession).path("tokens")
    write_files(docs, tokenizer, path, vocabulary, end_id)
    return read_files(docs.sparkSession, path)
