"""What several operators share: words, hashes, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import Scratch  # noqa: F401  for the operators

MASK64 = (1 << 64) - 1

#: Java pattern of the bytes that part words.
SPACES = r"[\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lower-cased; bytes.split parts at just these bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_list(text: Column) -> Column:
    """The same words as an array of strings, JVM side; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def from_zero(texts: pa.Array) -> pa.Array:
    """texts as large strings, null as empty, whose bytes begin with its buffer: the cast of a part of a batch keeps the batch's
    offsets, which `ascii_lower` doesn't heed."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(t):
        return t
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = t.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_string(), len(t), [None, pa.py_buffer(offsets - offsets[0]), data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))])


def coded(texts: pa.Array, lower: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the words of all texts by their places in them, and how many each text has."""
    t = from_zero(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    flat = lists.flatten()
    full = np.asarray(pc.not_equal(flat, pa.scalar("", flat.type)))
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
    length = np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])
    d = flat.filter(pa.array(full)).dictionary_encode()
    return d.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(d.indices).astype(np.int64), length


_PARTS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64; kept by the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        factors = np.full((2, size), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        factors[:, 0] = 1
        _powers[:] = np.multiply.accumulate(factors, axis=1)
    return _powers[0][:n], _powers[1][:n]


def stretch_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of x[start:end] for every pair, each of its values alone, by sums of x times powers: no loop over lengths."""
    p, inverse = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, where each word starts and ends in them, and how many words each text has."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    data = t.buffers()[2] if len(t) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    edge = (offsets - offsets[0])[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    inside = ~_PARTS[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]  # a text's end parts words too
    starts = np.flatnonzero(first)
    return raw, starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets - offsets[0]))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the commoner words only so that memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def slices(b: pa.RecordBatch, text: int, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes in its text column, or one row."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield b.slice(i, j - i)
        i = j


def text_key(text: Column) -> Column:
    """31 bits of the text: with it, rows that share a doc_id are told apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """run, for mapInArrow; at its end the worker, which lives on for other tasks, gives back the memory that it has free."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
