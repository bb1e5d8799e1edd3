"""Operator 5: ordinal cumulative-link regression on graded ratings over hashed text.

Grades 0, 1, ... are one axis: P(grade >= k) = sigmoid(w . x - t_k), with weights w shared by all grades and ordered
thresholds t_1 < t_2 < ... A document gets its expected grade and its tail probability P(grade >= the wanted one).

x has, hashed and scaled by how much they tell grades apart: each distinct word of the text and its first four characters; and, as shares of all words, their
shapes (letters to a or A, digits to 9, marks kept). And bands of length and of the share of distinct words.

Fitted in numpy on a bounded sample of labelled rows: about SAMPLE of them, by hash of the id, of at most SAMPLE_BYTES
of features. One task fits it, so that the driver never holds the sample, only the weights (1 MB). Scored over every whole
text, however long: each distinct word's weight is looked up once a task.

Null or empty text: no words, only the bands count. Null ratings or ids are not learned from; of several ratings of one
id the lowest holds. Repeated rows are scored row by row; equal texts (ties) get equal scores. No labelled rows: every grade is equally likely, and
`select_good` rejects nothing. Empty table: empty result. Other columns are kept by `select_good`, ignored by `score`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import tidy

SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
WORD_BITS, SHAPE_BITS = 18, 10
BANDS = 16
DIM = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 2 * BANDS + 1
#: Features seen in fewer documents of the sample get no weight.
LEAST_SEEN = 6
EPOCHS, BATCH, RATE, RIDGE = 20, 64, 0.05, 3e-3
#: Features are scaled by how much they tell grades apart, within these bounds.
TELLING = 0.0, 8.0
KEPT = 200_000
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def _hash(kind: str, s: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{s}".encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def word_features(word: str) -> tuple[int, int, int]:
    """Of the word, of its first four characters, of its shape."""
    low = word.lower()
    shape = _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", word)))[:12]
    return _hash("w", low, WORD_BITS), _hash("p", low[:4], WORD_BITS), (1 << WORD_BITS) + _hash("s", shape, SHAPE_BITS)


def band_features(words: int, distinct: int) -> tuple[int, int]:
    base = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    return base + min(words.bit_length(), BANDS - 1), base + BANDS + min(distinct * BANDS // max(words, 1), BANDS - 1)


def _words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = _words(text)
    distinct = set(words)
    at: dict[int, float] = {}
    for w in distinct:
        a, b, _ = word_features(w)
        at[a] = at.get(a, 0) + 1
        at[b] = at.get(b, 0) + 1
    cache: dict[str, int] = {}
    for w in words:
        if w not in cache:
            cache[w] = word_features(w)[2]
        at[cache[w]] = at.get(cache[w], 0) + 4 / len(words)
    for k in band_features(len(words), len(distinct)):
        at[k] = 1.0
    return np.fromiter(at.keys(), np.int32, len(at)), np.fromiter(at.values(), np.float32, len(at))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tobytes() for a, _ in at], pa.binary()), pa.array([v.tobytes() for _, v in at], pa.binary())], ["grade", "at", "value"])


class OrdinalModel:
    def __init__(self, grades: int):
        self.w = np.zeros(DIM, np.float32)
        self.t = np.array([np.log(k / (grades - k)) for k in range(1, grades)])  # every grade alike, until it has learned
        self.learned = False

    def fit(self, at: np.ndarray, value: np.ndarray, length: np.ndarray, grade: np.ndarray, seed: int = 3) -> OrdinalModel:
        """at, value: features of all texts end to end; length: how many each has."""
        scale, seen = self.telling(at, length, grade)
        use = (seen >= LEAST_SEEN)[at]
        length = np.add.reduceat(np.append(use, False).astype(np.int64), np.cumsum(length) - length) * (length > 0)
        at = at[use]
        value = value[use] * scale[at]
        ends = np.cumsum(length)
        k = len(self.t)
        n = np.array([np.mean(grade >= j + 1) for j in range(k)]).clip(0.01, 0.99)
        self.t = -np.log(n / (1 - n))
        w, size, r = np.zeros(DIM), np.full(DIM, 1e-3), np.random.default_rng(seed)
        t_size = np.full(k, 1e-3)
        for _ in range(EPOCHS):
            order = r.permutation(len(length))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                places = np.concatenate([np.arange(ends[j] - length[j], ends[j]) for j in rows])
                a, v = at[places], value[places].astype(np.float64)
                whose = np.repeat(np.arange(len(rows)), length[rows])
                s = np.bincount(whose, w[a] * v, len(rows))
                p = 1 / (1 + np.exp(-np.clip(s[:, None] - self.t[None, :], -30, 30)))  # of grade >= 1, 2, ...
                tails = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
                g, own = grade[rows], np.arange(len(rows))
                mass = np.maximum(tails[own, g] - tails[own, g + 1], 1e-9)
                slope = tails * (1 - tails)
                ds = -(slope[own, g] - slope[own, g + 1]) / mass
                dt = np.zeros(k)
                for j in range(k):
                    dt[j] = np.mean(np.where(g == j + 1, slope[:, j + 1] / mass, np.where(g == j, -slope[:, j + 1] / mass, 0)))
                hot, back = np.unique(a, return_inverse=True)
                d = np.bincount(back, ds[whose] * v, len(hot)) / len(rows) + RIDGE * w[hot]
                size[hot] += d * d
                w[hot] -= RATE * d / np.sqrt(size[hot])
                t_size += dt * dt
                self.t = np.sort(self.t - RATE * dt / np.sqrt(t_size))
        self.w = (w * scale).astype(np.float32)
        return self

    def telling(self, at: np.ndarray, length: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much each feature's presence tells grades apart: the largest log ratio of its rate in one to that in the others.
        And in how many texts it stands."""
        out, whose = np.full(DIM, TELLING[0]), np.repeat(grade, length)
        seen = np.bincount(at, minlength=DIM)
        for g in np.unique(grade):
            own = np.bincount(at[whose == g], minlength=DIM)
            n, m = int((grade == g).sum()), int((grade != g).sum())
            out = np.maximum(out, np.abs(np.log((own + 1) / (n + 2)) - np.log((seen - own + 1) / (m + 2))))
        out[(1 << WORD_BITS) :] = 1.0  # shapes and bands are shares, not presence
        return np.minimum(out, TELLING[1]).astype(np.float32), seen

    def tails(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.t[None, :], -30, 30)))


class _WordWeights(dict):
    """word -> what it adds as a distinct word, and what its shape adds, of which the share counts."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: bytes) -> tuple[float, float]:
        a, b, c = word_features(word.decode("utf-8", "replace"))
        out = (float(self.w[a] + self.w[b]), 4 * float(self.w[c]))
        if len(self) < KEPT and len(word) <= 64:
            self[word] = out
        return out


def _link_scores(texts: pa.Array, w: np.ndarray, weights: _WordWeights) -> np.ndarray:
    """w . x of every whole text."""
    get, out = weights.__getitem__, np.zeros(len(texts))
    for k, t in enumerate(texts.to_pylist()):
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        own, first = 0.0, {}
        if words:
            at = np.array([*map(get, words)], np.float64).reshape(-1, 2)
            first = {x: i for i, x in enumerate(words)}
            own = float(at[np.fromiter(first.values(), np.int64, len(first)), 0].sum() + at[:, 1].mean())
        out[k] = own + sum(float(w[j]) for j in band_features(len(words), len(first)))
    return out


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights = _WordWeights(m.w)
        for b in batches:
            s = _link_scores(b.column(1), m.w, weights)
            p = m.tails(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, -1] if p.shape[1] else np.zeros(len(p))), pa.array(s)], ["doc_id", "expected_grade", "tail_probability", "link_score"])

    return run


def _good(model, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights = _WordWeights(m.w)
        for b in batches:
            p = m.tails(_link_scores(b.column(at), m.w, weights))
            yield b.filter(pa.array(p[:, -1] >= least, pa.bool_()))

    return run


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of low quality, 2 good."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") >= 1, 2)
    return labels.select("doc_id", g.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _fitted(top: int, most: int):
    """One model from the rows of a task, which come in a fixed order: those up to `most` bytes of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, grade, held = [], [], [], 0
        for b in batches:
            for g, a, v in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held += len(a) + len(v)
                if held > most and grade:
                    break
                at.append(np.frombuffer(a, np.int32))
                value.append(np.frombuffer(v, np.float32))
                grade.append(g)
        if grade:
            length = np.array([len(a) for a in at])
            flat, values = np.concatenate(at), np.concatenate(value)
            del at, value
            m = OrdinalModel(top + 1).fit(flat, values, length, np.array(grade))
            yield pa.RecordBatch.from_arrays([pa.array([m.w.tobytes()], pa.binary()), pa.array([m.t.astype(np.float64).tobytes()], pa.binary())], ["w", "t"])

    return run


def train(docs: DataFrame, rated: DataFrame, top: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Features are made where the texts lie; the sample of them, of bounded size, meets in one task, which fits the model."""
    n = rated.count()
    drawn = F.xxhash64("doc_id")
    part = rated.filter(F.pmod(drawn, F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1)))
    part = F.broadcast(part.limit(2 * sample))  # at most 2 * sample ids
    rows = docs.select("doc_id", "text").join(part, "doc_id").select("grade", "text").mapInArrow(tidy(_sampled), "grade int, at binary, value binary")
    rows = rows.select(F.xxhash64("at", "value").alias("h"), "*").repartition(1).sortWithinPartitions("h", "grade", "at", "value")
    model = OrdinalModel(top + 1)
    for r in rows.mapInArrow(tidy(_fitted(top, sample_bytes)), "w binary, t binary").collect():  # one row at most
        model.w, model.t, model.learned = np.frombuffer(r["w"], np.float32), np.frombuffer(r["t"], np.float64), True
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the top grade), link_score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, grades(labels), sample=sample))
    d = docs.select("doc_id", "text")
    return d.mapInArrow(tidy(_scored(model)), d.select("doc_id").schema.add("expected_grade", "double").add("tail_probability", "double").add("link_score", "double"))


#: Documents with a tail probability under this are rejected.
LEAST_TAIL = 0.5


def select_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_TAIL, **how) -> DataFrame:
    """The rows that are not rejected, with all their columns; each is judged by its own text, in place."""
    own = train(docs, grades(labels), **how)
    if not own.learned:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(own)
    return docs.mapInArrow(tidy(_good(model, docs.columns.index("text"), least)), docs.schema)
