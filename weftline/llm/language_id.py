"""Operator 10: language identification by a byte convolutional network.

A text is cut into windows of fixed length, all of it, the last filled up with zeros. Bytes are embedded; filters of
several widths slide over the window; each filter's maximum goes to a softmax over the languages. A document's
probabilities are the means over its windows, weighted by their bytes.

Trained in numpy on a bounded sample: about SAMPLE documents (twice as many at most), dealt evenly over the languages, and of each at most
WINDOWS_A_DOC windows at places drawn from the whole text. Prediction covers every byte of every document.

Null text, or text without a letter: `und`, score 0. Null lang: never learned from. No labelled rows: all `und`. Empty table: empty result.
Repeated rows are judged row by row; of languages that are equally likely (ties) the first by name is given. Very long texts are read whole, some
windows at once: 4 MB of them at a time, or one text. Other columns are ignored; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import tidy

SAMPLE, WINDOWS_A_DOC = 4000, 4
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 24, 8
STEPS, BATCH, RATE = 500, 64, 0.02
_LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, DIM)), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: dict[int, list[np.ndarray]] = {}

    def pooled(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The convolution at every place, by tables of what each byte adds at each place of a filter."""
        length = WINDOW - width + 1
        y = np.zeros((len(x), length, FILTERS), np.float32)
        for k in range(width):
            y += (self.p["e"] @ self.p[f"w{width}"][k])[x[:, k : k + length]]
        at = y.argmax(axis=1)
        top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0, :]
        return np.maximum(top + self.p[f"b{width}"], 0), at

    def softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNet:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == c) for c in range(len(self.langs))]
        for step in range(1, STEPS + 1):
            rows = np.array([r.choice(by[c]) for c in r.integers(0, len(by), BATCH)])
            xb, yb = x[rows].copy(), y[rows]
            short = np.where(r.random(BATCH) < 0.3, r.integers(8, WINDOW, BATCH), WINDOW)
            xb[np.arange(WINDOW)[None, :] >= short[:, None]] = 0
            parts = [self.pooled(xb, w) for w in WIDTHS]
            h = np.concatenate([t for t, _ in parts], axis=1)
            g = self.softmax(h)
            g[np.arange(BATCH), yb] -= 1
            g /= BATCH
            grad = {"out": h.T @ g, "bias": g.sum(axis=0), "e": np.zeros_like(self.p["e"])}
            back = (g @ self.p["out"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                own, at = back[:, i * FILTERS : (i + 1) * FILTERS], parts[i][1]
                grad[f"b{w}"], gw = own.sum(axis=0), np.zeros_like(self.p[f"w{w}"])
                for k in range(w):  # only the places of the maxima
                    byte = np.take_along_axis(xb, at + k, axis=1)
                    gw[k] = np.einsum("bf,bfd->df", own, self.p["e"][byte])
                    np.add.at(grad["e"], byte, own[:, :, None] * self.p[f"w{w}"][k].T[None])
                grad[f"w{w}"] = gw
            rate = RATE * (1 - step / (STEPS + 1))
            for k, d in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def ready(self) -> None:
        """Tables of what each pair of bytes adds: half the look-ups."""
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][k] for k in range(w)]
            pairs = [(one[k][None, :, :] + one[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self.tables[w] = pairs + ([one[-1]] if w % 2 else [])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            self.ready()
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), 128):
            part = x[i : i + 128]
            pair = part[:, :-1].astype(np.uint16) | (part[:, 1:].astype(np.uint16) << 8)
            h = []
            for w in WIDTHS:
                length, y = WINDOW - w + 1, None
                for k, table in enumerate(self.tables[w]):
                    codes = part if len(table) == 256 else pair
                    add = table.take(codes[:, 2 * k : 2 * k + length], axis=0)
                    y = add if y is None else np.add(y, add, out=y)
                h.append(np.maximum(y.max(axis=1) + self.p[f"b{w}"], 0))
            out[i : i + 128] = self.softmax(np.concatenate(h, axis=1))
        return out


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at places drawn from the whole text."""
    for b in batches:
        lang, raw = [], []
        for text, name, seed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            r = np.random.default_rng(seed & 0x7FFFFFFF)
            for s in sorted({int(s) for s in r.integers(0, max(1, len(data) - WINDOW + 1), WINDOWS_A_DOC)}):
                lang.append(name)
                raw.append(data[s : s + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(raw, pa.binary())], ["lang", "raw"])


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id") -> ByteNet | None:
    d = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.xxhash64(doc_id, "text").alias("h"), "text", "lang")
    count = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each language
    if not count:
        return None
    each = max(8, SAMPLE // len(count))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in count.items() for x in (k, min(1.0, 1.2 * each / n + 4 / n)))), F.col("lang"))
    part = d.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang", "h")
    got = part.mapInArrow(tidy(_drawn), "lang string, raw binary").limit(2 * WINDOWS_A_DOC * max(SAMPLE, 8 * len(count))).toPandas()
    langs = sorted(got["lang"].unique())
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, raw in enumerate(got["raw"]):
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    order = np.lexsort([*x.T[:16], got["lang"]])  # rows come in any order; the model is the same
    y = np.array([langs.index(v) for v in got["lang"]])
    return ByteNet(langs).fit(x[order], y[order])


def _predicted(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            i = 0
            while model and i < len(texts):  # so many texts at once that their windows stay small
                rows, held, whose = [], 0, []
                while i < len(texts) and held < 4 << 20:
                    if texts[i] and _LETTER.search(texts[i]):
                        rows.append(windows(texts[i]))
                        held += rows[-1].size
                        whose.append(i)
                    i += 1
                if rows:
                    x = np.concatenate(rows)
                    p = model.predict(x) * np.maximum((x != 0).sum(axis=1), 1)[:, None]
                    p = np.add.reduceat(p, np.cumsum([0] + [len(r) for r in rows[:-1]]), axis=0)
                    p /= p.sum(axis=1, keepdims=True)
                    for k, q in zip(whose, p, strict=True):
                        names[k], scores[k] = model.langs[int(q.argmax())], min(1.0, float(q.max()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out, doc_id))
    d = docs.select(F.col(doc_id).alias("doc_id"), "text", held_out.alias("held_out"))
    return d.mapInArrow(tidy(_predicted(net)), d.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double"))


def accuracy(predicted: pd.DataFrame, lang: pd.Series) -> float:
    return float((predicted["lang_pred"].to_numpy() == lang.to_numpy()).mean())
