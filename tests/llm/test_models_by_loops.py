"""Operators 5 and 10 as their queries run them, against plain loops over words and bytes; and what very long texts give."""

import math

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents
from weftline.llm import language_id as li
from weftline.llm import quality_classifier as qc
from weftline.llm import token_files
from weftline.llm.common import crc_mod, table
from weftline.llm.queries import QUERIES, TOKENIZER, VOCABULARY

SF = "/root/testdata/sf0.001"
LETTERS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]


def split(text):
    out, word = [], ""
    for ch in text or "":
        if ch in " \t\n\v\f\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += ch
    return out + [word] * bool(word)


def bits(kind, s, n):
    return xxhash.xxh3_64_intdigest((kind + s).encode()) % 2**n


def shape(word):
    """Runs of capitals, of other letters, of digits as one sign each, by a loop over the word's signs as the features see them."""
    low = lambda c: qc._LOWER.fullmatch(c) is not None
    kind = ["A" if qc._UPPER.fullmatch(c) else c for c in word]
    out, before = [], None
    for c in kind:
        k = "A" if c == "A" else "a" if low(c) else "9" if c.isdecimal() else c
        if not (k == before and k in "Aa9"):
            out.append(k)
        before = k
    return "".join(out)[:12]


def link(text, w):
    words = split(text)
    base, s = 2**18 + 2**10, 0.0
    for word in set(words):
        s += w[bits("w", word.lower(), 18)] + w[bits("p", word.lower()[:4], 18)]
    for word in words:
        s += 4 * w[2**18 + bits("s", shape(word), 10)] / len(words)
    size = 0
    while 2**size <= len(words):
        size += 1
    return s + w[base + min(size, 15)] + w[base + 16 + min(len(set(words)) * 16 // max(len(words), 1), 15)]


def test_every_score_of_the_classifier(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = qc.train(docs, qc.grades(labels))
    w, t = model.w.astype(np.float64), model.t.tolist()
    assert model.learned and w.any() and t == sorted(t)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op5_quality_classifier"](spark, SF).collect()
    for r in rows:
        s = link(texts[r.doc_id], w)
        tails = [1 / (1 + math.exp(-max(-30.0, min(30.0, s - k)))) for k in t]
        assert abs(r.link_score - s) < 1e-4 and abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail_probability - tails[-1]) < 1e-4
        assert r.kept == (r.tail_probability >= 0.5)
    assert {r.doc_id for r in rows} == set(texts) and 0 < sum(r.kept for r in rows) < len(rows)
    stage = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert {r.doc_id for r in stage.collect()} == {r.doc_id for r in rows if r.kept} and stage.columns == docs.columns


def net_scores(text, p, langs):
    """Mean over windows of softmax(max over places of a convolution), weighted by bytes, by loops."""
    raw = text.encode()
    total, mean = 0, [0.0] * len(langs)
    for start in range(0, max(1, len(raw)), li.WINDOW):
        part = list(raw[start : start + li.WINDOW])
        part += [0] * (li.WINDOW - len(part))
        h = []
        for width in li.WIDTHS:
            kernel, bias = p[f"w{width}"].astype(np.float64), p[f"b{width}"]
            best = np.full(li.FILTERS, -np.inf)
            for i in range(li.WINDOW - width + 1):
                y = np.zeros(li.FILTERS)
                for k in range(width):
                    y += p["e"][part[i + k]].astype(np.float64) @ kernel[k]
                best = np.maximum(best, y)
            h += [max(0.0, float(b + c)) for b, c in zip(best, bias, strict=True)]
        z = [sum(x * float(p["out"][i, j]) for i, x in enumerate(h)) + float(p["bias"][j]) for j in range(len(langs))]
        e = [math.exp(x - max(z)) for x in z]
        n = max(1, sum(b != 0 for b in part))
        mean = [m + n * x / sum(e) for m, x in zip(mean, e, strict=True)]
        total += n
    return [m / sum(mean) for m in mean]


def test_every_score_of_the_network(spark):
    docs = table(spark, SF, "documents")
    net = li.train(docs, ~(crc_mod(F.col("doc_id"), 4) == 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, SF).collect() if len(texts[r.doc_id] or "") < 1500]
    assert len(rows) > 60
    letters = set(LETTERS)
    for r in rows:
        text = texts[r.doc_id]
        if not text or not set(text) & letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = net_scores(text, net.p, net.langs)
        assert abs(r.score - max(want)) < 1e-3 and (r.lang_pred == net.langs[want.index(max(want))] or sorted(want)[-1] - sorted(want)[-2] < 1e-3)


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 9 MB beside short ones with the same words."""
    words = [f"word{i % 900}" for i in range(1_000_000)]
    return documents(spark, [(1, " ".join(words)), (2, " ".join(words[:900])), (3, "un mot de plus")])


def test_very_long_texts(spark, long_docs):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.score(long_docs, labels).collect()}
    w = qc.train(long_docs, qc.grades(labels)).w.astype(np.float64)
    text = {r.doc_id: r.text for r in long_docs.collect()}
    assert all(abs(got[i].link_score - link(text[i], w)) < 1e-3 for i in (2, 3)) and len(got) == 3 and 0 <= got[1].tail_probability <= 1
    langs = {r.doc_id: r for r in li.identify(long_docs.withColumn("lang", F.when(F.col("doc_id") == 3, "fr").otherwise("en")), F.lit(False)).collect()}
    assert langs[1].lang_pred == langs[2].lang_pred == "en" and langs[1].score > 0.5
    files = {r.doc_id: r for r in token_files.token_files(long_docs, public_tokenizers.path(TOKENIZER), VOCABULARY).collect()}
    own = token_files.own_encoder(public_tokenizers.path(TOKENIZER)).tokenizer
    assert all(files[i].n_tokens == len(own.encode(text[i], add_special_tokens=False).ids) + 1 for i in (1, 2, 3))
    assert files[2].start == files[1].n_tokens and files[3].start == files[1].n_tokens + files[2].n_tokens
