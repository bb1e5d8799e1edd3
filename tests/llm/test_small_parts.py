"""Bit packing, the ordinal model, the ledger's ablation, the byte network: parts with answers known beforehand."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows
from weftline.llm import language_id, quality_classifier, quality_rules, token_files


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.data())
def test_pack_round_trip(bits, ids, data):
    x = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    packed = token_files.pack(x, bits)
    assert len(packed) == -(-len(x) // 64) * bits * 8
    start = data.draw(st.integers(0, len(x)))
    n = data.draw(st.integers(0, len(x) - start))
    assert np.array_equal(token_files.unpack(packed, bits, start, n), x[start : start + n].astype(np.uint32))
    assert token_files.bits_for(50257) == 16 and token_files.bits_for(2) == 1 and token_files.bits_for(1) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\0é 'S1.", max_size=25)), max_size=8))
def test_encoder_equals_the_tokenizer(texts):
    import public_tokenizers

    e = token_files.own_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, n = e.encode(pa.array(texts, pa.string()))
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_ordinal_model_orders_grades():
    r = np.random.default_rng(0)
    grade = r.integers(0, 3, 900)
    at = np.concatenate([np.array([10 + g, 20 + int(r.integers(5))], np.int32) for g in grade])
    m = quality_classifier.OrdinalModel(3).fit(at, np.ones(1800, np.float32), np.full(900, 2), grade)
    assert m.t[0] < m.t[1]
    p = m.tails(np.array([m.w[10], m.w[11], m.w[12]], np.float64))
    assert (np.diff(p.sum(axis=1)) > 0.3).all() and (p[:, 0] >= p[:, 1]).all()


def test_ordinal_model_comes_near_the_likeliest():
    """Against the cumulative-link likelihood by plain loops: no step in any weight or threshold gains much."""
    import math

    r = np.random.default_rng(1)
    grade = r.integers(0, 3, 600)
    rows = [[int(g) if r.random() < 0.8 else int(r.integers(3)), 5 + int(r.integers(3))] for g in grade]
    m = quality_classifier.OrdinalModel(3).fit(np.array(rows, np.int32).reshape(-1), np.ones(1200, np.float32), np.full(600, 2), grade)

    def likelihood(w, t):
        out = 0.0
        for g, x in zip(grade, rows, strict=True):
            s = sum(w[k] for k in x)
            tail = [1.0, *(1 / (1 + math.exp(-(s - k))) for k in t), 0.0]
            out += math.log(tail[g] - tail[g + 1])
        return out / len(rows)

    w, t = [float(m.w[k]) for k in range(8)], m.t.tolist()
    best = likelihood(w, t)
    assert best > likelihood([0.0] * 8, t) + 0.2
    for k in (0, 1, 2, 5, 6, 7):
        for d in (-0.5, 0.5):
            assert likelihood([x + d * (i == k) for i, x in enumerate(w)], t) < best + 0.05
    for k in range(2):
        for d in (-0.5, 0.5):
            moved = [x + d * (i == k) for i, x in enumerate(t)]
            assert moved[0] >= moved[1] or likelihood(w, moved) < best + 0.05


def test_sample_is_bounded_in_bytes(spark):
    """The fit takes rows up to its bytes; the score still covers every text."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(i, f"good fine {i}" if i % 2 else f"bad poor {i}") for i in range(40)])
    rated = quality_classifier.grades(labels)
    one = quality_classifier.train(docs, rated, sample_bytes=1)
    full = quality_classifier.train(docs, rated)
    assert not one.w[: 1 << 18].any() and full.w[: 1 << 18].any()
    assert quality_classifier.score(docs, labels).count() == 40


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(documents(spark, odd_rows()), none).collect()
    assert len(got) == 10 and all(abs(r.tail_probability - 1 / 3) < 1e-9 and abs(r.expected_grade - 1) < 1e-9 for r in got)
    assert quality_classifier.select_good(documents(spark, odd_rows()), none).count() == 10


def test_ablation(spark):
    docs = documents(spark, [(1, "few words"), (2, "### " * 60), (3, " ".join(f"w{i}" for i in range(80)))])
    led = quality_rules.ledger(docs)
    assert {r.doc_id: r.kept for r in quality_rules.apply_policy(led, "v1").collect()} == {1: False, 2: False, 3: True}
    got = {r.rule: (r.rejected, r.rejected_alone) for r in quality_rules.ablation(led, "v1").collect()}
    assert got["few_words"] == (1, 1) and got["repeat_words"] == (1, 0) and got["symbols"] == (1, 0)
    assert quality_rules.apply_policy(led, "base").filter("kept").count() == 1


def test_byte_net_learns():
    r = np.random.default_rng(1)
    x = r.integers(97, 110, (120, language_id.WINDOW)).astype(np.uint8)
    y = np.arange(120) % 2
    for i in np.flatnonzero(y):
        at = r.integers(0, language_id.WINDOW - 3, 12)
        for a in at:
            x[i, a : a + 3] = [120, 121, 122]
    net = language_id.ByteNet(["a", "b"]).fit(x, y)
    assert (net.predict(x).argmax(axis=1) == y).mean() > 0.97
    assert language_id.windows("é" * 200).shape == (2, language_id.WINDOW) and language_id.windows("").shape[0] == 1


def test_language_of_odd_texts(spark):
    docs = documents(spark, [*odd_rows(), (20, "123 456")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, F.lit(False)).collect()}
    assert got[1] == got[2] == got[20] == ("und", 0.0) and got[8][0] == "en"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aBé \n\tX", max_size=12)), min_size=1, max_size=12), st.integers(0, 12), st.integers(0, 12))
def test_words_of_a_part_of_a_batch(texts, start, n):
    """A part of a batch keeps the batch's buffers: its words must be its own."""
    from weftline.llm.common import coded, lower_words, plain_words, word_spans

    part = pa.array(texts, pa.string()).slice(min(start, len(texts)), n)
    for lower, split in ((True, lower_words), (False, plain_words)):
        words, codes, length = coded(part, lower)
        want = [split(t) for t in part.to_pylist()]
        assert [words[c] for c in codes] == [w for ws in want for w in ws] and length.tolist() == [len(w) for w in want]
    raw, first, last, length = word_spans(part)
    assert [raw[i:j].tobytes() for i, j in zip(first, last, strict=True)] == [w for t in part.to_pylist() for w in plain_words(t)]
