import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, lower, odd_rows, random_rows, words
from weftline.llm import class_lm
from weftline.llm.common import crc_mod


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def base(rows):
    """(doc_id, n_tokens, n_known, N, base_score) by counting all tokens."""
    tokens = {i: [lower(w) for w in words(t)] + ["<end>"] for i, (_, t) in enumerate(rows)}
    c = Counter(w for i, (doc, _) in enumerate(rows) if not held(doc) for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return sorted((doc or -1, len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), 6)) for i, (doc, _) in enumerate(rows))


def scored(spark, rows):
    return class_lm.score(documents(spark, rows), crc_mod(F.col("doc_id"), 7) == 2)


@pytest.mark.parametrize("counted", [200_000, 10])
def test_base_equals_brute_force(spark, monkeypatch, counted):
    monkeypatch.setattr(class_lm, "COUNTED", counted)
    rows = random_rows(3, n=120, vocabulary=500) + odd_rows()[:5]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = scored(spark, rows).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((0 if x[0] == -1 else x[0], *x[1:]) for x in base(rows))


def test_joined_counts_give_the_same_scores(spark, monkeypatch):
    rows = random_rows(4, n=80, vocabulary=300)
    monkeypatch.setattr(class_lm, "TYPES", 8)
    whole = {r.doc_id: r.score for r in scored(spark, rows).collect()}
    monkeypatch.setattr(class_lm, "COUNTED", 20)
    joined = {r.doc_id: r.score for r in scored(spark, rows).collect()}
    assert all(abs(whole[i] - joined[i]) < 1e-6 for i in whole)


def numbered(spark, rows):
    d = documents(spark, rows)
    return d.select(F.monotonically_increasing_id().alias("row"), "doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text")


def own_classes(own, column):
    """Class of each training word, and how often it stands there."""
    named = list(own.common)[: class_lm.TYPES]
    of = {w: int(c) for w, c in zip(named, own.held[own.types(named)], strict=True)}
    n = {w: own.common[w] for w in named}
    for r in own.rest.collect():
        of[bytes(r["word"])], n[bytes(r["word"])] = r[column], r.n
    return of, n


def test_model_sums_to_one(spark, monkeypatch):
    """Of every class: what follows, and words with the unknown one."""
    monkeypatch.setattr(class_lm, "TYPES", 12)
    m, _, own, column = class_lm.fitted(numbered(spark, random_rows(5, n=50)))
    assert np.allclose((10**m.step).sum(axis=1), 1)
    of, n = own_classes(own, column)
    for c in set(of.values()):
        known = sum(10 ** (m.known[c] + math.log10(n[w])) for w, k in of.items() if k == c)
        assert abs(known + 10 ** m.unknown[c] - 1) < 1e-9


@pytest.mark.parametrize("counted", [200_000, 30])
def test_score_equals_brute_force(spark, monkeypatch, counted):
    """From the words' classes alone: counts, transitions and probabilities by plain loops."""
    monkeypatch.setattr(class_lm, "TYPES", 10)
    monkeypatch.setattr(class_lm, "COUNTED", counted)
    rows = random_rows(6, n=80, vocabulary=300)
    _, _, own, column = class_lm.fitted(numbered(spark, rows))
    of, _ = own_classes(own, column)
    end, unseen_class = class_lm.CLASSES, lambda w: int(own.held[own.types([w])][0])
    tokens = {i: [lower(w).encode() for w in words(t)] for i, t in rows}
    train = [i for i, _ in rows if not held(i)]
    n = Counter(w for i in train for w in tokens[i])
    assert {w: n[w] for w in of} == dict(n)
    chain = {i: [*(of.get(w, unseen_class(w)) for w in tokens[i]), end] for i in tokens}
    pairs = Counter(p for i in train for p in zip([end, *chain[i]], chain[i], strict=False))
    size, once = Counter(), Counter()
    for w, k in n.items():
        size[of[w]] += k
        once[of[w]] += k == 1
    size[end] = len(train)
    share = {c: (size[c] + 1) / (sum(size.values()) + end + 1) for c in range(end + 1)}
    row = Counter()
    for (a, _), k in pairs.items():
        row[a] += k
    for i, got in ((r.doc_id, r.score) for r in scored(spark, rows).collect()):
        want, before = 0.0, end
        for w, c in zip([*tokens[i], None], chain[i], strict=True):
            want += math.log10((pairs[before, c] + class_lm.PULL * share[c]) / (row[before] + class_lm.PULL))
            before = c
            if w is not None:
                u = (once[c] + 1) / (size[c] + 2)
                want += math.log10((1 - u) * n[w] / size[c] if n[w] else u)
        assert abs(want - got) < 1e-6


def test_every_word_is_exchanged():
    """Against moving each word by itself and counting the likelihood anew."""
    r = np.random.default_rng(2)
    k, words = 5, 30
    m = r.integers(20, 200, (k + 1, k + 1)).astype(float)
    of = r.integers(0, k, words)
    owner, side, other, n = [], [], [], []
    for w in range(words):
        for s in (0, 1):
            for e in r.choice(k, 2, replace=False):
                owner.append(w), side.append(s), other.append(int(e)), n.append(int(r.integers(1, 6)))
    arrays = [np.array(x) for x in (owner, side, other, n)]
    for o, s, e, x in zip(*arrays, strict=True):  # the table holds the words' own places
        m[(of[o], e) if s == 0 else (e, of[o])] += x
    got = class_lm.exchange_words(*arrays, of, m, fixed=1)
    better = 0
    for w in range(words):
        def moved(d, w=w):
            t = m.copy()
            for o, s, e, x in zip(*arrays, strict=True):
                if o == w:
                    t[(of[w], e) if s == 0 else (e, of[w])] -= x
                    t[(d, e) if s == 0 else (e, d)] += x
            return class_lm.objective(t)

        better += moved(got[w]) >= max(moved(d) for d in range(k)) - 0.5  # a word next to its own class is counted once, not twice
        assert moved(got[w]) >= moved(of[w]) - 0.5
    assert better >= 0.9 * words


def test_words_beyond_the_types_are_clustered(spark, monkeypatch):
    """Rare words of two kinds, alike in their endings, part by what stands next to them; held-out text gains."""
    monkeypatch.setattr(class_lm, "TYPES", 20)
    monkeypatch.setattr(class_lm, "BUCKETS", 4)
    r = random.Random(1)
    rare = [[f"{k}{i}xxx" for i in range(300)] for k in "ab"]
    frame = [[f"{k}l{i}" for i in range(5)] for k in "ab"]
    rows = []
    for i in range(500):
        text = []
        for _ in range(25):
            k = r.randrange(2)
            text += [r.choice(frame[k]), r.choice(rare[k]), r.choice(frame[k])]
        rows.append((i, " ".join(text)))
    _, chains, own, column = class_lm.fitted(numbered(spark, rows))
    assert column == "class_1" and class_lm.objective(own.pairs(chains)) > class_lm.objective(own.m) + 100
    of, _ = own_classes(own, "class")
    kinds = [Counter(of[w.encode()] for w in some if w.encode() in of) for some in rare]
    assert not {c for c, n in kinds[0].items() if n > 15} & {c for c, n in kinds[1].items() if n > 15}


def test_exchange_gains_likelihood():
    """Two kinds of words that follow their own kind only: the exchange parts them."""
    r = np.random.default_rng(1)
    n = np.zeros((20, 20))
    for k in (0, 1):
        own = np.arange(k, 20, 2)
        n[np.ix_(own, own)] = r.integers(5, 20, (10, 10))
    of = np.arange(20) // 2 % 4
    first = None
    for _ in range(12):
        after, before = np.zeros((20, 4)), np.zeros((20, 4))
        for t in range(20):
            np.add.at(after[t], of, n[t])
            np.add.at(before[t], of, n[:, t])
        m = np.zeros((4, 4))
        np.add.at(m, of, after)
        first = class_lm.objective(m) if first is None else first
        of = class_lm.exchange(after, before, np.diagonal(n).copy(), of, m, fixed=0)
    last = np.zeros((4, 4))
    np.add.at(last, (of[:, None], of[None, :]), n)
    assert class_lm.objective(last) > first
    assert not set(of[0::2]) & set(of[1::2])


def test_held_out_texts_score_better_than_by_single_words(spark):
    from weftline.llm.common import table

    got = class_lm.score(table(spark, "/root/testdata/sf0.01", "documents"), crc_mod(F.col("doc_id"), 7) == 2)
    a, b = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert a > 0.9 * b and a > b


def test_odd_cases(spark):
    got = scored(spark, odd_rows()).collect()
    assert len(got) == 10 and all(r.n_tokens == len(words(dict(odd_rows()[:5]).get(r.doc_id, "x"))) + 1 for r in got if r.doc_id in (1, 2, 3))
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert scored(spark, []).count() == 0
    nothing = class_lm.score(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in nothing] == [(0, 0, 0.0)] * 2
    clash = documents(spark, [(1, "a b a")]).selectExpr("*", "1 AS row", "2 AS words", "3 AS score", "4 AS held_out")
    assert class_lm.score(clash, F.col("doc_id") == 2).first().n_known == 4


def test_a_flat_vocabulary(spark, monkeypatch):
    """Every word as often as every other, and more of them than the commonest may be: none is common, none is collected."""
    monkeypatch.setattr(class_lm, "COUNTED", 5)
    rows = [(i + 1, " ".join(f"u{j}" for j in range(60))) for i in range(20)]
    got = scored(spark, rows).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)


def test_groups_hold_whole_words(monkeypatch):
    """However rows fall into batches and groups, each word comes once, with all of its entries."""
    import pyarrow as pa

    r = random.Random(1)
    rows = sorted((f"w{r.randrange(40):02d}".encode(), bytes(r.randrange(130) for _ in range(n)), bytes(r.randrange(1, 256) for _ in range(n))) for n in (r.randrange(1, 9) for _ in range(300)))
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + 17]], pa.binary()) for i in range(3)], ["word", "near", "times"]) for a in range(0, 300, 17)]
    want = Counter()
    for w, near, times in rows:
        for c, t in zip(near, times, strict=True):
            want[w, c] += t
    for entries, most in ((1 << 20, 1 << 17), (50, 1 << 17), (1 << 20, 3), (1, 1)):
        monkeypatch.setattr(class_lm, "GROUP_ENTRIES", entries)
        monkeypatch.setattr(class_lm, "GROUP_WORDS", most)
        got, seen = Counter(), []
        for names, whose, code, times in class_lm._groups(iter(batches)):
            seen += names
            for i, c, t in zip(whose.tolist(), code.tolist(), times.tolist(), strict=True):
                got[names[i], c] += t
        assert got == want and len(seen) == len(set(seen)) == len({w for w, _, _ in rows})


def test_neighbours_are_summed_a_slice(spark):
    """A word of a slice is one row; counts above a byte are several entries."""
    import pyarrow as pa

    class Sent:
        def __init__(self, value):
            self.value = value

    own = class_lm.Types([])
    of = np.arange(own.end + 1) % 3
    of[own.end] = 3
    batch = pa.RecordBatch.from_arrays([pa.array(["aa bb " * 700, "bb"])], ["text"])
    out = next(iter(class_lm._word_neighbours(Sent(own), Sent(of))(iter([batch])))).to_pylist()
    assert sorted(r["word"] for r in out) == [b"aa", b"bb"]
    sums = {r["word"]: sum(r["times"]) for r in out}
    assert sums == {b"aa": 1400, b"bb": 1402} and all(len(r["near"]) == len(r["times"]) < 20 for r in out)
