import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, lower, odd_rows, words
from weftline.llm import near_dedup
from weftline.llm.common import Scratch


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = [lower(x) for x in words(t)]
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(rows, n, percent=80):
    """(doc_id, set size, smallest id reachable) over all pairs."""
    s = sets(rows, n)
    root = {i: i for i in s}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted((i, len(s[i]), top(i)) for i in ids)


def variants(seed, families=12, each=8):
    """Families of texts that drift apart word by word, so that links chain; some lie about the threshold."""
    r = random.Random(seed)
    rows = []
    for f in range(families):
        w = [f"f{f}w{r.randrange(400)}" for _ in range(r.randrange(30, 200))]
        for _ in range(each):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(r.randrange(0, max(2, len(w) // 18))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n", [(0, 2), (1, 5), (2, 2), (3, 1)])
def test_equals_brute_force(spark, seed, n):
    rows = variants(seed)
    got = near_dedup.near_duplicates(documents(spark, rows), words=n)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, n)


def test_rows_that_share_an_id_are_one_document(spark):
    """One component for an id, whatever its texts; what either links to is reachable."""
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "x y z w"), (7, "x y z w"), (9, ""), (9, "x y z w"), (3, "k l m n"), (3, None), (8, "alone here")]
    got = near_dedup.near_duplicates(documents(spark, rows), words=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (7, 1), (9, 1), (3, 3), (8, 8)} and len(got) == 9
    assert {(r.doc_id, r.kept) for r in got} == {(1, True), (5, False), (7, False), (9, False), (3, True), (8, True)}
    kept = near_dedup.keep_one(documents(spark, rows), words=2).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 8]


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    rows = variants(11, families=4)
    got = near_dedup.near_duplicates(documents(spark, rows), words=1)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 1)


def test_one_large_bucket(spark, monkeypatch):
    """Hundreds of texts about the threshold around one; small blocks, so that many are compared."""
    monkeypatch.setattr(near_dedup, "BLOCK_STRAYS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(100), r.randrange(0, 12)):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(documents(spark, rows), words=1)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 1)


def test_components(spark):
    """A long path, a star and a ring, against union by hand."""
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = dict(near_dedup.components(e, Scratch(spark)).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}
    assert near_dedup.components(e.limit(0), Scratch(spark)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words are here today"), (2, "other words are here today"), (None, "a b c d e f g"), (4, None), (5, "")]
    kept = near_dedup.keep_one(documents(spark, rows)).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]


def test_odd_cases(spark):
    got = near_dedup.near_duplicates(documents(spark, odd_rows()), words=2)
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert got.count() == 10 and by[5, 1].component_id == 4 and not by[5, 1].kept and by[4, 1].kept
    assert by[1, 0].kept and by[1, 0].component_id == 1 and by[None, 2].component_id is None
    assert got.filter(F.col("doc_id").isNull()).first().kept
