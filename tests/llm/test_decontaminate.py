import random
import re

import numpy as np
import pytest

from tests.llm.helpers import documents, lower, odd_rows
from weftline.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(rows, items, window):
    tests = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for doc, t in rows:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for x, ids in tests.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found)))
    return sorted(out)


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["A", "b", "C1", "dé", "e", "f-g"])
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 12)))) for i in range(12)]
    rows = []
    for i in range(40):
        t = [word() for _ in range(r.randrange(0, 25))]
        if r.random() < 0.5:
            t += r.choice(items)[1].split()
        rows.append((i, r.choice([" ", ", ", "\n"]).join(t)))
    return rows, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_equals_brute_force(spark, seed, block_bytes):
    rows, items = case(seed)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dec.contamination(documents(spark, rows), b, window=4, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == brute(rows, items, 4)
    kept = {r.doc_id for r in dec.clean(documents(spark, rows), b, window=4, block_bytes=block_bytes).collect()}
    assert kept == {r.doc_id for r in got if not r.contaminated}


def test_longest_match(spark):
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    r = dec.contamination(documents(spark, [(1, "zero. Two three FOUR five, seven")]), b, window=3).first()
    assert (r.longest, r.longest_item, r.longest_start, r.contaminated) == (4, "1", 1, True)


def test_search_equals_every_comparison():
    """Sorted suffixes, longest matches and groups, over texts whose ids have gaps, against comparing all with all."""
    r = np.random.default_rng(3)
    for _ in range(300):
        some = [1, 2, 3, int(r.integers(4, 30))]
        run = lambda: np.append(r.choice(some, r.integers(1, 15)), 0)  # noqa: B023, E731
        train, tests = (np.concatenate([run() for _ in range(r.integers(1, 4))]) for _ in range(2))
        t, n = np.concatenate([train, tests]), len(train)
        zero = np.flatnonzero(t == 0)
        rest = zero[np.searchsorted(zero, np.arange(len(t)))] - np.arange(len(t))
        text = [tuple(t[i : i + rest[i]]) for i in range(len(t))]
        same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        levels = dec.doubled(t, n, rest)
        at = np.flatnonzero(train)
        order = at[np.argsort(levels[-1][at], kind="stable")]
        wanted = np.flatnonzero(tests) + n
        longest, place = dec.search(levels, order, wanted, rest)
        for w, k, p in zip(wanted, longest, place, strict=True):
            assert k == max(same(text[w], text[i]) for i in at) and same(text[w], text[order[p]]) >= k
        for depth in range(1, int(longest.max(initial=0)) + 1):
            group = dec.stretches(levels, n, rest, order, depth)
            for i in range(len(order)):
                for j in range(i):
                    assert (group[i] == group[j]) == (same(text[order[i]], text[order[j]]) >= depth)


def test_long_matches_are_not_slow():
    """An item copied whole, and one word over and over: neither grows with the square."""
    import time

    words = [b"w%d" % (i * 7919 % 50_021) for i in range(200_000)]
    began = time.time()
    mask, found, best = dec.Block([("a", b" ".join(words).decode())], 10).shard([words])[0]
    assert mask.all() and found == ["a"] and best == (200_000, "a", 0)
    mask, found, best = dec.Block([("a", "x " * 100_000)], 10).shard([[b"x"] * 100_000])[0]
    assert mask.all() and found == ["a"] and best == (100_000, "a", 0)
    assert time.time() - began < 40


def test_each_copy_has_its_longest_match():
    text = b"one two three four five six".split()
    got = dec.Block([("i", "one two three four five six")], 10).shard([text, [b"zero", *text[1:4]], text])
    assert [x[2] for x in got] == [(6, "i", 0), (3, "i", 1), (6, "i", 0)]


def test_ids_that_repeat_or_are_null(spark):
    """Rows that share an id are one item; those without one mark words only. The SQL says the same."""
    import duckdb

    from weftline.llm.sql import DECONTAMINATION

    b = spark.createDataFrame([(1, "a b c d"), (1, "c d e"), (2, "a b c d"), (None, "x y z")], "item_id long, text string")
    d = documents(spark, [(1, "a b c d e"), (2, "x y z"), (3, "q"), (4, "c d e a")])
    got = dec.contamination(d, b, block_bytes=8).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got.collect()) == [(1, 5, 2), (2, 3, 0), (3, 0, 0), (4, 3, 1)]
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in b.collect()])
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(DECONTAMINATION).fetchall())


def test_gaps_hide_no_match(spark):
    b = spark.createDataFrame([(1, "a b f"), (2, "a b c"), (3, "d e f")], "item_id long, text string")
    rows = [(1, "a b f"), (2, "a b c")]
    got = dec.contamination(documents(spark, rows), b, window=3).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.longest, r.longest_item) for r in got) == [(1, 3, 1, 3, "1"), (2, 3, 1, 3, "2")]


def test_odd_cases(spark):
    b = spark.createDataFrame([(1, "no id here"), (2, None), (3, ""), (4, "w1 w2 w3")], "item_id long, text string")
    got = dec.contamination(documents(spark, odd_rows()), b).collect()
    assert len(got) == 10 and {r.doc_id for r in got if r.contaminated} == {None, 6}
    assert dec.contamination(documents(spark, []), b).count() == 0
    assert not any(r.contaminated for r in dec.contamination(documents(spark, odd_rows()), b.limit(0)).collect())


def test_blocks_are_bounded(spark, monkeypatch):
    """Many copies of one row are one; a very long item is cut into pieces, and nothing that it hits is lost."""
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(4000))
    own = long.split()
    docs = documents(spark, [(i, " ".join(["x", *own[a : a + n], "y"])) for i, (a, n) in enumerate((r.randrange(3900), r.randrange(5, 40)) for _ in range(300))])
    bench = spark.createDataFrame([(1, long)] + [(2, "a copied row of ten words and a few more words")] * 3000, "item_id long, text string")
    want = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256) for x in dec.contamination(docs, bench).collect()}
    sizes = []
    real = dec.Block.__init__
    monkeypatch.setattr(dec.Block, "__init__", lambda self, items, window: sizes.append(sum(len(t) for _, t in items)) or real(self, items, window))
    got = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256) for x in dec.contamination(docs, bench, block_bytes=4000).collect()}
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 100
    assert len(sizes) > 4 and max(sizes) < 3 * 4000 and sum(sizes) < 1.2 * len(long)
