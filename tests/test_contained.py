"""Names anywhere in texts, against a loop over every pair."""

import random

import numpy as np

from weftline.operators import contained as K


def plain(texts, names):
    names = sorted({n for n in names if n})
    return {i: min((n for n in names if n in t), default=None) for i, t in enumerate(texts) if t}


def words(seed, n, longest, letters="abAB é"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, longest))) for _ in range(n)]


def test_automaton_equals_every_pair(monkeypatch):
    for piece in (2_000, 7):
        monkeypatch.setattr(K, "PIECE", piece)
        for seed in range(6):
            names, texts = sorted({n for n in words(seed, 40, 7) if n}), [t for t in words(seed + 50, 200, 60) if t]
            names += ["abab", "ab", "b"] if seed % 2 else ["é" * 20]
            names = sorted(set(names))
            got = K.Automaton(names).first_in(texts)
            assert [names[g] if g < len(names) else None for g in got] == list(plain(texts, names).values())


def test_pieces_step_together_within_bounds(monkeypatch):
    monkeypatch.setattr(K, "TOGETHER", 500)
    monkeypatch.setattr(K, "PIECE", 50)
    texts = ["x" * n + "needle" for n in (0, 1, 49, 50, 51, 3000, 44)] * 5 + ["needl"]
    assert K.Automaton(["needle"]).first_in(texts).tolist() == [0] * 35 + [1]


def test_states_are_as_many_as_letters_at_most():
    names = sorted({n for n in words(3, 500, 12) if n})
    a = K.Automaton(names)
    assert len(a.next) <= 1 + sum(map(len, names)) and (np.asarray(a.next) < len(a.next)).all()


def test_blocks_of_names_and_rows(spark):
    texts, names = words(1, 300, 50), words(2, 120, 6)
    rows = spark.createDataFrame([*enumerate(texts), (998, None), (999, "")], "row_id long, text string")
    listed = spark.createDataFrame([(n,) for n in [*names, *names, None, ""]], "name string")
    want = {i: n for i, n in plain(texts, names).items() if n}
    got = K.first_contained(rows, listed, letters=100, most_rows=70)
    assert {r.row_id: r.name for r in got.collect()} == want and len(want) > 100
    assert "CartesianProduct" not in (p := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in p
    assert K.first_contained(rows, listed.limit(0)).collect() == K.first_contained(rows.limit(0), listed).collect() == []


def test_one_text_with_every_name(spark):
    """A hot row: many names in one text make one row, not many."""
    names = [f"n{i:05d}" for i in range(5000)]
    rows = spark.createDataFrame([(1, " ".join(reversed(names))), (1, "n04999")], "row_id long, text string")
    got = K.first_contained(rows, spark.createDataFrame([(n,) for n in names], "name string"))
    assert [tuple(r) for r in got.collect()] == [(1, "n00000")]
