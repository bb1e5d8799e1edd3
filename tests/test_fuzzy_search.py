"""The search over all names against every pair, scored one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_copies import nodes
from weftline.functions import similarity as S
from weftline.operators import cascade as C
from weftline.operators import fuzzy_search as FS
from weftline.plans import queries as Q
from weftline.plans import rules

KINDS = ["token_set", "token_sort", "partial_token_sort"]


def texts(seed, n):
    r = random.Random(seed)
    letters = "ABCDEFGHIé5 "
    word = lambda: "".join(r.choice(letters[:-1]) for _ in range(r.randrange(1, 9)))
    words = [word() for _ in range(60)]
    out = ["", "A", "A A", "AB"]
    while len(out) < n:
        own = [r.choice(words) for _ in range(r.randrange(1, 6))]
        if out and r.random() < 0.5:  # letters lost, changed, brought in
            own = list(" ".join(own))
            for _ in range(r.randrange(0, 4)):
                i = r.randrange(len(own))
                own[i] = r.choice(["", r.choice(letters), own[i] * 2])
            own = "".join(own).split()
        out.append(" ".join(own))
    return out


def every(asked, names, kinds, most, least):
    out = {}
    for i, a in enumerate(asked):
        for k, kind in enumerate(kinds):
            own = [(-round(float(S._ALL[kind](a, b)), 6), j) for j, b in enumerate(names)]
            out[i, k] = sorted(x for x in own if -x[0] >= least)[:most]
    return out


@pytest.mark.parametrize(("least", "most"), [(80.0, 1), (68.0, 5), (90.0, 3), (50.0, 2)])
def test_block_equals_every_pair(least, most):
    asked, names = texts(1, 150), texts(2, 250)
    got: dict = {}
    for i, k, j, s in FS.block_tops(asked, names, np.arange(len(names)), KINDS, most, least):
        got.setdefault((i, k), []).append((-round(s, 6), j))
    want = {x: v for x, v in every(asked, names, KINDS, most, least).items() if v}
    assert got == want and sum(map(len, want.values())) > 100


def test_bounds_hold():
    asked, names = texts(3, 60), texts(4, 120)
    block = FS.Block(names)
    for a in asked:
        b = block.bounds(a, KINDS)
        for k, kind in enumerate(KINDS):
            assert all(b[k, j] >= S._ALL[kind](a, y) - 1e-9 for j, y in enumerate(names)), (a, kind)


def test_most_names_are_never_scored(monkeypatch):
    """A name with a near one in the block leaves few whose bound could do better."""
    names = texts(5, 400)
    asked = [f"{n}X" for n in names if len(n) > 20]
    scored = []
    real = FS.batch_scores
    monkeypatch.setattr(FS, "batch_scores", lambda kinds, a, b: scored.append(len(a)) or real(kinds, a, b))
    list(FS.block_tops(asked, names, np.arange(len(names)), ["token_sort"], 1, 80.0))
    assert sum(scored) < 0.15 * len(asked) * len(names)


def test_blocks_lose_nothing(spark):
    """Every item whose id 50 divides against all names, in several blocks of each side, with ties, nulls and repeated scores."""
    items = rules._misspelt(spark, SF).filter("item_id % 50 = 0 or item_id % 7 = 0").selectExpr("name as d_name", "name as a").distinct()
    names = Q.catalogue(spark, SF).selectExpr("candidate as m_name").distinct().selectExpr("m_name", "m_name as b", "xxhash64(m_name) % 40 as row_id", "1.5D as m_price")
    names = names.unionByName(spark.createDataFrame([(None, None, 1, None)], "m_name string, b string, row_id long, m_price double"))
    x, y = [r.d_name for r in items.collect()], sorted(((r.b, r.row_id) for r in names.collect() if r.b), key=str)
    want = {}
    for a in x:
        for kind in KINDS:
            s = np.round(S.batch_scores([kind], [a] * len(y), [b for b, _ in y])[kind], 6)
            own = sorted((-v, row) for v, (_, row) in zip(s.tolist(), y, strict=True) if v >= 68)[:4]
            if own:
                want[a, kind] = own
    got: dict = {}
    for r in FS.most_alike(items, names, KINDS, 4, 68.0, asked_block=20, names_block=30).orderBy("rank").collect():
        got.setdefault((r.d_name, r.scorer), []).append((-round(r.base, 6), r.row_id))
    assert got == want and len(want) > 30


@pytest.mark.parametrize(("asked_block", "names_block"), [(7, 30), (250, 20_000)])
def test_names_of_a_key_lose_nothing(spark, asked_block, names_block):
    """Keys of many, of few and of no names, null keys and texts, several blocks of each side, ties."""
    a, b = texts(9, 90), texts(10, 160)
    key = lambda i: None if i % 11 == 0 else f"k{min(i % 5, 2)}" if i % 13 else f"own{i}"
    x = [(t, t, key(i)) for i, t in enumerate(dict.fromkeys(a))] + [("none", None, "k0")]
    y = [(t, t, key(i), (i * 7) % 40, float(i)) for i, t in enumerate(dict.fromkeys(b))] + [("none", None, "k0", 0, 1.0)]
    want = {}
    for d, t, k in x:
        for kind in KINDS:
            own = sorted((-round(float(S._ALL[kind](t, n)), 6), row) for _, n, other, row, _ in y if k and k == other and t is not None and n is not None)
            if own := [s for s in own if -s[0] >= 68][:3]:
                want[d, kind] = own
    asked, names = spark.createDataFrame(x, "d_name string, a string, key string"), spark.createDataFrame(y, "m_name string, b string, key string, row_id long, m_price double")
    got: dict = {}
    for r in FS.most_alike_of_key(asked, names, KINDS, 3, 68.0, asked_block, names_block).orderBy("rank").collect():
        got.setdefault((r.d_name, r.scorer), []).append((-round(r.base, 6), r.row_id))
    assert got == want and len(want) > 30
    assert FS.most_alike_of_key(asked.limit(0), names, KINDS, 1, 80.0).collect() == FS.most_alike_of_key(asked, names.limit(0), KINDS, 1, 80.0).collect() == []


def test_names_that_begin_alike_are_not_all_paired(spark):
    """150 names on each side that begin alike: a join made 22,500 pairs of them, and each was scored three times."""
    of = lambda word: spark.range(150).select((F.col("id") + 1).alias("row_id"), F.concat(F.lit(f"ZETA{word} "), F.translate(F.conv("id", 10, 5), "01234", "KLMNO"), F.lit("TA TAB")).alias("name"))
    asked, m = C.names(of("MOL"), "name", "d").localCheckpoint(), C.names(of("MEL"), "name", "m").localCheckpoint()
    first = of("MEL").select(F.col("name").alias("m_name"), "row_id", F.lit(1.0).alias("m_price")).localCheckpoint()
    df = C.tops_of_beginnings(asked, m, first)
    assert len({r.d_name for r in df.collect()}) == 150
    assert max(n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()) <= 150


def test_names_and_pairs_are_dealt_by_number(spark):
    """A thousand names are few bytes but long to parse and to judge: they went to one task."""
    items = spark.range(1000).select(F.concat(F.lit("ZETA "), "id", F.lit(" MG TAB")).alias("name"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    d, m = C.names(items, "name", "d"), C.names(items, "name", "m")
    assert tasks(d) == 8  # two a core
    pairs = d.select("d_name", F.col("d_name").alias("m_name")).groupBy("d_name", "m_name").count()
    seen = []

    class Kept:
        def save(self, df, name):
            seen.append(tasks(df))
            return df

    C.passing(pairs, d.localCheckpoint(), m.localCheckpoint(), Kept())
    assert seen == [8]


def test_empty_sides(spark):
    asked = spark.createDataFrame([("A", "A")], "d_name string, a string")
    names = spark.createDataFrame([("A", "A", 1, 1.0)], "m_name string, b string, row_id long, m_price double")
    assert FS.most_alike(asked, names.limit(0), KINDS, 1, 80.0).collect() == []
    assert FS.most_alike(asked.limit(0), names, KINDS, 1, 80.0).collect() == []
    assert [r.base for r in FS.most_alike(asked, names, KINDS, 1, 80.0).collect()] == [100.0] * 3


def test_cascade_meets_a_name_that_shares_no_word(spark):
    """One wrong first letter of a name of one word: neither beginning nor word is shared."""
    items = spark.createDataFrame([(1, "XARACETAMOLUM", 1.0)], "item_id long, name string, price double")
    rows = spark.createDataFrame([(7, "PARACETAMOLUM", 1.0), (8, "BRUFEN", 1.0)], "row_id long, name string, price double")
    asked, m = C.names(items, "name", "d"), C.names(rows, "name", "m")
    first = rows.selectExpr("name as m_name", "row_id", "price as m_price")
    assert {r.m_name for r in C.tops_of_all(asked, m, first).collect()} == {"PARACETAMOLUM"}


def test_hot_keys_meet_in_blocks(spark):
    """Every key hot, in blocks of a few names: the pairs that reach the threshold are those of a plain join, and few others are made."""
    a, b = texts(7, 120), texts(8, 200)
    asked = spark.createDataFrame([(t, t, f"k{i % 3}") for i, t in enumerate(dict.fromkeys(a))], "d_name string, a string, key string")
    names = spark.createDataFrame([(t, t, f"k{i % 3}") for i, t in enumerate(dict.fromkeys(b))], "m_name string, b string, key string")
    plain = asked.join(names, "key").select("d_name", "m_name").distinct().collect()
    wanted = {(x, y) for x, y in plain if S.token_sort_ratio(x, y) >= 70}
    hot = FS.likely_pairs(asked, names, ["token_sort"], 70.0, most=10, asked_block=7, names_block=30)
    cold = {tuple(r) for r in FS.likely_pairs(asked, names, ["token_sort"], 70.0).collect()}
    got = [tuple(r) for r in hot.collect()]
    assert len(got) == len(set(got)) and wanted <= set(got) <= {tuple(r) for r in plain} == cold and wanted
    assert len(got) < 0.6 * len(plain)
    p = hot._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "FlatMapCoGroupsInArrow" in p


def test_beginnings_of_hot_brands(spark):
    """The pairs that the second stage may take are the same however few names make a beginning hot."""
    items = spark.createDataFrame([(i, f"ZETA{x} {n} MG TAB") for i, (x, n) in enumerate((x, n) for x in ("", "M", "LONG", "PLUS FORTE") for n in (5, 10))], "item_id long, name string")
    d, m = C.names(items, "name", "d"), C.names(items, "name", "m")
    score = {(r.d_name, r.m_name): S.token_sort_ratio(r.x, r.y) for r in C.pairs_of_beginnings(d, m, 74.0).join(d, "d_name").join(m, "m_name").selectExpr("d_name", "m_name", "d.normalized x", "m.normalized y").collect()}
    got = {tuple(r) for r in C.pairs_of_beginnings(d, m, 74.0, most=2).collect()}
    assert {p for p, s in score.items() if s >= 74} <= got < set(score)
