"""The rows that a price favours, against every row; and that the cascade never meets every row that bears a name."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_copies import nodes
from weftline.operators import cascade as C
from weftline.operators import priced as P
from weftline.operators.scoring import price_bonus


@pytest.mark.parametrize(("k", "rows_a_task"), [(1, 200_000), (5, 40)])
def test_best_rows_equal_every_row(spark, monkeypatch, k, rows_a_task):
    monkeypatch.setattr(P, "ROWS_A_TASK", rows_a_task)
    r = random.Random(k)
    price = lambda: r.choice([None, 0.0, -1.0, float("nan"), float("inf"), 100.0, 98.0, 95.0, 90.0, 100 / 0.98, 100 / 0.95, 100 / 0.9, round(r.uniform(80, 125), 1), r.uniform(1, 1000)])
    rows = spark.createDataFrame([(f"n{r.randrange(4)}", price(), i) for i in range(300)], "m_name string, price double, row_id long")
    asked = spark.createDataFrame([(f"n{r.randrange(5)}", price()) for _ in range(120)], "m_name string, asked double")
    bonus = price_bonus(F.col("asked"), F.col("price"))
    every = asked.join(rows, "m_name").select("m_name", P.known_price(F.col("asked")).alias("d_price"), bonus.alias("bonus"), "row_id").distinct().collect()
    want: dict = {}
    for x in sorted(every, key=lambda x: (-x.bonus, x.row_id)):
        want.setdefault((x.m_name, x.d_price), []).append((x.bonus, x.row_id))
    rows = rows.select("m_name", P.known_price(F.col("price")).alias("m_price"), "row_id", F.concat(F.lit("s"), "row_id").alias("store"))
    asked = asked.select("m_name", P.known_price(F.col("asked")).alias("d_price")).distinct()
    got: dict = {}
    for x in P.best_rows(asked, rows, k).collect():
        assert x.store == f"s{x.row_id}"
        got.setdefault((x.m_name, x.d_price), []).append((x.bonus, x.row_id))
    assert {p: sorted(v, key=lambda x: (-x[0], x[1])) for p, v in got.items()} == {p: v[:k] for p, v in want.items()}


def most_joined(monkeypatch, run):
    """The result of `run`, and the most rows that a join gave in any of its steps."""
    seen, real = [0], C.Scratch.save

    def joined(df):
        rows = df.collect()
        joins = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
        seen.extend(n.metrics().apply("numOutputRows").value() for n in joins)
        return rows

    monkeypatch.setattr(C.Scratch, "save", lambda self, df, name: joined(df) is None or real(self, df, name))
    return joined(run()), max(seen)


COPIES = 150


@pytest.mark.parametrize("in_turn", [False, True])
def test_rows_of_a_name_are_not_all_met(spark, monkeypatch, in_turn):
    """150 items and 150 rows of one name, each with its own price: 22,500 pairs when each item met each row."""
    items = spark.range(COPIES).select(F.col("id").alias("item_id"), F.lit("PANADOL 500 MG 24 TAB").alias("name"), (F.col("id") + 100.0).alias("price"))
    rows = spark.range(COPIES).select(F.col("id").alias("row_id"), F.lit("PANADOL 500 MG 24 TABLETS").alias("name"), (F.col("id") + 99.5).alias("price"))
    got, joined = most_joined(monkeypatch, lambda: C.cascade(items, rows, in_turn=in_turn))
    assert joined <= 2 * COPIES
    near = lambda a: [r for r in range(COPIES) if abs(a + 100.0 - (r + 99.5)) / max(a + 100.0, r + 99.5) <= 0.02]
    assert {r.item_id: r.row_id for r in got} == {a: min(near(a)) for a in range(COPIES)}


def test_item_that_has_two_names(spark):
    """The earliest stage of any of an item's names holds, in one row; without a match each of its rows says why."""
    items = spark.createDataFrame([(1, "PANADLO 500 MG 24 TAB", 1.0), (1, "PANADOL 500 MG 24 TAB", 1.0), (2, "XY", 1.0), (2, "QQQQ", None)], "item_id long, name string, price double")
    rows = spark.createDataFrame([(7, "PANADOL 500 MG 24 TAB", 1.0)], "row_id long, name string, price double")
    got = sorted((r.item_id, r.row_id, r.method) for r in C.cascade(items, rows).collect())
    assert got == [(1, 7, "component_index"), (2, None, "no_match"), (2, None, "too_short")]


def test_candidates_of_a_name_are_ordered_once(spark, monkeypatch):
    """150 items and 150 rows of one name: 22,500 pairs were joined and sorted; now the last join alone makes the rows that are asked for."""
    items = spark.range(COPIES).select(F.col("id").alias("item_id"), F.lit("PANADOL 500 MG 24 TAB").alias("name"), (F.col("id") + 100.0).alias("price"))
    rows = spark.range(COPIES).select(F.col("id").alias("row_id"), F.lit("PANADOL 500 MG 24 TABLETS").alias("name"), (F.col("id") + 99.5).alias("price"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("store_product_id"))
    seen, real = [0], C.Scratch.save

    def save(self, df, name):
        df.collect()
        seen.extend(n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName())
        return real(self, df, name)

    monkeypatch.setattr(C.Scratch, "save", save)
    df = C.search_candidates(items, rows)
    got = df.collect()
    assert max(seen) <= 2 * C.SEARCH_LIMIT * COPIES
    assert all(n.nodeName() != "Window" for n in nodes(df._jdf.queryExecution().executedPlan()))  # nothing is ordered after items are met
    for item in range(COPIES):
        own = sorted((r.position, r.store_product_id or "", r.row_id, r.score) for r in got if r.item_id == item)
        assert [p for p, *_ in own] == list(range(1, 41)) and len({s for _, s, *_ in own}) == 40
        off = lambda r, item=item: abs(item + 100.0 - (r + 99.5)) / max(item + 100.0, r + 99.5)
        step = {r: next((i for i, x in enumerate((0.02, 0.05, 0.1)) if off(r) <= x), 3) for r in range(COPIES)}
        first = sorted(range(COPIES), key=lambda r: (step[r], r))[: C.SEARCH_LIMIT]
        assert [r for _, _, r, _ in own] == first + [r for r in range(40) if r not in {x % 40 for x in first}]
