"""The catalogue rows that a price favours, without meeting every row.

The bonus of a price (`scoring.price_bonus`) has few steps, each a range of the catalogue's prices around the asked one. So of the rows of a
name, sorted by price, the best for an asked price are the smallest ids of a few ranges, found by tables of ranges of doubling length: a name
that N rows bear and M prices ask for costs about N log N + M, not N * M.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocking import MOST_TASKS, task_count

#: The bonus and how far off a price may be for it (`scoring.price_bonus`), and what any other price gets.
STEPS = [(6.0, 0.0), (5.0, 0.02), (4.0, 0.05), (2.0, 0.10)]
NONE = 0.0
#: Rows and asked prices of a task, about, at most; those of one name stay together. Of fewer than the second a task is not worth starting.
ROWS_A_TASK, FEW = 200_000, 10_000
_NO = np.iinfo(np.int32).max


def known_price(price: Column) -> Column:
    """The price, or 0 for one that never brings a bonus: null, not above zero or not finite."""
    p = price.cast("double")
    return F.when((p > 0) & (p < float("inf")), p).otherwise(0.0)


def _edges(q: np.ndarray, prices: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked price the range of `prices`, sorted, that is off by `step` at most. Guessed by division, then moved by the rule itself."""
    n = len(prices)
    lo, hi = np.searchsorted(prices, q * (1 - step), "left"), np.searchsorted(prices, q / (1 - step), "right")
    at = lambda i: prices[np.clip(i, 0, max(n - 1, 0))]
    within = lambda i: np.abs(q - at(i)) / np.maximum(q, at(i)) <= step
    moves = [
        (lo, -1, lambda: (lo > 0) & within(lo - 1)),
        (lo, 1, lambda: (lo < n) & (at(lo) < q) & ~within(lo)),
        (hi, 1, lambda: (hi < n) & within(hi)),
        (hi, -1, lambda: (hi > 0) & (at(hi - 1) > q) & ~within(hi - 1)),
    ]
    for edge, by, off in moves:
        while n and (m := off()).any():
            edge[m] += by
    return lo, hi


def _merged(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Row by row the k smallest of both, each once."""
    x = np.sort(np.concatenate([a, b], axis=1), axis=1)
    x[:, 1:][x[:, 1:] == x[:, :-1]] = _NO
    return np.sort(x, axis=1)[:, :k]


def smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Of each range begin:end of the values, all different, the k smallest, upwards; filled up with `_NO`."""
    out = np.full((len(begin), k), _NO, np.int32)
    size = end - begin
    table = np.full((len(values), k), _NO, np.int32)
    table[:, :1] = values[:, None]
    length = 1
    while length <= size.max(initial=0):
        own = np.flatnonzero((size >= length) & (size < 2 * length))
        out[own] = _merged(table[begin[own]], table[end[own] - length], k)
        if len(table) <= length:
            break
        table = _merged(table[:-length], table[length:], k)
        length *= 2
    return out


def first_rows(codes: np.ndarray, asked: np.ndarray, row_codes: np.ndarray, row_prices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in asked, place in rows, bonus): for each asked name and price the k first rows of that name by bonus, highest first, and place."""
    prices = np.unique(row_prices[row_prices > 0])
    width = len(prices) + 1
    keys = row_codes.astype(np.int64) * width + np.where(row_prices > 0, np.searchsorted(prices, row_prices) + 1, 0)
    order = np.argsort(keys, kind="stable")
    keys, values, base = keys[order], order.astype(np.int32), codes.astype(np.int64) * width
    different, which = np.unique(asked, return_inverse=True)
    begin, end, parts = None, None, []
    for _, step in STEPS:
        lo, hi = _edges(np.where(different > 0, different, 1.0), prices, step)
        lo, hi = (np.where(different > 0, e, 0)[which] for e in (lo, hi))
        a, b = (np.searchsorted(keys, base + 1 + e) for e in (lo, hi))
        parts.append([(a, b)] if begin is None else [(a, begin), (end, b)])
        begin, end = a, b
    parts.append([(np.searchsorted(keys, base), begin), (end, np.searchsorted(keys, base + width))])
    flat = [r for own in parts for r in own]
    found = np.split(smallest(values, np.concatenate([a for a, _ in flat]), np.concatenate([b for _, b in flat]), k), len(flat))
    steps = [found[0], *(_merged(found[2 * i - 1], found[2 * i], k) for i in range(1, len(parts)))]
    rows, bonus = np.concatenate(steps, axis=1), np.repeat([*(b for b, _ in STEPS), NONE], k)
    first = np.argsort(rows == _NO, axis=1, kind="stable")[:, :k]
    rows, bonus = np.take_along_axis(rows, first, axis=1), bonus[first]
    place, nth = np.nonzero(rows != _NO)
    return place, rows[place, nth], bonus[place, nth]


def _looked_up(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("row_id")
        names = pa.chunked_array([*left.column("m_name").chunks, *right.column("m_name").chunks], pa.string()).combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        own, theirs, bonus = first_rows(codes[: len(left)], left.column("d_price").to_numpy(), codes[len(left) :], right.column("m_price").to_numpy(), k)
        asked, rows = left.select(["m_name", "d_price"]).take(pa.array(own)), right.drop_columns(["_part", "m_name", "m_price"]).take(pa.array(theirs))
        return pa.table([*asked.columns, pa.array(bonus), *rows.columns], names=[*asked.column_names, "bonus", *rows.column_names])

    return run


def first_of_each_price(rows: DataFrame, k: int) -> DataFrame:
    """Of rows that agree in m_name and m_price the k first: no more are ever asked for."""
    nth = F.row_number().over(Window.partitionBy("m_name", "m_price").orderBy("row_id"))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")


def best_rows(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """m_name, d_price, bonus, row_id and other columns of rows: of each asked name and price the k rows of that name with the highest bonus, ties by row_id.

    asked: m_name, d_price, each pair once; rows: m_name, m_price, row_id (long), ...; prices as `known_price` gives them. Both are counted, so
    they should be cheap to make again. All rows are moved, so `first_of_each_price` goes before where many agree in name and price. A task
    holds the rows of whole names.
    """
    count = asked.count() + rows.count()
    n = min(max(-(-count // ROWS_A_TASK), task_count(rows.sparkSession, count, FEW)), MOST_TASKS)
    part = F.pmod(F.xxhash64("m_name"), F.lit(n)).cast("int").alias("_part")
    x, y = (d.select(part, *c).repartition(n, "_part") for d, c in ((asked, ["m_name", "d_price"]), (rows, rows.columns)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("m_name", "m_price"))
    return x.groupBy("_part").cogroup(y.groupBy("_part")).applyInArrow(_looked_up(k), f"m_name string, d_price double, bonus double, {kept}")
