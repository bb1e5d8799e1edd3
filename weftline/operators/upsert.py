"""Keyed tables: first or last row of each key in an explicit order, upserts, unions of unlike schemas, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.normalize import normalize_code, normalize_item_name, normalize_text, text
from weftline.operators.decide import first_of_each


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_of_each(df, keys, [F.asc(order)])


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_of_each(df, keys, [F.desc(order)])


def distinct_items(df: DataFrame, order: str, code: str = "code", name: str = "name") -> DataFrame:
    """Once by normalised code and name; rows without either go."""
    d = df.withColumns({"_code": normalize_code(F.col(code)), "_name": normalize_item_name(F.col(name))}).filter("_code <> '' or _name <> ''")
    return keep_first(d, ["_code", "_name"], order).drop("_code", "_name")


def distinct_names(df: DataFrame, order: str, code: str = "code", name: str = "name") -> DataFrame:
    """Items with a name, once by trimmed, lower-cased code and name."""
    d = df.withColumns({"_code": F.lower(F.trim(text(F.col(code)))), "_name": F.lower(F.trim(text(F.col(name))))}).filter("_name <> ''")
    return keep_first(d, ["_code", "_name"], order).drop("_code", "_name")


def distinct_products(df: DataFrame, order: str) -> DataFrame:
    """Products once by both names and the store's id, or the product's where that is blank; rows that lack names or ids go."""
    store, product = F.trim(text(F.col("store_product_id"))), F.trim(text(F.col("product_id")))
    key = F.when(store != "", F.concat(F.lit("store:"), store)).when(product != "", F.concat(F.lit("product:"), product))
    d = df.withColumns({"_en": normalize_text(F.col("name_en")), "_ar": normalize_item_name(F.col("name_ar")), "_key": key})
    return keep_first(d.filter("_key is not null and (_en <> '' or _ar <> '')"), ["_en", "_ar", "_key"], order).drop("_en", "_ar", "_key")


def distinct_export_rows(df: DataFrame, order: str) -> DataFrame:
    """Export rows once by both names and the store's id, or the product's where that is blank; all-blank rows go. `copies`: how many there were."""
    t = {c: F.trim(text(F.col(c))) for c in ("name_ar", "name_en", "store_product_id", "product_id")}
    any_ = F.concat(*t.values()) != ""
    d = df.filter(any_).withColumns({"_ar": t["name_ar"], "_en": t["name_en"], "_id": F.when(t["store_product_id"] != "", t["store_product_id"]).otherwise(t["product_id"])})
    d = d.groupBy("_ar", "_en", "_id").agg(F.min_by(F.struct(*df.columns), order).alias("r"), F.count("*").alias("copies"))
    return d.select("r.*", "copies")


def removed(scanned: DataFrame, unique: DataFrame) -> DataFrame:
    """removed: how many rows a dedup took, never below zero."""
    n = scanned.agg(F.count("*").alias("n")).unionByName(unique.agg((-F.count("*")).alias("n")))
    return n.agg(F.greatest(F.sum("n"), F.lit(0)).alias("removed"))


def removed_count(scanned: DataFrame, unique: DataFrame) -> int:
    return removed(scanned, unique).first()[0]


def upsert(rows: DataFrame, keys: list[str], seq: str, first: list[str]) -> DataFrame:
    """One row a key: columns in `first` from its first row, all others from its last. One aggregation, nothing sorted."""
    rest = [c for c in rows.columns if c not in {*keys, *first}]
    agg = [*(F.min_by(c, seq).alias(c) for c in first), *(F.max_by(c, seq).alias(c) for c in rest)]
    return rows.groupBy(*keys).agg(*agg).select(*rows.columns)


def upsert_keeping(rows: DataFrame, keys: list[str], seq: str, strong: Column) -> DataFrame:
    """The last row a key, but rows of a human's decision go before automatic ones."""
    return first_of_each(rows.withColumn("_strong", strong.cast("int")), keys, [F.desc("_strong"), F.desc(seq)]).drop("_strong")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns, by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*b.columns).subtract(b)


def add_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def remove_keys(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), keys, "left_anti")


def prepend_distinct(first: Column, rest: Column) -> Column:
    return F.array_distinct(F.concat(first, rest))


def after_row(df: DataFrame, seen: int, order: str) -> DataFrame:
    """Rows whose 0-based ordinal is not below `seen`."""
    return df.filter(F.col(order) >= seen)
