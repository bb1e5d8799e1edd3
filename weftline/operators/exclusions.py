"""What leaves a list before work begins: prevented items, finished items, reviewed items; and removals from a cart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.normalize import distinct_ignoring_case, hint_key, normalize_code, normalize_item_name, normalize_prevented_name
from weftline.operators.contained import first_contained


def without_prevented(items: DataFrame, prevented: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Items that no prevented row names.

    A prevented name blocks its items. An item with code and name is also blocked by a row that has that code alone; an
    item with a code alone by any row with that code. Three anti joins on equal keys.
    """
    keep = items.columns
    d = items.withColumns({"_code": normalize_code(F.col(code)), "_name": normalize_prevented_name(normalize_item_name(F.col(name)))})
    p = prevented.select(normalize_code(F.col("code")).alias("_code"), normalize_prevented_name(F.col("name")).alias("_name"), (F.coalesce(F.col("name"), F.lit("")) == "").alias("_alone"))
    names = p.filter("not _alone").select("_name").distinct()
    d = d.join(names, "_name", "left_anti")
    codes = p.filter("_code <> ''").groupBy(F.col("_code").alias("_blocked")).agg(F.max("_alone").alias("_only"))
    hit = (d["_code"] == codes["_blocked"]) & (codes["_only"] | (d["_name"] == "")) & (d["_code"] != "")
    return d.join(codes, hit, "left_anti").select(*keep)


def without_finished(items: DataFrame, summary: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Items that the latest summary doesn't hold, by lower-cased code and name."""
    low = lambda d, a, b: d.withColumns({"_c": F.lower(F.trim(F.coalesce(F.col(a).cast("string"), F.lit("")))), "_n": F.lower(F.trim(F.coalesce(F.col(b).cast("string"), F.lit(""))))})
    done = low(summary, "item_code", "item_name").select("_c", "_n").distinct()
    return low(items, code, name).join(done, ["_c", "_n"], "left_anti").select(*items.columns)


def with_decisions(items: DataFrame, decisions: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Items with their saved decision, if any, by hint key. decisions: code_key, name_key, and what they say."""
    k = hint_key(F.col(code), F.col(name))
    d = items.withColumns({"code_key": k["code_key"], "name_key": k["name_key"]})
    return d.join(decisions, ["code_key", "name_key"], "left")


def without_decisions(items: DataFrame, decisions: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    k = hint_key(F.col(code), F.col(name))
    d = items.withColumns({"code_key": k["code_key"], "name_key": k["name_key"]})
    return d.join(decisions.select("code_key", "name_key"), ["code_key", "name_key"], "left_anti").select(*items.columns)


def cart_rows_to_remove(cart: DataFrame, removals: DataFrame) -> DataFrame:
    """row_id, name: cart rows whose text holds the name of an item to remove, anywhere in it, with the first such name; both normalised."""
    rows = cart.select("row_id", normalize_item_name(F.col("row_text")).alias("text"))
    return first_contained(rows, removals.select(normalize_item_name(F.col("name")).alias("name")))


def removal_names(items: DataFrame, matches: DataFrame, item: str = "item_id") -> DataFrame:
    """Names under which an item may stand in the cart: its own and those of its matches, whatever their case."""
    found = matches.groupBy(item).agg(F.array_sort(F.collect_set("product_name")).alias("_names"))
    d = items.join(found, item, "left")
    return d.select(item, distinct_ignoring_case(F.concat(F.array("name"), F.coalesce("_names", F.array().cast("array<string>")))).alias("names"))
