"""Text tables, appends of changing schemas, worker parts, snapshots of decisions, JSON payloads, newest files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.normalize import blank_to_null, text
from weftline.operators import running
from weftline.operators.allocate import enrich_company
from weftline.operators.upsert import keep_last, union_all, upsert
from weftline.shared import Scratch

# Under which keys a service's answer has its rows.
ROW_KEYS = "data items products results rows content records".split()
EXPORT_FIELDS = "name_ar name_en product_id store_product_id company sale_price retail_price discount available_quantity products_count".split()


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.option("encoding", "UTF-8").text(path).first()
    return [c.strip().strip('"') for c in first[0].lstrip("﻿").split(sep)] if first else []


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV of one schema, all columns text, named by its first line without its byte order mark."""
    names = _header(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)


def blanks_for_nulls(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def write_text_table(df: DataFrame, path: str, sep: str = ",", private: bool = False, mode: str = "overwrite") -> None:
    """CSV; columns that begin with an underscore stay out unless they are asked for."""
    d = df if private else df.select(*(c for c in df.columns if not c.startswith("_")))
    d.select(*(text(F.col(f"`{c}`")).alias(c) for c in d.columns)).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def export_rows(products: DataFrame) -> DataFrame:
    """Products in the export's fixed fields, blanks for what they lack."""
    return products.select(*(text(F.col(c)).alias(c) if c in products.columns else F.lit("").alias(c) for c in EXPORT_FIELDS))


def append_evolving(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Appends Parquet under whatever columns df has; readers merge the schemas, old files stay as they are."""
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def merge_worker_parts(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Rows of workers' files under the union of their columns, with the worker's number from the file's name and the row's place."""
    parts = []
    for p in paths:
        d = read_text_table(spark, p, sep)
        worker = F.regexp_extract(F.input_file_name(), r"(\d+)(?:\.[a-z]+)?/?[^/0-9]*$", 1).try_cast("int")
        parts.append(d.withColumns({"worker": worker, "place": F.monotonically_increasing_id()}))
    return union_all(parts)


def merge_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, start of text files, each whole, in the order of their paths: start is how many bytes of the merged text stand before it.

    Files are dealt to ranges of paths, and lengths sum over those; a file must fit a task, all of them need not. Empty files have no row.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    rows = running.ranged(files.withColumn("_all", F.lit(0)), ["_all"], [F.col("path")], Scratch(spark))
    return running.before(rows, ["_all"], {"start": F.octet_length("text").cast("long")}).select("path", "text", "start")


def write_merged(merged: DataFrame, path: str) -> None:
    """Parts whose names rise with `start`; one after another they are the merged text. A text that doesn't end its last line has it ended."""
    d = merged.filter("text <> ''").repartitionByRange("start").sortWithinPartitions("start")
    d.select(F.regexp_replace("text", r"\n\z", "")).write.text(path)


def newest_by(files: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, path, modificationTime) the path last written of each key, of those written at one time the last."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def newest_file(spark: SparkSession, paths: list[str]) -> str | None:
    """The last written file under several layouts."""
    files = reduce(lambda a, b: a.unionByName(b), (spark.read.format("binaryFile").load(p).select("path", "modificationTime") for p in paths))
    return newest_by(files, []).first()[0]


def newest_within(files: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Of (path, modificationTime): the newest not older than so many seconds."""
    d = files.filter(F.unix_timestamp(now) - F.unix_timestamp("modificationTime") <= seconds)
    return d.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).filter("path is not null")


def last_candidates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of review candidates: the last line of each item, files in the order of their names.

    Spark deals files to tasks by their size, so a line's place is its file, where its split begins there, and its rank among a task's rows."""
    place = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    d = spark.read.json(path).withColumn("_place", place)
    key = F.concat(text(F.col("item_code")), F.lit("::"), text(F.col("item_name")))
    return keep_last(d.withColumn("item_key", key), ["item_key"], "_place").drop("_place")


def accepted_hints(decisions: DataFrame, seq: str = "seq") -> DataFrame:
    """Approved decisions that name a product, the last of each key."""
    d = decisions.filter("approved = 1").withColumn("correct_store_product_id", blank_to_null(F.col("correct_store_product_id")))
    return keep_last(d.filter("correct_store_product_id is not null"), ["item_code_key", "item_name_key"], seq)


def save_decisions(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The decision table with rows put in: the newest of each key, but its first names and time of creation."""
    return upsert(table.unionByName(rows, allowMissingColumns=True), ["item_code_key", "item_name_key"], "seq", ["item_code", "item_name", "created_at"])


def bucketed(decisions: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The decision table, written to path by buckets of its keys, sorted, and known to the catalogue by name.

    A look-up (`exclusions.with_decisions`) then shuffles its items into as many buckets and joins each with its file: the store itself,
    which is large and looked up at each run, is neither shuffled nor sorted again. buckets should not be fewer than the session's shuffle partitions,
    else Spark deals both sides anew.
    """
    keys = ["code_key", "name_key"]
    d = decisions.repartition(buckets, *keys)  # a file a bucket
    d.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name)
    return decisions.sparkSession.table(name)


def _listed(payload: Column) -> Column:
    """The first non-empty list of a JSON answer, under the known keys at the top or one object down, or the answer itself."""
    paths = [k for k in ROW_KEYS] + [f"{a}.{b}" for a in ROW_KEYS for b in ROW_KEYS]
    lists = [F.from_json(F.get_json_object(payload, f"$.{p}"), "array<string>") for p in paths]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.from_json(payload, "array<string>"))


def payload_rows(df: DataFrame, payload: str) -> DataFrame:
    """Rows of JSON answers: the first non-empty list under the known keys, at the top or one object down; those with a name."""
    d = df.withColumn("_rows", _listed(F.col(payload))).select(*df.columns, F.posexplode("_rows").alias("row_index", "row"))
    g = lambda k: blank_to_null(F.get_json_object("row", f"$.{k}"))
    d = d.withColumns({"name_ar": g("productName"), "name_en": F.coalesce(g("productNameEn"), g("productNameEnFallback")), "product_id": g("productId"), "store_product_id": g("storeProductId"), "company": enrich_company(F.col("row"))})
    d = d.withColumns({"sale_price": g("salePrice"), "retail_price": F.coalesce(g("retailPrice"), g("salePrice")), "available_quantity": g("availableQuantity")})
    return d.filter("name_ar is not null or name_en is not null")


def snapshot_json(columns: list[str]) -> Column:
    """A row as JSON, its keys in order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def query_fan_out(spark: SparkSession) -> DataFrame:
    """query_ord, query: nothing, A to Z, and the Arabic letters."""
    letters = ["", *map(chr, range(65, 91)), *"ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئى"]
    return spark.createDataFrame(list(enumerate(letters)), "query_ord int, query string")


def found_by_queries(products: DataFrame, name: str) -> DataFrame:
    """products a row for each query of the fan-out that finds them: the empty one, and the letters that words of their names begin with."""
    begins = F.transform(F.split(F.upper(F.coalesce(F.col(name), F.lit(""))), " "), lambda w: F.left(w, F.lit(1)))
    keyed = products.withColumn("query", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), begins))))
    return keyed.join(F.broadcast(query_fan_out(products.sparkSession)), "query")  # 62 rows
