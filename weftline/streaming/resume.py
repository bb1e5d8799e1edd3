"""Runs that stop anywhere and go on: each batch has its effect once.

A batch is written to a folder of its own, or many batches to one, and then named in the manifest, a file for each append that is moved into place whole. A batch
that is named there has been done, so a replayed one changes nothing; data that nothing names, left by a batch that was stopped, is nobody's.
One run at a time writes to a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.upsert import keep_last
from weftline.shared import file_system

_MANIFEST = "batch long, folder string, rows long"
_BATCH = "_batch"


def done(spark: SparkSession, table: str, batch: int) -> bool:
    p, fs = file_system(spark, f"{table}/manifest/batch-{batch:012d}.json")
    if fs.exists(p):
        return True
    many, _ = file_system(spark, f"{table}/manifest/batches-*.json")
    return bool(fs.globStatus(many)) and not progress(spark, table).filter(F.col("batch") == batch).isEmpty()


def _all_named(spark: SparkSession, table: str, name: str, batches: Iterable[tuple[int, str, int]]) -> None:
    """Puts batches (batch, folder, rows) into the manifest, all at once: a hidden file first, then moved to its name."""
    hidden, fs = file_system(spark, f"{table}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write("".join(f'{{"batch": {batch}, "folder": "{folder}", "rows": {rows}}}\n' for batch, folder, rows in batches).encode())
    finally:
        out.close()
    to, _ = file_system(spark, f"{table}/manifest/{name}.json")
    if not fs.rename(hidden, to):
        raise RuntimeError(f"{name} could not be named in {table}")


def _named(spark: SparkSession, table: str, batch: int, folder: str) -> None:
    """Puts one batch, whose rows lie in folder, into the manifest."""
    _all_named(spark, table, f"batch-{batch:012d}", [(batch, folder, spark.read.parquet(f"{table}/{folder}").count())])


def append_once(rows: DataFrame, table: str, batch: int) -> bool:
    """Adds the batch to table, unless that has been done. True if it was added now."""
    spark = rows.sparkSession
    if done(spark, table, batch):
        return False
    folder = f"data/{batch:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{folder}")
    _named(spark, table, batch, folder)
    return True


def append_many_once(rows: DataFrame, table: str, batch: str) -> None:
    """Adds all batches of rows to table that have not been added, in one pass over rows. batch: the column, a long, that says of each row which; without it a row is nobody's.

    They lie together in a folder, and one file of the manifest names all of them, so that all are done at once or none is.
    """
    spark = rows.sparkSession
    known = progress(spark, table).select(F.col("batch").alias(_BATCH))
    fresh = rows.filter(F.col(batch).isNotNull()).withColumnRenamed(batch, _BATCH).join(known, _BATCH, "left_anti")
    own = uuid.uuid4().hex
    fresh.write.parquet(f"{table}/many/{own}")
    sizes = spark.read.schema(fresh.schema).parquet(f"{table}/many/{own}").groupBy(_BATCH).agg(F.count("*").alias("rows")).collect()  # a row a batch
    if sizes:
        _all_named(spark, table, f"batches-{own}", ((r[_BATCH], f"many/{own}", r["rows"]) for r in sizes))


def progress(spark: SparkSession, table: str) -> DataFrame:
    """batch, folder, rows: what has been done, a row a batch; of a table that is not there yet, none."""
    p, fs = file_system(spark, f"{table}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{table}/manifest") if fs.exists(p) else spark.createDataFrame([], _MANIFEST)


def read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All rows of batches that are done, with `batch`."""
    folders = [r["folder"] for r in progress(spark, table).select("folder").distinct().collect()]  # a row an append
    many = [f"{table}/{f}" for f in folders if f.startswith("many/")]
    single = [f"{table}/{f}" for f in folders if not f.startswith("many/")]
    out = []
    if single:
        d = spark.read.schema(schema).parquet(*single)
        out.append(d.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/data/(\d+)-[0-9a-f]+/", 1).cast("long")))
    if many:
        out.append(spark.read.schema(f"{schema}, {_BATCH} long").parquet(*many).withColumnRenamed(_BATCH, "batch"))
    if not out:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return reduce(DataFrame.unionByName, out)


def latest(spark: SparkSession, table: str, schema: str, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key, whatever batch brought it."""
    return keep_last(read(spark, table, schema).drop("batch"), keys, seq)


def run(stream: DataFrame, table: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Adds the batches of a stream to table, each once, until all that is there has been read. then: called when a batch is done."""

    def each(rows: DataFrame, batch: int) -> None:
        append_once(rows, table, batch)
        if then:
            then(batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
