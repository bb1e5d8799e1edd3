"""Streaming forms of a run's state: the last trace row of each item, rows that are new, failures that disable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.providers import LONG_WAIT


def last_states(events: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """The last values of each key: the same plan over a table and over a stream (update or complete mode)."""
    return events.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.max_by(v, seq).alias(v) for v in values))


def new_files(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Rows of Parquet files as they come; the checkpoint knows those that were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, ts: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts a window and value; rows later than the watermark are dropped with the state they would need."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), value).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), value, "n")


def disabled_stream(attempts: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """Combinations that have failed `limit` times, once each, when they do, for good. Needs columns keys and ok."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, told = state.get if state.exists else (0, False)
        failures += sum(int((~b["ok"]).sum()) for b in batches)
        now = failures >= limit
        state.update((failures, bool(told or now)))
        if now and not told:
            yield pd.DataFrame([[*key, failures]], columns=[*keys, "failures"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in attempts.select(*keys).schema) + ", failures long"
    return attempts.groupBy(*keys).applyInPandasWithState(run, kinds, "failures long, told boolean", "append", GroupStateTimeout.NoTimeout)


class Failures(StatefulProcessor):
    """Of one combination: failures that the watermark has not reached, and the last `limit` times before it at which it failed.

    A timer stands at each time that waits, and one where the last failure is forgotten; then nothing is left of the combination.
    """

    def __init__(self, names: list[str], limit: int, memory: int, wait: int):
        self.names, self.limit, self.memory, self.wait = names, limit, memory, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "asked array<long>")
        self.last = handle.getValueState("last", "at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for b in rows:
            failed = b[(b["ok"] == False) & b["at"].notna()]  # noqa: E712  null is no failure
            for at, asked in failed.groupby("at")["asked"]:
                at, own = int(at), [int(x) for x in asked]
                before = list(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), (before + own,))
                self.handle.registerTimer(at // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()  # nothing before it is still to come, so all that waits before it is worked off in order
        last = list(self.last.get()[0]) if self.last.exists() else []
        out = []
        for at in sorted(a for (a,) in list(self.waiting.keys()) if a // 1000 < now):
            asked = self.waiting.getValue((at,))[0]
            self.waiting.removeKey((at,))
            last = [x for x in [*last, *[at] * len(asked)] if x > at - self.memory * 1_000_000][-self.limit :]
            wait = max([w for w in asked if w >= LONG_WAIT] + [self.wait] * (len(last) >= self.limit), default=0)
            if wait:
                out.append([*key, at, len(last), at + wait * 1_000_000])
        forgotten = last[-1] // 1000 + self.memory * 1000 + 1 if last else 0
        if forgotten > now:
            self.last.update((last,))
            self.handle.registerTimer(forgotten)
        else:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def timed_out_stream(attempts: DataFrame, keys: list[str], ts: str, limit: int = 2, memory: int = 600, wait: int = 300, late: str = "10 minutes") -> DataFrame:
    """keys, at, failures, until: each time at which combinations fail for the `limit`-th time in `memory` seconds, or are told to wait a minute or more.

    attempts: keys, ts, ok, retry_after (seconds; null: none). What `providers.timed_out` gives of a table, row by row as the watermark, `late` behind,
    passes them; rows that come later than it are dropped. State: failures that wait for the watermark and at most `limit` times; it is empty
    `memory` seconds after the last failure. Null times are nobody's. Keeps its state in RocksDB, which the session is told.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    asked = F.coalesce(F.col("retry_after").cast("long"), F.lit(0))
    kind, of = attempts.schema[ts].dataType, attempts.select(*keys).schema
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")  # one text: null keys among others are mistaken on their way to Python
    d = attempts.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    d = d.select(key, ts, F.col("ok").cast("boolean").alias("ok"), F.unix_micros(ts).alias("at"), asked.alias("asked"))
    names = ["key", "at", "failures", "until"]
    out = d.groupBy("key").transformWithStateInPandas(Failures(names, limit, memory, wait), "key string, at long, failures long, until long", "Append", "EventTime")
    return out.select(F.from_json("key", of).alias("k"), "at", "failures", "until").select("k.*", *(F.timestamp_micros(c).cast(kind).alias(c) if c != "failures" else c for c in names[1:]))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its table, for tests and batch comparison."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
