"""Streaming twins of the series operators: the same logic on unbounded input.

Windows work on batch and streaming frames alike. Runs and cooldown are kept as state for each media
by transformWithStateInPandas; a run that is still open stays in the state until it closes, as
in the batch form without open runs. `stream_runs` takes rows as they come and needs them in order of time from batch to batch;
`ordered_runs` waits for the watermark and doesn't. State and sinks resume from their checkpoint; an upserted table counts a batch once.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(df: DataFrame, t: str = "t_us", late: str | None = None) -> DataFrame:
    """df with ts, the time as a timestamp, and a watermark if late is given."""
    out = df.withColumn("ts", F.timestamp_micros(t))
    return out.withWatermark("ts", late) if late else out


def _windowed(df: DataFrame, window, late: str | None) -> DataFrame:
    got = timed(df, late=late).groupBy("media_id", window.alias("w")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return got.select("media_id", F.unix_micros("w.start").alias("w_us"), "n", "ids")


def tumbling(df: DataFrame, size_us: int, late: str | None = None) -> DataFrame:
    return _windowed(df, F.window("ts", f"{size_us} microseconds"), late)


def sliding(df: DataFrame, size_us: int, slide_us: int, late: str | None = None) -> DataFrame:
    return _windowed(df, F.window("ts", f"{size_us} microseconds", f"{slide_us} microseconds"), late)


def sessions(df: DataFrame, gap_us: int, late: str | None = None) -> DataFrame:
    """Sessions; rows exactly one gap apart share one."""
    got = timed(df, late=late).groupBy("media_id", F.session_window("ts", f"{gap_us} microseconds").alias("w")).agg(F.count("*").alias("n"))
    return got.select("media_id", F.unix_micros("w.start").alias("s_us"), F.unix_micros("w.end").alias("e_us"), "n")


class Runs(StatefulProcessor):
    """Runs of rows with on; a run is emitted when a row without it arrives, if it has least rows.
    With wait, rows that have held for `least` samples fire, and then stay silent until t + wait."""

    def __init__(self, least: int, wait: int | None = None):
        self.least, self.wait = least, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "start long, last long, n long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        start, last, n, until = self.state.get() or (0, 0, 0, -(1 << 62))
        out = []
        for t, on in sorted((t, on) for pdf in rows for t, on in zip(pdf["t_us"].tolist(), pdf["on"].tolist())):
            if on:
                start, last, n = (t if not n else start), t, n + 1
                if self.wait is not None and n >= self.least and t > until:
                    out.append((key[0], t, t, n))
                    until = t + self.wait
            else:
                if self.wait is None and n >= self.least:
                    out.append((key[0], start, last, n))
                n = 0
        self.state.update((start, last, n, until))
        yield pd.DataFrame(out, columns=["media_id", "start", "last", "n"])

    def close(self) -> None:
        pass


def stream_runs(df: DataFrame, least: int, wait: int | None = None) -> DataFrame:
    """df: media_id, t_us, on. Runs as they close, or fired rows with a cooldown of wait."""
    return df.groupBy("media_id").transformWithStateInPandas(Runs(least, wait), "media_id long, start long, last long, n long", "Append", "None")


class OrderedRuns(StatefulProcessor):
    """Runs of rows with on, by event time: rows wait until the watermark passes them and are taken in order of time, so late rows
    within the watermark's delay stand where they belong. A run closes with the row after it, or once the watermark is `idle`
    beyond its last row, by a timer. Rows behind the watermark, which begins at the epoch, are dropped by Spark before they come here."""

    def __init__(self, least: int, idle: int):
        self.least, self.idle = least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, on boolean")
        self.run = handle.getValueState("run", "start long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        new = [(int(t), bool(on)) for pdf in rows for t, on in zip(pdf["t_us"].tolist(), pdf["on"].tolist())]
        if new:
            self.pending.appendList(new)
        yield self._taken(key, timer.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._taken(key, timerValues.getCurrentWatermarkInMs())

    def _taken(self, key, watermark_ms: int) -> pd.DataFrame:
        passed = watermark_ms * 1000
        held = sorted((r[0], r[1]) for r in self.pending.get())
        start, last, n = self.run.get() or (0, 0, 0)
        out = []

        def close() -> None:
            if n >= self.least:
                out.append((key[0], start, last, n))

        rest = [(t, on) for t, on in held if t > passed]
        for t, on in held:
            if t > passed:
                break
            if n and t - last > self.idle:
                close()
                n = 0
            if on:
                start, last, n = (t if not n else start), t, n + 1
            elif n:
                close()
                n = 0
        if n and last + self.idle < passed:
            close()
            n = 0
        self.pending.put(rest) if rest else self.pending.clear()
        self.run.update((start, last, n)) if n else self.run.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [rest[0][0]] if rest else []
        due += [last + self.idle] if n else []
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        return pd.DataFrame(out, columns=["media_id", "start", "last", "n"])

    def close(self) -> None:
        pass


def ordered_runs(df: DataFrame, least: int, idle: int, late: str) -> DataFrame:
    """df: media_id, t_us, on. Runs by event time as they close; rows may be late by `late`, and a run ends after `idle` microseconds
    without a row."""
    rows = timed(df, late=late).select("media_id", "t_us", "on", "ts")
    return rows.groupBy("media_id").transformWithStateInPandas(OrderedRuns(least, idle), "media_id long, start long, last long, n long", "Append", "EventTime")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row of largest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def put_batch(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """What an upsert does with a batch: its newest row for each key goes to a folder named by the batch, which a repeated batch
    overwrites, so that a batch counts once however often it is tried."""

    def put(batch: DataFrame, batch_id: int) -> None:
        newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return put


def upserted(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str):
    """A table of rows by key that a stream keeps up to date. `current` reads it."""
    return stream.writeStream.foreachBatch(put_batch(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: StructType) -> DataFrame:
    """The rows of an upserted table: of each key the one of largest order, of equal ones the latest batch's. A table without a
    batch yet is empty."""
    schema = copy.deepcopy(schema).add("batch", "long")
    try:
        held = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], schema)
    return newest(held, keys, [*order, "batch"]).drop("batch")


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything the stream holds now, through a memory table; for tests and backfills."""
    spark: SparkSession = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return spark.table(name)


def keep_files(stream: DataFrame, path: str, checkpoint: str):
    """A file sink that resumes from its checkpoint after a restart."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
