"""Registry of queries, and the stand-in tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000


def query(name: str, sql: str | None = None):
    """Registers a query, with SQL for DuckDB where there is an equivalent."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled series: a user is a media, a time is in microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("media_id"), "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


def hits(spark: SparkSession, sf_dir: str, kind: str = "error") -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind)


def spans(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """Intervals: from an event on, as many hours as its value."""
    return hits(spark, sf_dir, kind).select("event_id", "media_id", F.col("t_us").alias("start_us"), (F.col("t_us") + F.floor("value") * HOUR).alias("end_us"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media's extent: its first to its last event."""
    return events(spark, sf_dir).groupBy("media_id").agg(F.min("t_us").alias("lo_us"), F.max("t_us").alias("hi_us"))


#: The same stand-ins as common table expressions.
EV = "ev AS (SELECT event_id, user_id AS media_id, event_type, value, epoch_us(ts)::BIGINT AS t FROM events)"
IV = "iv AS (SELECT event_id, media_id, t AS s, t + floor(value)::BIGINT * 3600000000 AS e FROM ev WHERE event_type = 'view')"
CL = "cl AS (SELECT event_id, media_id, t AS s, t + floor(value)::BIGINT * 3600000000 AS e FROM ev WHERE event_type = 'click')"
BD = "bd AS (SELECT media_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY 1)"
ER = "er AS (SELECT event_id, media_id, t FROM ev WHERE event_type = 'error')"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
