"""Sinks: review files, feedback, registry, sidecars. Overwrites go to a new path first, so that a
table is never read and replaced at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import registry, repeats
from tidemark.sources.readers import FEEDBACK, SPEC


def write_review(candidates: DataFrame, path: str) -> None:
    repeats.review(candidates).write.mode("overwrite").json(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("approve boolean, media_id long, start double, end double, type string, confidence double, cut_text string, keep_text string").json(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    """Decisions with text, appended with the time of writing."""
    rows = entries.where(F.trim("text") != "").select(F.trim("text").alias("text"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), F.coalesce("approved", F.lit(False)).alias("approved"), F.unix_micros(F.current_timestamp()).cast("double").alias("ts"))
    rows.write.mode("append").parquet(path)


def compact_feedback(spark: SparkSession, path: str, out: str, limit: int = 4000) -> DataFrame:
    """The last `limit` decisions, as a new table."""
    registry.bounded_log(spark.read.schema(FEEDBACK).parquet(path), limit, ("ts", "text")).write.mode("overwrite").parquet(out)
    return spark.read.schema(FEEDBACK).parquet(out)


def save_registry(disk: DataFrame, memory: DataFrame, out: str) -> None:
    registry.upsert(disk, memory).write.mode("overwrite").parquet(out)


def write_sidecars(rows: DataFrame, path: str, key: str = "job_id") -> None:
    """One folder of JSON for each job."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def spec_json(*columns: str):
    """An edit specification as JSON text from columns named like its fields; fields that are null are left out."""
    return F.to_json(F.struct(*columns))


def parsed_spec(text: Column) -> Column:
    """JSON text as a nested specification; fields that it lacks or that are malformed are null."""
    return F.from_json(text, SPEC)


def write_specs(specs: DataFrame, path: str, key: str = "job_id") -> None:
    """A JSON line for each job: its key and its specification, nested as the editor writes it."""
    fields = [c for c in specs.columns if c != key]
    specs.select(key, F.struct(*fields).alias("spec")).write.mode("overwrite").json(path)


def read_specs(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(key, T.StringType()), T.StructField("spec", T.StructType.fromDDL(SPEC))])).json(path)


def uncached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """What a result cache doesn't hold yet."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")
