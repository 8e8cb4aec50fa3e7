"""What the operators of this subpackage share: tables, sizes, and streams of key groups inside a task."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import scratch, shared_dir, stored  # noqa: F401

#: White space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Shuffle partitions at most: what the driver holds of each map task's output is in proportion to them. Beyond
#: it tasks read more and go on streaming.
MOST_PARTS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below df, as the optimizer knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, mb_each: int = 16, least: int = 12) -> int:
    """Partitions for a shuffle of df's rows: in proportion to the input, at least the session's and MOST_PARTS
    at most. Frames that aren't read from files have no known size; for them the session's number holds."""
    low = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = input_bytes(df)
    return low if size >= 1 << 55 else max(low, min(MOST_PARTS, size // (mb_each << 20)))


def key_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema, n: int | None = None, least: int = 1) -> DataFrame:
    """work() on groups of equal keys (integers, not null), many groups to a task without a call for each: one group
    at a time, or whole groups of at least `least` rows together.

    Rows are dealt out by the keys and sorted; a task cuts its stream where the key changes. The
    caller bounds the size of a group."""
    dealt = df.repartition(n, *keys) if n else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
            new = np.append(True, (cols[:, 1:] != cols[:, :-1]).any(axis=0))
            new[0] = last is None or (cols[:, 0] != last).any()
            begin = 0
            for i in np.flatnonzero(new).tolist():
                if rows + i - begin >= least:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield from work(pa.Table.from_batches(held))
                    held, rows, begin = [], 0, i
            held.append(batch.slice(begin))
            rows, last = rows + batch.num_rows - begin, cols[:, -1]
        if held:
            yield from work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def bucketed(df: DataFrame, n: int, keys: list[str], what: str) -> DataFrame:
    """df as a table in the shared folder, in n buckets by keys, so that joins on them needn't shuffle it again. The catalogue
    knows it for a moment only: its entry goes, its files stay with the others of the folder."""
    spark, name = df.sparkSession, f"{re.sub(r'\W', '_', what)}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("path", scratch(spark, what)).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the table is external
    return held


def row_key(key: str = "doc_id", text: str = "text"):
    """128 bits that tell rows of other number or text apart."""
    number, body = F.col(key).cast("long"), F.col(text)
    return F.struct(F.xxhash64(number, body).alias("a"), F.xxhash64(body, F.lit(7), number).alias("b"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
