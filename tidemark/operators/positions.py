"""Dense positions of rows within their keys, and joins on them, without gathering a key in one task.

Rows are dealt out by ranges of key and order, sorted, and stored; a row's place in its partition is the low part of its id. Partitions'
counts of a key are a small table, whose prefix sums give what lies before a partition. So a key of any length spans as many partitions as
it needs.

Defined results: rows that are equal in key and order stand in any order among themselves, unless the order names a tie-breaker; null keys are
keys like others and meet each other; an empty table gives no rows; with a shorter partner the rest of a key is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import stored


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """df with the position of each row within its keys, from 0."""
    sort = [*keys, *order]
    placed = stored(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_key": F.struct(*keys)})
    held = placed.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    bases = held.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    on = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))
    return placed.join(bases, on).select(*df.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias(name))


def zipped(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: Sequence[str], order_b: Sequence[str], prefix: str = "b_") -> DataFrame:
    """The rows of a and b at equal positions of a key, as long as both last: pos, a's columns, and b's with a prefix."""
    left, right = positions(a, keys, order_a), positions(b, keys, order_b, "_pos")
    right = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in b.columns], "_pos")
    on = F.col("pos") == F.col("_pos")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return left.join(right, on).select("pos", *a.columns, *[f"{prefix}{c}" for c in b.columns if c not in keys])
