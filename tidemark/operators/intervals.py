"""Interval algebra over integer microseconds, by media.

Intervals are half-open rows [start_us, end_us). Merging, complement and subtraction are running
maxima over sorted rows; joins on time are equi-joins on a time bucket with the range as a residual
condition, so that Spark hashes them instead of comparing all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def us(seconds: Column) -> Column:
    """Seconds as microseconds, half up."""
    return F.round(seconds * SECOND).cast("long")


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str, slack_us: int, strict: bool) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = before + F.lit(slack_us)
    fresh = before.isNull() | (F.col(start) >= reach if strict else F.col(start) > reach)
    marked = df.select(*keys, start, end, fresh.cast("long").alias("_new"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("media_id",), start: str = "start_us", end: str = "end_us", slack_us: int = 0, strict: bool = False, chunk_us: int | None = None) -> DataFrame:
    """Islands of intervals. A row joins the island before it if it starts no later than the
    island's end plus slack (before it, if strict). With chunk_us a first pass merges within chunks of
    time, so the rows of one busy media are reduced in many tasks before they meet."""
    if chunk_us:
        cut = df.withColumn("_chunk", F.floor(F.col(start) / F.lit(chunk_us)))
        df = _islands(cut, [*keys, "_chunk"], start, end, slack_us, strict).drop("_chunk")
    return _islands(df, keys, start, end, slack_us, strict)


def pad(df: DataFrame, before_us: int, after_us: int, low: Column | None = None, high: Column | None = None, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Intervals widened at both ends and clipped to low and high."""
    s, e = F.col(start) - F.lit(before_us), F.col(end) + F.lit(after_us)
    return df.withColumns({start: F.greatest(s, low) if low is not None else s, end: F.least(e, high) if high is not None else e})


def longer(df: DataFrame, min_us: int | None = None, max_us: int | None = None, inclusive: bool = False, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Rows longer than min_us (or as long, if inclusive) and no longer than max_us."""
    n = F.col(end) - F.col(start)
    if min_us is not None:
        df = df.where(n >= min_us if inclusive else n > min_us)
    return df if max_us is None else df.where(n <= max_us)


def speech_keep(spans: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("media_id",), min_silence_us: int = 1_500_000, pad_us: int = 300_000, min_len_us: int = 100_000) -> DataFrame:
    """Keep ranges around speech: spans closer than the silence (strictly) are one, padded, clipped
    to [0, dur_us], merged where they touch, and kept if longer than min_len_us."""
    islands = merge_intervals(spans, keys, slack_us=min_silence_us, strict=True)
    clipped = pad(islands.join(bounds, list(keys)), pad_us, pad_us, F.lit(0).cast("long"), F.col("dur_us"))
    return longer(merge_intervals(clipped.select(*keys, "start_us", "end_us"), keys), min_len_us)


def complement(df: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("media_id",), min_len_us: int = 0, inclusive: bool = False) -> DataFrame:
    """Gaps of the rows within bounds (keys, lo_us, hi_us), longer than min_len_us. Rows outside the
    bounds are dropped first, so no gap reaches beyond them. Every bound gives a row if it has no cut."""
    cuts = df.join(bounds, list(keys)).where("start_us < hi_us AND end_us > lo_us").select(*keys, F.greatest("start_us", "lo_us").alias("start_us"), F.least("end_us", "hi_us").alias("end_us"), "lo_us")
    ends = bounds.select(*keys, F.col("hi_us").alias("start_us"), F.col("hi_us").alias("end_us"), "lo_us")
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    gaps = cuts.unionByName(ends).select(*keys, F.coalesce(F.max("end_us").over(w), F.col("lo_us")).alias("_s"), F.col("start_us").alias("end_us"))
    return longer(gaps.withColumnRenamed("_s", "start_us").select(*keys, "start_us", "end_us").where("end_us > start_us"), min_len_us, inclusive=inclusive)


def _bucketed(df: DataFrame, start: str, end: str, bucket_us: int) -> DataFrame:
    b = lambda c: F.floor(F.col(c) / F.lit(bucket_us)).cast("long")
    return df.withColumn("_bucket", F.explode(F.sequence(b(start), F.greatest(b(start), b(end)))))


def point_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("media_id",), t: str = "t_us", bucket_us: int = 3600 * SECOND, how: str = "inner", closed: bool = True) -> DataFrame:
    """Points with the intervals that hold them: start <= t <= end, or t < end if not closed. how: inner,
    left, left_semi or left_anti."""
    right = _bucketed(intervals, "start_us", "end_us", bucket_us)
    left = points.withColumn("_bucket", F.floor(F.col(t) / F.lit(bucket_us)).cast("long"))
    p, i = left.alias("p"), right.alias("i")
    same = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bucket"]]
    inside = (F.col(f"p.{t}") >= F.col("i.start_us")) & ((F.col(f"p.{t}") <= F.col("i.end_us")) if closed else (F.col(f"p.{t}") < F.col("i.end_us")))
    cond = inside
    for c in same:
        cond = c & cond
    joined = p.join(i, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("media_id",), bucket_us: int = 3600 * SECOND) -> DataFrame:
    """Pairs of overlapping intervals (a.end > b.start and a.start < b.end), b's columns prefixed
    b_. A pair that shares several buckets is kept in the first of them."""
    left, right = _bucketed(a, "start_us", "end_us", bucket_us).alias("x"), _bucketed(b, "start_us", "end_us", bucket_us).alias("y")
    cond = (F.col("x.end_us") > F.col("y.start_us")) & (F.col("x.start_us") < F.col("y.end_us"))
    cond &= F.col("x._bucket") == F.greatest(F.floor(F.col("x.start_us") / F.lit(bucket_us)), F.floor(F.col("y.start_us") / F.lit(bucket_us)))
    for k in [*keys, "_bucket"]:
        cond = (F.col(f"x.{k}") == F.col(f"y.{k}")) & cond
    return left.join(right, cond).select(*[F.col(f"x.{c}") for c in a.columns], *[F.col(f"y.{c}").alias(f"b_{c}") for c in b.columns if c not in keys])


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("media_id",), min_len_us: int = 50_000, bucket_us: int = 3600 * SECOND) -> DataFrame:
    """Each interval of a without those of b; pieces longer than min_len_us. Equal rows of a count once."""
    keep = a.select(*keys, "start_us", "end_us").distinct()
    own = [*keys, "lo_us", "hi_us"]
    bounds = keep.select(*keys, F.col("start_us").alias("lo_us"), F.col("end_us").alias("hi_us"))
    pairs = overlap_join(keep, b.select(*keys, "start_us", "end_us"), keys, bucket_us)
    cuts = pairs.select(*keys, F.col("start_us").alias("lo_us"), F.col("end_us").alias("hi_us"), F.greatest("start_us", "b_start_us").alias("start_us"), F.least("end_us", "b_end_us").alias("end_us"))
    ends = bounds.select(*own, F.col("hi_us").alias("start_us"), F.col("hi_us").alias("end_us"))
    w = Window.partitionBy(*own).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    gaps = cuts.unionByName(ends).select(*keys, F.coalesce(F.max("end_us").over(w), F.col("lo_us")).alias("_s"), F.col("start_us").alias("end_us"))
    return longer(gaps.withColumnRenamed("_s", "start_us").select(*keys, "start_us", "end_us"), min_len_us)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("media_id",), min_len_us: int = 20_000, bucket_us: int = 3600 * SECOND, relative: bool = False) -> DataFrame:
    """Overlaps longer than min_len_us; relative to the start of a's interval if asked for."""
    pairs = overlap_join(a, b, keys, bucket_us)
    base = F.col("start_us") if relative else F.lit(0).cast("long")
    cut = pairs.withColumns({"_s": F.greatest("start_us", "b_start_us"), "_e": F.least("end_us", "b_end_us")}).where(F.col("_e") - F.col("_s") > min_len_us)
    return cut.select(*keys, (F.col("_s") - base).alias("start_us"), (F.col("_e") - base).alias("end_us"))


def tile(df: DataFrame, keys: Sequence[str] = ("media_id",), max_gap_us: int = 2 * SECOND) -> DataFrame:
    """Small holes closed: an end moves to the next start if that is later by at most max_gap_us."""
    nxt = F.lead("start_us").over(Window.partitionBy(*keys).orderBy("start_us", "end_us"))
    hole = nxt - F.col("end_us")
    return df.withColumn("end_us", F.when((hole > 0) & (hole <= max_gap_us), nxt).otherwise(F.col("end_us")))


def rebase(df: DataFrame, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """out_us: where each kept interval begins once they follow each other; seg_no from 0."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.sum(F.col("end_us") - F.col("start_us")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"seg_no": F.row_number().over(w) - 1, "out_us": F.coalesce(before, F.lit(0).cast("long"))})


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, value: Sequence[str], forward: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """Each left row with the values of the last right row at or before its time (or the first at or
    after, if forward): both sides in one sorted stream, no pairs. Of right rows of equal times the
    first by `then`, columns of theirs, counts."""
    cols = [c for c in left.columns if c not in (*keys, t)]
    both = left.select(*keys, t, F.lit(1 if not forward else 0).alias("_side"), F.lit(True).alias("_left"), F.struct(*cols).alias("_l"), F.lit(None).cast(f"struct<{','.join(f'`{v}`:{right.schema[v].dataType.simpleString()}' for v in value)}>").alias("_r"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_then{i}") for i, c in enumerate(then)])
    other = right.select(*keys, t, F.lit(0 if not forward else 1).alias("_side"), F.lit(False).alias("_left"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.struct(*value).alias("_r"), *[F.col(c).alias(f"_then{i}") for i, c in enumerate(then)])
    w = Window.partitionBy(*keys).orderBy(t, "_side", *[F.col(f"_then{i}") if forward else F.col(f"_then{i}").desc() for i in range(len(then))])
    found = F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.unionByName(other).withColumn("_f", found).where("_left").select(*keys, t, *[F.col(f"_l.{c}") for c in cols], *[F.col(f"_f.{v}") for v in value])
