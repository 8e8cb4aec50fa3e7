"""Edit decision lists: what to keep, mute, insert and overlay, as tables for an external encoder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import intervals as I

MEDIA = ("media_id",)


def keep_intervals(cuts: DataFrame, trims: DataFrame, keys: Sequence[str] = MEDIA, min_len_us: int = 50_000) -> DataFrame:
    """The trimmed range (keys, trim_start_us, trim_end_us null for the end, dur_us) without the cuts."""
    lo, hi = F.greatest(F.coalesce("trim_start_us", F.lit(0)), F.lit(0)), F.least(F.coalesce("trim_end_us", "dur_us"), "dur_us")
    return I.complement(cuts, trims.select(*keys, lo.cast("long").alias("lo_us"), hi.cast("long").alias("hi_us")), keys, min_len_us)


def silence_keep(silences: DataFrame, bounds: DataFrame, keys: Sequence[str] = MEDIA, pad_us: int = 150_000, min_removed_us: int = 200_000, min_keep_us: int = 400_000) -> DataFrame:
    """Silences shrunk by pad at both ends, those still longer than min_removed_us removed, and the
    rest kept where it is at least min_keep_us long."""
    s = silences.select(*keys, (F.col("start_us") + pad_us).alias("start_us"), (F.col("end_us") - pad_us).alias("end_us"))
    return I.complement(I.longer(s, min_removed_us), bounds, keys, min_keep_us, inclusive=True)


def protected_mutes(mutes: DataFrame, speech: DataFrame, margin_us: int = 120_000, keys: Sequence[str] = MEDIA, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """Mutes without speech and a margin around it."""
    return I.subtract(mutes, I.pad(speech.select(*keys, "start_us", "end_us"), margin_us, margin_us), keys, 50_000, bucket_us)


def prioritised(points: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str, base: int = -1, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """key, geometry and its origin: the smallest value of first that holds the point, else of second, else base."""
    a = I.point_join(points, first, bucket_us=bucket_us).groupBy(key).agg(F.min(value).alias("_a"))
    b = I.point_join(points, second, bucket_us=bucket_us).groupBy(key).agg(F.min(value).alias("_b"))
    found = points.select(key).join(a, key, "left").join(b, key, "left")
    origin = F.when(F.col("_a").isNotNull(), "recenter").when(F.col("_b").isNotNull(), "override").otherwise("base")
    return found.select(key, F.coalesce("_a", "_b", F.lit(base).cast("long")).alias("geometry"), origin.alias("origin"))


def cut_text(cuts: DataFrame, segments: DataFrame, key: str, limit: int = 400, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """The texts of the segments (text, ord) that a cut overlaps, in order, cut to limit characters."""
    pairs = I.overlap_join(cuts, segments, bucket_us=bucket_us)
    texts = F.array_sort(F.collect_list(F.struct(F.col("b_start_us").alias("s"), F.col("b_ord").alias("o"), F.col("b_text").alias("t"))))
    joined = pairs.groupBy(key).agg(texts.alias("_t"))
    return joined.select(key, F.substring(F.array_join(F.transform("_t", lambda x: x["t"]), " "), 1, limit).alias("text"))


def segment_mutes(segments: DataFrame, mutes: DataFrame, keys: Sequence[str] = MEDIA, min_len_us: int = 20_000, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """Mute windows inside each kept segment, relative to its start."""
    pairs = I.overlap_join(segments, mutes, keys, bucket_us)
    s, e = F.greatest("start_us", "b_start_us"), F.least("end_us", "b_end_us")
    return pairs.where(e - s > min_len_us).select(*keys, "seg_no", (s - F.col("start_us")).alias("start_us"), (e - F.col("start_us")).alias("end_us"))


def no_op(keep: DataFrame, bounds: DataFrame, slack_us: int = 300_000, keys: Sequence[str] = MEDIA) -> DataFrame:
    """Whether a media's keep list is one range that begins and ends within slack of its bounds."""
    k = keep.groupBy(*keys).agg(F.count("*").alias("n"), F.min("start_us").alias("s"), F.max("end_us").alias("e")).join(bounds, list(keys))
    return k.select(*keys, ((F.col("n") == 1) & (F.col("s") < F.col("lo_us") + slack_us) & (F.col("e") > F.col("hi_us") - slack_us)).alias("no_op"))


def plan_segments(keep: DataFrame, inserts: DataFrame, keys: Sequence[str] = MEDIA) -> DataFrame:
    """The finished timeline: keys, seg_no, input (0 the base, clips from 1 in order of first use),
    start_us and end_us (null for a whole clip).

    inserts: keys, at_us, clip, ord. An insert goes to the first kept range that ends at or after
    its time, clamped to the range's start; past the last range it goes to the end. Cut points split
    the ranges. Expressed as one sorted stream of boundaries, without a loop over inserts."""
    ranges = keep.select(*keys, "start_us", "end_us")
    w = Window.partitionBy(*keys)
    marks = ranges.select(*keys, F.col("end_us").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("clip"), F.lit(None).cast("long").alias("ord"), F.struct("start_us", "end_us").alias("_r"))
    asks = inserts.select(*keys, F.col("at_us").alias("_t"), F.lit(0).alias("_side"), "clip", "ord", F.lit(None).cast("struct<start_us:bigint,end_us:bigint>").alias("_r"))
    target = F.first("_r", True).over(w.orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing))
    placed = marks.unionByName(asks).withColumn("_to", target).where("_side = 0")
    placed = placed.select(*keys, "clip", "ord", "_t", F.col("_to.start_us").alias("_rs"), F.when(F.col("_to").isNotNull(), F.greatest("_t", F.col("_to.start_us"))).alias("_at"))
    # cut points of each range: its start, the inserts' places, its end; pieces lie between neighbours
    points = ranges.select(*keys, F.col("start_us").alias("_rs"), F.col("start_us").alias("_p")).unionByName(placed.where("_at IS NOT NULL").select(*keys, "_rs", F.col("_at").alias("_p"))).distinct()
    ends = ranges.select(*keys, F.col("start_us").alias("_rs"), F.col("end_us").alias("_re"))
    pieces = points.join(ends, [*keys, "_rs"]).withColumn("_next", F.coalesce(F.lead("_p").over(Window.partitionBy(*keys, "_rs").orderBy("_p")), F.col("_re"))).where("_next > _p")
    null = F.lit(None).cast("long")
    base = pieces.select(*keys, F.col("_rs").alias("_o1"), F.col("_p").alias("_o2"), F.lit(1).alias("_o3"), null.alias("_o4"), null.alias("ord"), F.lit(None).cast("string").alias("clip"), F.col("_p").alias("start_us"), F.col("_next").alias("end_us"))
    far = F.lit((1 << 62)).cast("long")
    clips = placed.select(*keys, F.coalesce("_rs", far).alias("_o1"), F.coalesce("_at", far).alias("_o2"), F.lit(0).alias("_o3"), F.col("_t").alias("_o4"), "ord", "clip", null.alias("start_us"), null.alias("end_us"))
    order = w.orderBy("_o1", "_o2", "_o3", "_o4", "ord")
    rows = base.unionByName(clips).withColumn("seg_no", F.row_number().over(order) - 1)
    first = rows.where("clip IS NOT NULL").groupBy(*keys, "clip").agg(F.min("seg_no").alias("_f"))
    numbered = first.withColumn("input", F.row_number().over(w.orderBy("_f"))).drop("_f")
    return rows.join(numbered, [*keys, "clip"], "left").select(*keys, "seg_no", F.coalesce("input", F.lit(0)).alias("input"), "clip", "start_us", "end_us")


def merge_plan(parts: DataFrame, job: str = "job_id") -> DataFrame:
    """Whether a job's parts can be joined by copying (one signature), and the expected length."""
    return parts.groupBy(job).agg((F.count_distinct("signature") == 1).alias("copy"), F.count("*").alias("n_parts"), F.sum("dur_us").alias("expected_us"))


def length_ok(expected_us: Column, got_us: Column) -> Column:
    """|expected - got| within half a second and two thousandths."""
    return F.abs(expected_us - got_us) <= F.lit(500_000) + expected_us * 0.002


def crossfade(parts: DataFrame, fade_us: int, job: str = "job_id", order: str = "part_no") -> DataFrame:
    """Where each part begins if neighbours overlap by fade_us."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset_us", F.coalesce(F.sum(F.col("dur_us") - fade_us).over(w), F.lit(0).cast("long")))


def active_overlays(points: DataFrame, overlays: DataFrame, key: str, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """The overlays shown at each point, both ends included."""
    found = I.point_join(points, overlays, bucket_us=bucket_us).groupBy(key).agg(F.array_sort(F.collect_list("overlay_id")).alias("_a"))
    out = points.select(key).join(found, key, "left")
    return out.select(key, F.coalesce(F.size("_a"), F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.array_join(F.col("_a").cast("array<string>"), ","), F.lit("")).alias("active"))


def with_assets(items: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items: media_id, id, ...; assets: id, path. The items whose asset exists, with its path, and for each media how many
    have none (n_missing): they are left out without an error, but counted. Of an id's paths the first in order counts."""
    known = assets.groupBy("id").agg(F.min("path").alias("path"))
    found = items.join(known, "id", "left")
    missing = found.groupBy("media_id").agg(F.count_if(F.col("path").isNull()).alias("n_missing"))
    return found.where("path IS NOT NULL"), missing


def branches(specs: DataFrame) -> DataFrame:
    """specs: media_id, texts, images, audios (arrays), mute_original. Which steps of an edit run: overlays, and inserts where
    the specification has some."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    mute = F.coalesce("mute_original", F.lit(False))
    return specs.select("media_id", (some("texts") | some("images") | some("audios") | mute).alias("overlays"), (some("audios") | mute).alias("new_sound"))


def ranges_by_action(found: DataFrame, gap_us: int = 0, keys: Sequence[str] = MEDIA) -> DataFrame:
    """found: keys, start_us, end_us, label. Ranges of disfluencies by action (cut or mute), touching ones of an action merged."""
    return I.merge_intervals(found.withColumn("action", T.action(F.col("label"))), [*keys, "action"], slack_us=gap_us)


def cleanup(keep: DataFrame, found: DataFrame, speech: DataFrame, bounds: DataFrame, margin_us: int = 120_000, slack_us: int = 300_000, keys: Sequence[str] = MEDIA, bucket_us: int = 3600 * I.SECOND) -> DataFrame:
    """The plan of a cleaning pass: keep (ranges of speech, or what silences leave) less the cuts among the disfluencies found,
    with the mutes inside each kept range relative to its start, clear of speech. keys, kind (keep or mute), seg_no, start_us,
    end_us; a media whose keep list is its whole length has no rows."""
    actions = ranges_by_action(found, keys=keys)
    kept = I.subtract(keep, actions.where("action = 'cut'").drop("action"), keys, 50_000, bucket_us)
    idle = no_op(kept, bounds, slack_us, keys).where("no_op").select(*keys)
    segments = I.rebase(kept.join(idle, list(keys), "left_anti"), keys)
    mutes = protected_mutes(actions.where("action = 'mute'").drop("action"), speech, margin_us, keys, bucket_us)
    inside = segment_mutes(segments, mutes, keys, bucket_us=bucket_us)
    row = lambda rows, kind: rows.select(*keys, F.lit(kind).alias("kind"), "seg_no", "start_us", "end_us")
    return row(segments, "keep").unionByName(row(inside, "mute"))


def case_between(t: Column, table: Sequence[tuple[float, float, float]], default: float) -> Column:
    """The value of the first range that holds t, both ends included, as one expression."""
    out = F.lit(default)
    for a, b, v in reversed(table):
        out = F.when(t.between(a, b), F.lit(v)).otherwise(out)
    return out


def font_size(text: Column, full: int = 96, floor: int = 54, fits: int = 28) -> Column:
    """Title size: full up to `fits` characters, then in proportion, not below floor."""
    n = F.length(text)
    return F.when(n <= fits, F.lit(full)).otherwise(F.greatest(F.lit(floor), F.floor(F.lit(full * fits) / n))).cast("int")
