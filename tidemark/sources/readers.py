"""Readers with declared schemas: probes, segments, specs, logs, directories, and a paged listing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import text as T

PROBE = "streams array<struct<codec_type: string, width: int, height: int, duration: string, r_frame_rate: string>>, format struct<duration: string>"
SEGMENT = "id int, start double, end double, text string, words array<struct<word: string, start: double, end: double>>"
FEEDBACK = "text string, type string, confidence double, approved boolean, ts double"
SPEC = (
    "trim struct<start: double, end: double>, cuts array<struct<start: double, end: double>>, mute_original boolean, "
    "texts array<struct<text: string, start: double, end: double, pos: string, size: int, color: string, x: int, y: int>>, "
    "images array<struct<id: string, start: double, end: double, pos: string, scale: double, w: int, x: int, y: int>>, "
    "audios array<struct<id: string, start: double, volume: double>>, inserts array<struct<job: string, at: double>>, "
    "repeat_feedback array<struct<text: string, type: string, confidence: double, approved: boolean>>, manual_cuts array<struct<start: double, end: double>>, title string"
)
VIDEO = ".*\\.(mp4|mov|mkv|webm|m4v|avi)$"


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object file; a file that is missing or holds no JSON gives no rows, malformed fields become null."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def probes(raw: DataFrame, column: str = "json") -> DataFrame:
    """media_id, w, h, duration of the first video stream, from probe output as JSON."""
    p = raw.select("media_id", F.from_json(column, PROBE).alias("p"))
    v = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    d = F.coalesce(F.col("p.format.duration").try_cast("double"), v["duration"].try_cast("double"))
    return p.select("media_id", v["width"].alias("w"), v["height"].alias("h"), d.alias("duration"), frame_rate(v["r_frame_rate"]).alias("fps"))


def streams(raw: DataFrame, column: str = "json") -> DataFrame:
    """media_id, codec_type, duration of streams whose duration parses."""
    s = raw.select("media_id", F.explode(F.from_json(column, PROBE)["streams"]).alias("s"))
    return s.select("media_id", "s.codec_type", F.col("s.duration").try_cast("double").alias("duration")).where("duration IS NOT NULL")


def frame_rate(fraction: Column) -> Column:
    """a/b as a number; null if it doesn't parse."""
    a, b = F.split_part(fraction, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(fraction, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(b != 0, a / b)


def has_audio(media: DataFrame, all_streams: DataFrame) -> DataFrame:
    return media.join(all_streams.where("codec_type = 'audio'").select("media_id").distinct(), "media_id", "left_semi")


def signatures(lines: DataFrame) -> DataFrame:
    """media_id and the sorted lines that describe its streams, as one text."""
    return lines.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("signature"))


def disfluencies(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated start, end, label; shorter lines are skipped. With type and action."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    out = rows.select(F.col("c")[0].try_cast("double").alias("start"), F.col("c")[1].try_cast("double").alias("end"), F.trim(F.col("c")[2]).alias("label")).where("start IS NOT NULL AND end IS NOT NULL")
    return out.withColumns({"type": T.base_type(F.col("label")), "action": T.action(F.col("label"))})


def silences(logs: DataFrame, log: str = "log", duration: str = "duration") -> DataFrame:
    """media_id, start_us, end_us from a detector's log: starts and ends paired by position, a missing end is the duration."""
    some = lambda k: F.transform(F.regexp_extract_all(log, F.lit(rf"silence_{k}: (-?[0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    z = logs.select("media_id", duration, F.explode(F.arrays_zip(some("start").alias("s"), some("end").alias("e"))).alias("z"))
    us = lambda c: F.round(c * 1e6).cast("long")
    return z.where("z.s IS NOT NULL").select("media_id", us(F.col("z.s")).alias("start_us"), us(F.coalesce("z.e", duration)).alias("end_us"))


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Videos below out folders, without backups: path, folder, mtime, length. Contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return f.where(F.col("path").contains("/out/") & ~F.col("path").endswith(".orig.mp4")).select("path", F.regexp_extract("path", "([^/]+)/out/", 1).alias("folder"), F.col("modificationTime").alias("mtime"), "length")


def listing(spark: SparkSession, folder: str, pattern: str = "*.mp4", but: str = "") -> DataFrame:
    """Files of a folder by name, without one."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return f.where(~F.col("path").endswith("/" + but) if but else F.lit(True)).orderBy("path")


def is_video(name: Column, mime: Column) -> Column:
    return F.lower(name).rlike(VIDEO) | F.coalesce(mime.startswith("video/"), F.lit(False))


def sample_times(media: DataFrame, n: int, kind: str = "middle") -> DataFrame:
    """n sample times of each duration: (i + 1) / (n + 1) of it (inner), or (i + 0.5) / n (middle)."""
    i = F.col("i")
    t = F.col("duration") * ((i + 1) / F.lit(n + 1) if kind == "inner" else (i + 0.5) / F.lit(n))
    return media.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", t)


class PagedListing(DataSource):
    """Entries of remote folders, a partition for each: option folders, comma-separated, and a page
    function set on the class, from (folder, token) to (rows, next token)."""

    page: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id string, name string, mime_type string, parent string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options.get("folders", ""), type(self).page)


class _Pages(DataSourceReader):
    def __init__(self, folders: str, page: Callable):
        self.folders, self.page = [f for f in folders.split(",") if f], page

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token = None
        while True:
            rows, token = self.page(partition.value, token)
            for id_, name, mime in rows:
                yield id_, name, mime, partition.value
            if not token:
                return
