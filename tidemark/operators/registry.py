"""The job registry: upserts, self-healing, relinking, queue positions, bounded logs, tombstones, folder trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def upsert(disk: DataFrame, memory: DataFrame, key: str = "id") -> DataFrame:
    """Disk rows overlaid by memory rows of kind render or edit."""
    cols = [c for c in disk.columns if c != key]
    m = memory.where(F.col("kind").isin("render", "edit"))
    both = disk.alias("d").join(m.alias("m"), key, "full_outer")
    fresh = F.col("m.kind").isNotNull()
    return both.select(key, *[F.when(fresh, F.col(f"m.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in cols])


def retained(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose output exists, or that wait or run and whose input does. files: path."""
    f = files.select("path").distinct()
    out = jobs.join(f.withColumnsRenamed({"path": "output"}).withColumn("_o", F.lit(True)), "output", "left")
    out = out.join(f.withColumnsRenamed({"path": "input"}).withColumn("_i", F.lit(True)), "input", "left")
    alive = F.col("_o").isNotNull() | (F.col("status").isin("queued", "running") & F.col("_i").isNotNull())
    return out.where(alive).select(*jobs.columns)


def missing(found: DataFrame, jobs: DataFrame, key: str = "id") -> DataFrame:
    """What is on disk but not in the registry."""
    return found.join(jobs.select(key).distinct(), key, "left_anti")


def newest(files: DataFrame, folder: str = "folder", time: str = "mtime", path: str = "path") -> DataFrame:
    """The latest file of each folder; of equal times the last path."""
    return files.groupBy(folder).agg(F.max_by(path, F.struct(time, path)).alias(path), F.max(time).alias(time))


def queue_position(jobs: DataFrame, shard: Sequence[str], order: str = "seq") -> DataFrame:
    """How many jobs before a queued one wait or run; a queue is a shard of jobs, and a window of its own."""
    if not shard:
        raise ValueError("name the columns that tell queues apart")
    w = Window.partitionBy(*shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    busy = F.coalesce(F.sum(F.col("status").isin("queued", "running").cast("long")).over(w), F.lit(0).cast("long"))
    return jobs.withColumn("position", F.when(F.col("status") == "queued", busy))


def relink(jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """Jobs (render) with the folder of the first video whose stem, folder name or bracketed folder text matches their title.
    videos: ord, name, parent, parent_name."""
    folder = F.coalesce("parent_name", F.lit(""))
    bracket = F.trim(F.regexp_extract(folder, r"\((.*)\)", 1))
    keys = F.array(T.stem(F.col("name")), F.nullif(folder, F.lit("")), F.nullif(bracket, F.lit("")))
    each = videos.where("parent IS NOT NULL AND parent <> ''").select("ord", "parent", F.posexplode(keys).alias("i", "k")).where("k IS NOT NULL")
    first = each.select(T.title_key(F.col("k")).alias("_key"), "ord", "i", "parent").groupBy("_key").agg(F.min_by("parent", F.struct("ord", "i")).alias("drive_parent"))
    return jobs.where("kind = 'render'").withColumn("_key", T.title_key(F.col("title"))).join(first, "_key").drop("_key")


def checked(requests: DataFrame, jobs: DataFrame, job: str = "part") -> DataFrame:
    """Requests (request_id, part) whose every part is a finished job; ok is false for the others."""
    done = jobs.where("status = 'done'").select(F.col("id").alias(job)).distinct().withColumn("_ok", F.lit(True))
    return requests.join(done, job, "left").groupBy("request_id").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok"), F.count("*").alias("n_parts"))


def require(checked_requests: DataFrame) -> DataFrame:
    """The requests, or an error that names one with a part that isn't finished."""
    bad = F.raise_error(F.concat(F.lit("a part is not finished: "), F.col("request_id").cast("string")))
    return checked_requests.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(bad.cast("boolean")))


def supersede(jobs: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """Jobs with superseded set where another job used them."""
    u = used.select(key).distinct().withColumn("_u", F.lit(True))
    return jobs.join(u, key, "left").withColumn("superseded", F.coalesce("_u", "superseded")).drop("_u")


def bounded_log(log: DataFrame, limit: int = 4000, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The last `limit` rows whose text isn't blank; a bounded top-k, so no global sort."""
    last = log.where(F.trim("text") != "")
    return last.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def tombstoned(jobs: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Jobs with deleted_at; running ones can't be deleted."""
    return jobs.join(deleted.select(key, F.col("at").alias("_at")), key, "left").withColumn("deleted_at", F.when(F.col("status") != "running", F.col("_at"))).drop("_at")


def visible(jobs: DataFrame) -> DataFrame:
    return jobs.where("deleted_at IS NULL")


def tree(edges: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """Entries below the roots, with depth from 1 and the parent's name. edges: id, name, parent. The depth is
    bounded, so it is as many joins as levels."""
    level = roots.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    out = None
    for k in range(1, depth + 1):
        found = edges.join(level, "parent").select("id", "name", "parent", "parent_name", F.lit(k).alias("depth"))
        out = found if out is None else out.unionByName(found)
        level = found.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return out


def pick_folder(folders: DataFrame, names: Sequence[str], fallback: str = "final", key: str = "parent") -> DataFrame:
    """For each parent the first folder named like one of names (trimmed, any case), else the first that contains fallback."""
    low = F.lower(F.trim("name"))
    rank = F.when(low.isin(*[n.lower() for n in names]), 0).when(F.contains(F.lower("name"), F.lit(fallback)), 1)
    return folders.withColumn("_r", rank).where("_r IS NOT NULL").groupBy(key).agg(F.min_by("id", F.struct("_r", "id")).alias("id"))


def find_in_folder(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """entries: id, name, parent; wanted: parent, name. The first entry (by id) of each wanted name in its folder."""
    return entries.join(wanted, ["parent", "name"], "left_semi").groupBy("parent", "name").agg(F.min("id").alias("id"))


def cache_key(content: Column, config: dict) -> Column:
    """md5 over content and the sorted configuration."""
    import json

    return F.md5(F.concat(content.cast("binary"), F.lit(json.dumps(config, sort_keys=True)).cast("binary")))


def status_with_fallback(memory: DataFrame, disk: DataFrame, key: str = "id", value: str = "status") -> DataFrame:
    return memory.select(key, F.col(value).alias("_m")).join(disk.select(key, F.col(value).alias("_d")), key, "full_outer").select(key, F.coalesce("_m", "_d").alias(value))


def job_view(jobs: DataFrame) -> DataFrame:
    """What a job list shows."""
    url = F.when(F.col("status") == "done", F.concat(F.lit("/api/jobs/"), F.col("id").cast("string"), F.lit("/download")))
    return jobs.select("id", "title", "status", F.bround("progress", 3).alias("progress"), url.alias("download"), F.coalesce(F.col("drive_parent") != "", F.lit(False)).alias("drive"))
