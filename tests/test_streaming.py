"""Streams give what batches give."""

import random

from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.streaming import series


def samples(spark):
    rows = [(m, i * 10, (i * 7 + m) % 5 < 3) for m in (1, 2) for i in range(60)]
    return spark.createDataFrame(rows, "media_id long, t_us long, on boolean").withColumn("event_id", F.monotonically_increasing_id())


def streamed(spark, path):
    samples(spark).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).parquet(str(path))


def test_runs(spark, tmp_path):
    got = series.drained(series.stream_runs(streamed(spark, tmp_path / "in"), 2), "stream_runs")
    want = E.runs(samples(spark), ["media_id"], ["t_us"], F.col("on"), 2, emit_open_run=False)
    rows = lambda df: sorted((r.media_id, r.start, r.last, r.n) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)


def test_cooldown(spark, tmp_path):
    got = series.drained(series.stream_runs(streamed(spark, tmp_path / "in"), 2, 100), "stream_cooldown")
    fired = E.persistent(samples(spark), ["media_id"], ["t_us"], F.col("on"), 2).select("media_id", "t_us")
    want = E.cooldown(fired, ["media_id"], "t_us", 100)
    assert sorted((r.media_id, r.last) for r in got.collect()) == sorted((r.media_id, r.t_us) for r in want.collect())


def test_tumbling(spark, tmp_path):
    got = series.drained(series.tumbling(streamed(spark, tmp_path / "in"), 200), "stream_tumbling", "complete")
    rows = lambda df: sorted((r.media_id, r.w_us, r.n) for r in df.collect())
    assert rows(got) == rows(series.tumbling(samples(spark), 200))


def fed(spark, tmp_path, parts):
    """A stream over files that are added one at a time, one to a batch: the stream, and a call that adds the next file."""
    path = tmp_path / "in"
    path.mkdir()
    left = list(enumerate(parts))
    names = "media_id long, t_us long, on boolean, event_id long"

    def add():
        i, rows = left.pop(0)
        spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], names).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(path / f"{i}.parquet")

    return lambda: spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(path)), add


SECOND = 1_000_000


def ordered_parts():
    """Rows that come late by up to three seconds, across batches; the last row pushes the watermark beyond all."""
    rows = [(m, i * SECOND, (i * 7 + m) % 5 < 3) for m in (1, 2) for i in range(1, 40)]
    rows += [(1, i * SECOND, True) for i in range(80, 84)]  # a run that only a timer closes
    parts = [[], [], []]
    for m, t, on in rows:
        i = t // SECOND
        parts[min(2, (i + (3 if i % 4 == 0 else 0)) // 15)].append((m, t, on))
    parts[2].append((3, 500 * SECOND, False))
    return rows, parts


def plain_runs(rows, least, idle):
    out = []
    for m in sorted({r[0] for r in rows}):
        run = []
        for _, t, on in [*sorted(r for r in rows if r[0] == m), (m, None, False)]:
            if run and (t is None or not on or t - run[-1] > idle):
                out += [(m, run[0], run[-1], len(run))] if len(run) >= least else []
                run = []
            if on:
                run.append(t)
    return sorted(out)


def test_late_rows_and_a_stop_between_batches(spark, tmp_path):
    """The query is stopped after each batch and started anew from its checkpoint: state, late rows and timers go on."""
    rows, parts = ordered_parts()
    stream, add = fed(spark, tmp_path, parts)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for _ in parts:
        add()
        query = series.keep_files(series.ordered_runs(stream(), 2, 20 * SECOND, "30 seconds"), out, at)
        query.awaitTermination()
        assert query.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == plain_runs(rows, 2, 20 * SECOND) and (1, 80 * SECOND, 83 * SECOND, 4) in got


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    parts = [[(1, i * SECOND, True) for i in range(1, 10)] + [(1, 100 * SECOND, False)], [(1, 4 * SECOND + 1, False), (1, 99 * SECOND, True), (1, 300 * SECOND, False)], [(1, 301 * SECOND, False)]]
    stream, add = fed(spark, tmp_path, parts)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for _ in parts:
        add()
        series.keep_files(series.ordered_runs(stream(), 1, 20 * SECOND, "5 seconds"), out, at).awaitTermination()
    # the first late row would have cut the run in two; the second is within five seconds of the latest row
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, SECOND, 9 * SECOND, 9), (1, 99 * SECOND, 99 * SECOND, 1)]


def test_windows_drop_late_rows(spark, tmp_path):
    parts = [[(1, i * SECOND, True) for i in range(30)], [(1, 2 * SECOND, True), (1, 27 * SECOND, True), (1, 90 * SECOND, True)], [(1, 200 * SECOND, True)]]
    stream, add = fed(spark, tmp_path, parts)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for _ in parts:
        add()
        series.keep_files(series.tumbling(stream(), 10 * SECOND, "5 seconds"), out, at).awaitTermination()
    got = {r.w_us: r.n for r in spark.read.parquet(out).collect()}
    assert {w: n for w, n in got.items() if w < 60 * SECOND} == {0: 10, 10 * SECOND: 10, 20 * SECOND: 11}


def test_upsert_is_idempotent(spark, tmp_path):
    """A table of jobs kept by a stream that stops between batches equals the newest row of each job, and a batch tried twice counts once."""
    r = random.Random(2)
    parts = [[(r.randrange(12), r.randrange(50), bool(r.randrange(2))) for _ in range(30)] for _ in range(3)]
    stream, add = fed(spark, tmp_path, parts)
    path, at, keys, order = str(tmp_path / "jobs"), str(tmp_path / "at"), ["media_id"], ["t_us", "event_id"]
    schema = spark.createDataFrame([], "media_id long, t_us long, on boolean, event_id long").schema
    assert series.current(spark, path, keys, order, schema).count() == 0
    seen = {}
    for i, part in enumerate(parts):
        add()
        series.upserted(stream(), path, keys, order, at).awaitTermination()
        for k, (m, t, on) in enumerate(part):
            seen[m] = max(seen.get(m, (-1, -1, -1, None)), (t, k, i, on))
        got = {x.media_id: (x.t_us, x.event_id, x.on) for x in series.current(spark, path, keys, order, schema).collect()}
        assert got == {m: (t, k, on) for m, (t, k, _, on) in seen.items()}
    before = sorted(map(repr, series.current(spark, path, keys, order, schema).collect()))
    put = series.put_batch(path, keys, order)
    for _ in range(2):  # as after a failure between the writing and the checkpoint
        put(spark.read.parquet(str(tmp_path / "in" / "2.parquet")), 2)
    assert sorted(map(repr, series.current(spark, path, keys, order, schema).collect())) == before
