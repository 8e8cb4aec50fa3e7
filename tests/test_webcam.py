"""A planted webcam disc: found among still circles, and followed when it jumps."""

import math
import random

import pytest

from tidemark.operators import webcam as W

WIDTH, HEIGHT = 240, 160


def disc(cx, cy, r, v, r_in=0):
    return {(y, x): v() for y in range(max(0, cy - r), min(HEIGHT, cy + r + 1)) for x in range(max(0, cx - r), min(WIDTH, cx + r + 1)) if r_in * r_in <= (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


def table(spark, frames, names="media_id long, frame_no long, y long, x long, v int"):
    return spark.createDataFrame([(*k, y, x, v) for k, f in frames.items() for (y, x), v in f.items()], names)


@pytest.mark.parametrize("cx, cy, r", [(190, 40, 22), (205, 50, 18), (170, 45, 24)])
def test_disc_is_found_where_it_moves(spark, cx, cy, r):
    """Seven frames with the webcam and a still diagram node of like size; a media without circles; one whose circles stand still."""
    q = random.Random(cx)
    other = (150 if cx > 180 else 215, 55, 17)
    frames, pairs = {}, []
    for f in range(7):
        frames[1, f] = disc(*other, lambda: 60) | disc(cx, cy, r, lambda: q.randrange(70, 130))
        frames[2, f] = {(3, x): 10 for x in range(30)}
        frames[3, f] = disc(*other, lambda: 60)
    for p in range(5):
        pairs += [(1, p, y, x, q.randrange(3, 20)) for y, x in disc(cx, cy, r, lambda: 1)] + [(m, p, 3, x, 1) for m in (2, 3) for x in range(5)]
    found = {x.media_id: x for x in W.find(table(spark, frames), spark.createDataFrame(pairs, "media_id long, pair long, y long, x long, d int"), WIDTH, HEIGHT, (12, 30), (7, 8, 9), reach=15, apart=30).collect()}
    got = found[1]
    assert got.detected and math.dist((got.cx, got.cy), (cx, cy)) <= 2 and abs(got.r - r) <= 6 and got.motion > 1.5
    assert all(tuple(found[m])[1:4] == (7, 8, 9) and not found[m].detected for m in (2, 3))


def test_circles_within_two_pixels(spark):
    q = random.Random(1)
    want, frames = {}, {}
    for f in range(12):
        cx, cy, r = q.randrange(165, 205), q.randrange(32, 48), q.randrange(14, 26)
        want[f] = (cx, cy, r)
        frames[1, f] = disc(cx, cy, r, lambda: q.randrange(50, 110))
    got = {x.frame_no: x for x in W.circles(table(spark, frames), (132, 239, 0, 79), (12, 30), apart=30).where("i = 0").collect()}
    assert all(math.dist((got[f].cx, got[f].cy), c[:2]) <= 2 and abs(got[f].cr - c[2]) <= 2 for f, c in want.items())


def test_disc_is_followed(spark):
    """The disc jumps by 15 pixels (16 on the grid of two) for a while, is lost in single frames, and twitches once; a second media never moves, a third is seen too
    rarely, a fourth has too few frames."""
    q = random.Random(3)
    times, frames, discs = [], {}, []
    for m, n in ((1, 40), (2, 20), (3, 20), (4, 6)):
        discs.append((m, 120, 80, 20))
        for f in range(n):
            times.append((m, f, f * 500_000))
            dx, dy = (0, 15) if m == 1 and 18 <= f < 30 else (12, 0) if m == 1 and f == 7 else (0, 0)
            if m == 3 and f % 3 or m == 1 and f in (3, 22):
                frames[m, f] = {(2, 2): 10}
                continue
            frames[m, f] = disc(120 + dx, 80 + dy, 20, lambda: q.randrange(40, 190)) | {(q.randrange(HEIGHT), q.randrange(WIDTH)): 0 for _ in range(40)}
    names = "media_id long, cx long, cy long, r long"
    places = W.disc_places(table(spark, frames), spark.createDataFrame(discs, names), WIDTH, HEIGHT)
    seen = spark.createDataFrame(times, "media_id long, frame_no long, t_us long")
    assert [tuple(x) for x in W.track(seen, places).collect()] == [(1, 9_000_000, 15_000_000, 0, 16)]
    fine = spark.createDataFrame([(1, t, 121.0, 95.0 + (0.5 if t % 3 else 0.0)) for t in range(8_700_000, 15_350_001, 50_000)] + [(1, t, 120.5, 80.5) for t in range(5_000_000, 8_650_001, 50_000)], "media_id long, t_us long, x double, y double")
    assert [(x.media_id, x.start, x.end, x.dx, x.dy) for x in W.track(seen, places, fine=fine).collect()] == [(1, 8_700_000, 15_350_000, 0, 16)]


def test_disc_area(spark):
    from pyspark.sql import functions as F

    rows = [(r, cx, cy) for r in (1, 5, 12) for cx in (0, 3, 100, 239) for cy in (0, 8, 159)]
    got = spark.createDataFrame(rows, "r long, cx long, cy long").select("*", W.disc_area(F.col("r"), F.col("cx"), F.col("cy"), WIDTH, HEIGHT).alias("a")).collect()
    assert all(x.a == len(disc(x.cx, x.cy, x.r, lambda: 1)) for x in got)


def test_empty(spark):
    none = spark.createDataFrame([], "media_id long, frame_no long, y long, x long, v int")
    pairs = spark.createDataFrame([], "media_id long, pair long, y long, x long, d int")
    assert W.find(none, pairs, WIDTH, HEIGHT, (12, 30)).count() == 0
    times = spark.createDataFrame([], "media_id long, frame_no long, t_us long")
    assert W.track(times, W.disc_places(none, spark.createDataFrame([], "media_id long, cx long, cy long, r long"), WIDTH, HEIGHT)).count() == 0
