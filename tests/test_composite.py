"""The composite's plan on hand-made slides, and the layer table's promises."""

import random

from tidemark.operators import composite as C

INK = "media_id long, slide long, y long, x long"
SLIDE = "media_id long, slide long, start_us long, end_us long, top long, bottom long"
S = 1_000_000


def plain_override(stage, top, bottom, ink):
    """Scale by scale, place by place."""
    under = lambda x, y: (x - stage.cam_x) ** 2 + (y - stage.cam_y) ** 2 < stage.cam_r**2
    off = stage.y + bottom * stage.scale > stage.out_h - 6 or stage.y + top * stage.scale < 2
    if not off and not any(under(stage.x + x * stage.scale, stage.y + y * stage.scale) for y, x in ink):
        return None
    s0, k = min(stage.scale, (stage.out_h - stage.margins) / max(1.0, bottom - top)), 0
    while s0 - k * stage.step >= stage.floor - 1e-9:
        s = s0 - k * stage.step
        bx, by = (stage.out_w - stage.width * s) / 2, (stage.out_h - (bottom - top) * s) / 2 - top * s
        if not any(under(bx + x * s, by + y * s) for y, x in ink):
            return round(s, 9)
        k += 1
    return stage.floor


def test_overrides_equal_a_search(spark):
    r = random.Random(1)
    slides, ink, want = [], [], {}
    for i in range(120):
        spots = [(r.randrange(5, 1078), r.randrange(1620)) for _ in range(r.randrange(1, 12))]
        spots += [(r.randrange(120, 330), r.randrange(1300, 1600)) for _ in range(r.randrange(4))]
        top, bottom = min(y for y, _ in spots), max(y for y, _ in spots)
        slides.append((i % 3, i, i * 20 * S, i * 20 * S + r.choice([S // 2, S, 9 * S]), top, bottom))
        ink += [(i % 3, i, y, x) for y, x in spots]
        found = plain_override(C.Stage(), top, bottom, spots)
        if found is not None and slides[-1][3] - slides[-1][2] >= S:
            want[i] = found
    got = {x.slide: round(x.scale, 9) for x in C.overrides(spark.createDataFrame(slides, SLIDE), spark.createDataFrame(ink, INK)).collect()}
    assert got == want and len(set(want.values())) > 15 and C.Stage().floor in want.values()


def test_caps(spark):
    """Four panels, six popups, each media for itself, the earliest first."""
    open_ = spark.createDataFrame([(m, k * 10 * S, k * 10 * S + S) for m in (1, 2) for k in range(10)], "media_id long, start_us long, end_us long")
    slides = spark.createDataFrame([(m, 1, 0, 500 * S) for m in (1, 2)], "media_id long, slide long, start_us long, end_us long")
    none = spark.createDataFrame([], "media_id long, start_us long, end_us long")
    got = C.patches(open_, open_, slides, none).collect()
    assert sorted((r.media_id, r.kind, r.start_us // (10 * S)) for r in got) == sorted((m, kind, k) for m in (1, 2) for kind, n in (("panel", 4), ("popup", 6)) for k in range(n))
    assert C.bridges(spark.createDataFrame([(1, k, k * 2 * S, (k * 2 + 1) * S + S // 2) for k in range(70)], "media_id long, slide long, start_us long, end_us long")).count() == C.BRIDGES


def test_layer_table_is_whole(spark):
    """Without gaps or overlaps, one row for each interval and layer, in order of z, as a scan of each instant says."""
    r = random.Random(4)
    bounds = [(m, 0, 100) for m in range(4)] + [(9, 5, 5)]
    rows = [(m, 0, 100, 0, "base", 1.0, 0, 0, 0, False, 10**9) for m in range(4)]
    for m in range(4):
        for _ in range(12):
            a = r.randrange(-10, 105)
            z = r.randrange(4)
            rows.append((m, a, a + r.randrange(0, 30), z, f"layer{z}" if z else "base", 1.0, r.randrange(9), r.randrange(9), 0, z == 2, r.randrange(99)))
    names = "media_id long, start_us long, end_us long, z int, layer string, scale double, x long, y long, mask_top long, opaque boolean, turn long"
    got = C.layer_table(spark.createDataFrame(rows, names), spark.createDataFrame(bounds, "media_id long, lo_us long, hi_us long")).collect()
    assert {x.media_id for x in got} == {0, 1, 2, 3}
    for m in range(4):
        spans = sorted({(x.start_us, x.end_us) for x in got if x.media_id == m})
        assert spans[0][0] == 0 and spans[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for a, b in spans:
            live = [x for x in rows if x[0] == m and x[1] <= a and x[2] >= b and x[1] < x[2]]
            best = {}
            for x in live:
                best[x[3], x[4]] = min(best.get((x[3], x[4]), x), x, key=lambda q: (q[10], q[6], q[7]))
            top = max((z for z, _ in best if best[z, _][9]), default=0)
            want = [(i, z, name, best[z, name][6], best[z, name][7], z >= top) for i, (z, name) in enumerate(sorted(best))]
            assert sorted((x.place, x.z, x.layer, x.x, x.y, x.shown) for x in got if x.media_id == m and x.start_us == a) == want


def test_layer_table_is_the_same_in_any_chunks(spark):
    """Chunks deal out the work of a media; they cut no interval, even where a chunk has no ends or one alone."""
    r = random.Random(7)
    bounds = [(1, 3, 400), (2, -50, 90)]
    rows = [(m, lo, hi, 0, "base", 1.0, 0, 0, 0, False, 10**9) for m, lo, hi in bounds]
    for m, lo, hi in bounds:
        for _ in range(25):
            a, z = r.randrange(lo - 20, hi), r.randrange(4)
            rows.append((m, a, a + r.randrange(60), z, f"layer{z}" if z else "base", 1.0, r.randrange(9), r.randrange(9), 0, z == 2, r.randrange(99)))
    names = "media_id long, start_us long, end_us long, z int, layer string, scale double, x long, y long, mask_top long, opaque boolean, turn long"
    layers, ends = spark.createDataFrame(rows, names), spark.createDataFrame(bounds, "media_id long, lo_us long, hi_us long")
    whole = sorted(map(tuple, C.layer_table(layers, ends).collect()))
    assert len(whole) > 200
    for chunk_us in (1, 7, 60):
        assert sorted(map(tuple, C.layer_table(layers, ends, chunk_us).collect())) == whole


def test_a_media_is_dealt_out(spark):
    """No sort or window holds the ends of a whole media, so few media with many slides use all tasks."""
    layers = spark.range(9).selectExpr("1L media_id", "id start_us", "id + 5 end_us", "0 z", "'base' layer", "1D scale", "0L x", "0L y", "0L mask_top", "false opaque", "id turn")
    plan = C.layer_table(layers, spark.createDataFrame([(1, 0, 9)], "media_id long, lo_us long, hi_us long"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_c#" in line for line in windows) and "Union" not in plan


def test_ink_is_dealt_out_once(spark):
    """Overrides read ink once; it may come without the media, which the slides have."""
    slides = spark.createDataFrame([(i % 2, i, i * 20 * S, i * 20 * S + 9 * S, i % 7 * 40, 700 + i % 9 * 40) for i in range(60)], SLIDE)
    ink = spark.range(600).selectExpr("id % 60 % 2 AS media_id", "id % 60 AS slide", "id * 37 % 1080 AS y", "id * 91 % 1620 AS x")
    got = C.overrides(slides, ink)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 5 and sorted(map(tuple, C.overrides(slides, ink.drop("media_id")).collect())) == rows


def test_overrides_in_fine_steps(spark):
    """More steps than one number has bits."""
    r, stage = random.Random(3), C.Stage(step=0.002)
    slides, ink, want = [], [], {}
    for i in range(80):
        spots = [(r.randrange(5, 1078), r.randrange(1620)) for _ in range(5)] + [(r.randrange(100, 330), r.randrange(1250, 1600)) for _ in range(r.randrange(6))]
        top, bottom = min(y for y, _ in spots), max(y for y, _ in spots)
        slides.append((1, i, i * 20 * S, i * 20 * S + 9 * S, top, bottom))
        ink += [(1, i, y, x) for y, x in spots]
        found = plain_override(stage, top, bottom, spots)
        if found is not None:
            want[i] = found
    got = {x.slide: round(x.scale, 9) for x in C.overrides(spark.createDataFrame(slides, SLIDE), spark.createDataFrame(ink, INK), stage).collect()}
    assert got == want and any(stage.floor < v < stage.scale - 0.002 * C.WORD for v in want.values())


def test_empty(spark):
    slides, ink = spark.createDataFrame([], SLIDE), spark.createDataFrame([], INK)
    assert C.overrides(slides, ink).count() == 0 and C.bridges(slides).count() == 0
