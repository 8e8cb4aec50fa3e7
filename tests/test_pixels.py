"""Masks by row runs, summed areas, the cleaners of pages and hole filling against loops over dense grids."""

import random

import numpy as np
import pytest

from tidemark.operators import morphology as M
from tidemark.plans import catalogue, pixels

DATA = "/root/testdata/sf0.001"


def grids(frames):
    """Runs of frames as dense masks."""
    out = {}
    for r in frames:
        out.setdefault((r.media_id, r.frame_no), set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    return out


def plain_dilate(mask, rx, ry, w, h):
    return {(y, x) for y in range(h) for x in range(w) if any((y + a, x + b) in mask for a in range(-ry, ry + 1) for b in range(-rx, rx + 1))}


def plain_erode(mask, rx, ry, w, h):
    return {(y, x) for y in range(h) for x in range(w) if all((y + a, x + b) in mask for a in range(-ry, ry + 1) for b in range(-rx, rx + 1) if 0 <= y + a < h and 0 <= x + b < w)}


def plain_components(mask):
    left, out = set(mask), []
    while left:
        todo = [min(left)]
        part = set(todo)
        left -= part
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            part |= near
            todo += near
        out.append(part)
    return out


@pytest.fixture(scope="module")
def masks():
    r = random.Random(2)
    out = {}
    for f in range(12):
        share = r.choice([0.05, 0.3, 0.6, 0.9])
        out[f % 3, f] = {(y, x) for y in range(14) for x in range(23) if r.random() < share}
    out[0, 50] = {(y, x) for y in range(14) for x in range(23)}
    out[1, 51] = {(0, 0)}
    return {k: m for k, m in out.items() if m}


@pytest.fixture(scope="module")
def runs(spark, masks):
    rows = [(m, f, y, x, 1) for (m, f), mask in masks.items() for y, x in mask]
    return M.row_runs(spark.createDataFrame(rows + rows[:40], "media_id long, frame_no long, y long, x long, label int"))


@pytest.mark.parametrize("rx, ry", [(2, 2), (3, 3), (1, 0), (0, 2), (5, 1)])
def test_dilation_erosion_closing(runs, masks, rx, ry):
    grown = {k: plain_dilate(m, rx, ry, 23, 14) for k, m in masks.items()}
    assert grids(M.dilate(runs, rx, ry, 23, 14).collect()) == grown
    shrunk = {k: plain_erode(m, rx, ry, 23, 14) for k, m in masks.items()}
    assert grids(M.erode(runs, rx, ry, 23, 14).collect()) == {k: m for k, m in shrunk.items() if m}
    closed = M.close(runs, rx, ry, 23, 14).collect()
    assert grids(closed) == {k: plain_erode(m, rx, ry, 23, 14) for k, m in grown.items()}
    rows = sorted(tuple(r) for r in closed)  # runs neither touch nor overlap
    assert all(a[:3] != b[:3] or b[3] > a[4] + 1 for a, b in zip(rows, rows[1:]))


def test_components_and_edges(runs, masks):
    labelled = M.run_components(runs)
    got = {}
    for r in labelled.collect():
        got.setdefault((r.media_id, r.frame_no, r.label), set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for m in masks.values() for c in plain_components(m))
    kept = grids(M.touching(labelled, 23).collect())
    want = {k: {p for c in plain_components(m) if any(y == 0 or x in (0, 22) for y, x in c) for p in c} for k, m in masks.items()}
    assert kept == {k: m for k, m in want.items() if m}


def test_summed_area():
    r = np.random.default_rng(1)
    y, x = np.unique(r.integers(0, 40, (2, 300)), axis=1)
    table = M.SummedArea(y, x)
    a = np.sort(r.integers(-5, 50, (2, 200)), axis=0)
    b = np.sort(r.integers(-5, 50, (2, 200)), axis=0)
    want = [int(((y >= p) & (y <= q) & (x >= s) & (x <= t)).sum()) for p, q, s, t in zip(*a, *b)]
    assert table.count(a[0], a[1], b[0], b[1]).tolist() == want
    assert M.SummedArea(np.zeros(0, "int64"), np.zeros(0, "int64")).count(np.array([0]), np.array([9]), np.array([0]), np.array([9])).tolist() == [0]


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "media_id long, frame_no long, y long, x long, b int, g int, r int, label int")
    assert M.background(none, 23, 14).count() == M.cursors(none, 23, 14).count() == M.vivid_blobs(none, 23, 14).count() == M.cleaned(none, 51, 20, **pixels.SMALL).count() == 0


# ---- the chain of cleaners -----------------------------------------------------------------------


def luma(c):
    return round(0.114 * c[0] + 0.587 * c[1] + 0.299 * c[2])


def sat(c):
    return round(255 * (max(c) - min(c)) / max(c)) if max(c) else 0


def box(points):
    ys, xs = zip(*points)
    return min(xs), max(xs), min(ys), max(ys)


def plain_clean(frame, w, h):
    """frame: (y, x) to (b, g, r); returns what is left, whether the guard put something back, and the steps that found something."""
    p, steps = dict(frame), set()
    colour = {q: max(c) - min(c) for q, c in p.items()}
    bins = {}
    for (y, x), s in colour.items():
        if y >= h - 4 and s > 45:
            bins[x * 8 // w] = bins.get(x * 8 // w, 0) + 1
    if sum(n > 0 for n in bins.values()) >= 4 and sum(bins.values()) < 0.35 * 4 * w:
        steps.add("taskbar")
        p = {q: c for q, c in p.items() if q[0] < h - 6}
    red = [q for q, c in p.items() if q[1] >= w - 8 and q[0] >= h - 6 and c[2] > 140 and c[2] - c[0] > 50]
    if len(red) >= 2:
        steps.add("badge")
        x0, x1, y0, y1 = box(red)
        x0, x1, y0, y1 = max(x0 - 1, 0), min(x1 + 1, w - 1), max(y0 - 1, 0), min(y1 + 1, h - 1)
        p = {(y, x): c for (y, x), c in p.items() if not (x0 <= x <= x1 and y0 <= y <= y1)}
    cw, ch = int(w * 0.2), int(h * 0.45)
    corner = {q: c for q, c in p.items() if q[1] < cw and q[0] < ch}
    vivid = {q for q, c in corner.items() if sat(c) > 90 and max(c) > 90}
    blobs, white = [], 0
    for part in plain_components(vivid):
        x0, x1, y0, y1 = box(part)
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if 1 <= len(part) <= 12 and max(bw, bh) <= 6 and 0.4 <= bw / bh <= 2.5:
            blobs.append(sum(y for y, _ in part) / len(part))
            ring = plain_dilate(part, 1, 1, cw, ch) - part
            dark = sum(max(corner[q]) < 210 for q in ring if q in corner)
            odd = sum(sat(corner[q]) > 40 for q in ring if q in corner)
            white += bool(ring) and 2 * dark < len(ring) and 2 * odd < len(ring)
    blobs.sort()
    rows = [y for y in range(h) if y < 0.45 * h and sum(1 for (a, x), c in p.items() if a == y and x < 0.2 * w and max(c) - min(c) > 45) >= 1]
    if any(b - a < 3 for a, b in zip(blobs, blobs[2:])) and white >= 3 and rows and rows[0] <= 4:
        steps.add("panel")
        p = {(y, x): c for (y, x), c in p.items() if not (x <= cw + 7 and y <= rows[-1] + 9)}
    mask = {q for q, c in p.items() if max(c) - min(c) <= 26 and 32 <= max(c) <= 250}
    mask = plain_erode(plain_dilate(mask, 2, 2, w, h), 2, 2, w, h)
    gone = {q for part in plain_components(mask) if any(y == 0 or x in (0, w - 1) for y, x in part) for q in part}
    if gone:
        steps.add("background")
        gone = plain_dilate(gone, 3, 3, w, h)
    p = {q: c for q, c in p.items() if q not in gone}
    dark = {q for q, c in p.items() if luma(c) < 215 and q[1] >= 4 and q[0] >= 1}
    spots = []
    for part in plain_components(dark):
        x0, x1, y0, y1 = box(part)
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if 2 <= len(part) <= 9 and 1 <= bw <= 4 and 2 <= bh <= 6 and bh >= 1.25 * bw:
            around = {(y, x) for y in range(max(0, y0 - 1), min(h, y1 + 2)) for x in range(max(0, x0 - 3), min(w, x1 + 4))} - part
            grey = sum(luma(p[q]) <= 235 for q in around if q in p)
            if len(around & dark) <= 1 and (len(around) - grey) / len(around) >= 0.85 and sum(sat(p[q]) for q in part) / len(part) <= 60:
                spots.append((x0, x1, y0, y1))
    if spots:
        steps.add("cursor")
    p = {(y, x): c for (y, x), c in p.items() if not any(a - 3 <= x <= b + 3 and d - 3 <= y <= e + 3 for a, b, d, e in spots)}
    zone = {(y, x): c for (y, x), c in frame.items() if int(w * 0.2) <= x < int(w * 0.8) and int(h * 0.15) <= y < int(h * 0.95) and luma(c) < 200}
    eaten = {q: c for q, c in zone.items() if q not in p}
    back = len(eaten) > 3 and len(eaten) > 0.25 * len(zone)
    return p | (eaten if back else {}), back, steps


def frames_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r.media_id, r.frame_no), {})[r.y, r.x] = (r.b, r.g, r.r)
    return out


def test_cleaning_chain_equals_a_plain_loop(spark):
    before = frames_of(pixels.mixed(spark, DATA).collect())
    r = random.Random(4)
    for f in range(40):  # pages that show the viewer: sparse ones, with swatches on white, icons below and a parked cursor
        page = {(r.randrange(20), r.randrange(51)): (v := r.choice([10, 60, 228, 255]), v, v) for _ in range(r.randrange(12))}
        if f % 2:
            page |= {(2 + r.randrange(2), x): c for x, c in ((1, (250, 20, 20)), (4, (20, 250, 20)), (7, (20, 20, 250)))}
        if f % 3 == 0:
            page |= {(18, x): (200, 30, 30) for x in range(2, 51, 7)}
        if f % 5 == 0:
            page |= {(y, 30): (90, 90, 90) for y in range(8, 11)}
        if f % 7 == 0:
            page |= {(17, 47): (20, 30, 220), (17, 48): (20, 30, 220)}
        before[99, f] = page
    rows = [(m, f, y, x, *c) for (m, f), p in before.items() for (y, x), c in p.items()]
    given = spark.createDataFrame(rows, "media_id long, frame_no long, y long, x long, b long, g long, r long")
    got = frames_of(M.cleaned(given, 51, 20, **pixels.SMALL).collect())
    want = {k: plain_clean(p, 51, 20) for k, p in before.items()}
    assert {b for _, b, _ in want.values()} == {True, False}
    assert set().union(*(s for _, _, s in want.values())) == {"taskbar", "badge", "panel", "background", "cursor"}
    assert got == {k: p for k, (p, _, _) in want.items() if p}


def test_query_of_the_chain(spark):
    got = frames_of(catalogue.QUERIES["cleaned_pages"](spark, DATA).collect())
    want = {k: plain_clean(p, 51, 20)[0] for k, p in frames_of(pixels.mixed(spark, DATA).collect()).items()}
    assert got == {k: p for k, p in want.items() if p}


# ---- holes ---------------------------------------------------------------------------------------


def plain_filled(frame, hole, w, h):
    known = {(y, x): frame.get((y, x), (255, 255, 255)) for y in range(h) for x in range(w) if (y, x) not in hole}
    left, out = set(hole), {}
    while left:
        now = {}
        for y, x in left:
            near = [known[q] for a in (-1, 0, 1) for b in (-1, 0, 1) if (q := (y + a, x + b)) in known]
            if near:
                now[y, x] = tuple(sum(c) // len(near) for c in zip(*near))
        if not now:
            return out | {q: (255, 255, 255) for q in left}
        known |= now
        out |= now
        left -= set(now)
    return out


def test_holes_equal_a_plain_loop(spark):
    r = random.Random(6)
    frames, holes = {}, {}
    for f in range(10):
        frames[0, f] = {(y, x): tuple(r.randrange(256) for _ in range(3)) for y in range(12) for x in range(15) if r.random() < 0.7}
        cy, cx, k = r.randrange(12), r.randrange(15), r.randrange(1, 30)
        holes[0, f] = {(y, x) for y in range(12) for x in range(15) if (y - cy) ** 2 + (x - cx) ** 2 <= k}
    holes[0, 3] = {(y, x) for y in range(12) for x in range(15)}  # all of a frame
    frames[0, 4] = {}
    p = spark.createDataFrame([(*k, *q, *c) for k, f in frames.items() for q, c in f.items()], "media_id long, frame_no long, y long, x long, b int, g int, r int")
    q = spark.createDataFrame([(*k, *s) for k, m in holes.items() for s in m] * 2, "media_id long, frame_no long, y long, x long")
    assert frames_of(M.filled(p, q, 15, 12).collect()) == {k: plain_filled(frames[k], m, 15, 12) for k, m in holes.items()}


def test_query_of_holes(spark):
    page = frames_of(pixels.page(spark, DATA).collect())
    hole = {(y, x) for y in range(20) for x in range(51) if (y - 10) ** 2 + (x - 44) ** 2 <= 20}
    assert frames_of(catalogue.QUERIES["filled_holes"](spark, DATA).collect()) == {k: plain_filled(f, hole, 51, 20) for k, f in page.items()}


def test_ruled_lines_are_no_content(spark):
    """A page border and a ruled line don't set a slide's box; a line that is seen once belongs to the union alone."""
    from tidemark.operators import raster

    ink, frames = [], []
    for f in range(12):
        frames.append((1, f, 0.0))
        ink += [(1, f, y, 3) for y in range(20)] + [(1, f, 1, x) for x in range(30)]  # border and rule
        ink += [(1, f, y, x) for y in range(6, 10) for x in range(8, 14)]
        ink += [(1, f, 15, x) for x in range(8, 14)] if f == 5 else []
    px = spark.createDataFrame([(*r, 0, 0, 0) for r in ink], "media_id long, frame_no long, y long, x long, b int, g int, r int")
    got = raster.slide_extents(spark.createDataFrame(frames, "media_id long, frame_no long, diff double"), px, 50, 30, 20).collect()
    assert [tuple(r) for r in got] == [(1, 0, 8, 1, 8, 6, 9, 1, 15)]


def test_masks_are_dealt_out_once(spark):
    """A chain of steps on bitmaps: one shuffle, the same runs whether pixels or runs are given, and in pieces of any number of frames."""
    cells = [(1, f, y, x) for f in range(7) for y in range(14) for x in range(23) if (f * 31 + y * 7 + x * 5) % 4]
    px = spark.createDataFrame(cells, "media_id long, frame_no long, y long, x long")
    closed = M.close(M.spots(px), 2, 2, 23, 14)
    plan = closed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, closed.collect()))
    assert want == sorted(map(tuple, M.erode(M.dilate(M.row_runs(px), 2, 2, 23, 14), 2, 2, 23, 14).collect())) and want
    assert sorted(map(tuple, M.swept(M.joined(px), lambda m: m, 23, 14).collect())) == sorted(map(tuple, M.row_runs(px).collect()))
