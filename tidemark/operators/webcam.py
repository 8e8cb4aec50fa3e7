"""The webcam's disc in a recording: found by circles whose inside moves, and followed over time.

Pixels are media_id, frame_no, y, x, v (grey); what a table lacks is white. Times are microseconds.

Defined results: a media without circles, or whose circles' inside moves less than `least`, gets the fallback with detected false;
of equal votes, motions and areas the first by y and x (by cluster, by label) counts; a media with fewer than eight frames, or whose
disc is seen in less than half of them, has no shifts; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import morphology as M
from tidemark.operators.events import pinned_edges, rle_locf
from tidemark.operators.groups import key_groups
from tidemark.operators.intervals import point_join
from tidemark.operators.raster import FRAME
from tidemark.operators.signal import greedy_clusters, vote
from tidemark.shared import stored


def _circles(grey: np.ndarray, r_min: int, r_max: int, steep: float, share: float, apart: int) -> list[tuple[int, int, int, int]]:
    """cx, cy, r, votes of the circles of a picture. Each edge pixel votes for the centres along its gradient, in both directions,
    at every radius; a centre's radius is the one at which most of the circle around it is edge."""
    h, w = grey.shape
    around = np.lib.stride_tricks.sliding_window_view(np.pad(grey, 2, mode="edge"), (5, 5))
    smooth = np.pad(np.median(around, axis=(2, 3)), 1, mode="edge")  # a face has many small edges
    gx = (smooth[:-2, 2:] + 2 * smooth[1:-1, 2:] + smooth[2:, 2:] - smooth[:-2, :-2] - 2 * smooth[1:-1, :-2] - smooth[2:, :-2]) / 8
    gy = (smooth[2:, :-2] + 2 * smooth[2:, 1:-1] + smooth[2:, 2:] - smooth[:-2, :-2] - 2 * smooth[:-2, 1:-1] - smooth[:-2, 2:]) / 8
    size = np.hypot(gx, gy)
    ys, xs = np.nonzero(size >= steep)
    if not len(ys):
        return []
    ux, uy = gx[ys, xs] / size[ys, xs], gy[ys, xs] / size[ys, xs]
    votes = np.zeros(h * w, "int64")
    for r in range(r_min, r_max + 1):
        for sign in (1, -1):
            cx, cy = np.rint(xs + sign * r * ux).astype(int), np.rint(ys + sign * r * uy).astype(int)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            votes += np.bincount(cy[ok] * w + cx[ok], minlength=h * w)
    near = np.pad(votes.reshape(h, w), 1)
    votes = sum(near[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1))  # rounding spreads a centre's votes
    edge = np.zeros((h, w), bool)
    edge[ys, xs] = True
    found: list[tuple[int, int, int, int]] = []
    angle = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    order = np.argsort(-votes, axis=None, kind="stable")[:200]
    for at in order.tolist():
        cy, cx = divmod(at, w)
        if votes[cy, cx] < 2 * r_min or any((cx - a) ** 2 + (cy - b) ** 2 < apart * apart for a, b, _, _ in found):
            continue
        best = (0.0, 0)
        for r in range(r_min, r_max + 1):
            px, py = np.rint(cx + r * np.cos(angle)).astype(int), np.rint(cy + r * np.sin(angle)).astype(int)
            ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            # edges are two pixels wide: the mean of three radii tells the middle one
            best = max(best, (float(edge[py[ok], px[ok]].sum()) / len(angle), -r))
        if best[0] >= share:
            near_best = [r for r in range(r_min, r_max + 1) if _ring(edge, cx, cy, r, angle) >= best[0] - 0.05]
            found.append((cx, cy, int(np.rint(np.median(near_best))), int(votes[cy, cx])))
    return found


def _ring(edge: np.ndarray, cx: int, cy: int, r: int, angle: np.ndarray) -> float:
    px, py = np.rint(cx + r * np.cos(angle)).astype(int), np.rint(cy + r * np.sin(angle)).astype(int)
    ok = (px >= 0) & (px < edge.shape[1]) & (py >= 0) & (py < edge.shape[0])
    return float(edge[py[ok], px[ok]].sum()) / len(angle)


def circles(pixels: DataFrame, roi: tuple[int, int, int, int], radii: tuple[int, int], steep: float = 12, share: float = 0.6, apart: int = 120, keys: Sequence[str] = FRAME) -> DataFrame:
    """keys, i (from 0, best first), cx, cy, cr, votes of the circles in a region (x0, x1, y0, y1 inclusive) of each frame. A call
    holds one frame's region."""
    x0, x1, y0, y1 = roi
    head = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        grey = np.full((y1 - y0 + 1, x1 - x0 + 1), 255)
        grey[rows.column("y").to_numpy() - y0, rows.column("x").to_numpy() - x0] = rows.column("v").to_numpy()
        got = _circles(grey, *radii, steep, share, apart)
        if got:
            cx, cy, cr, n = (pa.array(c, pa.int64()) for c in zip(*got))
            names = [rows.column(k).combine_chunks()[:1].take(pa.array([0] * len(got))) for k in keys]
            yield pa.RecordBatch.from_arrays([*names, pa.array(range(len(got)), pa.int64()), pa.array(np.add(cx.to_numpy(), x0)), pa.array(np.add(cy.to_numpy(), y0)), cr, n], [*keys, "i", "cx", "cy", "cr", "votes"])

    here = pixels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select(*keys, F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("long"))
    return key_groups(here, keys, ["y", "x"], work, f"{head}, i long, cx long, cy long, cr long, votes long")


def disc_area(r: Column, cx: Column, cy: Column, width: int, height: int) -> Column:
    """Pixels of a disc that lie in the frame."""

    def row(dy: Column) -> Column:
        half = F.floor(F.sqrt(r * r - dy * dy))
        span = F.least(F.lit(width - 1), cx + half) - F.greatest(F.lit(0), cx - half) + 1
        return F.when((cy + dy).between(0, height - 1), F.greatest(F.lit(0), span)).otherwise(0)

    return F.aggregate(F.sequence(-r, r), F.lit(0).cast("long"), lambda a, dy: a + row(dy).cast("long"))


def find(pixels: DataFrame, pairs: DataFrame, width: int, height: int, radii: tuple[int, int] | None = None, fallback: tuple[int, int, int] = (0, 0, 0), least: float = 1.5, reach: float = 60, apart: int = 120, moving: float = 0.5) -> DataFrame:
    """pixels: a few sampled frames. pairs: media_id, pair, y, x, d (absolute difference of two frames shortly after each other; 0
    where missing). media_id, cx, cy, r, motion, detected: of the circles in the upper right of the frames, clustered by place,
    the one whose inside moves most, its radius grown while the ring at it moves."""
    radii = radii or (int(width * 0.04), int(width * 0.11))
    seen = circles(pixels, (int(width * 0.55), width - 1, 0, int(height * 0.5) - 1), radii, apart=apart)
    seen = seen.withColumn("o", F.row_number().over(Window.partitionBy("media_id").orderBy("frame_no", "i")))
    groups = greedy_clusters(seen.select("media_id", "o", "cx", "cy", "cr"), ["media_id"], "o", reach)
    whole = lambda c: F.floor(c).cast("long")
    groups = stored(groups.select("media_id", "cluster", whole("cx").alias("cx"), whole("cy").alias("cy"), whole("cr").alias("cr")).withColumn("core", F.greatest(F.lit(10), whole(F.col("cr") * 0.7))), "circles")
    every = pairs.select("media_id", "pair").distinct()
    # a media has few clusters: pixels meet them on the media and the row
    rows = groups.withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("cy") - F.col("core")), F.least(F.lit(height - 1), F.col("cy") + F.col("core")))))
    met = rows.join(pairs.select("media_id", "pair", F.col("y").cast("long").alias("y"), "x", "d"), ["media_id", "y"]).where((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= F.col("core") * F.col("core"))
    sums = met.groupBy("media_id", "cluster", "pair").agg(F.sum("d").alias("_d"))
    each = groups.join(every, "media_id").join(sums, ["media_id", "cluster", "pair"], "left")
    moved = each.groupBy("media_id", "cluster", "cx", "cy", "cr", "core").agg(F.median(F.coalesce("_d", F.lit(0)) / disc_area(F.col("core"), F.col("cx"), F.col("cy"), width, height)).alias("motion"))
    best = moved.groupBy("media_id").agg(F.max(F.struct("motion", (-F.col("cluster")).alias("c"), "cx", "cy", "cr")).alias("b")).select("media_id", "b.motion", "b.cx", "b.cy", "b.cr")
    good = stored(best.where(F.col("motion") >= least), "webcams")
    ring = good.withColumn("rr", F.explode(F.sequence(F.greatest(F.lit(20).cast("long"), whole(F.col("cr") * 0.8)), F.lit(int(width * 0.13) - 1).cast("long"), F.lit(2).cast("long"))))
    ring = ring.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(89))))
    turn = F.col("k") * (2 * np.pi / 90)
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v.cast("long")))
    ring = ring.select("media_id", "rr", clip(F.col("cy") + F.col("rr") * F.sin(turn), height - 1).alias("y"), clip(F.col("cx") + F.col("rr") * F.cos(turn), width - 1).alias("x"))
    hits = ring.join(pairs.select("media_id", "pair", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "d"), ["media_id", "y", "x"]).groupBy("media_id", "rr", "pair").agg((F.sum("d") / 90).alias("_m"))
    ringed = ring.select("media_id", "rr").distinct().join(every, "media_id").join(hits, ["media_id", "rr", "pair"], "left").groupBy("media_id", "rr").agg(F.median(F.coalesce("_m", F.lit(0.0))).alias("_m")).where(F.col("_m") > moving)
    wide = ringed.groupBy("media_id").agg((F.max("rr") + 4).alias("_r"))
    found = good.join(wide, "media_id", "left").select("media_id", "cx", "cy", F.greatest("cr", F.coalesce("_r", F.lit(0).cast("long"))).alias("r"), "motion", F.lit(True).alias("detected"))
    rest = pixels.select("media_id").distinct().join(found, "media_id", "left_anti").select("media_id", *[F.lit(v).cast("long").alias(c) for c, v in zip(("cx", "cy", "r"), fallback)], F.lit(0.0).alias("motion"), F.lit(False).alias("detected"))
    return found.unionByName(rest)


def disc_places(pixels: DataFrame, discs: DataFrame, width: int, height: int, below: int = 210, pad: int = 70, opening: int = 3) -> DataFrame:
    """discs: media_id, cx, cy, r. media_id, frame_no, x, y: the centre of the largest dark blob around a media's disc in each frame, after an
    opening, where it is a disc of about that size."""
    d = discs.select("media_id", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("r").alias("_r"))
    dark = pixels.where(F.col("v") < below).join(d, "media_id").where((F.abs(F.col("x") - F.col("_cx")) <= F.col("_r") + pad) & (F.abs(F.col("y") - F.col("_cy")) <= F.col("_r") + pad))
    opened = M.open_(M.joined(dark), opening, opening, width, height)
    blobs = M.run_components(opened).groupBy(*FRAME, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    big = blobs.groupBy(*FRAME).agg(F.max(F.struct("n", (-F.col("label")).alias("l"), "x0", "x1", "y0", "y1")).alias("b")).select(*FRAME, "b.*").join(d, "media_id")
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fill = F.col("n") / (w * h)
    disc = (F.abs(w - h) <= F.greatest(F.lit(3.0), F.col("_r") * 0.08)) & (fill > 0.70) & (fill < 0.86) & (F.abs((w + h) / 4 - F.col("_r")) <= F.col("_r") * 0.10)
    return big.where(disc).select(*FRAME, (F.col("x0") + w / 2).alias("x"), (F.col("y0") + h / 2).alias("y"))


def track(frames: DataFrame, places: DataFrame, step: int = 500_000, min_shift: int = 6, min_len: int = 800_000, fine: DataFrame | None = None) -> DataFrame:
    """frames: media_id, frame_no, t_us (each sampled frame). places: media_id, frame_no, x, y (where the disc was seen). When the disc stood away
    from its median place: media_id, t0, t1, dx, dy. Lost frames carry the last place on, phases need `min_len`, `min_shift` on an axis
    and the votes of four fifths of their frames. fine: media_id, t_us, x, y seen more densely moves their edges."""
    seen = frames.join(places, list(FRAME), "left")
    home = seen.groupBy("media_id").agg(F.count("*").alias("_n"), F.count("x").alias("_k"), F.median("x").alias("_hx"), F.median("y").alias("_hy")).where((F.col("_n") >= 8) & (F.col("_k") >= 0.5 * F.col("_n"))).drop("_n", "_k")
    off = stored(seen.join(home, "media_id").select("media_id", "t_us", (F.col("x") - F.col("_hx")).alias("dx"), (F.col("y") - F.col("_hy")).alias("dy")), "disc-places")
    # before the first sight the disc stands at home
    first = Window.partitionBy("media_id").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0)
    known = F.count("dx").over(first) > 0
    steady = off.select("media_id", "t_us", *[F.when(known, F.col(c)).otherwise(0.0).alias(c) for c in ("dx", "dy")])
    runs = rle_locf(steady, ["media_id"], ["t_us"], ["dx", "dy"], "t_us").select("media_id", F.col("start").alias("start_us"), (F.col("last") + step).alias("end_us"), F.col("dx").alias("px"), F.col("dy").alias("py"))
    moved = runs.where((F.col("end_us") - F.col("start_us") >= min_len) & (F.greatest(F.abs("px"), F.abs("py")) >= min_shift))
    inside = point_join(off.where("dx IS NOT NULL"), moved.withColumn("_e", F.col("end_us")), closed=False).select("media_id", "start_us", "end_us", "px", "py", "dx", "dy")
    sure = vote(inside, ["media_id", "start_us", "end_us", "px", "py"], "dx", "dy")
    spans = sure.select("media_id", F.col("start_us").alias("t0"), F.col("end_us").alias("t1"), F.col("px").cast("long").alias("dx"), F.col("py").cast("long").alias("dy"))
    if fine is None:
        return spans
    w = Window.partitionBy("media_id").orderBy("t0")
    last = frames.groupBy("media_id").agg((F.max("t_us") + step).alias("_end"))
    spans = spans.join(last, "media_id").select("media_id", F.row_number().over(w).alias("span"), F.col("t0").alias("a"), F.col("t1").alias("b"), F.coalesce(F.lag("t1").over(w), F.lit(0).cast("long")).alias("lo"), F.coalesce(F.lead("t0").over(w), F.col("_end")).alias("hi"), "dx", "dy")
    near = fine.join(home, "media_id").select("media_id", F.col("t_us").alias("t"), (F.bround((F.col("x") - F.col("_hx")) / 2) * 2).alias("fx"), (F.bround((F.col("y") - F.col("_hy")) / 2) * 2).alias("fy"))
    fits = near.join(spans, "media_id").where((F.col("t").between(F.col("a") - 1_000_000, F.col("b") + 1_000_000)) & (F.abs(F.col("fx") - F.col("dx")) <= 2) & (F.abs(F.col("fy") - F.col("dy")) <= 2)).select("media_id", "span", "t")
    edges = pinned_edges(spans.select("media_id", "span", "a", "b", "lo", "hi"), fits, ["media_id", "span"])
    return edges.join(spans.select("media_id", "span", "dx", "dy"), ["media_id", "span"])
