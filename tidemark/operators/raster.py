"""Detectors over sparse pixels (media_id, frame_no, y, x, b, g, r) and blobs: masks and boxes are
filters and aggregates; components are a small fold for each frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.events import segment_on_change, trimmed_segments
from tidemark.operators.groups import key_groups
from tidemark.operators.signal import median_mad, saturating_count, seen_often

FRAME = ("media_id", "frame_no")


def grey() -> Column:
    return (F.col("b") + F.col("g") + F.col("r")) / 3


def saturation() -> Column:
    return F.greatest("b", "g", "r") - F.least("b", "g", "r")


def is_background() -> Column:
    """Neutral grey, light or dark, that a cleaner may whiten."""
    g = F.floor(grey())
    return (saturation() <= 26) & (g.between(125, 250) | g.between(32, 124))


def ink_box(pixels: DataFrame, below: int = 200, keys: Sequence[str] = FRAME) -> DataFrame:
    """Bounding box and count of dark pixels."""
    return pixels.where(grey() < below).groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))


def badge_boxes(pixels: DataFrame, width: int, height: int, least: int = 25, pad: int = 14, corner: tuple[int, int] = (130, 90)) -> DataFrame:
    """Box of warm pixels in the lower right corner, padded and clipped, where there are enough."""
    zone = pixels.where((F.col("x") >= width - corner[0]) & (F.col("y") >= height - corner[1]) & (F.col("r") > 140) & (F.col("r") - F.col("b") > 50))
    box = zone.groupBy(*FRAME).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).where(F.col("n") >= least)
    return box.select(*FRAME, F.greatest(F.col("x0") - pad, F.lit(0)).alias("x0"), F.least(F.col("x1") + pad, F.lit(width - 1)).alias("x1"), F.greatest(F.col("y0") - pad, F.lit(0)).alias("y0"), F.least(F.col("y1") + pad, F.lit(height - 1)).alias("y1"), "n")


def taskbar_frames(pixels: DataFrame, width: int, bins: int = 24, over: int = 40, least: int = 12, fill: float = 0.35, area: int = 48 * 1920) -> DataFrame:
    """Frames whose coloured pixels fill enough of the bins across the bottom, but not the band."""
    c = pixels.where(saturation() > 45).groupBy(*FRAME, F.floor(F.col("x") * bins / width).alias("bin")).agg(F.count("*").alias("n"))
    f = c.groupBy(*FRAME).agg(F.count_if(F.col("n") > over).alias("busy"), F.sum("n").alias("n"))
    return f.where((F.col("busy") >= least) & (F.col("n") < fill * area)).select(*FRAME, "busy")


def icon_rows(blobs: DataFrame, height: int = 14, spread: int = 250) -> DataFrame:
    """Frames with five blobs in a row (by y) within a height, whose x spread is wide; the first such row decides."""
    w = Window.partitionBy(*FRAME).orderBy("y", "x")
    xs = F.collect_list("x").over(w.rowsBetween(0, 4))
    rows = blobs.withColumns({"_h": F.lead("y", 4).over(w) - F.col("y"), "_x": xs, "_i": F.row_number().over(w)}).where(F.col("_h") <= height)
    first = rows.groupBy(*FRAME).agg(F.min_by("_x", "_i").alias("_x"))
    return first.where(F.array_max("_x") - F.array_min("_x") > spread).select(*FRAME)


def content_bounds(rows: DataFrame, least: int = 15) -> DataFrame:
    """rows: media_id, frame_no, y, n (inked pixels). Second and 98th percentile of the first and last inked row."""
    f = rows.where(F.col("n") > least).groupBy(*FRAME).agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    return f.groupBy("media_id").agg(F.percentile("top", 0.02).alias("top"), F.percentile("bottom", 0.98).alias("bottom"))


def repairs(pixels: DataFrame, keys: Sequence[str], value: str, stray: float = 26, steady: float = 12) -> DataFrame:
    """Samples that stray from the median of their cell where the cell is steady."""
    p = median_mad(pixels, keys, value)
    return pixels.join(p, list(keys)).where((F.abs(F.col(value) - F.col("median")) > stray) & (F.col("mad") < steady))


def fit_scale(top: Column, bottom: Column, available: float, spec: float, floor: float) -> Column:
    """The slide's scale: as specified, or as large as fits, not below the floor. A slide of no height counts as one pixel."""
    return F.greatest(F.lit(floor), F.least(F.lit(spec), F.lit(available) / F.greatest(F.lit(1.0), bottom - top)))


def slide_overrides(slides: DataFrame, cx: float, cy: float, radius: float, spec: float = 1.0, floor: float = 0.6, step: float = 0.01) -> DataFrame:
    """slides: slide, x1, y1 (a corner that may reach under the webcam). The largest scale at which it
    doesn't; slides that fit as they are have none."""
    n = int(round((spec - floor) / step))
    tries = slides.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("scale", F.bround(F.lit(spec) - F.col("k") * step, 2))
    clear = (F.col("x1") * F.col("scale") - cx) ** 2 + (F.col("y1") * F.col("scale") - cy) ** 2 > radius * radius
    best = tries.where(clear).groupBy("slide").agg(F.max("scale").alias("scale"))
    return slides.select("slide").join(best, "slide", "left").select("slide", F.coalesce("scale", F.lit(floor)).alias("scale")).where(F.col("scale") < spec)


def panel_view(faces: DataFrame, diameter: float, share: float = 0.55) -> DataFrame:
    """Crop size around the median face: share of the face's size, between 0.72 and 1 of the diameter."""
    m = faces.groupBy("media_id").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.median("w").alias("w"))
    return m.select("media_id", "x", "y", F.greatest(F.lit(0.72 * diameter), F.least(F.lit(diameter), F.col("w") / share)).alias("size"))


def components(pixels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """8-connected components of the pixels of each frame: label (place of its first pixel, by y and x, from 0), n and box. A
    frame's pixels are bounded by its size; a call takes several frames."""
    head = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pdf = rows.to_pandas()
        frame = pdf.groupby(list(keys), sort=False).ngroup().to_numpy()
        y, x = pdf["y"].to_numpy("int64"), pdf["x"].to_numpy("int64")
        place = dict(zip(zip(frame.tolist(), y.tolist(), x.tolist()), range(len(y))))
        pairs = [(i, place[q]) for (f, a, b), i in place.items() for q in ((f, a, b + 1), (f, a + 1, b - 1), (f, a + 1, b), (f, a + 1, b + 1)) if q in place]
        label = np.arange(len(y))
        if pairs:
            u, v = np.array(pairs).T
            while True:
                low = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        first = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
        pdf["label"] = label - first[frame]
        out = pdf.groupby([*keys, "label"], as_index=False, sort=False).agg(n=("x", "size"), x0=("x", "min"), x1=("x", "max"), y0=("y", "min"), y1=("y", "max"))
        yield pa.RecordBatch.from_pandas(out.astype({c: "int64" for c in ("label", "n", "x0", "x1", "y0", "y1")}), preserve_index=False)

    return key_groups(pixels.select(*keys, "y", "x").distinct(), keys, ["y", "x"], run, f"{head}, label long, n long, x0 long, x1 long, y0 long, y1 long", least=20_000)


def bubble_shifts(runs: DataFrame, min_len: int = 800_000, min_shift: int = 6) -> DataFrame:
    """runs: media_id, x, y, start, last (equal positions merged). Phases off the median home position by at least
    min_shift on an axis and long enough: media_id, t0, t1, dx, dy. Touching equal phases stay apart."""
    home = runs.groupBy("media_id").agg(F.median("x").alias("_hx"), F.median("y").alias("_hy"))
    d = runs.join(home, "media_id").select("media_id", F.col("start").alias("t0"), F.col("last").alias("t1"), (F.col("x") - F.col("_hx")).alias("dx"), (F.col("y") - F.col("_hy")).alias("dy"))
    return d.where((F.col("t1") - F.col("t0") >= min_len) & (F.greatest(F.abs("dx"), F.abs("dy")) >= min_shift))


def cursor_like(blobs: DataFrame, area: tuple[int, int] = (25, 400), near: int = 25, halo: float = 0.9, sat: float = 60) -> DataFrame:
    """Blobs (n, x0..y1, near: other pixels around, halo: white share of the ring, sat) that look like a cursor."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return blobs.where(F.col("n").between(*area) & (h >= 1.25 * w) & (F.col("near") <= near) & (F.col("halo") >= halo) & (F.col("sat") <= sat))


def nearest(candidates: DataFrame, keys: Sequence[str], x: float, y: float) -> DataFrame:
    """Of each key's circles (cx, cy, cr) the one nearest to x, y by the sum of distances; of equal ones the first by cx, cy."""
    d = F.abs(F.col("cx") - x) + F.abs(F.col("cy") - y)
    best = candidates.groupBy(*keys).agg(F.min(F.struct(d.alias("d"), "cx", "cy", "cr")).alias("m"))
    return best.select(*keys, "m.cx", "m.cy", "m.cr")


def largest(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key's boxes (x, y, w, h) the one of largest area; of equal ones the first by y, x."""
    best = boxes.groupBy(*keys).agg(F.max(F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("y")).alias("_y"), (-F.col("x")).alias("_x"), "w", "h")).alias("m"))
    return best.select(*keys, (-F.col("m._x")).alias("x"), (-F.col("m._y")).alias("y"), "m.w", "m.h")


def panel_rows(pixels: DataFrame, width: int, height: int, busy: int = 3, top: int = 130, share: tuple[float, float] = (0.20, 0.45)) -> DataFrame:
    """A tool panel in the upper left corner: rows of the corner (share of width and height) with at least `busy` coloured
    pixels, where the first of them is no lower than top: keys, y0, y1, n."""
    corner = pixels.where((F.col("x") < share[0] * width) & (F.col("y") < share[1] * height) & (saturation() > 45))
    rows = corner.groupBy(*FRAME, "y").agg(F.count("*").alias("_c")).where(F.col("_c") >= busy)
    return rows.groupBy(*FRAME).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).where(F.col("y0") <= top)


def whitened(pixels: DataFrame, strip: int = 52) -> DataFrame:
    """Pixels with the top strip white."""
    return pixels.withColumns({c: F.when(F.col("y") < strip, F.lit(255)).otherwise(F.col(c)) for c in ("b", "g", "r")})


def dark_rows(pixels: DataFrame, width: int, share: float = 0.40, below: int = 90, most: int = 4) -> DataFrame:
    """Frames in which a thin bar crosses: between one and `most` rows whose share of dark pixels exceeds share."""
    rows = pixels.groupBy(*FRAME, "y").agg(F.count_if(grey() < below).alias("_d")).where(F.col("_d") > share * width)
    return rows.groupBy(*FRAME).agg(F.count("*").alias("n_rows"), F.min("y").alias("y0"), F.max("y").alias("y1")).where(F.col("n_rows") <= most)


def padded_box(boxes: DataFrame, scale: float, pad_x: int, pad_y: int, width: int, height: int) -> DataFrame:
    """Boxes (x0, y0, x1, y1) of a scaled picture in full size, padded and clipped to the frame."""
    up = lambda c, d, hi: F.greatest(F.lit(0), F.least(F.lit(hi), F.floor(F.col(c) / scale).cast("long") + d))
    return boxes.withColumns({"x0": up("x0", -pad_x, width), "y0": up("y0", -pad_y, height), "x1": up("x1", pad_x, width), "y1": up("y1", pad_y, height)})


def still_geometry(slides: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """slides: slide, w, h (source), scale, cx, cy (where its centre goes). Scaled size, and the part that lies on the canvas:
    out_w, out_h, x, y (upper left corner on the canvas), crop_x, crop_y (first column and row used), use_w, use_h."""
    s = slides.withColumns({"out_w": F.bround(F.col("w") * F.col("scale")).cast("long"), "out_h": F.bround(F.col("h") * F.col("scale")).cast("long")})
    s = s.withColumns({"_x": F.col("cx") - F.floor(F.col("out_w") / 2), "_y": F.col("cy") - F.floor(F.col("out_h") / 2)})
    zero = F.lit(0)
    s = s.withColumns({"x": F.greatest(zero, F.col("_x")), "y": F.greatest(zero, F.col("_y")), "crop_x": F.greatest(zero, -F.col("_x")), "crop_y": F.greatest(zero, -F.col("_y"))})
    use = lambda c, crop, at, size: F.greatest(zero, F.least(F.col(c) - F.col(crop), F.lit(size) - F.col(at)))
    return s.select("slide", "out_w", "out_h", "x", "y", "crop_x", "crop_y", use("out_w", "crop_x", "x", width).alias("use_w"), use("out_h", "crop_y", "y", height).alias("use_h"))


def recenters(phases: DataFrame, home: float, least: float = 24, min_len: float = 2_500_000) -> DataFrame:
    """phases: media_id, slide, start, end, top, bottom. Shifts that bring a phase's middle to home, where the phase lasts and
    the shift is more than least: media_id, slide, start, end, dy."""
    dy = F.lit(home) - (F.col("top") + F.col("bottom")) / 2
    return phases.where((F.col("end") - F.col("start") >= min_len) & (F.abs(dy) > least)).select("media_id", "slide", "start", "end", dy.alias("dy"))


def slide_scan(frames: DataFrame, pixels: DataFrame, jump: float, least: int = 3) -> DataFrame:
    """Slides of sampled frames and what stands on them. frames: media_id, frame_no, diff (from the frame before); a new slide
    begins where diff exceeds jump. Frames at either end of a slide are left out, slides with fewer than `least` samples
    too, and ink counts where it is seen in enough of the samples: media_id, slide, samples, first_frame, last_frame, box, n_cells."""
    own = ["media_id", "slide"]
    kept = trimmed_segments(segment_on_change(frames, ["media_id"], ["frame_no"], F.col("diff") > jump), own, ["frame_no"])
    slides = kept.groupBy(*own).agg(F.count("*").alias("samples"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame")).where(F.col("samples") >= least)
    ink = pixels.where(grey() < 200).select(*FRAME, "y", "x").distinct().join(kept.select(*FRAME, "slide"), list(FRAME))
    cells = ink.groupBy(*own, "y", "x").agg(saturating_count(F.lit(True)).alias("seen")).join(slides.select(*own, "samples"), own)
    often = cells.where(seen_often(F.col("seen"), F.col("samples")))
    box = often.groupBy(*own).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n_cells"))
    return slides.join(box, own, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0).cast("long")))


def slide_extents(frames: DataFrame, pixels: DataFrame, jump: float, width: int, height: int, least: int = 3, row: int = 3, most: float = 0.5) -> DataFrame:
    """Slides as in slide_scan, with two boxes of rows. top, bottom: the rows with more than `row` cells of lasting ink, once columns and
    then rows that are inked over more than `most` of the picture are left out, since ruled lines and page borders aren't content.
    union_top, union_bottom: what was ever visible in one of the slide's frames but its first, faint ink too. Slides without lasting ink
    have no row here: media_id, slide, samples, first_frame, last_frame, top, bottom, union_top, union_bottom."""
    own = ["media_id", "slide"]
    numbered = segment_on_change(frames, ["media_id"], ["frame_no"], F.col("diff") > jump)
    kept = trimmed_segments(numbered, own, ["frame_no"])
    slides = kept.groupBy(*own).agg(F.count("*").alias("samples"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame")).where(F.col("samples") >= least)
    ink = pixels.where(grey() < 200).select(*FRAME, "y", "x").distinct().join(kept.select(*FRAME, "slide"), list(FRAME))
    cells = ink.groupBy(*own, "y", "x").agg(saturating_count(F.lit(True)).alias("seen")).join(slides.select(*own, "samples"), own)
    often = cells.where(seen_often(F.col("seen"), F.col("samples"))).select(*own, "y", "x")
    ruled = often.groupBy(*own, "x").agg(F.count("*").alias("_n")).where(F.col("_n") > most * height).select(*own, "x")
    rows = often.join(ruled, [*own, "x"], "left_anti").groupBy(*own, "y").agg(F.count("*").alias("_n")).where((F.col("_n") <= most * width) & (F.col("_n") > row))
    box = rows.groupBy(*own).agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    seen = trimmed_segments(numbered, own, ["frame_no"], tail=0).select(*FRAME, "slide")
    faint = pixels.where(grey() < 238).select(*FRAME, "y", "x").distinct().groupBy(*FRAME, "y").agg(F.count("*").alias("_n")).where(F.col("_n") > row)
    ever = faint.join(seen, list(FRAME)).groupBy(*own).agg(F.min("y").alias("_t"), F.max("y").alias("_b"))
    out = slides.join(box, own).join(ever, own, "left")
    return out.select(*own, "samples", "first_frame", "last_frame", "top", "bottom", F.least("top", "_t").alias("union_top"), F.greatest("bottom", "_b").alias("union_bottom"))
