"""Quality checks over feature rows: each rule is a frame of findings (media_id, level, kind, t, msg), all are
united, and a media's verdict rolls them up. A rule whose input is missing becomes a finding itself.

Samples go by t; those of equal t by event_id where the rows have it, so that a run gives the same findings each time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import events as E, intervals as I

FINDING = ("media_id", "level", "kind", "t", "msg")
K = ["media_id"]


def in_order(rows: DataFrame) -> list[str]:
    """The columns that order a media's samples."""
    return [c for c in ("t", "event_id") if c in rows.columns]


def finding(rows: DataFrame, level: str | Column, kind: str, t: Column | None, msg: str) -> DataFrame:
    """Findings of rows; t in seconds, null for the whole video."""
    when = t.cast("double") if t is not None else F.lit(None).cast("double")
    return rows.select("media_id", (F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(kind).alias("kind"), when.alias("t"), F.lit(msg).alias("msg"))


def held_rule(features: DataFrame, flag: Column, least: int, kind: str, msg: str, wait: float = 8.0, back: float = 0.0, level: str = "warn") -> DataFrame:
    """A condition that holds for `least` samples in a row fires, and is then silent for `wait` seconds."""
    fired = E.persistent(features, K, in_order(features), flag, least).select("media_id", "t")
    return finding(E.cooldown(fired, K, "t", wait), level, kind, F.col("t") - back, msg)


def top_cut(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("top_ink") > 12, 2, "top-cut", "content is cut off at the top edge", 8, 0.5)


def bottom_cut(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("bottom_ink") > 12, 4, "bottom-cut", "content touches the bottom edge", 8, 1.5)


def webcam_overlap(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("overlap_ink") > 6, 2, "webcam-overlap", "content runs into the webcam", 8, 0.5)


def corner_speck(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("speck_px").between(1, 60), 16, "corner-speck", "a small mark stays in the corner", 20, 8.0)


def ui_panel(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("panel_px") > 25, 1, "ui-panel", "a tool panel is visible", 8)


def corner_badge(features: DataFrame) -> DataFrame:
    return held_rule(features, F.col("red_px") > 15, 1, "corner-junk", "a red badge is in the corner", 8)


def corner_strip(columns: DataFrame, width: int = 480, area: int = 14 * 420) -> DataFrame:
    """columns: media_id, t, x, n (coloured pixels of a column of the bottom band). Specks that spread from edge to
    edge, or a spaced row of them, unless the band is dense."""
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("media_id", "t").orderBy("x"))
    rows = columns.where("n > 0").withColumn("_gap", gap)
    s = rows.groupBy("media_id", "t").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("_gap") > 3).alias("gaps"))
    sparse = F.col("n") <= area * 0.30
    spread = (F.col("c") > 30) & (F.col("lo") < width * 0.2 - 60) & (F.col("hi") > width * 0.8 - 60)
    spaced = (F.col("n") > 12) & (F.col("c") > 12) & (F.col("hi") - F.col("lo") > width * 0.3) & (F.col("gaps") >= 4)
    fired = s.where(sparse & (spread | spaced)).select("media_id", "t")
    return finding(E.cooldown(fired, K, "t", 8), "warn", "corner-junk", F.col("t"), "a strip of icons is along the bottom")


def bottom_missing(slides: DataFrame, limit: int = 1088) -> DataFrame:
    """slides: predicted and actual bottom (null if none was seen), scale, t. Below the frame it fails; short of the prediction by over 45 scaled pixels it warns."""
    over, short = F.col("predicted") > limit, F.col("predicted") - F.col("actual") > 45 * F.col("scale")
    rows = slides.where(over | F.coalesce(short, F.lit(False)))
    return finding(rows, F.when(over, "fail").otherwise("warn"), "bottom-missing", F.col("t"), "the bottom of a slide is missing")


def slide_ink(slides: DataFrame, frames: DataFrame) -> DataFrame:
    """slides: media_id, slide, t0, t1; frames: media_id, t, top, bottom (ink of the output). The ink of the frame shown late in
    each slide, at the later of its middle and 1.5 seconds before its end; null where no frame came before. Of frames of equal t
    the first by event_id counts."""
    at = slides.withColumn("t", F.greatest((F.col("t0") + F.col("t1")) / 2, F.col("t1") - 1.5))
    return I.as_of(at, frames, K, "t", ["top", "bottom"], then=in_order(frames)[1:])


def content_missing(cells: DataFrame, least: int = 120, cells_needed: int = 4) -> DataFrame:
    """cells: media_id, slide, t, src, out (ink of a grid cell). Ratios of inked cells against their slide's median."""
    inked = cells.where(F.col("src") >= least).withColumn("ratio", F.col("out") / F.col("src"))
    s = inked.groupBy("media_id", "slide").agg(F.count("*").alias("n"), F.median("ratio").alias("med"), F.min("ratio").alias("low"), F.min("t").alias("t"))
    bad = s.where((F.col("n") >= cells_needed) & (F.col("med") > 0.2) & (F.col("low") < 0.35 * F.col("med")))
    return finding(bad, "warn", "content-missing", F.col("t"), "part of a slide is missing")


def not_centred(slides: DataFrame) -> DataFrame:
    """slides: t0, t1, top, bottom, height of the frame. Small slides that don't grow into the next."""
    w = Window.partitionBy("media_id").orderBy("t0")
    grows = (F.lead("t0").over(w) - F.col("t1") < 3) & (F.abs(F.lead("top").over(w) - F.col("top")) < 30) & (F.lead("bottom").over(w) > F.col("bottom") + 80)
    off = F.abs((F.col("height") - F.col("bottom")) - F.col("top")) > 170
    rows = slides.withColumn("_g", F.coalesce(grows, F.lit(False))).where(~F.col("_g") & (F.col("bottom") - F.col("top") < 700) & off)
    return finding(rows, "warn", "slide-not-centred", F.col("t0"), "a slide is not centred")


def av_sync(streams: DataFrame, limit: float = 0.5) -> DataFrame:
    d = streams.groupBy("media_id").agg(F.max(F.when(F.col("codec_type") == "video", F.col("duration"))).alias("v"), F.max(F.when(F.col("codec_type") == "audio", F.col("duration"))).alias("a"))
    return finding(d.where(F.abs(F.col("v") - F.col("a")) > limit), "fail", "av-sync", None, "audio and video differ in length")


def audio_dip(loudness: DataFrame, window: float = 0.5, enter: float = 6, stay: float = 4, min_s: float = 1.5) -> DataFrame:
    """loudness: win_no, db, speech. Runs well below the median of speech."""
    med = loudness.where("speech").groupBy("media_id").agg(F.median("db").alias("_m"))
    rows = loudness.join(med, "media_id")
    quiet = lambda x: F.col("speech") & (F.col("db") < F.col("_m") - x)
    dips = E.hysteresis(rows, K, ["win_no"], quiet(enter), quiet(stay), "win_no").where(F.col("n") * window >= min_s)
    return finding(dips, "warn", "audio-dip", F.col("start") * window, "speech drops in level")


def freeze(features: DataFrame, loudness: DataFrame, least: int = 6, window: float = 0.5, floor: float = -45) -> DataFrame:
    """Still picture over sound, reported once motion resumes. loudness is looked up by window number."""
    r = E.runs(features, K, in_order(features), F.col("diff_max") < 2, least, "t", emit_open_run=False)
    near = r.withColumn("win_no", F.floor(F.col("start") / window)).join(loudness.select("media_id", "win_no", "db"), ["media_id", "win_no"])
    return finding(near.where(F.col("db") > floor), "warn", "freeze", F.col("start"), "the picture stands still")


def webcam_static(features: DataFrame, least: int = 8) -> DataFrame:
    r = E.runs(features, K, in_order(features), F.col("cam_diff") < 0.4, least, "t", emit_open_run=False)
    return finding(r, "warn", "webcam-static", F.col("start"), "the webcam stands still")


def bridge_too_long(pairs: DataFrame, min_s: float = 3.0) -> DataFrame:
    """pairs: t, out_diff, src_diff of output and source frames. Open runs count."""
    r = E.runs(pairs, K, in_order(pairs), (F.col("out_diff") < 0.6) & (F.col("src_diff") > 3.0), 1, "t")
    return finding(r.where(F.col("last") - F.col("start") >= min_s), "warn", "bridge-too-long", F.col("start"), "the output holds still over a moving source")


def islands_rule(hits: DataFrame, kind: str, msg: str, gap: float, max_len: float | None = None, level: str = "warn") -> DataFrame:
    """Islands of hit times (t) no further apart than gap, no longer than max_len."""
    i = E.hit_islands(hits, K, "t", gap)
    return finding(i if max_len is None else i.where(F.col("last") - F.col("start") <= max_len), level, kind, F.col("start"), msg)


def transition_junk(hits: DataFrame) -> DataFrame:
    return islands_rule(hits, "transition-junk", "a dark bar crosses the slide", 0.51, 1.5)


def ui_popup(hits: DataFrame) -> DataFrame:
    return islands_rule(hits, "ui-popup", "a popup is visible", 1.5, 8.0)


def cursor_visible(hits: DataFrame) -> DataFrame:
    return islands_rule(hits, "cursor-visible", "the cursor is visible", 8.0)


def crop_gap(sectors: DataFrame, degrees: int = 40, sector: int = 20) -> DataFrame:
    """sectors: t, s (sector number), clear. An arc of clear sectors in a row of at least so many degrees."""
    arcs = E.longest_run(sectors, ["media_id", "t"], "s", F.col("clear")).where(F.col("longest") * sector >= degrees)
    return islands_rule(arcs, "webcam-crop-gap", "the webcam's edge shows", 8.0, level="fail")


def face_rules(faces: DataFrame, least: int = 4, off: float = 45, tight: float = 0.72) -> DataFrame:
    """faces: dx, dy, size. Medians over a video with enough faces."""
    m = faces.groupBy("media_id").agg(F.count("*").alias("n"), F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.median("size").alias("size")).where(F.col("n") >= least)
    a = finding(m.where(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) > off), "warn", "webcam-off-centre", None, "the face is off centre")
    return a.unionByName(finding(m.where(F.col("size") > tight), "warn", "webcam-tight", None, "the face fills the webcam"))


#: Each rule with the input that it reads.
RULES: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "top-cut": (top_cut, ("features",)), "bottom-cut": (bottom_cut, ("features",)), "webcam-overlap": (webcam_overlap, ("features",)),
    "corner-speck": (corner_speck, ("features",)), "ui-panel": (ui_panel, ("features",)), "corner-badge": (corner_badge, ("features",)),
    "corner-strip": (corner_strip, ("columns",)), "bottom-missing": (bottom_missing, ("slides",)), "content-missing": (content_missing, ("cells",)),
    "slide-not-centred": (not_centred, ("spans",)), "av-sync": (av_sync, ("streams",)), "audio-dip": (audio_dip, ("loudness",)),
    "freeze": (freeze, ("features", "levels")), "webcam-static": (webcam_static, ("features",)), "bridge-too-long": (bridge_too_long, ("pairs",)),
    "transition-junk": (transition_junk, ("bars",)), "ui-popup": (ui_popup, ("popups",)), "cursor-visible": (cursor_visible, ("cursors",)),
    "webcam-crop-gap": (crop_gap, ("sectors",)), "webcam-faces": (face_rules, ("faces",)),
}


def check(media: DataFrame, inputs: Mapping[str, DataFrame], rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """Findings of all rules over their inputs, by name. A rule whose input is missing, or can't be planned over it, is a
    qa-error for every media; a rule that fails while it runs fails the job, so that no finding is lost unseen."""

    def run(name: str) -> DataFrame:
        rule, needs = RULES[name]
        missing = [x for x in needs if x not in inputs]
        return finding(media, "warn", "qa-error", None, f"{name}: no {missing[0]}") if missing else rule(*(inputs[x] for x in needs))

    return united({name: (lambda name=name: run(name)) for name in rules}, media)


def united(rules: Mapping[str, Callable[[], DataFrame]], media: DataFrame) -> DataFrame:
    """Findings of all rules. One that can't be planned over its input is a qa-error for every media."""
    out = None
    for name, rule in rules.items():
        try:
            found = rule()
        except AnalysisException as e:
            found = finding(media, "warn", "qa-error", None, f"{name}: {e.getCondition()}")
        out = found if out is None else out.unionByName(found)
    return out


def verdict(findings: DataFrame, media: DataFrame) -> DataFrame:
    """fail if any finding fails, else warn if there is one, else pass."""
    f = findings.groupBy("media_id").agg(F.bool_or(F.col("level") == "fail").alias("_f"), F.count("*").alias("n"))
    got = media.select("media_id").distinct().join(f, "media_id", "left")
    return got.select("media_id", F.when(F.col("_f"), "fail").when(F.col("n") > 0, "warn").otherwise("pass").alias("result"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"))


def summary(findings: DataFrame, skip: Sequence[str] = ("audio-dip",), most: int = 6) -> DataFrame:
    """A media's first findings as one text, without the kinds in skip."""
    rows = findings.where(~F.col("kind").isin(*skip))
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("t", F.lit(-1.0)).alias("t"), "kind"))), 1, most)
    return rows.groupBy("media_id").agg(F.array_join(F.transform(first, lambda x: x["kind"]), "; ").alias("text"))
