"""Quality rules over feature rows made from events: a user is a media, hours since its first event are seconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators.positions import zipped
from tidemark.plans.base import EV, SQL, events, query, table, with_

S = with_(EV) + ", s AS (SELECT media_id, event_id, event_type, value, (t - min(t) OVER (PARTITION BY media_id)) // 3600000000 + (event_id % 1000) / 1000.0::DOUBLE AS t FROM ev)"


def features(spark, d):
    e = events(spark, d)
    t = F.floor((F.col("t_us") - F.min("t_us").over(Window.partitionBy("media_id"))) / 3_600_000_000) + (F.col("event_id") % 1000) / 1000.0
    return e.select("media_id", "event_id", "event_type", "value", t.cast("double").alias("t"))


def _msg(level, kind, msg, src):
    return f"SELECT media_id, {level} AS level, '{kind}' AS kind, t::DOUBLE AS t, '{msg}' AS msg FROM ({src})"


def _held(flag: str, least: int, kind: str, msg: str, wait: float, back: float = 0.0) -> str:
    """A flag held for `least` samples fires; fired ones stand unless within wait of the last that stands."""
    return S.replace("WITH", "WITH RECURSIVE", 1) + f""",
 r0 AS (SELECT *, coalesce({flag}, false) AS on_ FROM s), r1 AS (SELECT *, lag(on_) OVER (PARTITION BY media_id ORDER BY t) AS p FROM r0),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 fired AS (SELECT media_id, t FROM (SELECT *, row_number() OVER (PARTITION BY media_id, g ORDER BY t) AS n FROM r2) WHERE on_ AND n >= {least}),
 stand AS (SELECT media_id, min(t) AS t FROM fired GROUP BY media_id UNION ALL
           SELECT x.media_id, min(f.t) FROM stand x JOIN fired f ON f.media_id = x.media_id AND f.t > x.t + {wait} GROUP BY x.media_id)
 SELECT media_id, 'warn' AS level, '{kind}' AS kind, (t - {back})::DOUBLE AS t, '{msg}' AS msg FROM stand"""


@query("rule_top_cut", _held("value > 12", 2, "top-cut", "content is cut off at the top edge", 8, 0.5))
def rule_top_cut(spark, d):
    return Q.top_cut(features(spark, d).withColumn("top_ink", F.col("value")))


@query("rule_bottom_cut", _held("value > 12", 4, "bottom-cut", "content touches the bottom edge", 8, 1.5))
def rule_bottom_cut(spark, d):
    return Q.bottom_cut(features(spark, d).withColumn("bottom_ink", F.col("value")))


@query("rule_webcam_overlap", _held("value > 6", 2, "webcam-overlap", "content runs into the webcam", 8, 0.5))
def rule_webcam_overlap(spark, d):
    return Q.webcam_overlap(features(spark, d).withColumn("overlap_ink", F.col("value")))


@query("rule_corner_speck", _held("floor(value) BETWEEN 1 AND 60", 16, "corner-speck", "a small mark stays in the corner", 20, 8.0))
def rule_corner_speck(spark, d):
    return Q.corner_speck(features(spark, d).withColumn("speck_px", F.floor("value")))


@query("rule_ui_panel", _held("value > 25", 1, "ui-panel", "a tool panel is visible", 8, 0.0))
def rule_ui_panel(spark, d):
    return Q.ui_panel(features(spark, d).withColumn("panel_px", F.col("value")))


@query("rule_corner_badge", _held("value > 15", 1, "corner-junk", "a red badge is in the corner", 8, 0.0))
def rule_corner_badge(spark, d):
    return Q.corner_badge(features(spark, d).withColumn("red_px", F.col("value")))


@query("rule_bottom_missing", _msg("CASE WHEN predicted > 1088 THEN 'fail' ELSE 'warn' END", "bottom-missing", "the bottom of a slide is missing", "SELECT o_custkey AS media_id, o_orderkey::DOUBLE AS t, o_orderkey % 1200 AS predicted FROM orders WHERE o_orderkey % 1200 > 1088 OR o_orderkey % 1200 - o_custkey % 1000 > 45 * 0.9"))
def rule_bottom_missing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("media_id"), F.col("o_orderkey").cast("double").alias("t"), (F.col("o_orderkey") % 1200).alias("predicted"), (F.col("o_custkey") % 1000).alias("actual"), F.lit(0.9).alias("scale"))
    return Q.bottom_missing(o)


@query("rule_content_missing", _msg("'warn'", "content-missing", "part of a slide is missing", """
 SELECT media_id, min(t) AS t FROM (SELECT l_suppkey AS media_id, l_orderkey % 3 AS slide, l_orderkey::DOUBLE AS t, (l_quantity * 10)::BIGINT AS src, (l_tax * 10000)::BIGINT AS out FROM lineitem WHERE l_quantity >= 12)
 GROUP BY media_id, slide HAVING count(*) >= 4 AND median(out / src) > 0.2 AND min(out / src) < 0.35 * median(out / src)"""))
def rule_content_missing(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), (F.col("l_orderkey") % 3).alias("slide"), F.col("l_orderkey").cast("double").alias("t"), F.round(F.col("l_quantity") * 10).cast("long").alias("src"), F.round(F.col("l_tax") * 10000).cast("long").alias("out"))
    return Q.content_missing(li)


@query("rule_not_centred", _msg("'warn'", "slide-not-centred", "a slide is not centred", """
 SELECT media_id, t0 AS t FROM (SELECT *, lead(t0) OVER w AS n0, lead(top) OVER w AS ntop, lead(bottom) OVER w AS nbot FROM (SELECT media_id, t AS t0, t + 1 AS t1, floor(value)::BIGINT AS top, floor(value)::BIGINT * 2 + 100 AS bottom FROM s) WINDOW w AS (PARTITION BY media_id ORDER BY t0))
 WHERE NOT coalesce(n0 - t1 < 3 AND abs(ntop - top) < 30 AND nbot > bottom + 80, false) AND bottom - top < 700 AND abs((1080 - bottom) - top) > 170""").replace("SELECT media_id", S + " SELECT media_id", 1))
def rule_not_centred(spark, d):
    return Q.not_centred(centred_spans(spark, d))


def centred_spans(spark, d):
    f = features(spark, d)
    v = F.floor("value")
    return (f.select("media_id", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), v.alias("top"), (v * 2 + 100).alias("bottom"), F.lit(1080).alias("height")))


@query("rule_av_sync", "SELECT o_custkey AS media_id, 'fail' AS level, 'av-sync' AS kind, NULL::DOUBLE AS t, 'audio and video differ in length' AS msg FROM orders GROUP BY 1 HAVING abs(max(o_totalprice) FILTER (o_orderstatus = 'F') - max(o_totalprice) FILTER (o_orderstatus = 'O')) > 0.5")
def rule_av_sync(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')")
    return Q.av_sync(o.select(F.col("o_custkey").alias("media_id"), F.when(F.col("o_orderstatus") == "F", "video").otherwise("audio").alias("codec_type"), F.col("o_totalprice").alias("duration")))


@query("rule_audio_dip", with_(EV) + """
 , l AS (SELECT media_id, event_id AS win_no, value AS db, event_type <> 'error' AS speech FROM ev), m AS (SELECT media_id, median(db) AS m FROM l WHERE speech GROUP BY 1),
 f AS (SELECT l.*, speech AND db < m - 6 AS enter, speech AND db < m - 4 AS stay FROM l JOIN m USING (media_id)),
 r1 AS (SELECT *, lag(stay) OVER (PARTITION BY media_id ORDER BY win_no) AS p FROM f),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> stay THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY win_no ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 r3 AS (SELECT *, max(enter::INT) OVER (PARTITION BY media_id, g ORDER BY win_no ROWS UNBOUNDED PRECEDING) AS on_ FROM r2 WHERE stay)
 SELECT media_id, 'warn' AS level, 'audio-dip' AS kind, (min(win_no) * 0.5)::DOUBLE AS t, 'speech drops in level' AS msg FROM r3 WHERE on_ = 1 GROUP BY media_id, g HAVING count(*) >= 3""")
def rule_audio_dip(spark, d):
    return Q.audio_dip(loudness(spark, d))


def loudness(spark, d):
    return events(spark, d).select("media_id", F.col("event_id").alias("win_no"), F.col("value").alias("db"), (F.col("event_type") != "error").alias("speech"))


def _runs(flag: str, src: str = "s") -> str:
    return f""", r0 AS (SELECT *, coalesce({flag}, false) AS on_ FROM {src}), r1 AS (SELECT *, lag(on_) OVER (PARTITION BY media_id ORDER BY t) AS p, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS nx FROM r0),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 rn AS (SELECT media_id, min(t) AS start, max(t) AS last, count(*) AS n, bool_or(nx IS NULL) AS open_ FROM r2 WHERE on_ GROUP BY media_id, g)"""


@query("rule_freeze", S + _runs("value < 30") + ", l AS (SELECT DISTINCT media_id, floor(t / 0.5)::BIGINT AS w FROM s WHERE event_id % 3 > 0) SELECT media_id, 'warn' AS level, 'freeze' AS kind, start::DOUBLE AS t, 'the picture stands still' AS msg FROM rn JOIN l USING (media_id) WHERE l.w = floor(start / 0.5) AND n >= 3 AND NOT open_")
def rule_freeze(spark, d):
    f = features(spark, d)
    loud = f.where("event_id % 3 > 0").select("media_id", F.floor(F.col("t") / 0.5).alias("win_no"), F.lit(-20.0).alias("db")).distinct()
    return Q.freeze(f.withColumn("diff_max", F.col("value") / 15), loud, 3)


@query("rule_webcam_static", S + _runs("value < 20") + " SELECT media_id, 'warn' AS level, 'webcam-static' AS kind, start::DOUBLE AS t, 'the webcam stands still' AS msg FROM rn WHERE n >= 3 AND NOT open_")
def rule_webcam_static(spark, d):
    return Q.webcam_static(features(spark, d).withColumn("cam_diff", F.col("value") / 50), 3)


@query("rule_bridge_too_long", S + _runs("value < 30 AND event_type <> 'error'") + " SELECT media_id, 'warn' AS level, 'bridge-too-long' AS kind, start::DOUBLE AS t, 'the output holds still over a moving source' AS msg FROM rn WHERE last - start >= 3.0")
def rule_bridge_too_long(spark, d):
    return Q.bridge_too_long(frame_pairs(spark, d))


ZIP = """, fo AS (SELECT media_id, t, value, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1 AS i, value - lag(value) OVER (PARTITION BY media_id ORDER BY t, event_id) AS dv FROM s WHERE event_type IN ('click', 'error')),
 fs AS (SELECT media_id, value, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1 AS i, value - lag(value) OVER (PARTITION BY media_id ORDER BY t, event_id) AS dv FROM s WHERE event_type NOT IN ('click', 'error')),
 zp AS (SELECT fo.media_id, fo.t, fo.i, abs(fo.dv) / 100 AS out_diff, abs(fs.dv) AS src_diff FROM fo JOIN fs ON fs.media_id = fo.media_id AND fs.i = fo.i)"""


def two_streams(spark, d):
    """Frames of an output and of its source, which are of unlike length: t, value and the difference from the frame before."""
    f = features(spark, d)
    moved = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("media_id").orderBy("t", "event_id")))
    of = lambda which: f.where(which).select("media_id", "event_id", "t", "value", moved.alias("diff"))
    out = F.col("event_type").isin("click", "error")
    return of(out), of(~out)


@query("zipped_frames", S + ZIP + " SELECT media_id, i AS pos, t, round(out_diff, 9) AS out_diff, round(src_diff, 9) AS src_diff FROM zp")
def zipped_frames(spark, d):
    z = zipped(*two_streams(spark, d), ["media_id"], ["t", "event_id"], ["t", "event_id"])
    return z.select("media_id", "pos", "t", F.round(F.col("diff") / 100, 9).alias("out_diff"), F.round("b_diff", 9).alias("src_diff"))


@query("rule_bridge_two_streams", S + ZIP + """, g AS (SELECT media_id, t, coalesce(out_diff < 0.6 AND src_diff > 3.0, false) AS h, row_number() OVER (PARTITION BY media_id ORDER BY t) - row_number() OVER (PARTITION BY media_id, coalesce(out_diff < 0.6 AND src_diff > 3.0, false) ORDER BY t) AS k FROM zp)
 SELECT media_id, 'warn' AS level, 'bridge-too-long' AS kind, min(t)::DOUBLE AS t, 'the output holds still over a moving source' AS msg FROM g WHERE h GROUP BY media_id, k HAVING max(t) - min(t) >= 3.0""")
def rule_bridge_two_streams(spark, d):
    z = zipped(*two_streams(spark, d), ["media_id"], ["t", "event_id"], ["t", "event_id"])
    return Q.bridge_too_long(z.select("media_id", "t", "event_id", (F.col("diff") / 100).alias("out_diff"), F.col("b_diff").alias("src_diff")))


def frame_pairs(spark, d):
    return features(spark, d).select("media_id", "t", "event_id", (F.col("value") / 50).alias("out_diff"), F.when(F.col("event_type") != "error", 4.0).otherwise(0.0).alias("src_diff"))


def _islands(where: str, gap: float, most: float | None, level: str, kind: str, msg: str) -> str:
    tail = f" HAVING max(t) - min(t) <= {most}" if most is not None else ""
    return S + f""", h AS (SELECT media_id, t, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS d FROM s WHERE {where}),
 g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM h)
 SELECT media_id, '{level}' AS level, '{kind}' AS kind, min(t)::DOUBLE AS t, '{msg}' AS msg FROM g GROUP BY media_id, g""" + tail


@query("rule_transition_junk", _islands("event_type = 'error'", 0.51, 1.5, "warn", "transition-junk", "a dark bar crosses the slide"))
def rule_transition_junk(spark, d):
    return Q.transition_junk(features(spark, d).where("event_type = 'error'"))


@query("rule_ui_popup", _islands("event_type = 'click'", 1.5, 8.0, "warn", "ui-popup", "a popup is visible"))
def rule_ui_popup(spark, d):
    return Q.ui_popup(features(spark, d).where("event_type = 'click'"))


@query("rule_cursor_visible", _islands("event_type = 'view'", 8.0, None, "warn", "cursor-visible", "the cursor is visible"))
def rule_cursor_visible(spark, d):
    return Q.cursor_visible(features(spark, d).where("event_type = 'view'"))


@query("rule_crop_gap", """
 WITH x AS (SELECT DISTINCT l_suppkey AS media_id, l_orderkey::DOUBLE AS t, l_linenumber AS s FROM lineitem WHERE l_quantity > 20),
 c AS (SELECT media_id, t, s - row_number() OVER (PARTITION BY media_id, t ORDER BY s) AS g FROM x),
 a AS (SELECT media_id, t FROM (SELECT media_id, t, count(*) AS n FROM c GROUP BY media_id, t, g) GROUP BY 1, 2 HAVING max(n) * 20 >= 40),
 d AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS d FROM a),
 g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM d)
 SELECT media_id, 'fail' AS level, 'webcam-crop-gap' AS kind, min(t) AS t, 'the webcam''s edge shows' AS msg FROM g GROUP BY media_id, g""")
def rule_crop_gap(spark, d):
    return Q.crop_gap(sectors(spark, d))


def sectors(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), F.col("l_orderkey").cast("double").alias("t"), F.col("l_linenumber").alias("s"), (F.col("l_quantity") > 20).alias("clear"))


@query("rule_faces", """
 WITH m AS (SELECT l_suppkey AS media_id, median(l_quantity) AS dx, median(l_linenumber * 12) AS dy, median(l_discount * 14) AS size FROM lineitem GROUP BY 1 HAVING count(*) >= 4)
 SELECT media_id, 'warn' AS level, 'webcam-off-centre' AS kind, NULL::DOUBLE AS t, 'the face is off centre' AS msg FROM m WHERE sqrt(dx * dx + dy * dy) > 45
 UNION ALL SELECT media_id, 'warn', 'webcam-tight', NULL, 'the face fills the webcam' FROM m WHERE size > 0.72""")
def rule_faces(spark, d):
    return Q.face_rules(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), F.col("l_quantity").alias("dx"), (F.col("l_linenumber") * 12).alias("dy"), (F.col("l_discount") * 14).alias("size")))


@query("rule_corner_strip", """
 WITH RECURSIVE c AS (SELECT l_suppkey % 10 AS media_id, floor(l_orderkey / 100)::DOUBLE AS t, l_partkey % 480 AS x, l_quantity::BIGINT AS n FROM lineitem WHERE l_quantity > 2),
 q AS (SELECT *, x - lag(x) OVER (PARTITION BY media_id, t ORDER BY x) AS gap FROM c),
 r AS (SELECT media_id, t, sum(n) AS n, count(*) AS c, min(x) AS lo, max(x) AS hi, count(*) FILTER (gap > 3) AS gaps FROM q GROUP BY 1, 2),
 fired AS (SELECT media_id, t FROM r WHERE n <= 14 * 420 * 0.30 AND ((c > 30 AND lo < 480 * 0.2 - 60 AND hi > 480 * 0.8 - 60) OR (n > 12 AND c > 12 AND hi - lo > 480 * 0.3 AND gaps >= 4))),
 stand AS (SELECT media_id, min(t) AS t FROM fired GROUP BY media_id UNION ALL
           SELECT x.media_id, min(f.t) FROM stand x JOIN fired f ON f.media_id = x.media_id AND f.t > x.t + 8 GROUP BY x.media_id)
 SELECT media_id, 'warn' AS level, 'corner-junk' AS kind, t, 'a strip of icons is along the bottom' AS msg FROM stand""")
def rule_corner_strip(spark, d):
    return Q.corner_strip(strip_columns(spark, d))


def strip_columns(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 2")
    return li.select((F.col("l_suppkey") % 10).alias("media_id"), F.floor(F.col("l_orderkey") / 100).cast("double").alias("t"), (F.col("l_partkey") % 480).alias("x"), F.col("l_quantity").cast("long").alias("n"))


def report(spark, d):
    """All rules over one set of inputs; the one whose input isn't there becomes a finding itself."""
    f = features(spark, d)
    v = F.col("value")
    e = f.select(
        "media_id", "t", "event_id", "event_type", *[v.alias(c) for c in ("top_ink", "bottom_ink", "overlap_ink", "panel_px", "red_px")],
        F.floor(v).alias("speck_px"), (v / 15).alias("diff_max"), (v / 50).alias("cam_diff"),
    )
    inputs = {
        "features": e, "columns": strip_columns(spark, d), "spans": centred_spans(spark, d), "loudness": loudness(spark, d), "pairs": frame_pairs(spark, d),
        "bars": f.where("event_type = 'error'"), "popups": f.where("event_type = 'click'"), "cursors": f.where("event_type = 'view'"), "sectors": sectors(spark, d),
    }
    rules = ("top-cut", "bottom-cut", "webcam-overlap", "corner-speck", "ui-panel", "corner-badge", "corner-strip", "slide-not-centred", "audio-dip", "webcam-static", "bridge-too-long", "transition-junk", "ui-popup", "cursor-visible", "webcam-crop-gap", "av-sync")
    return Q.check(f.select("media_id").distinct(), inputs, rules)


def _report_sql() -> str:
    parts = ("top_cut", "bottom_cut", "webcam_overlap", "corner_speck", "ui_panel", "corner_badge", "corner_strip", "not_centred", "audio_dip", "bridge_too_long", "transition_junk", "ui_popup", "cursor_visible", "crop_gap")
    static = S + _runs("value < 20") + " SELECT media_id, 'warn' AS level, 'webcam-static' AS kind, start::DOUBLE AS t, 'the webcam stands still' AS msg FROM rn WHERE n >= 8 AND NOT open_"
    error = "SELECT DISTINCT user_id AS media_id, 'warn' AS level, 'qa-error' AS kind, NULL::DOUBLE AS t, 'av-sync: no streams' AS msg FROM events"
    return " UNION ALL ".join(f"SELECT media_id, level, kind, t, msg FROM ({x})" for x in [*(SQL[f"rule_{p}"] for p in parts), static, error])


@query("findings_report", _report_sql())
def findings_report(spark, d):
    return report(spark, d)


@query("findings_summary", f"""
 WITH f AS ({_report_sql()}), r AS (SELECT media_id, kind, coalesce(t, -1) AS t, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(t, -1), kind) AS i FROM f WHERE kind <> 'audio-dip')
 SELECT media_id, string_agg(kind, '; ' ORDER BY i) AS text FROM r WHERE i <= 6 GROUP BY 1""")
def findings_summary(spark, d):
    return Q.summary(report(spark, d))


@query("verdict", """
 SELECT l_orderkey AS media_id, CASE WHEN bool_or(l_quantity > 48) THEN 'fail' WHEN count(*) FILTER (l_quantity > 40) > 0 THEN 'warn' ELSE 'pass' END AS result, count(*) FILTER (l_quantity > 40) AS n_findings FROM lineitem GROUP BY 1""")
def verdict(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), "l_quantity")
    found = Q.finding(li.where("l_quantity > 40"), F.when(F.col("l_quantity") > 48, "fail").otherwise("warn"), "k", None, "m")
    return Q.verdict(found, li)


@query("slide_ink", S + """
 , f AS (SELECT media_id, t, floor(value)::BIGINT AS top, floor(value)::BIGINT * 2 AS bottom FROM s WHERE event_type = 'view'),
 x AS (SELECT media_id, event_id AS slide, t AS t0, t + 9 AS t1, greatest((t + t + 9) / 2, t + 9 - 1.5) AS t FROM s WHERE event_type = 'click')
 SELECT x.media_id, slide, t0, t1, x.t, (SELECT arg_max(top, f.t) FROM f WHERE f.media_id = x.media_id AND f.t <= x.t) AS top, (SELECT arg_max(bottom, f.t) FROM f WHERE f.media_id = x.media_id AND f.t <= x.t) AS bottom FROM x""")
def slide_ink(spark, d):
    f, v = features(spark, d), F.floor("value")
    frames = f.where("event_type = 'view'").select("media_id", "t", "event_id", v.alias("top"), (v * 2).alias("bottom"))
    slides = f.where("event_type = 'click'").select("media_id", F.col("event_id").alias("slide"), F.col("t").alias("t0"), (F.col("t") + 9).alias("t1"))
    return Q.slide_ink(slides, frames)
