"""Interval queries: `view` events are intervals, `error` events are points, `click` intervals the other side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import edl, intervals as I
from tidemark.plans.base import BD, CL, ER, EV, HOUR, IV, bounds, events, hits, query, spans, table, with_
from tidemark.sources.sinks import parsed_spec, spec_json

MERGE = """
 m0 AS (SELECT media_id, s, e, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {src}),
 m1 AS (SELECT *, sum(CASE WHEN p IS NULL OR s {op} p + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m0),
 mg AS (SELECT media_id, min(s) AS s, max(e) AS e FROM m1 GROUP BY media_id, g)"""


@query("islands_gap", with_(EV) + """
 , d AS (SELECT media_id, t, lag(t) OVER (PARTITION BY media_id ORDER BY t) AS p FROM ev),
 g AS (SELECT media_id, t, sum(CASE WHEN p IS NULL OR t - p >= 8 * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM d)
 SELECT media_id, min(t) AS start, max(t) AS last, count(*) AS n FROM g GROUP BY media_id, g""")
def islands_gap(spark, d):
    from tidemark.operators.events import hit_islands

    return hit_islands(events(spark, d), ["media_id"], "t_us", 8 * HOUR, strict=True)


@query("merge_slack", with_(EV, IV, MERGE.format(src="iv", op=">", slack=20000)) + "SELECT media_id, s AS start_us, e AS end_us FROM mg")
def merge_slack(spark, d):
    return I.merge_intervals(spans(spark, d), slack_us=20_000)


@query("merge_strict_chunked", with_(EV, IV, MERGE.format(src="iv", op=">=", slack=7200000000)) + "SELECT media_id, s AS start_us, e AS end_us FROM mg")
def merge_strict_chunked(spark, d):
    return I.merge_intervals(spans(spark, d), slack_us=2 * HOUR, strict=True, chunk_us=48 * HOUR)


@query("speech_keep", with_(EV, IV, BD, MERGE.format(src="iv", op=">=", slack=5400000000)) + """
 , p AS (SELECT media_id, greatest(s - 1080000000 - lo, 0) AS s, least(e + 1080000000 - lo, hi - lo) AS e FROM mg JOIN bd USING (media_id)),
 q0 AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM p),
 q1 AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM q0)
 SELECT media_id, min(s) AS start_us, max(e) AS end_us FROM q1 GROUP BY media_id, g HAVING max(e) - min(s) > 360000000""")
def speech_keep(spark, d):
    b = bounds(spark, d)
    rel = spans(spark, d).join(b, "media_id").select("media_id", (F.col("start_us") - F.col("lo_us")).alias("start_us"), (F.col("end_us") - F.col("lo_us")).alias("end_us"))
    dur = b.select("media_id", (F.col("hi_us") - F.col("lo_us")).alias("dur_us"))
    return I.speech_keep(rel, dur, min_silence_us=HOUR * 3 // 2, pad_us=HOUR * 3 // 10, min_len_us=HOUR // 10)


COMPLEMENT = """
 c0 AS (SELECT media_id, greatest(s, lo) AS s, least(e, hi) AS e, lo FROM iv JOIN bd USING (media_id) WHERE s < hi AND e > lo
        UNION ALL SELECT media_id, hi, hi, lo FROM bd),
 c1 AS (SELECT media_id, coalesce(max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS s, s AS e FROM c0)"""


@query("complement", with_(EV, IV, BD, COMPLEMENT) + "SELECT media_id, s AS start_us, e AS end_us FROM c1 WHERE e - s > 0")
def complement(spark, d):
    return I.complement(spans(spark, d), bounds(spark, d))


@query("silence_keep", with_(EV, IV, BD) + """
 , sh AS (SELECT media_id, s + 1800000000 AS s, e - 1800000000 AS e FROM iv WHERE e - s - 3600000000 > 720000000),
 c0 AS (SELECT media_id, greatest(s, lo) AS s, least(e, hi) AS e, lo FROM sh JOIN bd USING (media_id) WHERE s < hi AND e > lo
        UNION ALL SELECT media_id, hi, hi, lo FROM bd),
 c1 AS (SELECT media_id, coalesce(max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS s, s AS e FROM c0)
 SELECT media_id, s AS start_us, e AS end_us FROM c1 WHERE e > s AND e - s >= 1440000000""")
def silence_keep(spark, d):
    return edl.silence_keep(spans(spark, d), bounds(spark, d), pad_us=HOUR // 2, min_removed_us=HOUR // 5, min_keep_us=HOUR * 2 // 5)


SUBTRACT = """
 k AS (SELECT DISTINCT media_id, s AS lo, e AS hi FROM iv),
 c0 AS (SELECT k.media_id, k.lo, k.hi, greatest(k.lo, cl.s) AS s, least(k.hi, cl.e) AS e FROM k JOIN cl ON k.media_id = cl.media_id AND k.hi > cl.s AND k.lo < cl.e
        UNION ALL SELECT media_id, lo, hi, hi, hi FROM k),
 c1 AS (SELECT media_id, coalesce(max(e) OVER (PARTITION BY media_id, lo, hi ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS s, s AS e FROM c0)"""


@query("subtract", with_(EV, IV, CL, SUBTRACT) + "SELECT media_id, s AS start_us, e AS end_us FROM c1 WHERE e - s > 50000")
def subtract(spark, d):
    return I.subtract(spans(spark, d), spans(spark, d, "click"), bucket_us=24 * HOUR)


@query("intersect_relative", with_(EV, IV, CL) + """
 SELECT a.media_id, greatest(a.s, b.s) - a.s AS start_us, least(a.e, b.e) - a.s AS end_us FROM iv a JOIN cl b ON a.media_id = b.media_id AND a.e > b.s AND a.s < b.e
 WHERE least(a.e, b.e) - greatest(a.s, b.s) > 20000""")
def intersect_relative(spark, d):
    return I.intersect(spans(spark, d), spans(spark, d, "click"), bucket_us=24 * HOUR, relative=True)


@query("protected_mutes", with_(EV, IV, CL) + """
 , sp AS (SELECT media_id, s - 432000000 AS s, e + 432000000 AS e FROM cl),
 k AS (SELECT DISTINCT media_id, s AS lo, e AS hi FROM iv),
 c0 AS (SELECT k.media_id, k.lo, k.hi, greatest(k.lo, sp.s) AS s, least(k.hi, sp.e) AS e FROM k JOIN sp ON k.media_id = sp.media_id AND k.hi > sp.s AND k.lo < sp.e
        UNION ALL SELECT media_id, lo, hi, hi, hi FROM k),
 c1 AS (SELECT media_id, coalesce(max(e) OVER (PARTITION BY media_id, lo, hi ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS s, s AS e FROM c0)
 SELECT media_id, s AS start_us, e AS end_us FROM c1 WHERE e - s > 50000""")
def protected_mutes(spark, d):
    return edl.protected_mutes(spans(spark, d), spans(spark, d, "click"), HOUR * 12 // 100, bucket_us=24 * HOUR)


@query("point_in_interval", with_(EV, IV, ER) + "SELECT er.event_id AS point_id, iv.event_id AS span_id FROM er JOIN iv ON er.media_id = iv.media_id AND er.t BETWEEN iv.s AND iv.e")
def point_in_interval(spark, d):
    p = hits(spark, d).select("media_id", F.col("event_id").alias("point_id"), "t_us")
    return I.point_join(p, spans(spark, d).withColumnRenamed("event_id", "span_id"), bucket_us=24 * HOUR).select("point_id", "span_id")


@query("first_interval_of_point", with_(EV, IV, ER) + """
 SELECT point_id, span_id FROM (SELECT er.event_id AS point_id, iv.event_id AS span_id, row_number() OVER (PARTITION BY er.event_id ORDER BY iv.s, iv.event_id) AS r
 FROM er JOIN iv ON er.media_id = iv.media_id AND er.t BETWEEN iv.s AND iv.e) WHERE r = 1""")
def first_interval_of_point(spark, d):
    p = hits(spark, d).select("media_id", F.col("event_id").alias("point_id"), "t_us")
    pairs = I.point_join(p, spans(spark, d).withColumnRenamed("event_id", "span_id"), bucket_us=24 * HOUR)
    return pairs.groupBy("point_id").agg(F.min(F.struct("start_us", "span_id"))["span_id"].alias("span_id"))


@query("interval_anti", with_(EV, IV, ER) + "SELECT event_id, media_id, t AS t_us FROM er WHERE NOT EXISTS (SELECT 1 FROM iv WHERE er.media_id = iv.media_id AND er.t BETWEEN iv.s AND iv.e)")
def interval_anti(spark, d):
    return I.point_join(hits(spark, d).select("event_id", "media_id", "t_us"), spans(spark, d), bucket_us=24 * HOUR, how="left_anti")


@query("prioritised_lookup", with_(EV, IV, CL, ER) + """
 , a AS (SELECT er.event_id, min(iv.event_id) AS x FROM er JOIN iv ON er.media_id = iv.media_id AND er.t BETWEEN iv.s AND iv.e GROUP BY 1),
 b AS (SELECT er.event_id, min(cl.event_id) AS x FROM er JOIN cl ON er.media_id = cl.media_id AND er.t BETWEEN cl.s AND cl.e GROUP BY 1)
 SELECT er.event_id, coalesce(a.x, b.x, -1) AS geometry, CASE WHEN a.x IS NOT NULL THEN 'recenter' WHEN b.x IS NOT NULL THEN 'override' ELSE 'base' END AS origin
 FROM er LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def prioritised_lookup(spark, d):
    p = hits(spark, d).select("event_id", "media_id", "t_us")
    return edl.prioritised(p, spans(spark, d).withColumnRenamed("event_id", "g"), spans(spark, d, "click").withColumnRenamed("event_id", "g"), "event_id", "g", bucket_us=24 * HOUR)


@query("overlap_text", with_(EV, IV, CL) + """
 SELECT iv.event_id, substr(string_agg(cl.event_id::VARCHAR, ' ' ORDER BY cl.s, cl.event_id), 1, 400) AS text
 FROM iv JOIN cl ON iv.media_id = cl.media_id AND cl.e > iv.s AND cl.s < iv.e GROUP BY iv.event_id""")
def overlap_text(spark, d):
    segs = spans(spark, d, "click").select("media_id", "start_us", "end_us", F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("text"))
    return edl.cut_text(spans(spark, d), segs, "event_id", bucket_us=24 * HOUR)


@query("tile", with_(EV, IV) + """
 SELECT event_id, media_id, s AS start_us, CASE WHEN n - e > 0 AND n - e <= 7200000000 THEN n ELSE e END AS end_us
 FROM (SELECT *, lead(s) OVER (PARTITION BY media_id ORDER BY s, e) AS n FROM iv)""")
def tile(spark, d):
    return I.tile(spans(spark, d), max_gap_us=2 * HOUR)


@query("rebase", with_(EV, IV, MERGE.format(src="iv", op=">", slack=0)) + """
 SELECT media_id, s AS start_us, e AS end_us, (row_number() OVER w - 1)::INTEGER AS seg_no,
 coalesce(sum(e - s) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_us FROM mg WINDOW w AS (PARTITION BY media_id ORDER BY s, e)""")
def rebase(spark, d):
    return I.rebase(I.merge_intervals(spans(spark, d)))


@query("as_of_backward", with_(EV, ER) + """
 , v AS (SELECT media_id, t, value, event_id FROM ev WHERE event_type = 'view')
 SELECT er.event_id, er.media_id, er.t AS t_us, (SELECT arg_max(value, t) FROM v WHERE v.media_id = er.media_id AND v.t <= er.t) AS value FROM er""")
def as_of_backward(spark, d):
    return I.as_of(hits(spark, d).select("event_id", "media_id", "t_us"), hits(spark, d, "view"), ["media_id"], "t_us", ["value"])


@query("as_of_forward", with_(EV, ER) + """
 , v AS (SELECT media_id, t, value FROM ev WHERE event_type = 'view')
 SELECT er.event_id, er.media_id, er.t AS t_us, (SELECT arg_min(value, t) FROM v WHERE v.media_id = er.media_id AND v.t >= er.t) AS value FROM er""")
def as_of_forward(spark, d):
    return I.as_of(hits(spark, d).select("event_id", "media_id", "t_us"), hits(spark, d, "view"), ["media_id"], "t_us", ["value"], forward=True)


@query("segment_plan", with_(EV, IV, ER, MERGE.format(src="iv", op=">", slack=0)) + """
 , i0 AS (SELECT er.media_id, er.t AS ask, (er.event_id % 7)::VARCHAR AS clip, er.event_id AS ord, (SELECT min(s) FROM mg WHERE mg.media_id = er.media_id AND mg.e >= er.t) AS rs FROM er),
 ins AS (SELECT *, greatest(ask, rs) AS p FROM i0),
 pts AS (SELECT media_id, s AS rs, s AS p FROM mg UNION SELECT media_id, rs, p FROM ins WHERE rs IS NOT NULL),
 pc AS (SELECT pts.media_id, rs, p, coalesce(lead(p) OVER (PARTITION BY pts.media_id, rs ORDER BY p), mg.e) AS nx FROM pts JOIN mg ON mg.media_id = pts.media_id AND mg.s = rs),
 al AS (SELECT media_id, rs AS a, p AS b, 1 AS c, NULL::BIGINT AS d, NULL::BIGINT AS ord, NULL::VARCHAR AS clip, p AS start_us, nx AS end_us FROM pc WHERE nx > p
        UNION ALL SELECT media_id, coalesce(rs, 4611686018427387904), CASE WHEN rs IS NULL THEN 4611686018427387904 ELSE p END, 0, ask, ord, clip, NULL, NULL FROM ins),
 n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY a, b, c, d, ord) - 1)::INTEGER AS seg_no FROM al),
 f AS (SELECT media_id, clip, row_number() OVER (PARTITION BY media_id ORDER BY min(seg_no))::INTEGER AS input FROM n WHERE clip IS NOT NULL GROUP BY media_id, clip)
 SELECT n.media_id, seg_no, coalesce(f.input, 0) AS input, n.clip, start_us, end_us FROM n LEFT JOIN f ON f.media_id = n.media_id AND f.clip = n.clip""")
def segment_plan(spark, d):
    keep = I.merge_intervals(spans(spark, d))
    ins = hits(spark, d).select("media_id", F.col("t_us").alias("at_us"), (F.col("event_id") % 7).cast("string").alias("clip"), F.col("event_id").alias("ord"))
    return edl.plan_segments(keep, ins)


@query("edl_mutes", with_(EV, IV, CL, MERGE.format(src="iv", op=">", slack=0)) + """
 , r AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY s, e) - 1)::INTEGER AS seg_no FROM mg)
 SELECT r.media_id, r.seg_no, greatest(r.s, cl.s) - r.s AS start_us, least(r.e, cl.e) - r.s AS end_us FROM r JOIN cl ON r.media_id = cl.media_id AND r.e > cl.s AND r.s < cl.e
 WHERE least(r.e, cl.e) - greatest(r.s, cl.s) > 20000""")
def edl_mutes(spark, d):
    return edl.segment_mutes(I.rebase(I.merge_intervals(spans(spark, d))), spans(spark, d, "click"), bucket_us=24 * HOUR)


@query("no_op_edit", with_(EV, IV, BD, COMPLEMENT) + """
 , n AS (SELECT media_id, count(*) AS n, min(s) AS s, max(e) AS e FROM (SELECT * FROM c1 WHERE e - s > 0) GROUP BY 1)
 SELECT media_id, n = 1 AND s < lo + 3600000000 AND e > hi - 3600000000 AS no_op FROM n JOIN bd USING (media_id)""")
def no_op_edit(spark, d):
    return edl.no_op(I.complement(spans(spark, d), bounds(spark, d)), bounds(spark, d), HOUR)


@query("merge_plan", """
 SELECT o_custkey AS job_id, count(DISTINCT o_orderpriority) = 1 AS copy, count(*) AS n_parts, sum(floor(o_totalprice))::BIGINT AS expected_us,
 abs(sum(floor(o_totalprice)) - (sum(floor(o_totalprice)) - 900000)) <= 500000 + 0.002 * sum(floor(o_totalprice)) AS ok FROM orders GROUP BY 1""")
def merge_plan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("signature"), F.floor("o_totalprice").alias("dur_us"))
    return edl.merge_plan(o).withColumn("ok", edl.length_ok(F.col("expected_us"), F.col("expected_us") - 900_000))


@query("crossfade_offsets", """
 WITH p AS (SELECT l_orderkey AS job_id, l_linenumber * 1000000 + l_partkey AS part_no, max(floor(l_extendedprice))::BIGINT AS dur_us FROM lineitem GROUP BY 1, 2)
 SELECT job_id, part_no, dur_us, (coalesce(sum(dur_us - 500) OVER (PARTITION BY job_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset_us FROM p""")
def crossfade_offsets(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("part_no")).agg(F.max(F.floor("l_extendedprice")).alias("dur_us"))
    return edl.crossfade(p, 500)


@query("overlay_active", with_(EV, IV, ER) + "SELECT er.event_id AS at_id, count(iv.event_id) AS n_active, coalesce(string_agg(iv.event_id::VARCHAR, ',' ORDER BY iv.event_id), '') AS active FROM er LEFT JOIN iv ON er.media_id = iv.media_id AND er.t BETWEEN iv.s AND iv.e GROUP BY 1")
def overlay_active(spark, d):
    p = hits(spark, d).select("media_id", F.col("event_id").alias("at_id"), "t_us")
    return edl.active_overlays(p, spans(spark, d).withColumnRenamed("event_id", "overlay_id"), "at_id", bucket_us=24 * HOUR)


def _less(k: str, c: str, o: str) -> str:
    return f"""
 {o}k AS (SELECT DISTINCT media_id, s AS lo, e AS hi FROM {k}),
 {o}0 AS (SELECT k.media_id, lo, hi, greatest(lo, c.s) AS s, least(hi, c.e) AS e FROM {o}k k JOIN {c} c ON k.media_id = c.media_id AND hi > c.s AND lo < c.e UNION ALL SELECT media_id, lo, hi, hi, hi FROM {o}k),
 {o}1 AS (SELECT media_id, coalesce(max(e) OVER (PARTITION BY media_id, lo, hi ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS s, s AS e FROM {o}0),
 {o} AS (SELECT * FROM {o}1 WHERE e - s > 50000)"""


def _merged(src: str, name: str) -> str:
    return MERGE.format(src=src, op=">", slack=0).replace("m0", f"{name}0").replace("m1", f"{name}1").replace("mg", name)


_ACTIONS = (
    "d AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'cut' ELSE 'mute' END AS action FROM cl), dc AS (SELECT * FROM d WHERE action = 'cut'), dm AS (SELECT * FROM d WHERE action = 'mute')",
    _merged("dc", "cut_"), _merged("dm", "mute_"),
)


def disfluencies(spark, d):
    return spans(spark, d, "click").withColumn("label", F.when(F.col("event_id") % 2 == 0, "CUT_FILLER_SOUND").otherwise("MUTE_BREATH"))


@query("disfluency_ranges", with_(EV, CL, *_ACTIONS) + "SELECT media_id, 'cut' AS action, s AS start_us, e AS end_us FROM cut_ UNION ALL SELECT media_id, 'mute', s, e FROM mute_")
def disfluency_ranges(spark, d):
    return edl.ranges_by_action(disfluencies(spark, d))


@query("cleanup_plan", with_(EV, IV, CL, BD, "sp AS (SELECT media_id, t - 120000 AS s, t + floor(value)::BIGINT * 3600000000 + 120000 AS e FROM ev WHERE event_type = 'purchase')",
       *_ACTIONS, _merged("iv", "keep_"), _less("keep_", "cut_", "kept"), _less("mute_", "sp", "mutes")) + """
 , idle AS (SELECT n.media_id FROM (SELECT media_id, count(*) AS n, min(s) AS s, max(e) AS e FROM kept GROUP BY 1) n JOIN bd USING (media_id) WHERE n = 1 AND s < lo + 300000 AND e > hi - 300000),
 sg AS (SELECT media_id, s, e, (row_number() OVER (PARTITION BY media_id ORDER BY s, e) - 1)::INTEGER AS seg_no FROM kept WHERE media_id NOT IN (SELECT media_id FROM idle))
 SELECT media_id, 'keep' AS kind, seg_no, s AS start_us, e AS end_us FROM sg UNION ALL
 SELECT sg.media_id, 'mute', seg_no, greatest(sg.s, m.s) - sg.s, least(sg.e, m.e) - sg.s FROM sg JOIN mutes m ON m.media_id = sg.media_id AND sg.e > m.s AND sg.s < m.e WHERE least(sg.e, m.e) - greatest(sg.s, m.s) > 20000""")
def cleanup_plan(spark, d):
    return edl.cleanup(I.merge_intervals(spans(spark, d)), disfluencies(spark, d), spans(spark, d, "purchase"), bounds(spark, d), bucket_us=24 * HOUR)


def overlays(spark, d):
    return hits(spark, d, "view").select("media_id", (F.col("event_id") % 60).alias("id"), F.col("event_id").alias("ord"))


def clip_assets(spark, d):
    return table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"))


@query("overlay_assets", with_(EV) + "SELECT media_id, event_id % 60 AS id, event_id AS ord, p_name AS path FROM ev JOIN part ON p_partkey = event_id % 60 WHERE event_type = 'view' AND p_partkey % 3 > 0")
def overlay_assets(spark, d):
    return edl.with_assets(overlays(spark, d), clip_assets(spark, d))[0].select("media_id", "id", "ord", "path")


@query("missing_assets", with_(EV) + "SELECT media_id, count(*) FILTER (p_partkey IS NULL) AS n_missing FROM ev LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0) ON p_partkey = event_id % 60 WHERE event_type = 'view' GROUP BY 1")
def missing_assets(spark, d):
    return edl.with_assets(overlays(spark, d), clip_assets(spark, d))[1]


@query("spec_branches", "SELECT o_orderkey AS media_id, o_orderkey % 4 IN (1, 2, 3) AS overlays, o_orderkey % 4 = 2 OR o_orderkey % 4 = 3 AS new_sound FROM orders")
def spec_branches(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    full = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    s = o.select(F.col("o_orderkey").alias("media_id"), full(k == 1).alias("texts"), F.lit(None).cast("array<string>").alias("images"), full(k == 2).alias("audios"), F.when(k == 3, True).alias("mute_original"))
    return edl.branches(s)


@query("overlay_looks", r"""
 SELECT p_partkey, (CASE WHEN p_size BETWEEN 1 AND 10 THEN 2.5 WHEN p_size BETWEEN 10 AND 20 THEN 4.0 ELSE 1.0 END)::DOUBLE AS gain,
 (CASE WHEN length(p_name) <= 10 THEN 96 ELSE greatest(54, floor(96 * 10 / length(p_name))) END)::INTEGER AS font,
 replace(replace(replace(replace(p_name || '\it''s 5%: x', '\', '\\'), ':', '\:'), '''', chr(8217)), '%', '\%') AS label,
 (['60', '(W-w)/2', 'W-w-60'])[p_partkey % 3 + 1] AS x, (['60', '(H-h)/2', 'H-h-60'])[p_partkey // 3 % 3 + 1] AS y FROM part""")
def overlay_looks(spark, d):
    """Gain by size, title size, escaped label and preset position of each part's overlay."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    preset = F.concat(F.get(F.array(*map(F.lit, "tmb")), F.floor(k / 3).cast("int") % 3), F.get(F.array(*map(F.lit, "lcr")), (k % 3).cast("int")))
    at = T.position_xy(preset)
    return p.select(
        "p_partkey", edl.case_between(F.col("p_size"), [(1, 10, 2.5), (10, 20, 4.0)], 1.0).alias("gain"), edl.font_size(F.col("p_name"), fits=10).alias("font"),
        T.overlay_escape(F.concat("p_name", F.lit("\\it's 5%: x"))).alias("label"), at["x"].alias("x"), at["y"].alias("y"),
    )


@query("spec_roundtrip", """
 WITH c AS (SELECT l_orderkey AS media_id, l_linenumber AS i, l_linenumber * 10.5::DOUBLE AS s, l_linenumber * 10.5 + l_quantity AS e, l_linenumber * 1000 + l_quantity AS o FROM lineitem),
 g AS (SELECT media_id, count(*)::INTEGER AS n_cuts, arg_min(s, i) AS first_start, arg_max(e, o) AS last_end FROM c GROUP BY 1)
 SELECT media_id, n_cuts, first_start, last_end::DOUBLE AS last_end, o_orderpriority AS title, o_orderkey % 3 = 0 AS muted, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS trim_start, 0 AS n_texts FROM g JOIN orders ON o_orderkey = media_id""")
def spec_roundtrip(spark, d):
    """Nested edit specifications as JSON text and back."""
    li = table(spark, d, "lineitem")
    start = F.col("l_linenumber") * 10.5
    cut = F.struct(F.col("l_linenumber").alias("i"), start.alias("start"), (start + F.col("l_quantity")).alias("end"))
    cuts = li.groupBy(F.col("l_orderkey").alias("media_id")).agg(F.transform(F.sort_array(F.collect_list(cut)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("cuts"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 3 == 0).alias("mute_original"), F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.col("o_totalprice").alias("start"))).alias("trim"))
    text = cuts.join(o, "media_id").select("media_id", spec_json("trim", "cuts", "mute_original", "title").alias("text"))
    s = text.select("media_id", parsed_spec(F.col("text")).alias("s"))
    return s.select("media_id", F.size("s.cuts").alias("n_cuts"), F.col("s.cuts")[0]["start"].alias("first_start"), F.element_at("s.cuts", -1)["end"].alias("last_end"), "s.title", F.col("s.mute_original").alias("muted"), F.col("s.trim.start").alias("trim_start"), F.coalesce(F.size("s.texts"), F.lit(0)).alias("n_texts"))
