"""Queries of the composite's plan. Orders are slides of 40 media, their lineitems are ink, events are open menus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import composite as C
from tidemark.plans.base import query, table
from tidemark.shared import stored

STAGE = C.Stage()
G = STAGE

SL = """oo AS (SELECT o_orderkey AS slide, o_custkey % 40 AS media_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS i FROM orders),
 ink AS (SELECT media_id, slide, l_partkey * 17 % 1080 AS y, (l_quantity * 32)::BIGINT AS x FROM lineitem JOIN oo ON l_orderkey = slide),
 sl AS (SELECT media_id, slide, i * 12000000 + slide % 5 * 500000 AS s, i * 12000000 + slide % 5 * 500000 + (slide % 23 + 1) * 500000 AS e, min(y) AS t, max(y) AS b FROM oo JOIN ink USING (media_id, slide) GROUP BY media_id, slide, i)"""


def ink(spark, d):
    """Ink by slide; which media has the slide is in the slides alone."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slide"), (F.col("l_partkey") * 17 % 1080).alias("y"), (F.col("l_quantity") * 32).cast("long").alias("x"))


def slides(spark, d):
    k = F.col("slide")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("slide"), (F.col("o_custkey") % 40).alias("media_id"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("media_id").orderBy("slide")))
    ext = ink(spark, d).groupBy("slide").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    start = F.col("i").cast("long") * 12_000_000 + k % 5 * 500_000
    return o.join(ext, "slide").select("media_id", "slide", start.alias("start_us"), (start + (k % 23 + 1) * 500_000).alias("end_us"), "top", "bottom")


def _at(x: str, y: str) -> str:
    return f"(({x}) - {G.cam_x}) * (({x}) - {G.cam_x}) + (({y}) - {G.cam_y}) * (({y}) - {G.cam_y}) < {float(G.cam_r) ** 2}"


OV = f"""{SL}, z AS (SELECT *, least({G.scale}::DOUBLE, {G.out_h - G.margins}::DOUBLE / greatest(1.0::DOUBLE, (b - t)::DOUBLE)) AS s0 FROM sl WHERE e - s >= 1000000),
 br AS (SELECT z.* FROM z JOIN (SELECT media_id, slide FROM z JOIN ink USING (media_id, slide) GROUP BY ALL HAVING bool_or({_at(f"{G.x} + x * {G.scale}::DOUBLE", f"{G.y} + y * {G.scale}::DOUBLE")}) OR bool_or({G.y} + b * {G.scale}::DOUBLE > {G.out_h - 6} OR {G.y} + t * {G.scale}::DOUBLE < 2)) USING (media_id, slide)),
 st AS (SELECT media_id, slide, k, s0 - k * {G.step}::DOUBLE AS c FROM br, (SELECT unnest(range(0, 40)) AS k) WHERE k <= floor((s0 - {G.floor}::DOUBLE + 1e-9) / {G.step}::DOUBLE)),
 bad AS (SELECT DISTINCT media_id, slide, k FROM st JOIN br USING (media_id, slide) JOIN ink USING (media_id, slide) WHERE {_at(f"({G.out_w} - {G.width} * c) / 2 + x * c", f"({G.out_h} - (b - t) * c) / 2 - t * c + y * c")}),
 ok AS (SELECT media_id, slide, max(c) AS c FROM st ANTI JOIN bad USING (media_id, slide, k) GROUP BY 1, 2),
 o1 AS (SELECT br.*, coalesce(c, {G.floor}::DOUBLE) AS scale FROM br LEFT JOIN ok USING (media_id, slide)),
 o2 AS (SELECT *, round_even(({G.out_w} - {G.width} * scale) / 2, 0)::BIGINT AS x, round_even(({G.out_h} - (b - t) * scale) / 2 - t * scale, 0)::BIGINT AS y FROM o1),
 oa AS (SELECT media_id, slide, s AS start_us, e AS end_us, scale, x, y, greatest(0, round_even(y + t * scale, 0)::BIGINT - 12) AS mask_top FROM o2),
 ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, slide) AS n FROM oa) WHERE n <= {C.OVERRIDES})"""


def all_overrides(spark, d):
    return C.overrides(slides(spark, d), ink(spark, d), STAGE)


def capped(found):
    return C.first_k(found, C.OVERRIDES, order=("start_us", "slide"))


@query("override_plan", f"WITH {OV} SELECT media_id, slide, start_us, end_us, round(scale, 6) AS scale, x, y, mask_top FROM ov")
def override_plan(spark, d):
    return capped(all_overrides(spark, d)).withColumn("scale", F.round("scale", 6))


RC = f"""ph AS (SELECT media_id, slide, s AS a, s + (e - s) // 2 AS z, s, e, t, t + (b - t) // 4 AS b FROM sl UNION ALL SELECT media_id, slide, s + (e - s) // 2, e, s, e, t, b FROM sl),
 pm AS (SELECT *, (s + e) // 2 AS mid, round_even(({G.out_h} - (b - t) * {G.scale}::DOUBLE) / 2 - t * {G.scale}::DOUBLE, 0)::BIGINT AS y FROM ph WHERE e - s >= 2500000),
 pk AS (SELECT * FROM pm WHERE y > {G.y + 24} AND NOT EXISTS (SELECT 1 FROM oa WHERE oa.media_id = pm.media_id AND pm.mid BETWEEN oa.start_us AND oa.end_us)),
 rb AS (SELECT DISTINCT media_id, slide, pk.y FROM pk JOIN ink USING (media_id, slide) WHERE {_at(f"{G.x} + ink.x * {G.scale}::DOUBLE", f"pk.y + ink.y * {G.scale}::DOUBLE")}),
 r1 AS (SELECT media_id, slide, a, z, y, greatest(0, round_even(y + t * {G.scale}::DOUBLE, 0)::BIGINT - 12) AS mask_top FROM pk ANTI JOIN rb USING (media_id, slide, y)),
 rc AS (SELECT media_id, slide, a AS start_us, CASE WHEN nx - z > 0 AND nx - z <= 2000000 THEN nx ELSE z END AS end_us, y, mask_top FROM (SELECT *, lead(a) OVER (PARTITION BY media_id ORDER BY a, z) AS nx FROM r1))"""


def phases(s):
    """Two phases for each slide, as if its content grew in the middle."""
    half = (F.col("start_us") + F.floor((F.col("end_us") - F.col("start_us")) / 2)).cast("long")
    grown = (F.col("top") + F.floor((F.col("bottom") - F.col("top")) / 4)).alias("bottom")
    first = F.struct(F.col("start_us"), half.alias("end_us"), grown)
    second = F.struct(half.alias("start_us"), F.col("end_us"), F.col("bottom"))
    both = s.select("media_id", "slide", "top", F.col("start_us").alias("slide_start_us"), F.col("end_us").alias("slide_end_us"), F.explode(F.array(first, second)).alias("p"))
    return both.select("media_id", "slide", "p.start_us", "p.end_us", "top", "p.bottom", "slide_start_us", "slide_end_us")


def centred(spark, d):
    return C.recenters(phases(slides(spark, d)), ink(spark, d), all_overrides(spark, d), STAGE)


@query("recenter_plan", f"WITH {OV}, {RC} SELECT media_id, slide, start_us, end_us, y, mask_top FROM rc")
def recenter_plan(spark, d):
    return centred(spark, d)


MN = "mn AS (SELECT user_id % 40 AS media_id, event_type, event_id % 97 * 7000000 AS s, event_id % 97 * 7000000 + floor(value)::BIGINT % 6 * 400000 + 300000 AS e FROM events WHERE event_type IN ('click', 'view'))"
PT = f"""{MN}, mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, event_type ORDER BY s, e) AS n FROM mn) WHERE n <= CASE WHEN event_type = 'view' THEN {C.PANELS} ELSE {C.POPUPS} END),
 ma AS (SELECT DISTINCT media_id, CASE WHEN event_type = 'view' THEN 'panel' ELSE 'popup' END AS kind, s AS a, e AS b, (s + e) // 2 AS mid FROM mk),
 mb AS (SELECT * FROM ma WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.media_id = ma.media_id AND ma.mid BETWEEN ov.start_us AND ov.end_us)),
 mc AS (SELECT * FROM (SELECT mb.media_id, mb.kind, mb.a, mb.b, sl.slide, sl.s, sl.e, row_number() OVER (PARTITION BY mb.media_id, kind, mb.a, mb.b ORDER BY sl.s, sl.slide) AS n FROM mb JOIN sl ON sl.media_id = mb.media_id AND mid BETWEEN sl.s AND sl.e) WHERE n = 1),
 md AS (SELECT media_id, kind, slide, a AS start_us, b AS end_us, CASE WHEN b + 800000 < e - 300000 THEN b + 800000 WHEN a - 800000 > s + 300000 THEN a - 800000 END AS donor_us FROM mc),
 ik AS (SELECT user_id % 40 AS media_id, event_id % 97 * 7000000 + event_id % 11 * 100000 AS t, max(event_id % 50 + 100) AS n FROM events GROUP BY ALL),
 me AS (SELECT *, (SELECT n FROM ik WHERE ik.media_id = md.media_id AND ik.t <= donor_us ORDER BY t DESC LIMIT 1) AS base FROM md WHERE donor_us IS NOT NULL),
 pt AS (SELECT media_id, kind, slide, start_us, end_us, donor_us FROM me WHERE NOT EXISTS (SELECT 1 FROM ik WHERE ik.media_id = me.media_id AND t BETWEEN start_us AND end_us AND base > 0 AND n > base * 1.06::DOUBLE))"""


def menus(spark, d, kind):
    k = F.col("event_id") % 97
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.select((F.col("user_id") % 40).alias("media_id"), (k * 7_000_000).alias("start_us"), (k * 7_000_000 + F.floor("value") % 6 * 400_000 + 300_000).cast("long").alias("end_us"))


def stills(spark, d, s=None, zooms=None):
    e = table(spark, d, "events")
    seen = e.groupBy((F.col("user_id") % 40).alias("media_id"), (F.col("event_id") % 97 * 7_000_000 + F.col("event_id") % 11 * 100_000).alias("t_us")).agg(F.max(F.col("event_id") % 50 + 100).alias("n"))
    return C.patches(menus(spark, d, "view"), menus(spark, d, "click"), s or slides(spark, d), zooms or capped(all_overrides(spark, d)), seen).distinct()


@query("still_plan", f"WITH {OV}, {PT} SELECT * FROM pt")
def still_plan(spark, d):
    return stills(spark, d)


BR = f"""b0 AS (SELECT media_id, slide, s, lag(s) OVER w AS a0, lag(e) OVER w AS a1 FROM sl WINDOW w AS (PARTITION BY media_id ORDER BY s, slide)),
 b1 AS (SELECT media_id, slide, a1 - 350000 AS start_us, CASE WHEN s - a1 > 50000 THEN s ELSE a1 END AS end_us, greatest(a0 + 300000, a1 - 800000) AS donor_us FROM b0 WHERE s - a1 <= 1200000),
 bd AS (SELECT media_id, slide, start_us, end_us, donor_us FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, slide) AS n FROM b1 WHERE end_us - start_us >= 150000) WHERE n <= {C.BRIDGES})"""


@query("bridge_plan", f"WITH {SL}, {BR} SELECT * FROM bd")
def bridge_plan(spark, d):
    return C.bridges(slides(spark, d))


SHIFT = "sh AS (SELECT p_partkey % 40 AS media_id, p_partkey % 31 * 20000000 AS start_us, p_partkey % 31 * 20000000 + 3000000 AS end_us, p_size - 25 AS dx, p_size % 7 AS dy FROM part WHERE p_size % 5 = 0)"


def webcam_shifts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").where("p_size % 5 = 0").select((k % 40).alias("media_id"), (k % 31 * 20_000_000).alias("start_us"), (k % 31 * 20_000_000 + 3_000_000).alias("end_us"), (F.col("p_size") - 25).alias("dx"), (F.col("p_size") % 7).alias("dy"))


def _geometry(source: str, at: str) -> str:
    """The slide's geometry at a time: centred, else zoomed, else as usual."""
    return f"""SELECT p.media_id, p.start_us, p.end_us, CASE WHEN c.y IS NULL AND o.y IS NOT NULL THEN o.scale ELSE {G.scale}::DOUBLE END AS scale, CASE WHEN c.y IS NULL AND o.y IS NOT NULL THEN o.x ELSE {G.x} END AS x,
  coalesce(c.y, o.y, {G.y}) AS y, CASE WHEN c.y IS NOT NULL THEN c.mask_top ELSE coalesce(o.mask_top, 0) END AS mask_top FROM (SELECT DISTINCT media_id, start_us, end_us, {at} AS t FROM {source}) p
  LEFT JOIN LATERAL (SELECT y, mask_top FROM rc WHERE rc.media_id = p.media_id AND p.t BETWEEN rc.start_us AND rc.end_us ORDER BY rc.start_us, y, mask_top LIMIT 1) c ON true
  LEFT JOIN LATERAL (SELECT scale, x, y, mask_top FROM ov WHERE ov.media_id = p.media_id AND p.t BETWEEN ov.start_us AND ov.end_us ORDER BY ov.start_us, scale, x, y LIMIT 1) o ON true"""


LT = f"""{OV}, {RC}, {PT}, {BR}, {SHIFT}, bo AS (SELECT media_id, min(s) AS lo, max(e) AS hi FROM sl GROUP BY 1),
 gs AS ({_geometry("pt", "(start_us + end_us) // 2")}), gb AS ({_geometry("bd", "donor_us")}),
 la AS (SELECT media_id, lo AS s, hi AS e, 0 AS z, 'base' AS layer, {G.scale}::DOUBLE AS scale, {G.x} AS x, {G.y} AS y, 0 AS m, false AS op, 4611686018427387904 AS turn FROM bo
  UNION ALL SELECT media_id, start_us, end_us, 0, 'base', {G.scale}::DOUBLE, {G.x}, y, 0, false, start_us FROM rc
  UNION ALL SELECT media_id, start_us, end_us, 1, 'zoom', scale, x, y, mask_top, true, -start_us FROM ov
  UNION ALL SELECT media_id, start_us, end_us, 2, 'margin', 1.0, 0, 0, mask_top, false, start_us FROM rc WHERE mask_top > 2
  UNION ALL SELECT media_id, start_us, end_us, 3, 'still', scale, x, y, 0, true, -start_us FROM gs
  UNION ALL SELECT media_id, start_us, end_us, 4, 'bridge', scale, x, y, mask_top, true, -start_us FROM gb
  UNION ALL SELECT media_id, lo, hi, 5, 'webcam', 1.0, 0, 0, 0, false, 4611686018427387904 FROM bo UNION ALL SELECT media_id, start_us, end_us, 5, 'webcam', 1.0, dx, dy, 0, false, start_us FROM sh
  UNION ALL SELECT media_id, lo, hi, 6, 'ring', 1.0, 0, 0, 0, false, 0 FROM bo UNION ALL SELECT media_id, lo, hi, 7, 'logo', 1.0, 0, 0, 0, false, 0 FROM bo),
 lc AS (SELECT la.* REPLACE (greatest(s, lo) AS s, least(e, hi) AS e) FROM la JOIN bo USING (media_id) WHERE greatest(s, lo) < least(e, hi)),
 en AS (SELECT media_id, t, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS u FROM (SELECT media_id, s AS t FROM lc UNION SELECT media_id, e FROM lc UNION SELECT media_id, lo FROM bo UNION SELECT media_id, hi FROM bo)),
 ac AS (SELECT en.media_id, t, u, z, layer, scale, x, y, m, op, row_number() OVER (PARTITION BY en.media_id, t, z, layer ORDER BY turn, x, y, scale, m) AS n FROM en JOIN lc ON lc.media_id = en.media_id AND lc.s <= t AND lc.e >= u WHERE u IS NOT NULL),
 one AS (SELECT *, row_number() OVER (PARTITION BY media_id, t ORDER BY z, layer) - 1 AS place, max(z) FILTER (WHERE op) OVER (PARTITION BY media_id, t) AS top FROM ac WHERE n = 1)"""


@query("layer_table", f"WITH {LT} SELECT media_id, t AS start_us, u AS end_us, place, z, layer, round(scale, 6) AS scale, x, y, m AS mask_top, z >= coalesce(top, 0) AS shown FROM one")
def layer_table(spark, d):
    # each plan is read several times
    s, places = stored(slides(spark, d), "slides"), ink(spark, d)
    every = stored(C.overrides(s, places, STAGE), "overrides")
    zooms = stored(capped(every), "zooms")
    middle = stored(C.recenters(phases(s), places, every, STAGE), "recenters")
    bounds = stored(s.groupBy("media_id").agg(F.min("start_us").alias("lo_us"), F.max("end_us").alias("hi_us")), "bounds")
    rows = C.layers(bounds, STAGE, zooms, middle, stored(stills(spark, d, s, zooms), "stills"), stored(C.bridges(s), "bridges"), webcam_shifts(spark, d))
    return C.layer_table(stored(rows, "layers"), bounds).withColumn("scale", F.round("scale", 6))
