"""Queries that read pixels through row runs, components and summed areas. Lineitems are sparse pixels of small frames (51 by 20),
mostly grey; a place that several rows share takes the smallest of their colours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import morphology as M
from tidemark.operators import webcam as W
from tidemark.plans.base import query, table
from tidemark.plans.vision import pixels
from tidemark.shared import stored

WIDTH, HEIGHT = 51, 20

PG = """px AS (SELECT l_suppkey % 10 AS media_id, l_orderkey // 100 AS frame_no, (l_quantity * 8)::BIGINT // 8 AS x, (l_partkey % 200) % 20 AS y, l_partkey * 7 % 256 AS v, l_partkey * 13 % 256 AS g, l_partkey * 31 % 256 AS r FROM lineitem),
 pg AS (SELECT media_id, frame_no, y, x, min(v) AS b, min(v) AS g, least(255, min(v) + min(v) % 3 * 20) AS r FROM px GROUP BY ALL),
 cl AS (SELECT media_id, frame_no, y, x, min(v) AS b, min(g) AS g, min(r) AS r FROM px GROUP BY ALL),
 grid AS (SELECT dy, dx FROM (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx)),
 tm AS (SELECT media_id, frame_no, frame_no * 250000 AS t_us FROM px GROUP BY ALL)"""


def places(spark, d):
    return pixels(spark, d).withColumns({"x": F.floor(F.col("x") / 8), "y": F.col("y") % 20}).groupBy("media_id", "frame_no", "y", "x")


def page(spark, d):
    """Grey pixels, some with a tint of red."""
    v = F.min("b")
    return places(spark, d).agg(v.alias("b"), v.alias("g"), F.least(F.lit(255), v + v % 3 * 20).alias("r"))


def coloured(spark, d):
    return places(spark, d).agg(*[F.min(c).alias(c) for c in "bgr"])


def times(spark, d):
    """A frame every quarter of a second."""
    return pixels(spark, d).select("media_id", "frame_no").distinct().withColumn("t_us", F.col("frame_no") * 250_000)


CANVAS = f"""m AS (SELECT media_id, frame_no, y, x FROM pg WHERE greatest(b, g, r) - least(b, g, r) <= 26 AND greatest(b, g, r) BETWEEN 32 AND 250),
 di AS (SELECT DISTINCT media_id, frame_no, y + dy AS y, x + dx AS x FROM m, grid WHERE abs(dy) <= 2 AND abs(dx) <= 2 AND y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1}),
 fr AS (SELECT DISTINCT media_id, frame_no FROM m),
 fit AS (SELECT y, x, count(*) AS n FROM (SELECT unnest(range({HEIGHT})) AS y), (SELECT unnest(range({WIDTH})) AS x), grid WHERE abs(dy) <= 2 AND abs(dx) <= 2 AND y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1} GROUP BY 1, 2),
 er AS (SELECT media_id, frame_no, y, x FROM (SELECT media_id, frame_no, y + dy AS y, x + dx AS x, count(*) AS k FROM di, grid WHERE abs(dy) <= 2 AND abs(dx) <= 2 AND y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1} GROUP BY 1, 2, 3, 4) JOIN fit USING (y, x) WHERE k = n),
 fl AS (SELECT * FROM er WHERE y = 0 OR x = 0 OR x = {WIDTH - 1} UNION SELECT e.media_id, e.frame_no, e.y, e.x FROM fl JOIN er e ON e.media_id = fl.media_id AND e.frame_no = fl.frame_no AND abs(e.y - fl.y) <= 1 AND abs(e.x - fl.x) <= 1),
 bg AS (SELECT DISTINCT media_id, frame_no, y + dy AS y, x + dx AS x FROM fl, grid WHERE abs(dy) <= 3 AND abs(dx) <= 3 AND y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1})"""


@query("background_boxes", f"WITH RECURSIVE {PG}, {CANVAS} SELECT media_id, frame_no, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM bg GROUP BY 1, 2")
def background_boxes(spark, d):
    found = M.background(page(spark, d), WIDTH, HEIGHT)
    return found.groupBy("media_id", "frame_no").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("background_removed", f"WITH RECURSIVE {PG}, {CANVAS} SELECT media_id, frame_no, count(*) AS n, sum(b)::BIGINT AS b, sum(r)::BIGINT AS r FROM pg ANTI JOIN bg USING (media_id, frame_no, y, x) GROUP BY 1, 2")
def background_removed(spark, d):
    p = page(spark, d)
    left = M.inside(p, M.background(p, WIDTH, HEIGHT), not_=True)
    return left.groupBy("media_id", "frame_no").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("r").alias("r"))


@query("closed_mask", f"WITH RECURSIVE {PG}, {CANVAS} SELECT media_id, frame_no, y, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM er GROUP BY 1, 2, 3")
def closed_mask(spark, d):
    runs = M.close(M.spots(page(spark, d).where(M.canvas())), 2, 2, WIDTH, HEIGHT)
    return runs.groupBy("media_id", "frame_no", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _components(name: str, source: str, mask: str) -> str:
    """Common table expressions of the 8-connected components of a mask: {name}_l with the first place of each pixel's."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame_no ORDER BY y, x) - 1 AS i FROM {source} WHERE {mask}),
 {name}_n AS (SELECT a.media_id, a.frame_no, a.i, b.i AS j FROM {name} a JOIN {name} b ON a.media_id = b.media_id AND a.frame_no = b.frame_no AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.i <> b.i),
 {name}_r AS (SELECT media_id, frame_no, i, i AS j FROM {name} UNION SELECT r.media_id, r.frame_no, r.i, n.j FROM {name}_r r JOIN {name}_n n ON n.media_id = r.media_id AND n.frame_no = r.frame_no AND n.i = r.j),
 {name}_l AS (SELECT media_id, frame_no, y, x, b, g, r, l FROM {name} JOIN (SELECT media_id, frame_no, i, min(j) AS l FROM {name}_r GROUP BY ALL) USING (media_id, frame_no, i))"""


LUMA, SAT = "round_even(0.114 * b + 0.587 * g + 0.299 * r, 0)", "(CASE WHEN greatest(b, g, r) > 0 THEN round_even(255 * (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r), 0) ELSE 0 END)"

CURSORS = f"""{_components("dk", "pg", f"{LUMA} < 215 AND x >= 4 AND y >= 1")},
 bl AS (SELECT media_id, frame_no, l, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg({SAT}) AS sat FROM dk_l GROUP BY ALL),
 bs AS (SELECT *, greatest(0, x0 - 3) AS ax, least({WIDTH - 1}, x1 + 3) AS bx, greatest(0, y0 - 1) AS ay, least({HEIGHT - 1}, y1 + 1) AS bt FROM bl WHERE n BETWEEN 2 AND 9 AND x1 - x0 + 1 BETWEEN 1 AND 4 AND y1 - y0 + 1 BETWEEN 2 AND 6),
 ct AS (SELECT s.media_id, s.frame_no, s.l, count(*) FILTER (WHERE {LUMA} < 215 AND x >= 4 AND y >= 1) AS dark, count(*) FILTER (WHERE {LUMA} <= 235) AS grey FROM bs s JOIN pg p ON p.media_id = s.media_id AND p.frame_no = s.frame_no AND p.x BETWEEN ax AND bx AND p.y BETWEEN ay AND bt GROUP BY 1, 2, 3),
 cu AS (SELECT media_id, frame_no, bs.l, n, x0, x1, y0, y1, dark - n AS near, ((bx - ax + 1) * (bt - ay + 1) - grey) / ((bx - ax + 1) * (bt - ay + 1) - n) AS halo, sat FROM bs JOIN ct USING (media_id, frame_no, l)),
 cf AS (SELECT * FROM cu WHERE y1 - y0 + 1 >= 1.25 * (x1 - x0 + 1) AND near <= 1 AND halo >= 0.85 AND sat <= 60)"""


def page_cursors(spark, d):
    return M.cursors(page(spark, d), WIDTH, HEIGHT, area=(2, 9), wide=(1, 4), high=(2, 6), margin=(3, 1), near=1, halo=0.85)


@query("cursor_frames", f"WITH RECURSIVE {PG}, {CURSORS} SELECT media_id, frame_no, n, x0, x1, y0, y1, near, round(halo, 6) AS halo, round(sat, 6) AS sat FROM cf")
def cursor_frames(spark, d):
    return page_cursors(spark, d).select("media_id", "frame_no", "n", "x0", "x1", "y0", "y1", "near", F.round("halo", 6).alias("halo"), F.round("sat", 6).alias("sat"))


@query("rule_cursor_from_pixels", f"""WITH RECURSIVE {PG}, {CURSORS}, h AS (SELECT DISTINCT media_id, t_us FROM cf JOIN tm USING (media_id, frame_no)),
 g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 8000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_us) AS k FROM (SELECT *, t_us - lag(t_us) OVER (PARTITION BY media_id ORDER BY t_us) AS d FROM h))
 SELECT media_id, min(t_us) AS start, max(t_us) AS last, count(*) AS n FROM g GROUP BY media_id, k""")
def rule_cursor_from_pixels(spark, d):
    from tidemark.operators.events import hit_islands

    seen = times(spark, d).join(page_cursors(spark, d).select("media_id", "frame_no").distinct(), ["media_id", "frame_no"], "left_semi")
    return hit_islands(seen, ["media_id"], "t_us", 8_000_000)


HUE = "floor((CASE WHEN h < 0 THEN h + 360 ELSE h END) / 2 / {})::INTEGER"


def _vivid(area: tuple[int, int], most: int, aspect: tuple[float, float], wheel: int, bright: int, pale: int, edge: tuple[int, int]) -> str:
    return f"""{_components("vv", "cl", f"{SAT} > 90 AND greatest(b, g, r) > 90 AND x >= {edge[0]} AND y >= {edge[1]}")},
 hv AS (SELECT *, CASE WHEN greatest(b, g, r) = r THEN 60 * (g - b) / (greatest(b, g, r) - least(b, g, r)) WHEN greatest(b, g, r) = g THEN 120 + 60 * (b - r) / (greatest(b, g, r) - least(b, g, r)) ELSE 240 + 60 * (r - g) / (greatest(b, g, r) - least(b, g, r)) END AS h FROM vv_l),
 vb AS (SELECT media_id, frame_no, l, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(y) AS cy, count(DISTINCT {HUE.format(wheel)}) AS hues FROM hv GROUP BY ALL),
 vs AS (SELECT * FROM vb WHERE n BETWEEN {area[0]} AND {area[1]} AND greatest(x1 - x0 + 1, y1 - y0 + 1) <= {most} AND (x1 - x0 + 1) / (y1 - y0 + 1) BETWEEN {aspect[0]} AND {aspect[1]}),
 rg AS (SELECT DISTINCT v.media_id, v.frame_no, v.l, v.y + dy AS y, v.x + dx AS x FROM vv_l v SEMI JOIN vs ON vs.media_id = v.media_id AND vs.frame_no = v.frame_no AND vs.l = v.l CROSS JOIN grid WHERE abs(dy) <= 1 AND abs(dx) <= 1 AND v.y + dy BETWEEN 0 AND {HEIGHT - 1} AND v.x + dx BETWEEN 0 AND {WIDTH - 1}),
 ro AS (SELECT rg.* FROM rg ANTI JOIN vv_l v ON v.media_id = rg.media_id AND v.frame_no = rg.frame_no AND v.l = rg.l AND v.y = rg.y AND v.x = rg.x),
 rw AS (SELECT ro.media_id, ro.frame_no, l, count(*) AS size, count(*) FILTER (WHERE greatest(b, g, r) < {bright}) AS dk, count(*) FILTER (WHERE {SAT} > {pale}) AS vv FROM ro LEFT JOIN cl ON cl.media_id = ro.media_id AND cl.frame_no = ro.frame_no AND cl.y = ro.y AND cl.x = ro.x GROUP BY 1, 2, 3),
 vz AS (SELECT vs.*, coalesce(size > 0 AND 2 * dk < size AND 2 * vv < size, false) AS white FROM vs LEFT JOIN rw USING (media_id, frame_no, l))"""


LOOKS = {"area": (2, 12), "most": 6, "reach": 1}


@query("swatch_frames", f"WITH RECURSIVE {PG}, {_vivid((2, 12), 6, (0.4, 2.5), 20, 210, 40, (0, 0))}, b AS (SELECT *, lead(cy, 2) OVER (PARTITION BY media_id, frame_no ORDER BY cy) - cy AS h FROM vz) SELECT media_id, frame_no, count(*) FILTER (WHERE white) AS n_white FROM b GROUP BY 1, 2 HAVING bool_or(h < 5) AND count(*) FILTER (WHERE white) >= 3")
def swatch_frames(spark, d):
    return M.swatch_rows(M.vivid_blobs(coloured(spark, d), WIDTH, HEIGHT, **LOOKS), band=5)


@query("popup_intervals", f"""WITH RECURSIVE {PG}, {_vivid((3, 12), 16, (0.0, 1e9), 30, 225, 25, (4, 1))}, h AS (SELECT DISTINCT media_id, t_us AS t FROM vz JOIN tm USING (media_id, frame_no) WHERE white AND hues >= 3),
 o AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id ORDER BY t) AS i FROM h),
 s AS (SELECT media_id, i, t AS a, t + 800000 AS e, 1 AS k FROM o WHERE i = 1 UNION ALL SELECT o.media_id, o.i, CASE WHEN o.t - s.e <= 1500000 THEN s.a ELSE o.t END, CASE WHEN o.t - s.e <= 1500000 THEN greatest(s.e, o.t + 500000) ELSE o.t + 800000 END, CASE WHEN o.t - s.e <= 1500000 THEN s.k ELSE s.k + 1 END FROM s JOIN o ON o.media_id = s.media_id AND o.i = s.i + 1),
 z AS (SELECT media_id, k, greatest(0, min(a) - 600000) AS start, arg_max(e, i) AS e FROM s GROUP BY 1, 2)
 SELECT media_id, start, e + 1200000 AS "end" FROM z WHERE e - start <= 6000000""")
def popup_intervals(spark, d):
    return M.popup_intervals(coloured(spark, d), times(spark, d), WIDTH, HEIGHT, area=(3, 12), reach=1)


@query("bar_intervals", f"""WITH RECURSIVE {PG}, rw AS (SELECT media_id, frame_no, y, count(*) AS n FROM pg WHERE {LUMA} < 100 AND y >= 2 AND y < 19 GROUP BY 1, 2, 3 HAVING count(*) > 0.04 * {WIDTH}),
 h AS (SELECT media_id, t_us AS t FROM (SELECT media_id, frame_no FROM rw GROUP BY 1, 2 HAVING max(y) - min(y) <= 4) JOIN tm USING (media_id, frame_no)),
 o AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id ORDER BY t) AS i FROM h),
 s AS (SELECT media_id, i, t AS a, t + 450000 AS e, 1 AS k FROM o WHERE i = 1 UNION ALL SELECT o.media_id, o.i, CASE WHEN o.t - s.e <= 800000 THEN s.a ELSE o.t END, CASE WHEN o.t - s.e <= 800000 THEN greatest(s.e, o.t + 250000) ELSE o.t + 450000 END, CASE WHEN o.t - s.e <= 800000 THEN s.k ELSE s.k + 1 END FROM s JOIN o ON o.media_id = s.media_id AND o.i = s.i + 1),
 z AS (SELECT media_id, k, greatest(0, min(a) - 400000) AS start, arg_max(e, i) AS e FROM s GROUP BY 1, 2)
 SELECT media_id, start, e AS "end" FROM z WHERE e - start <= 1200000""")
def bar_intervals(spark, d):
    return M.bar_intervals(page(spark, d), times(spark, d), WIDTH, HEIGHT, share=0.04)


#: Sizes of the viewer's parts in frames as small as these.
SMALL = {
    "taskbar": {"bins": 8, "over": 0, "least": 4, "area": 4 * WIDTH}, "strip": 4, "wipe": 6, "badge": {"least": 2, "pad": 1, "corner": (8, 6)}, "swatches": {"area": (1, 12), "most": 6, "reach": 1},
    "panel": {"busy": 1, "top": 4}, "band": 3, "cursor": {"area": (2, 9), "wide": (1, 4), "high": (2, 6), "margin": (3, 1), "near": 1, "halo": 0.85}, "guard": {"least": 3, "share": 0.25},
}


def mixed(spark, d):
    """Frames of grey pixels, every third one coloured."""
    colours = [F.when(F.col("frame_no") % 3 == 0, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "bgr"]
    other = coloured(spark, d).select("media_id", "frame_no", "y", "x", *[F.col(c).alias(f"_{c}") for c in "bgr"])
    return page(spark, d).join(other, ["media_id", "frame_no", "y", "x"]).select("media_id", "frame_no", "y", "x", *colours)


@query("cleaned_pages")
def cleaned_pages(spark, d):
    return M.cleaned(stored(mixed(spark, d), "pages"), WIDTH, HEIGHT, **SMALL)


@query("filled_holes")
def filled_holes(spark, d):
    """Where a webcam's disc covers the page, the page is carried on into it."""
    p = stored(page(spark, d), "pages")
    disc = [(y, x) for y in range(6, 15) for x in range(40, 49) if (y - 10) ** 2 + (x - 44) ** 2 <= 20]
    hole = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in disc]))
    holes = p.select("media_id", "frame_no").distinct().select("media_id", "frame_no", hole.alias("s")).select("media_id", "frame_no", "s.y", "s.x")
    return M.filled(p, holes, WIDTH, HEIGHT)


TR = """ev AS (SELECT user_id % 40 AS media_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS frame_no, event_id FROM events),
 pl AS (SELECT media_id, frame_no, frame_no * 500000 AS t, CASE WHEN event_id % 11 > 0 THEN (frame_no // 9) % 4 // 3 * 8 END AS x, CASE WHEN event_id % 11 > 0 THEN (frame_no // 9) % 5 // 4 * -10 END AS y FROM ev)"""


def discs(spark, d):
    """A frame for each event: a dark disc that jumps by the frame's number, and is lost in every eleventh event's."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("media_id"), "event_id")
    e = e.withColumn("frame_no", F.row_number().over(Window.partitionBy("media_id").orderBy("event_id")).cast("long") - 1)
    ninth = F.floor(F.col("frame_no") / 9)
    return e.select("media_id", "frame_no", (F.col("frame_no") * 500_000).alias("t_us"), (F.floor(ninth % 4 / 3) * 8 + 40).alias("_x"), (40 - F.floor(ninth % 5 / 4) * 10).alias("_y"), (F.col("event_id") % 11 > 0).alias("_seen"))


@query("webcam_track", f"""WITH {TR}, h AS (SELECT media_id, median(x) AS hx, median(y) AS hy FROM pl GROUP BY 1 HAVING count(*) >= 8 AND count(x) >= 0.5 * count(*)),
 o AS (SELECT media_id, t, x - hx AS dx, y - hy AS dy FROM pl JOIN h USING (media_id)),
 c AS (SELECT media_id, t, dx, round_even(coalesce(last_value(dx IGNORE NULLS) OVER w, 0) / 2, 0) * 2 AS px, round_even(coalesce(last_value(dy IGNORE NULLS) OVER w, 0) / 2, 0) * 2 AS py FROM o WINDOW w AS (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, sum(CASE WHEN px = lag_x AND py = lag_y THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t) AS k FROM (SELECT *, lag(px) OVER (PARTITION BY media_id ORDER BY t) AS lag_x, lag(py) OVER (PARTITION BY media_id ORDER BY t) AS lag_y FROM c)),
 s AS (SELECT media_id, px, py, min(t) AS a, max(t) + 500000 AS b FROM r GROUP BY media_id, k, px, py HAVING max(t) + 500000 - min(t) >= 800000 AND greatest(abs(px), abs(py)) >= 6),
 v AS (SELECT s.media_id, a, b, px, py, count(*) AS n, count(*) FILTER (WHERE abs(o.dx - px) <= 2.5 AND abs(o.dy - py) <= 2.5) AS ok FROM s JOIN o ON o.media_id = s.media_id AND o.t >= a AND o.t < b AND o.dx IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
 SELECT media_id, a AS t0, b AS t1, px::BIGINT AS dx, py::BIGINT AS dy FROM v WHERE n >= 2 AND ok >= 0.8 * n""")
def webcam_track(spark, d):
    f = stored(discs(spark, d), "discs")
    spots = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in range(-6, 7) for x in range(-6, 7) if x * x + y * y <= 38]))
    px = f.where("_seen").select("media_id", "frame_no", "_x", "_y", spots.alias("s")).select("media_id", "frame_no", (F.col("_y") + F.col("s.y")).alias("y"), (F.col("_x") + F.col("s.x")).alias("x"), F.lit(90).alias("v"))
    home = f.select("media_id").distinct().select("media_id", F.lit(40).alias("cx"), F.lit(40).alias("cy"), F.lit(6).alias("r"))
    return W.track(f.select("media_id", "frame_no", "t_us"), W.disc_places(px, home, 100, 100, opening=1, pad=30))
