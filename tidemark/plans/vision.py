"""Raster queries: lineitems are sparse pixels (an order is a frame, quantity and price give places and colours)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import raster as P
from tidemark.plans.base import query, table

PX = "px AS (SELECT l_suppkey % 10 AS media_id, l_orderkey // 100 AS frame_no, (l_quantity * 8)::BIGINT AS x, l_partkey % 200 AS y, l_partkey * 7 % 256 AS b, l_partkey * 13 % 256 AS g, l_partkey * 31 % 256 AS r FROM lineitem)"


def pixels(spark, d):
    li, p = table(spark, d, "lineitem"), F.col("l_partkey")
    return li.select((F.col("l_suppkey") % 10).alias("media_id"), F.floor(F.col("l_orderkey") / 100).alias("frame_no"), (F.col("l_quantity") * 8).cast("long").alias("x"), (p % 200).alias("y"), (p * 7 % 256).alias("b"), (p * 13 % 256).alias("g"), (p * 31 % 256).alias("r"))


@query("background_mask", f"WITH {PX} SELECT media_id, count(*) AS n FROM px WHERE greatest(b, g, r) - least(b, g, r) <= 26 AND (floor((b + g + r) / 3) BETWEEN 125 AND 250 OR floor((b + g + r) / 3) BETWEEN 32 AND 124) GROUP BY 1")
def background_mask(spark, d):
    return pixels(spark, d).where(P.is_background()).groupBy("media_id").agg(F.count("*").alias("n"))


@query("ink_box", f"WITH {PX} SELECT media_id, frame_no, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM px WHERE (b + g + r) / 3 < 200 GROUP BY 1, 2")
def ink_box(spark, d):
    return P.ink_box(pixels(spark, d))


@query("badge_boxes", f"WITH {PX} SELECT media_id, frame_no, greatest(min(x) - 14, 0) AS x0, least(max(x) + 14, 399) AS x1, greatest(min(y) - 14, 0) AS y0, least(max(y) + 14, 199) AS y1, count(*) AS n FROM px WHERE x >= 270 AND y >= 110 AND r > 140 AND r - b > 50 GROUP BY 1, 2 HAVING count(*) >= 2")
def badge_boxes(spark, d):
    return P.badge_boxes(pixels(spark, d), 400, 200, least=2)


@query("taskbar_frames", f"WITH {PX}, c AS (SELECT media_id, frame_no, floor(x * 24 / 408)::BIGINT AS bin, count(*) AS n FROM px WHERE greatest(b, g, r) - least(b, g, r) > 45 GROUP BY 1, 2, 3) SELECT media_id, frame_no, count(*) FILTER (n > 1) AS busy FROM c GROUP BY 1, 2 HAVING count(*) FILTER (n > 1) >= 3 AND sum(n) < 0.35 * 92160")
def taskbar_frames(spark, d):
    return P.taskbar_frames(pixels(spark, d), 408, over=1, least=3)


@query("icon_rows", f"WITH {PX}, w AS (SELECT *, lead(y, 4) OVER v - y AS h, list(x) OVER (PARTITION BY media_id, frame_no ORDER BY y, x ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS xs, row_number() OVER v AS i FROM px WINDOW v AS (PARTITION BY media_id, frame_no ORDER BY y, x)), f AS (SELECT media_id, frame_no, arg_min(xs, i) AS xs FROM w WHERE h <= 30 GROUP BY 1, 2) SELECT media_id, frame_no FROM f WHERE list_max(xs) - list_min(xs) > 250")
def icon_rows(spark, d):
    return P.icon_rows(pixels(spark, d), height=30)


@query("content_bounds", f"WITH {PX}, n AS (SELECT media_id, frame_no, y, count(*) * 10 AS n FROM px GROUP BY 1, 2, 3), f AS (SELECT media_id, frame_no, min(y) AS t, max(y) AS b FROM n WHERE n > 5 GROUP BY 1, 2) SELECT media_id, round(quantile_cont(t, 0.02), 6) AS top, round(quantile_cont(b, 0.98), 6) AS bottom FROM f GROUP BY 1")
def content_bounds(spark, d):
    rows = pixels(spark, d).groupBy("media_id", "frame_no", "y").agg((F.count("*") * 10).alias("n"))
    b = P.content_bounds(rows, 5)
    return b.select("media_id", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("plate_repairs", f"WITH {PX}, m AS (SELECT media_id, y, median(g) AS md FROM px GROUP BY 1, 2), a AS (SELECT media_id, y, md, median(abs(g - md)) AS mad FROM px JOIN m USING (media_id, y) GROUP BY 1, 2, 3) SELECT media_id, y, count(*) AS n FROM px JOIN a USING (media_id, y) WHERE abs(g - md) > 26 AND mad < 60 GROUP BY 1, 2")
def plate_repairs(spark, d):
    return P.repairs(pixels(spark, d), ["media_id", "y"], "g", steady=60).groupBy("media_id", "y").agg(F.count("*").alias("n"))


@query("slide_overrides", "WITH s AS (SELECT p_partkey AS slide, 300 + p_partkey % 700 AS x1, 200 + p_partkey % 500 AS y1 FROM part), k AS (SELECT unnest(range(0, 41)) AS k), g AS (SELECT slide, max(100 - k) AS s FROM s, k WHERE power(x1 * (100 - k) / 100.0 - 800, 2) + power(y1 * (100 - k) / 100.0 - 500, 2) > 208.0 * 208.0 GROUP BY 1) SELECT slide, (coalesce(g.s, 60) / 100.0)::DOUBLE AS scale FROM s LEFT JOIN g USING (slide) WHERE coalesce(g.s, 60) < 100")
def slide_overrides(spark, d):
    p = F.col("p_partkey")
    s = table(spark, d, "part").select(p.alias("slide"), (p % 700 + 300).alias("x1"), (p % 500 + 200).alias("y1"))
    return P.slide_overrides(s, 800, 500, 208)


@query("panel_view", "SELECT l_suppkey AS media_id, round(median(l_quantity), 6) AS x, round(median(l_linenumber), 6) AS y, round(greatest(0.72 * 200, least(200, median(l_quantity * 4) / 0.55)), 6) AS size FROM lineitem GROUP BY 1")
def panel_view(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_quantity") * 4).alias("w"))
    return P.panel_view(f, 200.0).select("media_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "size")])


@query("components", f"""
 WITH RECURSIVE {PX}, q AS (SELECT media_id, frame_no, x // 8 AS x, y % 20 AS y FROM px GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame_no ORDER BY y, x) - 1 AS i FROM q),
 nb AS (SELECT a.media_id, a.frame_no, a.i, b.i AS j FROM p a JOIN p b ON a.media_id = b.media_id AND a.frame_no = b.frame_no AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.i <> b.i),
 r AS (SELECT media_id, frame_no, i, i AS j FROM p UNION SELECT r.media_id, r.frame_no, r.i, nb.j FROM r JOIN nb ON nb.media_id = r.media_id AND nb.frame_no = r.frame_no AND nb.i = r.j),
 l AS (SELECT media_id, frame_no, i, min(j) AS label FROM r GROUP BY ALL)
 SELECT media_id, frame_no, label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l JOIN p USING (media_id, frame_no, i) GROUP BY media_id, frame_no, label""")
def components(spark, d):
    return P.components(pixels(spark, d).select("media_id", "frame_no", (F.col("x") / 8).cast("long").alias("x"), (F.col("y") % 20).alias("y")).distinct())


def boxes(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_orderkey") % 89).alias("y"), F.col("l_quantity").cast("long").alias("w"), F.col("l_linenumber").cast("long").alias("h"))


BX = "bx AS (SELECT l_suppkey % 50 AS k, l_partkey % 97 AS x, l_orderkey % 89 AS y, l_quantity::BIGINT AS w, l_linenumber::BIGINT AS h FROM lineitem)"


@query("nearest_circle", f"WITH {BX} SELECT k, cx, cy, cr FROM (SELECT k, x AS cx, y AS cy, w AS cr, row_number() OVER (PARTITION BY k ORDER BY abs(x - 50) + abs(y - 40), x, y, w) AS i FROM bx) WHERE i = 1")
def nearest_circle(spark, d):
    return P.nearest(boxes(spark, d).select("k", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("w").alias("cr")), ["k"], 50, 40)


@query("largest_box", f"WITH {BX} SELECT k, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w * h DESC, y, x, w DESC) AS i FROM bx) WHERE i = 1")
def largest_box(spark, d):
    return P.largest(boxes(spark, d), ["k"])


@query("panel_rows", f"WITH {PX}, r AS (SELECT media_id, frame_no, y, count(*) AS c FROM px WHERE x < 0.20 * 1200 AND y < 0.45 * 300 AND greatest(b, g, r) - least(b, g, r) > 45 GROUP BY 1, 2, 3 HAVING count(*) >= 1) SELECT media_id, frame_no, min(y) AS y0, max(y) AS y1, count(*) AS n FROM r GROUP BY 1, 2 HAVING min(y) <= 20")
def panel_rows(spark, d):
    return P.panel_rows(pixels(spark, d), 1200, 300, busy=1, top=20)


@query("whitened_top", f"WITH {PX} SELECT media_id, sum(CASE WHEN y < 52 THEN 255 ELSE b END)::BIGINT AS b, sum(CASE WHEN y < 52 THEN 255 ELSE g END)::BIGINT AS g, sum(CASE WHEN y < 52 THEN 255 ELSE r END)::BIGINT AS r FROM px GROUP BY 1")
def whitened_top(spark, d):
    return P.whitened(pixels(spark, d)).groupBy("media_id").agg(*[F.sum(c).alias(c) for c in "bgr"])


@query("dark_rows", f"WITH {PX}, r AS (SELECT media_id, frame_no, y, count(*) FILTER ((b + g + r) / 3 < 90) AS d FROM px GROUP BY 1, 2, 3) SELECT media_id, frame_no, count(*) AS n_rows, min(y) AS y0, max(y) AS y1 FROM r WHERE d > 0.4 * 2 GROUP BY 1, 2 HAVING count(*) <= 4")
def dark_rows(spark, d):
    return P.dark_rows(pixels(spark, d), 2)


@query("padded_boxes", f"WITH {BX} SELECT k, w, h, least(480, greatest(0, x * 4 - 24)) AS x0, least(270, greatest(0, y * 4 - 48)) AS y0, least(480, greatest(0, (x + w) * 4 + 24)) AS x1, least(270, greatest(0, (y + h) * 4 + 48)) AS y1 FROM bx")
def padded_boxes(spark, d):
    b = boxes(spark, d).select("k", "w", "h", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return P.padded_box(b, 0.25, 24, 48, 480, 270)


@query("still_geometry", """
 WITH s AS (SELECT p_partkey AS slide, p_size * 40 AS w, p_size * 20 AS h, p_partkey % 1920 AS cx, p_partkey * 7 % 1080 AS cy FROM part),
 o AS (SELECT *, round_even(w * 0.75, 0)::BIGINT AS out_w, round_even(h * 0.75, 0)::BIGINT AS out_h FROM s), c AS (SELECT *, cx - out_w // 2 AS ax, cy - out_h // 2 AS ay FROM o)
 SELECT slide, out_w, out_h, greatest(0, ax) AS x, greatest(0, ay) AS y, greatest(0, -ax) AS crop_x, greatest(0, -ay) AS crop_y,
 greatest(0, least(out_w - greatest(0, -ax), 1920 - greatest(0, ax))) AS use_w, greatest(0, least(out_h - greatest(0, -ay), 1080 - greatest(0, ay))) AS use_h FROM c""")
def still_geometry(spark, d):
    p = F.col("p_partkey")
    s = table(spark, d, "part").select(p.alias("slide"), (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 20).alias("h"), F.lit(0.75).alias("scale"), (p % 1920).alias("cx"), (p * 7 % 1080).alias("cy"))
    return P.still_geometry(s)


@query("recenters", 'SELECT o_custkey AS media_id, o_orderkey AS slide, 0 AS start, o_orderkey % 50 * 250001 AS "end", (540 - (o_orderkey % 700 + 400) / 2)::DOUBLE AS dy FROM orders WHERE o_orderkey % 50 > 9 AND abs(540 - (o_orderkey % 700 + 400) / 2) > 24')
def recenters(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("media_id"), k.alias("slide"), F.lit(0).alias("start"), (k % 50 * 250001).alias("end"), (k % 700).alias("top"), F.lit(400).alias("bottom"))
    return P.recenters(o, 540.0)


@query("cursor_blobs", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 8 AS n FROM lineitem WHERE l_quantity::BIGINT * 8 BETWEEN 25 AND 400 AND l_linenumber * 6 + 1 >= 1.25 * 13 AND l_partkey % 60 <= 25 AND l_discount * 10 >= 0.9 AND l_suppkey % 90 <= 60")
def cursor_blobs(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 8).alias("n"), F.lit(0).alias("x0"), F.lit(12).alias("x1"), F.lit(0).alias("y0"), (F.col("l_linenumber") * 6).alias("y1"),
        (F.col("l_partkey") % 60).alias("near"), (F.col("l_discount") * 10).alias("halo"), (F.col("l_suppkey") % 90).alias("sat"),
    )
    return P.cursor_like(li).select("l_orderkey", "l_linenumber", "n")


@query("slide_scan", f"""
 WITH {PX}, fr AS (SELECT media_id, frame_no, sum(x) % 100 AS diff FROM px GROUP BY 1, 2),
 s AS (SELECT *, sum(CASE WHEN diff > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame_no) AS slide FROM fr),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, slide ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY media_id, slide) AS m FROM s) WHERE i > 1 AND i <= m - 3),
 n AS (SELECT media_id, slide, count(*) AS samples, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM t GROUP BY 1, 2 HAVING count(*) >= 3),
 c AS (SELECT media_id, slide, y, x, least(255, count(*)) AS seen FROM (SELECT DISTINCT media_id, frame_no, y % 5 AS y, x // 80 AS x FROM px WHERE (b + g + r) / 3 < 200) JOIN t USING (media_id, frame_no) GROUP BY ALL)
 SELECT n.media_id, n.slide::BIGINT AS slide, samples, first_frame, last_frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(x) AS n_cells
 FROM n LEFT JOIN c ON c.media_id = n.media_id AND c.slide = n.slide AND seen >= least(3, greatest(1, samples - 1)) GROUP BY n.media_id, n.slide, samples, first_frame, last_frame""")
def slide_scan(spark, d):
    p = pixels(spark, d)
    frames = p.groupBy("media_id", "frame_no").agg((F.sum("x") % 100).alias("diff"))
    return P.slide_scan(frames, p.withColumns({"y": F.col("y") % 5, "x": F.floor(F.col("x") / 80)}), 95)


@query("slide_extents", f"""
 WITH {PX}, fr AS (SELECT media_id, frame_no, sum(x) % 100 AS diff FROM px GROUP BY 1, 2),
 s AS (SELECT *, sum(CASE WHEN diff > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame_no) AS slide FROM fr),
 a AS (SELECT *, row_number() OVER (PARTITION BY media_id, slide ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY media_id, slide) AS m FROM s),
 n AS (SELECT media_id, slide, count(*) AS samples, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM a WHERE i > 1 AND i <= m - 3 GROUP BY 1, 2 HAVING count(*) >= 3),
 q AS (SELECT DISTINCT media_id, frame_no, y % 12 AS y, x // 40 AS x, (b + g + r) / 3 AS v FROM px),
 c AS (SELECT media_id, slide, y, x, least(255, count(*)) AS seen FROM (SELECT DISTINCT media_id, frame_no, y, x FROM q WHERE v < 200) JOIN a USING (media_id, frame_no) WHERE i > 1 AND i <= m - 3 GROUP BY ALL),
 o AS (SELECT c.* FROM c JOIN n USING (media_id, slide) WHERE seen >= least(3, greatest(1, samples - 1))),
 k AS (SELECT media_id, slide, y, count(*) AS w FROM o ANTI JOIN (SELECT media_id, slide, x FROM o GROUP BY ALL HAVING count(*) > 0.75 * 12) USING (media_id, slide, x) GROUP BY ALL HAVING count(*) <= 0.75 * 11 AND count(*) > 1),
 b AS (SELECT media_id, slide, min(y) AS t, max(y) AS e FROM k GROUP BY ALL),
 u AS (SELECT media_id, slide, min(y) AS t, max(y) AS e FROM (SELECT media_id, frame_no, y FROM q WHERE v < 238 GROUP BY ALL HAVING count(DISTINCT x) > 1) JOIN a USING (media_id, frame_no) WHERE i > 1 GROUP BY ALL)
 SELECT media_id, slide::BIGINT AS slide, samples, first_frame, last_frame, b.t AS top, b.e AS bottom, least(b.t, u.t) AS union_top, greatest(b.e, u.e) AS union_bottom FROM n JOIN b USING (media_id, slide) LEFT JOIN u USING (media_id, slide)""")
def slide_extents(spark, d):
    p = pixels(spark, d)
    frames = p.groupBy("media_id", "frame_no").agg((F.sum("x") % 100).alias("diff"))
    return P.slide_extents(frames, p.withColumns({"y": F.col("y") % 12, "x": F.floor(F.col("x") / 40)}), 95, 11, 12, row=1, most=0.75)
