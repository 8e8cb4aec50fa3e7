"""Event-detection queries over the sampled series of the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.plans.base import BD, ER, EV, HOUR, IV, events, hits, query, with_

K = ["media_id"]
O = ["t_us", "event_id"]  # noqa: E741
RUN = """
 r0 AS (SELECT *, coalesce({flag}, false) AS on_ FROM {src}),
 r1 AS (SELECT *, lag(on_) OVER (PARTITION BY media_id ORDER BY t, event_id) AS p, lead(t) OVER (PARTITION BY media_id ORDER BY t, event_id) AS nx FROM r0),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 rn AS (SELECT media_id, g, min(t) AS start, max(t) AS last, arg_max(nx, (t, event_id)) AS closed_any, bool_or(nx IS NULL) AS open_, count(*) AS n FROM r2 WHERE on_ GROUP BY 1, 2)"""


@query("runs_open", with_(EV, RUN.format(src="ev", flag="value > 20")) + "SELECT media_id, start, last, CASE WHEN open_ THEN NULL ELSE closed_any END AS closed_at, n FROM rn WHERE n >= 2")
def runs_open(spark, d):
    return E.runs(events(spark, d), K, O, F.col("value") > 20, 2)


@query("freeze_runs", with_(EV, RUN.format(src="ev", flag="value < 30")) + """
 SELECT media_id, start, last, closed_any AS closed_at, n FROM rn WHERE n >= 3 AND NOT open_""")
def freeze_runs(spark, d):
    return E.runs(events(spark, d), K, O, F.col("value") < 30, 3, emit_open_run=False)


@query("panel_intervals", with_(EV, RUN.format(src="ev", flag="event_type = 'view'")) + """
 SELECT media_id, greatest(start - 1440000000, 0) AS start_us, CASE WHEN open_ THEN last + 900000000 ELSE closed_any + 1440000000 END AS end_us FROM rn""")
def panel_intervals(spark, d):
    r = E.runs(events(spark, d), K, O, F.col("event_type") == "view")
    p = HOUR * 2 // 5
    return r.select("media_id", F.greatest(F.col("start") - p, F.lit(0)).alias("start_us"), F.coalesce(F.col("closed_at") + p, F.col("last") + HOUR // 4).alias("end_us"))


@query("hit_islands", with_(EV) + """
 , h AS (SELECT media_id, t, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS d FROM ev WHERE event_type = 'error'),
 g AS (SELECT media_id, t, sum(CASE WHEN d IS NULL OR d > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM h)
 SELECT media_id, min(t) AS start, max(t) AS last, count(*) AS n FROM g GROUP BY media_id, g""")
def hit_islands(spark, d):
    return E.hit_islands(hits(spark, d), K, "t_us", 24 * HOUR)


@query("widening_islands", with_(EV).replace("WITH", "WITH RECURSIVE", 1) + """
 , h AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id ORDER BY t) AS i FROM ev WHERE event_type = 'error'),
 w AS (SELECT media_id, i, t, 1 AS g, true AS first FROM h WHERE i = 1 UNION ALL
       SELECT h.media_id, h.i, h.t, CASE WHEN h.t - w.t <= 86400000000 + CASE WHEN w.first THEN 10800000000 ELSE 0 END THEN w.g ELSE w.g + 1 END,
              h.t - w.t > 86400000000 + CASE WHEN w.first THEN 10800000000 ELSE 0 END FROM w JOIN h ON h.media_id = w.media_id AND h.i = w.i + 1),
 g AS (SELECT media_id, greatest(min(t) - 3600000000, 0) AS start, greatest(max(t) + 14400000000, min(t) + 25200000000) AS e FROM w GROUP BY media_id, g)
 SELECT media_id, start, e + 3600000000 AS "end" FROM g WHERE e - start <= 720000000000""")
def widening_islands(spark, d):
    return E.widening_islands(hits(spark, d), K, "t_us", gap=20 * HOUR, step=4 * HOUR, first_extra=3 * HOUR, before=HOUR, max_len=200 * HOUR, after=HOUR)


@query("hysteresis", with_(EV) + """
 , md AS (SELECT median(value) AS m FROM ev), f AS (SELECT ev.*, value < m - 4 AS stay, value < m - 6 AS enter FROM ev, md),
 r1 AS (SELECT *, lag(stay) OVER (PARTITION BY media_id ORDER BY t, event_id) AS p FROM f),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> stay THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 r3 AS (SELECT *, max(enter::INT) OVER (PARTITION BY media_id, g ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS on_ FROM r2 WHERE stay)
 SELECT media_id, min(t) AS start, max(t) AS last, count(*) AS n FROM r3 WHERE on_ = 1 GROUP BY media_id, g""")
def hysteresis(spark, d):
    e = events(spark, d)
    m = e.agg(F.median("value").alias("m")).first().m  # one number
    return E.hysteresis(e, K, O, F.col("value") < F.lit(m) - 6, F.col("value") < F.lit(m) - 4)


@query("persistent", with_(EV) + """
 , r1 AS (SELECT *, value > 20 AS on_, lag(value > 20) OVER (PARTITION BY media_id ORDER BY t, event_id) AS p FROM ev),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 r3 AS (SELECT *, row_number() OVER (PARTITION BY media_id, g ORDER BY t, event_id) AS n FROM r2 WHERE on_)
 SELECT event_id, media_id, t AS t_us, n AS n_run FROM r3 WHERE n >= 3""")
def persistent(spark, d):
    p = E.persistent(events(spark, d), K, O, F.col("value") > 20, 3)
    return p.select("event_id", "media_id", "t_us", F.col("_n").cast("long").alias("n_run"))


@query("cooldown", with_(EV).replace("WITH", "WITH RECURSIVE", 1) + """
 , r1 AS (SELECT *, value > 20 AS on_, lag(value > 20) OVER (PARTITION BY media_id ORDER BY t, event_id) AS p FROM ev),
 r2 AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> on_ THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 fired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, g ORDER BY t, event_id) AS n FROM r2 WHERE on_) WHERE n >= 2),
 stand AS (SELECT media_id, min(t) AS t FROM fired GROUP BY media_id UNION ALL
           SELECT x.media_id, min(f.t) FROM stand x JOIN fired f ON f.media_id = x.media_id AND f.t > x.t + 172800000000 GROUP BY x.media_id)
 SELECT media_id, t AS t_us, event_id FROM stand JOIN fired USING (media_id, t)""")
def cooldown(spark, d):
    p = E.persistent(events(spark, d), K, O, F.col("value") > 20, 2).select("media_id", "t_us", "event_id")
    return E.cooldown(p, K, "t_us", 48 * HOUR)


@query("change_points", with_(EV) + """
 , c AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY media_id ORDER BY t, event_id)) > 40 AS ch FROM ev),
 s AS (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS slide FROM c)
 SELECT media_id, slide::BIGINT AS slide, count(*) AS n, min(t) AS t0, max(t) AS t1, max(value) AS top, min(value) AS low FROM s GROUP BY 1, 2""")
def change_points(spark, d):
    e = events(spark, d)
    jump = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*K).orderBy(*O))) > 40
    s = E.segment_on_change(e.withColumn("_jump", jump), K, O, F.col("_jump"))
    return s.groupBy("media_id", "slide").agg(F.count("*").alias("n"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.max("value").alias("top"), F.min("value").alias("low"))


@query("trimmed_segments", with_(EV) + """
 , c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY media_id) AS m FROM ev)
 SELECT event_id, media_id FROM c WHERE i > 1 AND i <= m - 3""")
def trimmed_segments(spark, d):
    return E.trimmed_segments(events(spark, d), K, O).select("event_id", "media_id")


@query("rle_locf", with_(EV) + """
 , v AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN 20 * round_even(value / 20, 0) END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS q FROM ev),
 r1 AS (SELECT *, lag(q) OVER (PARTITION BY media_id ORDER BY t, event_id) AS p, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) AS i FROM v),
 r2 AS (SELECT *, sum(CASE WHEN i = 1 OR p IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1)
 SELECT media_id, any_value(q)::BIGINT AS value, min(t) AS start, max(t) AS last, count(*) AS n FROM r2 GROUP BY media_id, g""")
def rle_locf(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return E.rle_locf(e, K, O, ["value"], grid=20)


@query("phases", with_(EV, BD).replace("WITH", "WITH RECURSIVE", 1) + """
 , r AS (SELECT media_id, t, value AS v, row_number() OVER (PARTITION BY media_id ORDER BY t) AS i FROM ev),
 p AS (SELECT media_id, i, t, v, v AS f, 1 AS k FROM r WHERE i = 1 UNION ALL
       SELECT r.media_id, r.i, r.t, r.v, CASE WHEN abs(r.v - p.f) > 25 THEN r.v ELSE p.f END, CASE WHEN abs(r.v - p.f) > 25 THEN p.k + 1 ELSE p.k END FROM p JOIN r ON r.media_id = p.media_id AND r.i = p.i + 1),
 q AS (SELECT media_id, k, min(t) AS a, max(t) AS z, any_value(f) AS f, max(v) AS low, count(*) AS n FROM p GROUP BY media_id, k),
 m AS (SELECT *, sum(CASE WHEN k = 1 OR z - a >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM q),
 o AS (SELECT media_id, g, min(a) AS a, arg_min(f, k) AS f, max(low) AS low, sum(n)::BIGINT AS n FROM m GROUP BY media_id, g)
 SELECT media_id, CASE WHEN g = 1 THEN lo ELSE a END AS start, coalesce(lead(a) OVER (PARTITION BY media_id ORDER BY g), hi) AS "end", f AS first, low, n FROM o JOIN bd USING (media_id)""")
def phases(spark, d):
    e = events(spark, d)
    w = Window.partitionBy(*K)
    return E.phases(e.withColumns({"slide_start": F.min("t_us").over(w), "slide_end": F.max("t_us").over(w)}), K, "t_us", "value", 25, 24 * HOUR)


@query("longest_run", """
 WITH x AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_quantity > 15), g AS (SELECT k, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM x)
 SELECT k, max(n) AS longest FROM (SELECT k, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def longest_run(spark, d):
    from tidemark.plans.base import table

    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), "l_quantity")
    return E.longest_run(x, ["k"], "i", F.col("l_quantity") > 15)


@query("onset_settle", """
 WITH x AS (SELECT o_custkey AS k, epoch(o_orderdate)::DOUBLE AS t, o_totalprice AS diff FROM orders),
 m AS (SELECT *, max(diff) OVER (PARTITION BY k) AS top FROM x)
 SELECT k, min(t) - 0.5 / 30.0 AS onset, max(t) + 1.0 / 30.0 AS settle FROM m WHERE top >= 4.0 AND diff >= greatest(4.0, top * 0.35) GROUP BY 1""")
def onset_settle(spark, d):
    from tidemark.plans.base import table

    x = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"), F.col("o_totalprice").alias("diff"))
    return E.onset_settle(x, ["k"])


@query("grows_and_bridges", with_(EV) + """
 , s AS (SELECT media_id, event_id, t, value AS top, value + 30 AS bottom, t + 3600000000 AS e FROM ev),
 n AS (SELECT *, lead(t) OVER w AS nt, lead(top) OVER w AS ntop, lead(bottom) OVER w AS nbot, lag(e) OVER w AS pe, lag(t) OVER w AS pt FROM s WINDOW w AS (PARTITION BY media_id ORDER BY t, event_id))
 SELECT event_id, coalesce(nt - e < 36000000000 AND abs(ntop - top) < 30 AND nbot > bottom + 8, false) AS grows,
 coalesce(t - pe <= 14400000000, false) AS bridged, CASE WHEN t - pe <= 14400000000 THEN greatest(pt + 300000, pe - 800000) END AS donor_us FROM n""")
def grows_and_bridges(spark, d):
    w = Window.partitionBy(*K).orderBy(*O)
    s = events(spark, d).select("media_id", "event_id", "t_us", F.col("value").alias("top"), (F.col("value") + 30).alias("bottom"), (F.col("t_us") + HOUR).alias("e_us"))
    near = F.col("t_us") - F.lag("e_us").over(w) <= 4 * HOUR
    grows = (F.lead("t_us").over(w) - F.col("e_us") < 10 * HOUR) & (F.abs(F.lead("top").over(w) - F.col("top")) < 30) & (F.lead("bottom").over(w) > F.col("bottom") + 8)
    donor = F.greatest(F.lag("t_us").over(w) + 300_000, F.lag("e_us").over(w) - 800_000)
    return s.select("event_id", F.coalesce(grows, F.lit(False)).alias("grows"), F.coalesce(near, F.lit(False)).alias("bridged"), F.when(near, donor).alias("donor_us"))


@query("static_reuse", with_(EV, RUN.format(src="(SELECT *, abs(value - lag(value) OVER (PARTITION BY media_id ORDER BY t, event_id)) <= 10 AS still FROM ev)", flag="still")) + """
 , n AS (SELECT event_id, media_id, t, on_, row_number() OVER (PARTITION BY media_id, g ORDER BY t, event_id) AS i FROM r2),
 f AS (SELECT *, on_ AND i >= 2 AS reuse FROM n)
 SELECT event_id, reuse, last_value(CASE WHEN NOT reuse THEN event_id END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS source_id FROM f""")
def static_reuse(spark, d):
    w = Window.partitionBy(*K).orderBy(*O)
    e = events(spark, d).withColumn("still", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) <= 10, F.lit(False)))
    r = E.run_ids(e, K, O, F.col("still"))
    i = F.row_number().over(Window.partitionBy(*K, "_run").orderBy(*O))
    r = r.withColumn("reuse", F.col("still") & (i >= 2))
    return r.select("event_id", "reuse", F.last(F.when(~F.col("reuse"), F.col("event_id")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("source_id"))


@query("tumbling_windows", "SELECT user_id AS media_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS w_us, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    from tidemark.streaming.series import tumbling

    return tumbling(events(spark, d), 6 * HOUR)


@query("sliding_windows", with_(EV) + """
 , k AS (SELECT *, unnest([0, 1, 2]) AS i FROM ev)
 SELECT media_id, (t // 7200000000 - i) * 7200000000 AS w_us, count(*) AS n, sum(event_id)::BIGINT AS ids FROM k GROUP BY 1, 2""")
def sliding_windows(spark, d):
    from tidemark.streaming.series import sliding

    return sliding(events(spark, d), 6 * HOUR, 2 * HOUR)


@query("session_windows", with_(EV) + """
 , x AS (SELECT media_id, t, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS d FROM ev),
 g AS (SELECT media_id, t, sum(CASE WHEN d IS NULL OR d > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM x)
 SELECT media_id, min(t) AS s_us, max(t) + 28800000000 AS e_us, count(*) AS n FROM g GROUP BY media_id, g""")
def session_windows(spark, d):
    from tidemark.streaming.series import sessions

    return sessions(events(spark, d), 8 * HOUR)


@query("accepted_apart", with_(EV, IV).replace("WITH", "WITH RECURSIVE", 1) + """
 , r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, e) AS i FROM iv),
 a AS (SELECT media_id, i, event_id, true AS ok, e AS last, 1 AS n FROM r WHERE i = 1 UNION ALL
       SELECT r.media_id, r.i, r.event_id, a.n < 48 AND r.e > a.last + 400000, CASE WHEN a.n < 48 AND r.e > a.last + 400000 THEN r.e ELSE a.last END, a.n + CASE WHEN a.n < 48 AND r.e > a.last + 400000 THEN 1 ELSE 0 END
       FROM a JOIN r ON r.media_id = a.media_id AND r.i = a.i + 1)
 SELECT media_id, s AS start_us, e AS end_us, event_id FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.ok AND a.media_id = r.media_id AND a.i = r.i)""")
def accepted_apart(spark, d):
    from tidemark.plans.base import spans

    return E.accepted_apart(spans(spark, d).select("media_id", "start_us", "end_us", "event_id"), K, most=48)


@query("pinned_edges", with_(EV, IV, ER) + """
 SELECT iv.media_id, iv.event_id AS span, min(er.t) AS start, max(er.t) AS "end" FROM iv JOIN er ON iv.media_id = er.media_id AND er.t BETWEEN iv.s - 3600000000 AND iv.e + 3600000000 GROUP BY 1, 2""")
def pinned_edges(spark, d):
    from tidemark.plans.base import spans

    far = F.lit(1 << 60)
    s = spans(spark, d).select("media_id", F.col("event_id").alias("span"), F.col("start_us").alias("a"), F.col("end_us").alias("b"), (-far).alias("lo"), far.alias("hi"))
    return E.pinned_edges(s, hits(spark, d).select("media_id", F.col("t_us").alias("t")), K, HOUR)


@query("bubble_shifts", with_(EV) + """
 , v AS (SELECT *, (20 * round_even(value / 20, 0))::BIGINT AS x, (20 * round_even(value / 2 / 20, 0))::BIGINT AS y FROM ev),
 r1 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY media_id ORDER BY t, event_id)),
 r2 AS (SELECT *, sum(CASE WHEN i = 1 OR px <> x OR py <> y THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r1),
 r AS (SELECT media_id, any_value(x) AS x, any_value(y) AS y, min(t) AS t0, max(t) AS t1 FROM r2 GROUP BY media_id, g),
 h AS (SELECT media_id, median(x) AS hx, median(y) AS hy FROM r GROUP BY 1)
 SELECT media_id, t0, t1, x - hx AS dx, y - hy AS dy FROM r JOIN h USING (media_id) WHERE greatest(abs(x - hx), abs(y - hy)) >= 20""")
def bubble_shifts(spark, d):
    from tidemark.operators.raster import bubble_shifts as shifts

    e = events(spark, d).select("media_id", "t_us", "event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y"))
    return shifts(E.rle_locf(e, K, O, ["x", "y"], grid=20), 0, 20)
