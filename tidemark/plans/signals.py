"""Signal and aggregate queries; float results are rounded to six decimals where sums depend on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signal as S
from tidemark.plans.base import EV, events, query, table, with_


@query("mad", "WITH m AS (SELECT user_id AS media_id, median(value) AS md FROM events GROUP BY 1) SELECT media_id, round(md, 6) AS median, round(median(abs(value - md)), 6) AS mad FROM events JOIN m ON user_id = media_id GROUP BY 1, 2")
def mad(spark, d):
    return S.median_mad(events(spark, d), ["media_id"], "value").select("media_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY 1")
def percentiles(spark, d):
    p = S.percentiles(events(spark, d), ["event_type"], "value", (0.02, 0.5, 0.98))
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p2", "p50", "p98")])


@query("rms_db", "SELECT l_suppkey % 50 AS media_id, l_orderkey // 100 AS win_no, round(20 * log10(sqrt(avg(l_quantity * l_quantity) + 1e-12) + 1e-9), 6) AS db FROM (SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem) GROUP BY 1, 2 HAVING count(*) = 8")
def rms_db(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("media_id"), (F.floor(F.col("l_orderkey") / 100) * 8).alias("i"), F.col("l_quantity").alias("x"))
    return S.rms_db(li, ["media_id"], "i", "x", 8).withColumn("db", F.round("db", 6))


@query("busy_bins", "SELECT event_type, least(floor((value - 0) * 24 / 200), 23)::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2 HAVING count(*) > 40")
def busy_bins(spark, d):
    return S.busy_bins(events(spark, d), ["event_type"], "value", 0, 200)


@query("distinct_buckets", "SELECT user_id AS media_id, count(DISTINCT floor(value / 30)) AS n_buckets FROM events GROUP BY 1")
def distinct_buckets(spark, d):
    return S.distinct_buckets(events(spark, d), ["media_id"], "value", 30)


@query("seen_cells", "WITH n AS (SELECT l_suppkey AS slide, count(DISTINCT l_linenumber) AS samples FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey AS slide, l_partkey % 20 AS cell, least(255, count(*) FILTER (l_quantity > 25)) AS seen FROM lineitem GROUP BY 1, 2) SELECT slide, cell, seen FROM c JOIN n USING (slide) WHERE seen >= least(3, greatest(1, samples - 1))")
def seen_cells(spark, d):
    li = table(spark, d, "lineitem")
    n = li.groupBy(F.col("l_suppkey").alias("slide")).agg(F.count_distinct("l_linenumber").alias("samples"))
    c = li.groupBy(F.col("l_suppkey").alias("slide"), (F.col("l_partkey") % 20).alias("cell")).agg(S.saturating_count(F.col("l_quantity") > 25).alias("seen"))
    return c.join(n, "slide").where(S.seen_often(F.col("seen"), F.col("samples"))).select("slide", "cell", "seen")


@query("first_argmax", "SELECT o_custkey AS k, arg_max(o_orderkey, (floor(o_totalprice / 50000), -o_orderkey)) AS id, max(floor(o_totalprice / 50000))::BIGINT AS score FROM orders GROUP BY 1")
def first_argmax(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 50000).alias("score"))
    return S.first_argmax(o, ["k"], "score", "ord", "id")


@query("vote", "SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (abs(l_linenumber - 3) <= 2.5 AND abs(l_tax * 100 - 4) <= 2.5) AS agree FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (abs(l_linenumber - 3) <= 2.5 AND abs(l_tax * 100 - 4) <= 2.5) >= 0.38 * count(*)")
def vote(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("x"), (F.col("l_tax") * 100).alias("y"), F.lit(3).alias("px"), F.lit(4).alias("py"))
    return S.vote(p, ["k"], "x", "y", share=0.38)


@query("sliding_energy", with_(EV) + ", i AS (SELECT media_id, event_id, floor(value)::BIGINT AS x, row_number() OVER (PARTITION BY media_id ORDER BY event_id DESC) AS back FROM ev) SELECT media_id, event_id, x, sum(x * x) OVER (PARTITION BY media_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)::BIGINT AS energy FROM i QUALIFY back >= 4")
def sliding_energy(spark, d):
    e = events(spark, d).select("media_id", "event_id", F.floor("value").alias("x"))
    return S.sliding_energy(e, ["media_id"], "event_id", "x", 4)


@query("window_starts", "SELECT doc_id, unnest(range(0, n_chars - 600 + 1, 400)) AS start FROM documents WHERE n_chars >= 600")
def window_starts(spark, d):
    return S.window_starts(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 600, 400).select("doc_id", "start")


def sounds(spark, d):
    """Fifty embeddings in a row are a raw sound of 3,200 samples; the edited one leaves 200 out, or 300 and 400."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("media_id"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    raw = v.groupBy("media_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("raw"))
    part = lambda a, b: F.slice("raw", F.lit(a + 1), F.lit(b - a))
    cut = F.when(F.col("media_id") % 2 == 0, F.concat(part(0, 400), part(600, 3200))).otherwise(F.concat(part(0, 700), part(1000, 1900), part(2300, 3200)))
    return raw.withColumn("edited", cut)


@query("audio_anchors")
def audio_anchors(spark, d):
    return S.anchors(sounds(spark, d), rate=100)


@query("offset_segments")
def offset_segments(spark, d):
    return S.offset_segments(audio_anchors(spark, d), 12)


@query("recovered_keep")
def recovered_keep(spark, d):
    return S.recovered_keep(sounds(spark, d), rate=100)


@query("greedy_clusters")
def greedy_clusters(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") * 10).alias("cx"), (F.col("l_discount") * 1000).alias("cy"), (F.col("l_tax") * 100).alias("cr"))
    return S.greedy_clusters(p, ["k"], "ord")


@query("kept_time", "SELECT o_custkey AS media_id, sum(o_orderkey % 97)::BIGINT AS kept, count(*) AS n FROM orders GROUP BY 1")
def kept_time(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("media_id"), F.lit(0).alias("s"), (F.col("o_orderkey") % 97).alias("e"))
    return S.kept_time(o, ["media_id"], "s", "e")


@query("fraction_true", "SELECT l_returnflag, count(*) FILTER (l_quantity > 25)::DOUBLE / count(*) AS share FROM lineitem GROUP BY 1")
def fraction_true(spark, d):
    return S.fraction_true(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 25)


@query("grown_ink", "SELECT l_orderkey, bool_or(l_quantity > 1.06 * f) AS grew FROM (SELECT *, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS f FROM lineitem) GROUP BY 1")
def grown_ink(spark, d):
    return S.grown(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
