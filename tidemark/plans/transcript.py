"""Transcript queries: conversations are transcripts (a turn is a segment, a word lasts 0.3 s of 0.4 s, and every
seventh word is followed by a pause of a second); documents are corpora of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import repeats as R
from tidemark.plans.base import EV, IV, query, spans, table, with_


def segments(spark, d) -> DataFrame:
    """media_id, seg_no, text, words with times: word i of a media begins at 0.4 i + (i div 7) seconds."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_no"), "text").repartition("media_id")  # texts are dealt out, which are smaller than their words
    c = c.withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("media_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("k", before)
    at = lambda i: (F.col("k") + i) * 0.4 + F.floor((F.col("k") + i) / 7) * 1.0
    return c.select("media_id", "seg_no", "text", F.transform("w", lambda x, i: F.struct(x.alias("word"), at(i).alias("start"), (at(i) + 0.3).alias("end"))).alias("words"))


def words(spark, d) -> DataFrame:
    return R.word_stream(segments(spark, d))


#: The words of conversations: media_id, pos, norm, raw, s, e (microseconds).
WORDS = r"""
 c AS (SELECT conv_id AS media_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations),
 f AS (SELECT media_id, turn, unnest(w) AS raw, unnest(range(len(w))) AS i FROM c),
 n AS (SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY turn, i) - 1)::INTEGER AS pos, trim(raw) AS raw, regexp_extract(lower(raw), '[a-z0-9'']+') AS norm FROM f),
 words AS (SELECT media_id, pos, norm, raw, pos::BIGINT * 400000 + (pos // 7)::BIGINT * 1000000 AS s, pos::BIGINT * 400000 + (pos // 7)::BIGINT * 1000000 + 300000 AS e FROM n)"""


@query("word_stream", "WITH " + WORDS + " SELECT media_id, pos, norm, raw, s AS start_us, e AS end_us FROM words")
def word_stream(spark, d):
    return words(spark, d)


@query("slim_transcript", """
 WITH c AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)
 SELECT conv_id AS media_id, turn AS seg_no, trim(text) AS text, len(w)::INTEGER AS n_words, w[1] AS first_word, w[-1] AS last_word FROM c""")
def slim_transcript(spark, d):
    return R.slim(segments(spark, d)).select(
        "media_id", "seg_no", "text", F.size("words").alias("n_words"), F.get("words", F.lit(0))["word"].alias("first_word"), F.get("words", F.size("words") - 1)["word"].alias("last_word")
    )


@query("repeats_set", r"""
 WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
 g AS (SELECT doc_id, i AS pos, list_aggregate(list_slice(w, i, i + 2), 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))
 SELECT a.doc_id, a.gram, count(*) AS n FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.pos - a.pos BETWEEN 3 AND 7 GROUP BY 1, 2""")
def repeats_set(spark, d):
    """Trigrams that come again 3 to 7 words later, by lagged equality over each document's words."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "w"))
    full = F.lead("w", 2).over(w).isNotNull()
    g = t.select("doc_id", "pos", F.when(full, F.concat_ws(" ", "w", F.lead("w", 1).over(w), F.lead("w", 2).over(w))).alias("gram"))
    n = sum((F.coalesce(F.col("gram") == F.lead("gram", k).over(w), F.lit(False)).cast("long") for k in range(3, 8)), F.lit(0).cast("long"))
    return g.select("doc_id", "gram", n.alias("n")).where("n > 0").groupBy("doc_id", "gram").agg(F.sum("n").alias("n"))


@query("jaccard_items", r"""
 WITH t AS (SELECT item_id AS id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ0-9'']+'), lambda x: length(x) > 1)) AS t FROM benchmark)
 SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS common FROM t a JOIN t b ON a.id < b.id
 WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) * 20 >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))""")
def jaccard_items(spark, d):
    """Benchmark items whose token sets overlap by a twentieth or more, through shared rare tokens."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.accent_tokens(F.col("text")).alias("t"))
    pairs = R.near_sets(b, b, 0.05).where("a < b").join(b.toDF("a", "_x"), "a").join(b.toDF("b", "_y"), "b")
    got = pairs.withColumn("common", F.size(F.array_intersect("_x", "_y")))
    return got.where(F.col("common") * 20 >= F.size("_x") + F.size("_y") - F.col("common")).select("a", "b", "common")


@query("corrections_marked", "WITH " + WORDS + r""",
 m AS (SELECT *, lead(norm) OVER w AS n1, max(CASE WHEN s - pe > 900000 THEN pos END) OVER (PARTITION BY media_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p, count(*) OVER (PARTITION BY media_id) AS total
       FROM (SELECT *, lag(e) OVER (PARTITION BY media_id ORDER BY pos) AS pe FROM words) WINDOW w AS (PARTITION BY media_id ORDER BY pos)),
 k AS (SELECT media_id, pos, greatest(pos - 2, coalesce(p, 0), 0) AS a, e FROM m WHERE norm = 'with')
 SELECT k.media_id, x.s AS start_us, k.e AS end_us, (SELECT string_agg(raw, ' ' ORDER BY pos) FROM words y WHERE y.media_id = k.media_id AND y.pos BETWEEN k.a AND k.pos) AS text,
  coalesce((SELECT string_agg(raw, ' ' ORDER BY pos) FROM words y WHERE y.media_id = k.media_id AND y.pos BETWEEN k.pos + 1 AND k.pos + 8), '') AS keep_text, 'correction' AS type, 0.7::DOUBLE AS confidence
 FROM k JOIN words x ON x.media_id = k.media_id AND x.pos = k.a""")
def corrections_marked(spark, d):
    """Corrections with a frequent word as the marker, since the real ones don't occur here."""
    return R.corrections(words(spark, d), slips=("with",), retakes=())


@query("translation_guard", "SELECT doc_id, french > 4 * others AS french FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: x IN ({w}))) AS french, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) - len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: x IN ({w}))) AS others FROM documents)".format(w=", ".join(f"'{w}'" for w in T.FRENCH_WORDS)))
def translation_guard(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    fr = F.size(F.filter("t", T.is_french))
    return t.select("doc_id", (fr > 4 * (F.size("t") - fr)).alias("french"))


@query("repeated_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 5 GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 5)
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


def _history(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.where("turn % 2 = 0").select("text", (F.col("conv_id") % 3 == 0).alias("approved"))


def stutters(spark, d) -> DataFrame:
    """words, with speech that stutters: of every four turns one begins with its first five words twice, one with its first
    six twice of which the second time the third is another, and one breaks off after four and begins again."""
    s = segments(spark, d)
    plain = F.transform("words", lambda x: x["word"])
    w = F.filter(plain, lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) > 1)
    head = lambda n: F.slice(w, 1, n)
    other = F.concat(F.slice(w, 1, 2), F.array(F.lit("instead")), F.slice(w, 4, 3))
    kind = (F.col("media_id") + F.col("seg_no")) % 4
    text = F.when(kind == 1, F.concat(head(5), w)).when(kind == 2, F.concat(other, w)).when(kind == 3, F.concat(head(4), F.array(F.lit("-")), w)).otherwise(w)
    s = s.select("media_id", "seg_no", text.alias("t"), (kind == 3).alias("cut"))
    k = F.coalesce(F.sum(F.size("t") + 6).over(Window.partitionBy("media_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("k", k)
    # a second's pause before each turn, and where it breaks off
    at = lambda i: (F.col("k") + i + F.when(F.col("cut") & (i > 3), 2).otherwise(0)) * 0.4
    return R.word_stream(s.select("media_id", "seg_no", F.transform("t", lambda x, i: F.struct(x.alias("word"), at(i).alias("start"), (at(i) + 0.3).alias("end"))).alias("words")))


#: The words of stutters, with n (words of the media), c (content words so far), a (where a cut here begins).
STUTTERS = r"""
 c AS (SELECT conv_id AS m, turn, (conv_id + turn) % 4 AS kind, list_filter(string_split(text, ' '), lambda x: x <> '' AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > 1) AS w FROM conversations),
 t AS (SELECT m, turn, kind = 3 AS cut, CASE kind WHEN 1 THEN list_concat(w[1:5], w) WHEN 2 THEN list_concat(list_concat(list_append(w[1:2], 'instead'), w[4:6]), w) WHEN 3 THEN list_concat(list_append(w[1:4], '-'), w) ELSE w END AS t FROM c),
 k AS (SELECT *, coalesce(sum(len(t) + 6) OVER (PARTITION BY m ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM t),
 f AS (SELECT m, turn, i, raw, (k + i + CASE WHEN cut AND i > 3 THEN 2 ELSE 0 END)::DOUBLE * 0.4 AS at_ FROM (SELECT m, turn, cut, k, unnest(t) AS raw, unnest(range(len(t))) AS i FROM k)),
 w0 AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY turn, i) - 1 AS pos, trim(raw) AS raw, regexp_extract(lower(raw), '[a-z0-9'']+') AS norm, round(at_ * 1e6)::BIGINT AS s, round((at_ + 0.3) * 1e6)::BIGINT AS e FROM f),
 w1 AS (SELECT *, count(*) OVER (PARTITION BY m) AS n, sum(CASE WHEN norm <> '' AND norm NOT IN ({stop}) THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY pos) AS c,
        s - lag(e) OVER (PARTITION BY m ORDER BY pos) AS gap, min(pos) OVER (PARTITION BY m ORDER BY s RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW) AS near FROM w0),
 w AS (SELECT *, greatest(near, coalesce(max(CASE WHEN gap >= 450000 THEN pos END) OVER (PARTITION BY m ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) AS a FROM w1)""".format(stop=", ".join(f"'{x}'" for x in T.STOP_WORDS))


@query("repeats_exact", "WITH RECURSIVE " + STUTTERS + """,
 q AS (SELECT x.m, y.pos - x.pos AS d, x.pos FROM w x JOIN w y ON x.m = y.m AND x.norm = y.norm AND y.pos BETWEEN x.pos + 3 AND x.pos + 18),
 r AS (SELECT m, d, pos, max(pos) OVER (PARTITION BY m, d, g) - pos + 1 AS run FROM (SELECT *, pos - row_number() OVER (PARTITION BY m, d ORDER BY pos) AS g FROM q)),
 b AS (SELECT m, pos, max(least(run, d, 14)) AS len, arg_min(d, (-least(run, d, 14), d)) AS d FROM r WHERE least(run, d, 14) >= greatest(3, d - 4) GROUP BY m, pos),
 z AS (SELECT b.m, b.pos, b.len, b.pos + b.d AS b FROM b JOIN w x ON x.m = b.m AND x.pos = b.pos JOIN w y ON y.m = b.m AND y.pos = b.pos + b.len - 1
       WHERE x.norm <> '' AND y.c - x.c + CASE WHEN x.norm NOT IN ({stop}) THEN 1 ELSE 0 END >= 2),
 nx AS (SELECT z.*, y.pos AS nx FROM z ASOF LEFT JOIN z y ON z.m = y.m AND z.b <= y.pos),
 k_ AS (SELECT * FROM nx WHERE pos = (SELECT min(pos) FROM z WHERE z.m = nx.m) UNION ALL SELECT nx.* FROM k_ JOIN nx ON nx.m = k_.m AND nx.pos = k_.nx),
 o AS (SELECT k_.m, w.a, k_.b, least(k_.b + k_.len + 5, w.n) AS z, round(least(1.0, 0.55 + 0.08 * k_.len), 2)::DOUBLE AS conf FROM k_ JOIN w ON w.m = k_.m AND w.pos = k_.pos)
 SELECT o.m AS media_id, min(CASE WHEN w.pos = o.a THEN w.s END) AS start_us, min(CASE WHEN w.pos = o.b THEN w.s END) AS end_us,
 trim(string_agg(w.raw, ' ' ORDER BY w.pos) FILTER (w.pos < o.b)) AS text, trim(coalesce(string_agg(w.raw, ' ' ORDER BY w.pos) FILTER (w.pos >= o.b), '')) AS keep_text, 'verbatim_repeat' AS type, conf AS confidence
 FROM o JOIN w ON w.m = o.m AND w.pos >= o.a AND w.pos < o.z GROUP BY o.m, o.a, o.b, o.z, conf""".format(stop=", ".join(f"'{x}'" for x in T.STOP_WORDS)))
def repeats_exact(spark, d):
    return R.verbatim_repeats(stutters(spark, d))


@query("near_repeats")
def near_repeats(spark, d):
    return R.near_repeats(stutters(spark, d))


@query("false_starts")
def false_starts(spark, d):
    return R.false_starts(stutters(spark, d))


def retold(spark, d):
    """The turns of conversations as segments without word times; every third one is told again, shortened or with other words."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_remove(F.split("text", " "), "").alias("w"))
    n = F.size("w")
    short = F.slice("w", F.lit(1), F.greatest(F.lit(1), F.floor(n * 0.8).cast("int")))
    other = F.transform("w", lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit("x"))).otherwise(x))
    again = F.when(F.col("turn") % 2 == 0, short).otherwise(other)
    rows = c.select("conv_id", (F.col("turn") * 2).alias("o"), "w").unionByName(c.where("turn % 3 = 0").select("conv_id", (F.col("turn") * 2 + 1).alias("o"), again.alias("w")))
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("o")).cast("long")
    return rows.select(F.col("conv_id").alias("media_id"), no.alias("seg_no"), (no * 10_000_000).alias("start_us"), (no * 10_000_000 + 9_000_000).alias("end_us"), F.array_join("w", " ").alias("text"))


@query("similar_segments")
def similar_segments(spark, d):
    return R.similar_segments(retold(spark, d))


@query("repeat_candidates")
def repeat_candidates(spark, d):
    """The whole chain: words, detectors, past decisions, suppression."""
    return R.find_repeats(stutters(spark, d), _history(spark, d))


@query("rerank", r"""
 WITH c AS (SELECT item_id AS media_id, 0.5::DOUBLE AS confidence, text FROM benchmark),
 h AS (SELECT text, item_id % 3 = 0 AS approved FROM benchmark UNION ALL SELECT text, item_id % 4 < 2 FROM benchmark UNION ALL SELECT text, item_id % 5 = 1 FROM benchmark),
 k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ0-9'']+'), lambda x: length(x) > 1)) AS t FROM c),
 l AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ0-9'']+'), lambda x: length(x) > 1)) AS t FROM h),
 v AS (SELECT k.media_id, count(*) FILTER (l.approved) AS yes, count(*) FILTER (NOT l.approved) AS no FROM k JOIN l ON len(list_intersect(k.t, l.t)) * 10 >= 6 * (len(k.t) + len(l.t) - len(list_intersect(k.t, l.t))) GROUP BY 1)
 SELECT k.media_id, CASE WHEN coalesce(yes, 0) >= 2 AND yes > 2 * no THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence, k.text FROM k LEFT JOIN v USING (media_id) WHERE NOT (coalesce(no, 0) >= 2 AND no > 2 * yes)""")
def rerank(spark, d):
    b = table(spark, d, "benchmark")
    h = b.select("text", (F.col("item_id") % 3 == 0).alias("approved")).union(b.select("text", F.col("item_id") % 4 < 2)).union(b.select("text", F.col("item_id") % 5 == 1))
    return R.rerank(b.select(F.col("item_id").alias("media_id"), F.lit(0.5).alias("confidence"), "text"), h)


@query("suppress_overlaps", with_(EV, IV).replace("WITH", "WITH RECURSIVE", 1) + """
 , r AS (SELECT *, (event_id % 10) / 10 AS c, row_number() OVER (PARTITION BY media_id ORDER BY s, e) AS i FROM iv),
 k AS (SELECT media_id, i, i AS cur, e AS last, c, 1 AS slot FROM r WHERE i = 1 UNION ALL
       SELECT r.media_id, r.i, CASE WHEN r.s >= k.last - 50000 OR r.c > k.c THEN r.i ELSE k.cur END, CASE WHEN r.s >= k.last - 50000 OR r.c > k.c THEN r.e ELSE k.last END,
              CASE WHEN r.s >= k.last - 50000 OR r.c > k.c THEN r.c ELSE k.c END, k.slot + CASE WHEN r.s >= k.last - 50000 THEN 1 ELSE 0 END
       FROM k JOIN r ON r.media_id = k.media_id AND r.i = k.i + 1),
 z AS (SELECT media_id, arg_max(cur, i) AS i FROM k GROUP BY media_id, slot)
 SELECT media_id, s AS start_us, e AS end_us, 'x' AS type, c AS confidence FROM z JOIN r USING (media_id, i)""")
def suppress_overlaps(spark, d):
    s = spans(spark, d).select("media_id", "start_us", "end_us", F.lit("x").alias("type"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return R.suppress_overlaps(s)


@query("review_roundtrip", """
 SELECT event_id AS media_id, (round(epoch_us(ts) / 10000.0) * 10000)::BIGINT AS start_us, (round(epoch_us(ts) / 10000.0) * 10000)::BIGINT + floor(value)::BIGINT * 1000000 AS end_us FROM events WHERE event_id % 2 = 0 AND floor(value) > 0""")
def review_roundtrip(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("media_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), "value")
    c = e.select("media_id", "start_us", (F.col("start_us") + F.floor("value") * 1_000_000).alias("end_us"), F.lit("x").alias("type"), F.lit(0.5).alias("confidence"), F.lit("t").alias("text"), F.lit("k").alias("keep_text"))
    return R.approved_cuts(R.review(c).withColumn("approve", F.col("media_id") % 2 == 0))


@query("disfluency_routing", """
 SELECT o_orderkey AS media_id, CASE WHEN upper(l) LIKE 'MUTE\\_%' ESCAPE '\\' OR upper(l) LIKE '%BREATH%' THEN 'mute' ELSE 'cut' END AS action, regexp_replace(upper(l), '^(MUTE_|CUT_)', '') AS type
 FROM (SELECT o_orderkey, (['MUTE_BREATH', 'CUT_FILLER_SOUND', 'DEADAIR', 'breath', 'mute_noise'])[(o_orderkey % 5 + 1)::INT] AS l FROM orders)""")
def disfluency_routing(spark, d):
    labels = F.array(*[F.lit(x) for x in ("MUTE_BREATH", "CUT_FILLER_SOUND", "DEADAIR", "breath", "mute_noise")])
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.get(labels, (F.col("o_orderkey") % 5).cast("int")).alias("l"))
    return o.select("media_id", T.action(F.col("l")).alias("action"), T.base_type(F.col("l")).alias("type"))


@query("disfluency_counts", """
 SELECT type, action, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 IN (0, 3, 4) THEN 'mute' ELSE 'cut' END AS action,
 (['BREATH', 'FILLER_SOUND', 'DEADAIR', 'BREATH', 'NOISE'])[(o_orderkey % 5 + 1)::INT] AS type FROM orders) GROUP BY 1, 2""")
def disfluency_counts(spark, d):
    return disfluency_routing(spark, d).groupBy("type", "action").agg(F.count("*").alias("n"))
