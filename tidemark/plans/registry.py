"""Registry queries: orders are jobs, lineitems their parts, customers their folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import registry as G
from tidemark.plans.base import query, table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END"
KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'render' WHEN 1 THEN 'edit' ELSE 'repeats' END"


def jobs(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "render").when(F.col("o_orderkey") % 3 == 1, "edit").otherwise("repeats")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), kind.alias("kind"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("title"))


J = f"j AS (SELECT o_orderkey AS id, {STATUS} AS status, {KIND} AS kind, o_custkey AS owner, o_orderpriority AS title FROM orders)"


@query("registry_upsert", f"WITH {J}, d AS (SELECT * FROM j WHERE id % 2 = 0), m AS (SELECT id, 'memory' AS status, kind, owner, title FROM j WHERE id % 3 < 2 AND id % 5 = 0) SELECT id, coalesce(m.status, d.status) AS status, coalesce(m.kind, d.kind) AS kind, coalesce(m.owner, d.owner) AS owner, coalesce(m.title, d.title) AS title FROM d FULL JOIN m USING (id)")
def registry_upsert(spark, d):
    j = jobs(spark, d)
    return G.upsert(j.where("id % 2 = 0"), j.where("id % 5 = 0").withColumn("status", F.lit("memory")))


@query("registry_retained", f"WITH {J} SELECT id, status FROM j WHERE id % 4 = 0 OR (status IN ('queued', 'running') AND id % 6 = 0)")
def registry_retained(spark, d):
    j = jobs(spark, d).withColumns({"output": F.concat(F.lit("o"), F.col("id")), "input": F.concat(F.lit("i"), F.col("id"))})
    files = j.where("id % 4 = 0").select(F.col("output").alias("path")).union(j.where("id % 6 = 0").select("input"))
    return G.retained(j, files).select("id", "status")


@query("registry_missing", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def registry_missing(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return G.missing(found, jobs(spark, d).where("status = 'done'"))


@query("newest_file", "SELECT o_custkey AS folder, arg_max('f' || o_orderkey, (o_orderdate, 'f' || o_orderkey)) AS path, epoch_us(max(o_orderdate))::BIGINT AS mtime FROM orders GROUP BY 1")
def newest_file(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    return G.newest(f)


@query("queue_position", f"WITH {J}, w AS (SELECT *, count(*) FILTER (status IN ('queued', 'running')) OVER (PARTITION BY owner ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM j) SELECT id, CASE WHEN status = 'queued' THEN n END AS position FROM w")
def queue_position(spark, d):
    return G.queue_position(jobs(spark, d), ["owner"], "id").select("id", "position")


@query("relink", r"""
 WITH v AS (SELECT c_custkey AS ord, 'v/' || c_name || '.mp4' AS name, 'p' || c_custkey AS parent, CASE WHEN c_custkey % 3 = 0 THEN 'F (' || c_mktsegment || ' ' || (c_custkey % 40) || ')' WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' ' || (c_custkey % 50) END AS pn FROM customer),
 k AS (SELECT ord, parent, 0 AS i, c AS k FROM (SELECT ord, parent, regexp_replace(regexp_replace(name, '^.*/', ''), '\.[^.]*$', '') AS c FROM v) UNION ALL SELECT ord, parent, 1, pn FROM v WHERE pn IS NOT NULL
       UNION ALL SELECT ord, parent, 2, trim(regexp_extract(pn, '\((.*)\)', 1)) FROM v WHERE trim(regexp_extract(coalesce(pn, ''), '\((.*)\)', 1)) <> ''),
 f AS (SELECT regexp_replace(lower(k), '[^a-z0-9]', '', 'g') AS key, arg_min(parent, ord * 10 + i) AS parent FROM k GROUP BY 1),
 j AS (SELECT p_partkey AS id, (['AUTOMOBILE', 'BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD'])[(p_partkey % 5 + 1)::INT] || ' ' || (p_partkey % 60) AS title FROM part)
 SELECT j.id, f.parent AS drive_parent FROM j JOIN f ON f.key = regexp_replace(lower(j.title), '[^a-z0-9]', '', 'g')""")
def relink(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    pn = F.when(k % 3 == 0, F.concat(F.lit("F ("), "c_mktsegment", F.lit(" "), (k % 40).cast("string"), F.lit(")"))).when(k % 3 == 1, F.concat("c_mktsegment", F.lit(" "), (k % 50).cast("string")))
    v = c.select(k.alias("ord"), F.concat(F.lit("v/"), "c_name", F.lit(".mp4")).alias("name"), F.concat(F.lit("p"), k.cast("string")).alias("parent"), pn.alias("parent_name"))
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD")])
    p = F.col("p_partkey")
    j = table(spark, d, "part").select(p.alias("id"), F.lit("render").alias("kind"), F.concat(F.get(names, (p % 5).cast("int")), F.lit(" "), (p % 60).cast("string")).alias("title"))
    return G.relink(j, v).select("id", "drive_parent")


@query("validated_parts", "SELECT l_orderkey AS request_id, bool_and(p_size > 5) AS ok, count(*) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def validated_parts(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, "done").otherwise("error").alias("status"))
    return G.checked(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("part")), parts)


@query("supersede", "SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN true ELSE false END AS superseded FROM orders")
def supersede(spark, d):
    j = jobs(spark, d).select("id").withColumn("superseded", F.lit(False))
    return G.supersede(j, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))).select("id", "superseded")


@query("bounded_log", "SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> '' ORDER BY conv_id DESC, turn DESC LIMIT 300")
def bounded_log(spark, d):
    return G.bounded_log(table(spark, d, "conversations").select("conv_id", "turn", "text"), 300, ("conv_id", "turn"))


@query("tombstones", f"WITH {J} SELECT id, status FROM j WHERE NOT (id % 7 = 0 AND status <> 'running')")
def tombstones(spark, d):
    j = jobs(spark, d)
    return G.visible(G.tombstoned(j, j.where("id % 7 = 0").select("id", F.lit(1).alias("at")))).select("id", "status")


@query("folder_tree", """
 WITH RECURSIVE e AS (SELECT p_partkey AS id, p_name AS name, p_partkey // 5 AS parent FROM part), t AS (
 SELECT id, name, parent, 'root' AS parent_name, 1 AS depth FROM e WHERE parent = 1 AND id <> 1 UNION ALL
 SELECT e.id, e.name, e.parent, t.name, t.depth + 1 FROM e JOIN t ON e.parent = t.id WHERE t.depth < 4) SELECT * FROM t""")
def folder_tree(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.floor(F.col("p_partkey") / 5).cast("long").alias("parent")).where("id <> 1")
    root = spark.range(1, 2).select("id", F.lit("root").alias("name"))
    return G.tree(e, root)


@query("pick_folder", """
 SELECT parent, arg_min(id, (r, id)) AS id FROM (SELECT p_size AS parent, p_partkey AS id, CASE WHEN lower(trim(p_type)) IN (SELECT lower(p_type) FROM part WHERE p_partkey = 1) THEN 0 WHEN lower(p_type) LIKE '%steel%' THEN 1 END AS r FROM part) WHERE r IS NOT NULL GROUP BY 1""")
def pick_folder(spark, d):
    p = table(spark, d, "part")
    name = p.where("p_partkey = 1").select("p_type").first().p_type  # one row, by key
    return G.pick_folder(p.select(F.col("p_size").alias("parent"), F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), [name], "steel")


@query("cache_keys", """SELECT page_id, md5(html || '{"a": 1, "b": "x"}') AS key FROM pages""")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", G.cache_key(F.col("html"), {"b": "x", "a": 1}).alias("key"))


@query("status_fallback", f"WITH {J} SELECT id, CASE WHEN id % 2 = 0 THEN 'live' ELSE status END AS status FROM j WHERE id % 2 = 0 OR id % 3 = 0")
def status_fallback(spark, d):
    j = jobs(spark, d)
    return G.status_with_fallback(j.where("id % 2 = 0").withColumn("status", F.lit("live")), j.where("id % 3 = 0"))


@query("job_view", f"WITH {J} SELECT id, title, status, (id % 1000) / 1000 AS progress, CASE WHEN status = 'done' THEN '/api/jobs/' || id || '/download' END AS download, id % 2 = 0 AS drive FROM j")
def job_view(spark, d):
    j = jobs(spark, d).withColumns({"progress": (F.col("id") % 1000) / 1000, "drive_parent": F.when(F.col("id") % 2 == 0, "p")})
    return G.job_view(j)


@query("title_keys", "SELECT p_partkey, regexp_replace(replace(replace(lower(p_name || ' (Edited)'), '(re-render)', ''), '(edited)', ''), '[^a-z0-9]', '', 'g') AS key FROM part")
def title_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.title_key(F.concat("p_name", F.lit(" (Edited)"))).alias("key"))


@query("page_ids", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, nullif(regexp_extract(url, '://([^/]+)', 1), '') AS host FROM pages")
def page_ids(spark, d):
    some = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", some("[?&]page=([0-9]+)").alias("page"), some("://([^/]+)").alias("host"))
