"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group; groups are ordered by the digest of the text. The
smallest capacity for which a greedy left-to-right filling needs no more than the given number of
shards is found by binary search, and the greedy cuts for that capacity are the shards.

The group sizes stay on the cluster. The driver sees sums over digest prefixes, at most 4,096 of
them at first, and a greedy filling over sums gives a lower and an upper bound of each cut. Where
the bounds differ, the few prefixes around the cut are split further (at most REFINE prefixes a
round, 4,096 parts each), until the bounds meet at whole groups; so the result is exact. Only
DataFrame functions are used.

Defined results: a null text counts as an empty one (size 8, CRC of no bytes); null or repeated
document numbers are rows like others; equal rows take their slots in any order; an empty table
gives no rows; columns of the input other than the two named are left out. A group larger than an
even share raises the capacity to its size. With fewer groups than shards some shards are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored, table, text_or_empty

#: Hex digits by which a prefix grows, and prefixes that one round splits.
DIGITS, REFINE = 3, 64


@dataclass(frozen=True)
class Piece:
    """Neighbouring groups: all whose digest starts with prefix."""

    prefix: str
    size: int
    groups: int
    largest: int


def _fill(pieces: list[Piece], starts: list[int], capacity: int, shards: int, upper: bool) -> list[int]:
    """Ends of the shards, in units of size, of a greedy filling. Pieces of several groups are
    taken whole for a lower bound of each end, and as if divisible at will for an upper bound."""
    total, ends, base, at = starts[-1], [], 0, 0
    for _ in range(shards):
        reach = base + capacity
        while at < len(pieces) and starts[at + 1] <= reach:
            at += 1
        base = total if at == len(pieces) else reach if upper and pieces[at].groups > 1 and reach > starts[at] else starts[at]
        ends.append(base)
        if base >= total:
            break
    return ends


def _split(groups: DataFrame, pieces: list[Piece], which: set[int]) -> list[Piece]:
    """The pieces with those at the places in which replaced by their parts."""
    old = [pieces[i].prefix for i in sorted(which)]
    n = len(old[0]) if old else 0
    out: dict[str, list[Piece]] = {p: [] for p in old}
    for length in sorted({len(p) for p in old}):
        some = [p for p in old if len(p) == length]
        n = length + DIGITS
        rows = groups.where(F.substring("g", 1, length).isin(some)).groupBy(F.substring("g", 1, n).alias("p"))
        for r in rows.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).orderBy("p").collect():
            out[r.p[:length]].append(Piece(r.p, r.s, r.n, r.m))
    return [q for i, p in enumerate(pieces) for q in (out[p.prefix] if i in which else [p])]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """groups: g (hex digest, unique) and size (long). The smallest capacity, and for each shard
    after the first the prefix at which it starts."""
    first = groups.groupBy(F.substring("g", 1, DIGITS).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m"))
    pieces = [Piece(r.p, r.s, r.n, r.m) for r in first.orderBy("p").collect()]
    total, largest = sum(p.size for p in pieces), max((p.largest for p in pieces), default=0)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the second always suffices
    while True:
        starts = [0]
        for p in pieces:
            starts.append(starts[-1] + p.size)
        doubt = None
        while low < high and doubt is None:
            mid = (low + high) // 2
            lower, upper = _fill(pieces, starts, mid, shards, False), _fill(pieces, starts, mid, shards, True)
            if lower[-1] >= total:
                high = mid
            elif upper[-1] < total:
                low = mid + 1
            else:
                doubt = (lower, upper)
        if doubt is None:
            lower, upper = _fill(pieces, starts, low, shards, False), _fill(pieces, starts, low, shards, True)
            if lower == upper:
                return low, [pieces[starts.index(e)].prefix for e in lower if e < total]
            doubt = (lower, upper)
        which: set[int] = set()
        spans = list(zip(*doubt))
        for i, p in enumerate(pieces):
            if p.groups > 1 and len(which) < REFINE and any(a < starts[i + 1] and b > starts[i] for a, b in spans if a < b):
                which.add(i)
        pieces = _split(groups, pieces, which)


def shard_of(cuts: list[str], g: Column) -> Column:
    """The shard of a digest: how many cuts it has reached."""
    return sum(((g >= c).cast("int") for c in cuts), F.lit(0)).cast("int")


def shards(docs: DataFrame, n: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, g (digest), shard and slot of each row."""
    body = F.encode(text_or_empty(text), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("g"))
    # one table in the order of digest and number: a large group spans partitions, and a row's place
    # within its partition is the low part of the id
    placed = rows.repartitionByRange(parts(docs), "g", "doc_id").sortWithinPartitions("g", "doc_id").withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed, "shard-rows")
    groups = stored(placed.groupBy("g").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, n)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"shard": shard_of(cuts, F.col("g")), "_part": part, "_place": place})
    held = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    bases = held.select("shard", "_part", "_first", before.alias("_before"))
    # bases has a row for each of at most MOST_PARTS partitions, and one more for each cut: below 2 MB
    return placed.join(F.broadcast(bases), ["shard", "_part"]).select("doc_id", "size", "text_crc32", "g", "shard", (F.col("_before") + F.col("_place") - F.col("_first")).alias("slot"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

OP6_SQL = r"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, ''))::BIGINT + 8 AS size, md5(coalesce(text, '')) AS g FROM documents),
b AS (SELECT g, list_transform(range(0, strlen(x)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT g, any_value(x) AS x, hex(encode(any_value(x))) AS h FROM d GROUP BY g)),
c AS (SELECT g, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM b, tb),
gr AS (SELECT g, z, sum(z) OVER (ORDER BY g) AS pre FROM (SELECT g, sum(size)::BIGINT AS z FROM d GROUP BY g)),
pf AS (SELECT list(pre::BIGINT ORDER BY pre) AS ps, max(pre)::BIGINT AS total, max(z) AS big FROM gr),
st AS (SELECT greatest(big, (total + 23) // 24) AS lo, (total + 23) // 24 + big AS hi, 0 AS k, 0::BIGINT AS base FROM pf UNION ALL
       SELECT CASE WHEN nb < total AND k = 23 THEN mid + 1 ELSE lo END, CASE WHEN nb = total THEN mid ELSE hi END,
              CASE WHEN nb = total OR k = 23 THEN 0 ELSE k + 1 END, CASE WHEN nb = total OR k = 23 THEN 0 ELSE nb END
       FROM (SELECT *, (lo + hi) // 2 AS mid, list_max(list_filter(ps, lambda x: x <= base + (lo + hi) // 2)) AS nb FROM st, pf WHERE lo < hi)),
cap AS (SELECT lo AS cap FROM st WHERE lo = hi LIMIT 1),
cu AS (SELECT 0::BIGINT AS base UNION ALL SELECT list_max(list_filter(ps, lambda x: x <= base + cap)) FROM cu, pf, cap WHERE base < total),
sh AS (SELECT g, (SELECT count(*) - 1 FROM cu WHERE base < pre)::INTEGER AS shard FROM gr)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM d JOIN c USING (g) JOIN sh USING (g)
"""
