"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set holds its distinct shingles of lower-cased words. Circulant MinHash takes two
permutations: the first, a mix of the hash cut to D positions, scatters shingles over 0..D-1 (a few share one), the second
ranks positions, and coordinate k of a signature is the smallest rank after a circular shift by k. Coordinates are
banded; documents that agree in a band are candidates. For a pair at the threshold the chance that no band
agrees is below one in a million: bands and their coordinates are chosen for that.

Documents with equal sets are one node from the start. Links are confirmed on full sets, packed once for each node that
shares a band. In STARS rounds each node meets one pivot, a member of one of its buckets; what is linked
becomes one group, and buckets within one group are done. So near copies cost a few comparisons each, however
many there are. In buckets of CROWD members at most that still hold several groups, the members outside the largest one meet all others,
in blocks of BLOCK. The members of larger ones are met anew by their rarest shingles: two sets at the
threshold have one among the first size - threshold * size + 1 in common, so boilerplate that fills a bucket makes no pairs.
Members of a rare shingle outside its largest group meet all others whose sizes allow a link, dealt into blocks of BLOCK members by size: a task compares
two blocks, counting common shingles by a product of incidence matrices, in slices of columns. Tasks emit a spanning forest of the links that they confirm, never the
pairs they compared, and each pair that shares a band is either in one group by then or compared.

Defined results: without words or with a null or empty text the set is empty, n_shingles is 0 and
the document is linked with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows that repeat a document number are judged each by its own text; a null number is linked like others, its
component is the smallest number in its group, or null where there is none, and then it is kept; rows are told apart by 128-bit keys; an empty table gives no
rows; columns other than the two named are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, key_groups, parts, row_key, stored, table
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Positions of the permutations, bands and coordinates in a band at 85 percent, members of a block, rounds with pivots, and members
#: of a bucket beyond which they meet by their rarest shingles.
D, BANDS, ROWS, BLOCK, STARS, CROWD = 1 << 20, 64, 10, 256, 2, 4096
SEED = 20250101

_ranks: dict[int, np.ndarray] = {}


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, "uint64")
    # spaces can't be in a word, so a joined shingle is unambiguous
    grams = {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), "uint64", len(grams)))


def banding(percent: int) -> tuple[int, int]:
    """Bands and coordinates in each: the longest bands, of about BANDS * ROWS coordinates in all, that a
    pair at the threshold misses with a probability below one in a million."""
    s = percent / 100
    for rows in range(ROWS, 0, -1):
        bands = BANDS * ROWS // rows
        if (1 - s**rows) ** bands < 1e-6:
            return bands, rows
    return math.ceil(math.log(1e-6) / math.log(1 - s)), 1


def _ranking(k: int) -> np.ndarray:
    """The second permutation, its first k ranks once more at the end, so that a shift is a slice."""
    if k not in _ranks:
        p = np.random.default_rng(SEED).permutation(D).astype("uint32")
        _ranks[k] = np.concatenate([p, p[:k]])
    return _ranks[k]


def signature(hashes: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k coordinates. The first permutation is a bijective mix of the hash's bits, cut to D."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    at = (x & np.uint64(D - 1)).astype("int64")
    shifts = np.lib.stride_tricks.sliding_window_view(_ranking(k), k)
    out = np.full(k, np.iinfo("uint32").max, "uint32")
    for i in range(0, len(at), 512):
        np.minimum(out, shifts[at[i : i + 512]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = sig.reshape(bands, -1).astype("uint64")
    h = np.arange(bands, dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("int64")


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, row (key of number and text), n_shingles, set_hash (binary; null for an empty set) and keys (array of long)."""
    bands, rows_each = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                n, sets, keys, seen = [], [], [], {}
                for t in part.column(2).to_pylist():
                    if t not in seen:
                        s = shingles(t, size)
                        seen[t] = (len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(signature(s, bands * rows_each), bands)) if len(s) else (0, None, np.zeros(0, "int64"))
                    a, b, c = seen[t]
                    n.append(a)
                    sets.append(b)
                    keys.append(c)
                ends = np.cumsum([0, *map(len, keys)]).astype("int32")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["doc_id", "row", "n_shingles", "set_hash", "keys"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row struct<a:long,b:long>, n_shingles long, set_hash binary, keys array<long>")


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees; later pairs inside a tree are dropped."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for each left and right set."""
    sizes = [np.array([len(s) for s in side], "int64") for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), "float32")
    keep = [np.isin(f, shared) for f in flat]
    column = [np.searchsorted(shared, f[k]) for f, k in zip(flat, keep)]
    owner = [o[k] for o, k in zip(owner, keep)]
    for at in range(0, len(shared), 4096):
        width = min(4096, len(shared) - at)
        m = []
        for side, col, own in zip((left, right), column, owner):
            here = (col >= at) & (col < at + width)
            x = np.zeros((len(side), width), "float32")
            x[own[here], col[here] - at] = 1
            m.append(x)
        common += m[0] @ m[1].T
    both = common.astype("int64")
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def packed(docs: DataFrame, nodes: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """node and set (its sorted hashes as bytes) of each node, from the text of its row."""
    body = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text"))
    rows = body.join(nodes.select("node", "row"), "row").dropDuplicates(["row"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, size).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def confirmed(tasks: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """tasks: x, y, z (key of a task), node, label (group so far), left. Links a, b between left and right nodes of a
    task in different groups: a spanning forest of each task's."""

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        left = group.column("left").to_numpy()
        if left.all() or not left.any():
            return
        nodes, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        held = [np.frombuffer(b.as_py(), "uint64") for b in group.column("set")]
        i, j = np.flatnonzero(left), np.flatnonzero(~left)
        found = linked([held[k] for k in i], [held[k] for k in j], percent) & (label[i][:, None] != label[j][None, :])
        kept = _forest(len(nodes), ((int(i[a]), int(j[b])) for a, b in np.argwhere(found).tolist()))
        if kept:
            a, b = np.array(kept).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return key_groups(tasks.join(sets, "node").select("x", "y", "z", "node", "label", "left", "set"), ["x", "y", "z"], compare, "a long, b long", n)


def _pairs(mixed: DataFrame) -> DataFrame:
    """mixed: band, node, label, p (the bucket's pivot: order, node, label). node, label, x, x_label: one pivot in another
    group for each node that has one."""
    pairs = mixed.where(F.col("label") != F.col("p.label")).groupBy("node", "label").agg(F.min_by("p", F.struct("p.order", "p.node")).alias("p"))
    return pairs.select("node", "label", F.col("p.node").alias("x"), F.col("p.label").alias("x_label"))


def _star(pairs: DataFrame) -> DataFrame:
    """Tasks in which each node meets its pivot; a pivot of many nodes has many tasks."""
    pivots = pairs.groupBy("x", "x_label").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("k"))
    own = pairs.join(pivots.drop("x_label"), "x").select("x", F.pmod(F.xxhash64("node"), F.col("k")).alias("y"), "node", "label", F.lit(True).alias("left"))
    each = pivots.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("y"), F.col("x").alias("node"), F.col("x_label").alias("label"), F.lit(False).alias("left"))
    return own.unionByName(each).withColumn("z", F.lit(0).cast("long"))


def prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: node. node, size (of its set) and x: the rarest shingles of each set, so many that two sets at the threshold have one
    of them in common. Rarity is counted over the members; what one member alone has leads to nobody and is left out."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 200):
                held = [np.frombuffer(b.as_py(), "int64") for b in batch.column(1).slice(at, 200)]
                n = np.array([len(h) for h in held], "int64")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[at : at + 200], n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(held))], ["node", "size", "x"])

    each = sets.join(members, "node", "left_semi").select("node", "set").mapInArrow(spread, "node long, size long, x long")
    held = each.groupBy("x").agg(F.count("*").alias("_f")).where("_f > 1")
    own = Window.partitionBy("node")
    shared = each.join(held, "x").withColumns({"_i": F.row_number().over(own.orderBy("_f", "x")), "_n": F.count("*").over(own)})
    # the shingles of one member alone come first in its order
    few = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.col("_n"))
    return shared.where(F.col("_i") <= few).select("node", "size", "x")


def _within(mixed: DataFrame) -> DataFrame:
    """Tasks in which the members of each bucket outside its largest group meet all of them, in blocks; of buckets with the same
    members one is taken. Buckets have at most CROWD members, so a member is sent to CROWD / BLOCK tasks of a bucket at most."""
    same = mixed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_a"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("_b"))
    once = same.groupBy("n", "_a", "_b").agg(F.min("band").alias("band")).select("band", "n")
    main = mixed.groupBy("band", "label").agg(F.count("*").alias("k")).groupBy("band").agg(F.max(F.struct("k", "label")).alias("m"))
    sized = once.join(main, "band").select("band", F.ceil(F.col("n") / F.lit(BLOCK)).alias("_all"), F.ceil((F.col("n") - F.col("m.k")) / F.lit(BLOCK)).alias("_odd"), F.col("m.label").alias("_main"))
    rows = mixed.join(sized, "band")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    left = rows.where(F.col("label") != F.col("_main")).select(F.col("band").alias("x"), block("_odd").alias("y"), up_to("_all").alias("z"), "node", "label", F.lit(True).alias("left"))
    right = rows.select(F.col("band").alias("x"), up_to("_odd").alias("y"), block("_all").alias("z"), "node", "label", F.lit(False).alias("left"))
    # numbers below 0, so that no bucket meets a shingle's task
    return left.unionByName(right).withColumn("y", -1 - F.col("y"))


def _blocks(met: DataFrame, percent: int) -> DataFrame:
    """met: x (a group), node, label, size. Tasks in which the members of each group outside its largest label meet all members, in
    blocks by size: only blocks whose sizes allow a link meet. Of groups with the same members one is taken, and groups
    of one label are done."""
    same = met.groupBy("x").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_a"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("_b"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
    once = same.groupBy("n", "_a", "_b").agg(F.min("x").alias("x")).select("x")
    main = met.groupBy("x", "label").agg(F.count("*").alias("k")).groupBy("x").agg(F.max(F.struct("k", "label")).alias("m")).select("x", F.col("m.label").alias("_main"))
    place = F.row_number().over(Window.partitionBy("x").orderBy("size", "node")) - 1
    rows = met.join(once, "x").join(main, "x").select("x", "node", "label", "size", (F.col("label") != F.col("_main")).alias("odd"), F.floor(place / F.lit(BLOCK)).alias("b"))
    rows = stored(rows, "members")
    spans = rows.groupBy("x", "b").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.bool_or("odd").alias("odd"))
    left, right = spans.where("odd").select("x", F.col("b").alias("y"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), spans.select("x", F.col("b").alias("z"), "lo", "hi")
    meet = left.join(right, "x").where((F.col("_hi") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("_lo") * percent)).select("x", "y", "z")
    a = rows.where("odd").join(meet.withColumnRenamed("y", "b"), ["x", "b"]).select("x", F.col("b").alias("y"), "z", "node", "label", F.lit(True).alias("left"))
    b = rows.join(meet.withColumnRenamed("z", "b"), ["x", "b"]).select("x", "y", F.col("b").alias("z"), "node", "label", F.lit(False).alias("left"))
    return a.unionByName(b)


def linked_groups(docs: DataFrame, nodes: DataFrame, percent: int, size: int, key: str, text: str, n: int) -> DataFrame:
    """nodes: node, row, keys. node and label (a node of its group) of each node that is linked."""
    bands = nodes.select("node", F.explode("keys").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    bands = stored(bands.join(shared, "band"), "bands")
    # sets are looked up by node in each round; a bucketed table saves shuffling them each time
    rows = packed(docs, nodes.join(bands.select("node").distinct(), "node", "left_semi"), size, key, text)
    sets = bucketed(rows, n, ["node"], "sets")
    groups = None

    def mixed(turn: int) -> DataFrame:
        """The buckets that hold several groups; their pivot is the smallest node at first, so that nodes agree on few."""
        rows = bands.withColumn("label", F.col("node")) if groups is None else bands.join(groups, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        buckets = rows.groupBy("band").agg(F.min(F.struct(order.alias("order"), "node", "label")).alias("p"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("band", "p")
        return rows.join(buckets, "band")

    for turn in range(STARS + 1):
        if turn < STARS:
            pairs = stored(_pairs(mixed(turn)), "pairs")
            if pairs.isEmpty():  # no bucket holds several groups
                break
            tasks = _star(pairs)
        else:
            held = stored(mixed(turn).select("band", "node", "label"), "mixed")
            sized = held.groupBy("band").agg(F.count("*").alias("n"))
            tasks = _within(held.join(sized.where(F.col("n") <= CROWD), "band").select("band", "node", "label"))
            crowd = stored(held.join(sized.where(F.col("n") > CROWD), "band").select("node", "label").distinct(), "crowd")
            if not crowd.isEmpty():
                tasks = tasks.unionByName(_blocks(prefixes(crowd.select("node"), sets, percent).join(crowd, "node"), percent))
        links = stored(confirmed(tasks, sets, percent, n), "links")
        if links.isEmpty():
            continue
        # from links between nodes to links between groups
        if groups is None:
            groups = stored(components(links).toDF("node", "label"), "groups")
        else:
            label = lambda c: groups.toDF(c, f"_{c}")
            met = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            new = components(met).toDF("_old", "_new")
            fresh = new.select(F.col("_old").alias("node"), F.col("_new").alias("label")).join(groups, "node", "left_anti")
            groups = stored(groups.join(new, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label")).unionByName(fresh), "groups")
    return groups if groups is not None else nodes.select("node", F.col("node").alias("label")).where("false")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (key of number and text), n_shingles, component_id, kept and group_id (null for an empty set), for links
    of 100 * intersection >= percent * union."""
    n = parts(docs, 8)
    sigs = stored(signatures(docs, key, text, size, percent), "signatures")
    nodes = stored(sigs.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.first("keys").alias("keys")), "nodes")
    # a node's number is its smallest document's; where documents have none, or several texts one number, a hash
    twice = stored(nodes.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc").alias("_twice")), "twice")
    odd = not twice.isEmpty() or not nodes.where("doc IS NULL").isEmpty()
    if odd:
        own = F.when(F.col("doc").isNull() | F.col("_twice").isNotNull(), F.xxhash64("set_hash")).otherwise(F.col("doc"))
        nodes = nodes.join(twice, F.col("doc") == F.col("_twice"), "left").withColumn("node", own).drop("_twice")
    else:
        nodes = nodes.withColumn("node", F.col("doc"))
    groups = linked_groups(docs, nodes, percent, size, key, text, n)
    # a label is the smallest node of its group; with hashes among the nodes it needn't be the smallest number
    named = nodes.select("set_hash", "node", "doc").join(groups, "node", "left").select("set_hash", "doc", F.coalesce("label", "node").alias("group_id"))
    if odd:
        least = named.groupBy("group_id").agg(F.min("doc").alias("_c"))
        named = named.join(least, "group_id").select("set_hash", "group_id", "_c")
    else:
        named = named.select("set_hash", "group_id", F.col("group_id").alias("_c"))
    out = sigs.where("n_shingles > 0").select("doc_id", "row", "n_shingles", "set_hash").join(named, "set_hash").select("doc_id", "row", "n_shingles", F.col("_c").alias("component_id"), "group_id")
    # empty sets have no hash to join by
    empty = sigs.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    out = out.unionByName(empty)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "group_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "group_id")

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, md5_number(list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS i, a AS j FROM u UNION SELECT r.i, u.b FROM r JOIN u ON u.a = r.j),
c AS (SELECT i AS doc_id, min(j) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
