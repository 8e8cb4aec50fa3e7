"""Source divergence audit: which sources of a language use its words unlike others, and by which words.

Terms are runs of a-z (A-Z are lower-cased first) and of characters beyond ASCII. A language keeps the V terms that occur in
at least `least_docs` of its documents. In a group (language and source), and in the language as a whole, a kept term
with count c has the probability p = 1 + floor(10^9 * (c + 1) / (N + V)), N the sum of the counts of kept terms. The divergence of
p from q is f = floor((p - q)^2 / q). All arithmetic is on whole numbers.

Terms are counted in each task before anything is shuffled; a kept term's counts are one posting list. Two results:

* `term`: a group's TOP terms of largest f against the language, of those with p > q. Terms are held in buckets of their
  count. A bucket's largest p and its smallest q in the language bound f, as f rises with p and falls with q where p > q. Best-first:
  the buckets of highest bounds that hold TOP terms are evaluated, which gives a kth value; then those whose bound reaches it. The
  rest is below the kth value strictly, so ties are whole.
* `pair`: the sum of f over all kept terms for each two sources of a language. A term that neither source has adds the same f0;
  so a pair's sum is (V - n_g - n_h) * f0, a sum over g's terms and one over h's as if the other had none, and a correction for
  terms that both have. The sums over one source's terms need its distinct counts alone (at most sqrt(2 N) of them). The corrections
  come from the posting lists: each adds its sources' differences to a task's sums of pairs, and only
  sums leave the task, so neither pairs of a term nor absent terms are ever rows.

A posting list has an entry for each source of its language; the pairs of sources are the result itself.

Defined results: null texts, languages and sources are read as ''; a group without terms has count 0 for each kept term; a
language without kept terms has value 0 for each pair and no term rows; equal rows and repeated numbers are documents of their
own; equal values rank by the item's UTF-8 bytes; an empty table gives no rows; columns other than the three named are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored, table, text_or_empty

#: Scale of probabilities, documents that a kept term needs, ranks of the part `term`.
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Entries that a task holds before it hands on its sums; sources of a language in a block.
HELD, BLOCK = 1_000_000, 256

#: Bytes that aren't part of a term become blanks, A-Z become a-z; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): sums of each task, several rows for a term."""
    schema = "lang string, source string, term string, n long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, d) in seen.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([a] * k, pa.string()), pa.array([b] * k, pa.string()), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(d.__getitem__, n), pa.int64())], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            bodies = batch.column(2)
            for i, group in enumerate(names):
                n, d = seen[group]
                words = Counter(memoryview(bodies[i].as_buffer()).tobytes().translate(TERM_BYTES).split())
                before = len(n)
                n.update(words)
                d.update(words.keys())
                held += len(n) - before
                if held >= HELD:
                    yield from rows()
                    seen.clear()
                    held = 0
        yield from rows()

    body = [F.coalesce(F.col(c), F.lit("")) for c in (lang, source)]
    return docs.select(body[0].alias("lang"), body[1].alias("source"), F.encode(text_or_empty(text), "UTF-8").alias("text")).mapInArrow(run, schema)


def postings(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, m (occurrences in the language) and posts (array of source, n) of each kept term."""
    each = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = each.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return terms.where(F.col("d") >= least_docs).select("lang", "term", "m", "posts")


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact beyond 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """gid, lang, source, total (N + V), lang_total, v (V), n_terms and p0 (probability of an absent term) of each group."""
    each = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    sums = terms.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("_n"), F.count("*").alias("_k"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("_v"), F.sum("m").alias("_m"))
    rows = each.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["_n", "_k", "_v", "_m"])
    total = F.col("_n") + F.col("_v")
    p0 = F.when(total > 0, probability(F.lit(0).cast("long"), F.greatest(total, F.lit(1)))).otherwise(1)
    return rows.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", total.alias("total"), (F.col("_m") + F.col("_v")).alias("lang_total"), F.col("_v").alias("v"), F.col("_k").alias("n_terms"), p0.alias("p0"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """posts (array of gid, p, p0) of terms to a, b, value: for each two sources of a term what the sums over each
    one's terms have too much or too little, added up in the task."""
    for batch in batches:
        lists = batch.column(0)
        ends, flat = lists.offsets.to_numpy(), lists.values
        gid, p, p0 = (flat.field(k).to_numpy() for k in range(3))
        names, at = np.unique(gid, return_inverse=True)
        width, held = len(names), 0
        codes: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def summed() -> None:
            """One value for each pair so far."""
            code, x = np.concatenate(codes), np.concatenate(values)
            if width * width <= 4 * HELD:
                seen, place = np.arange(width * width), code
            else:
                seen, place = np.unique(code, return_inverse=True)
            out = np.zeros(len(seen), "int64")
            np.add.at(out, place, x)
            codes[:], values[:] = [seen], [out]

        sizes = np.diff(ends)
        for size in np.unique(sizes[sizes > 1]).tolist():
            starts = ends[:-1][sizes == size]
            rows, step = max(1, HELD // (size * size)), max(1, HELD // size)
            for i in range(0, len(starts), rows):
                some = starts[i : i + rows, None] + np.arange(size)
                for k in range(0, size, step):  # of a long list a slice against all
                    a, b = some[:, k : k + step, None], some[:, None, :]
                    x = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
                    codes.append((at[a] * width + at[b]).ravel())
                    values.append(x.ravel())
                    held += x.size
                    if held >= 4 * HELD:
                        summed()
                        held = 0
        if codes:
            summed()
            a, b = names[codes[0] // width], names[codes[0] % width]
            off = (a != b) & (values[0] != 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[off]), pa.array(b[off]), pa.array(values[0][off])], ["a", "b", "value"])


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gid, total, p0, v, n_terms, counts (array of n, k) and others (array of gid, p0, n_terms) to a, b, value: the
    sums over the group's own terms against others that lack them, in both directions, and the part of terms that both lack."""
    for batch in batches:
        for row in range(batch.num_rows):
            gid, total, p0, v, n_terms = (batch.column(k)[row].as_py() for k in range(5))
            counts, others = batch.column(5)[row].values, batch.column(6)[row].values
            ids, q0, k0 = (others.field(k).to_numpy() for k in range(3))
            here = ids != gid
            ids, q0, k0 = ids[here], q0[here], k0[here]
            if not len(ids):
                continue
            out, back = np.zeros(len(ids), "int64"), np.zeros(len(ids), "int64")
            if counts is not None and len(counts):
                n, k = counts.field(0).to_numpy(), counts.field(1).to_numpy()
                # beyond 64 bits only where a count exceeds nine billions
                p = np.array([1 + SCALE * (c + 1) // total for c in n.tolist()], "int64")
                for i in range(0, len(p), 4096):
                    x, w = p[i : i + 4096, None], k[i : i + 4096, None]
                    out += (_f(x, q0[None, :]) * w).sum(axis=0)
                    back += (_f(q0[None, :], x) * w).sum(axis=0)
            out += _f(np.int64(p0), q0) * (v - n_terms - k0)
            a = np.full(len(ids), gid, "int64")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids])), pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([out, back]))], ["a", "b", "value"])


def pair_values(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """gid, b (gid of another source of the language) and value, for each two sources."""
    lists = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("posts")).select("posts")
    both = lists.mapInArrow(_pair_sums, "a long, b long, value long")
    counts = entries.groupBy("gid", "n").agg(F.count("*").alias("k")).groupBy("gid").agg(F.collect_list(F.struct("n", "k")).alias("counts"))
    sized = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
    blocks = groups.join(sized, "lang").groupBy("lang", F.pmod(F.xxhash64("gid"), F.col("_blocks")).alias("_block")).agg(F.collect_list(F.struct("gid", "p0", "n_terms")).alias("others"))
    own = groups.join(counts, "gid", "left").join(blocks, "lang").select("gid", "total", "p0", "v", "n_terms", "counts", "others")
    alone = own.mapInArrow(_one_sided, "a long, b long, value long")
    return both.unionByName(alone).groupBy(F.col("a").alias("gid"), "b").agg(F.sum("value").alias("value"))


def top_terms(entries: DataFrame, top: int = TOP) -> DataFrame:
    """gid, item, value and rank of each group's terms of largest divergence, best-first by buckets of counts."""
    # a bucket holds the counts of one power of two, cut in four
    over = entries.where("p > q").withColumn("bucket", F.floor(F.log2("n") * 4))
    over = stored(over.select("gid", "term", "bucket", "p", "q"), "divergence-terms")
    buckets = over.groupBy("gid", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("k"))
    order = Window.partitionBy("gid").orderBy(F.desc("bound"), "bucket")
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q"))).withColumn("before", F.sum("k").over(order) - F.col("k"))
    buckets = stored(buckets.select("gid", "bucket", "bound", (F.col("before") < top).alias("first")), "divergence-buckets")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "term"))

    def best(chosen: DataFrame) -> DataFrame:
        seen = over.join(chosen.select("gid", "bucket"), ["gid", "bucket"]).select("gid", "term", divergence(F.col("p"), F.col("q")).alias("value"))
        return seen.withColumn("rank", rank).where(F.col("rank") <= top)

    one = stored(best(buckets.where("first")), "divergence-best")
    kth = one.groupBy("gid").agg(F.count("*").alias("k"), F.min("value").alias("kth")).where(F.col("k") >= top).select("gid", "kth")
    # a group with fewer terms than asked for has all of its buckets among the first
    more = buckets.where("NOT first").join(kth, "gid").where(F.col("bound") >= F.col("kth"))
    two = one.select("gid", "term", "value").unionByName(best(more).select("gid", "term", "value"))
    return two.withColumn("rank", rank).where(F.col("rank") <= top).select("gid", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    terms = stored(postings(term_counts(docs, lang, source, text), least_docs), "divergence-postings")
    groups = stored(groups_of(docs, terms, lang, source), "divergence-groups")
    named = groups.select("gid", "lang", "source", "total", "lang_total", "p0")
    entries = terms.select("lang", "term", "m", F.explode("posts").alias("x")).select("lang", "term", "m", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    entries = entries.join(named, ["lang", "source"])
    entries = stored(entries.select("gid", "lang", "term", "n", "p0", probability(F.col("n"), F.col("total")).alias("p"), probability(F.col("m"), F.col("lang_total")).alias("q")), "divergence-entries")
    names = groups.select("gid", "lang", "source")
    found = pair_values(groups, entries).join(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b").join(names, "gid")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    words = top_terms(entries, top).join(names, "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(words)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
ls AS (SELECT lang, count(*) AS v, sum(m) AS big FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(s.n, 0) AS total, coalesce(big, 0) AS big FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN ls USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.m + 1) // (g.big + g.v))::HUGEINT AS q FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pr
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM tm) WHERE rank <= 200
"""
