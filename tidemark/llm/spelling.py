"""Spelling variant grouping by rolling-hash deletions.

Words are runs of letters (A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased) of at least `least_points` code points that occur
`least_n` times at least. Of every `planted`-th occurrence of a run in a document, as a checksum of number and run decides, one letter is left
out. Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's form is its near word that occurs
most, if that occurs `ratio` times as often; its root is the last word of the chain of forms.

Runs are counted in each task before anything is shuffled. Words are put in order and numbered, so that a number stands for
a word and for its place among ties. A word of L letters has L remainders, each with one letter left out. The hash of a remainder
is joined from the polynomial hashes of its prefix and its suffix, for all words of a length at once in NumPy; two moduli
make 62 bits. Remainders and the words themselves are dealt out by the hash's upper bits (the radix) and sorted by it. In a run of
equal hashes the strings decide; those of more than LONG letters are held by their 128-bit digest instead, so that
no row grows with a word. Two words are near by

* replacement if they share a remainder at the same place: at most one word for each letter of the alphabet, and each near pair
  shares one such place only;
* insertion or deletion if the remainder of one is the other: a remainder that several places of a word leave is taken once.

So groups are bounded by alphabet and length. A member gets the count of the others and the best of them, found from the group's first
two; pairs aren't made. Forms are followed by doubling, and each step multiplies the count by `ratio`, so few rounds do.

Defined results: null and empty texts have no runs; a null document number is read as '' in the checksum; equal rows count
each; of near words that occur equally often the smallest in code-point order is taken; an empty table gives no rows; columns other
than the two named are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import key_groups, parts, stored, table

#: Distinct words that a task counts before it hands on its sums; letters up to which remainders are held as strings; bytes of a
#: batch of remainders; rows of whole groups that are compared together.
HELD, LONG, BATCH_BYTES, ROWS = 500_000, 128, 4 << 20, 100_000
#: Moduli and bases of the two hashes.
MODULI, BASES = (2147483647, 2147483629), (1_000_003, 998_244_353)

#: Latin-1 bytes of letters, A-Z in lower case; all others are blanks, characters beyond Latin-1 too.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def run_counts(docs: DataFrame, least_points: int = 6, planted: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: sums of each task, several rows for a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, number in enumerate(numbers):
                start = zlib.crc32(f"{number or ''}:".encode())
                for word, n in Counter((texts[i].as_py() or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                    size = len(word)
                    if size >= least_points:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if not h % planted:
                            at = h % size
                            word = word[:at] + word[at + 1 :]
                            if size == least_points:
                                continue
                        seen[word] += n
                if len(seen) >= HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")


def numbered(counts: DataFrame, least_n: int = 5, n: int | None = None) -> DataFrame:
    """id (in the order of words), word and n of the words that occur often enough."""
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    dealt = words.repartitionByRange(n, "word") if n else words.repartitionByRange("word")
    return dealt.sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")


def hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters: words of one length as rows. 62-bit hashes of the words, and of their remainders by the place left out."""
    k, size = letters.shape
    whole, rest = np.zeros(k, "uint64"), np.zeros((k, size), "uint64")
    for p, base in zip(map(np.uint64, MODULI), map(np.uint64, BASES)):
        prefix, suffix, power = np.zeros((size + 1, k), "uint64"), np.zeros((size + 1, k), "uint64"), [np.uint64(1)]
        for i in range(size):
            prefix[i + 1] = (prefix[i] * base + letters[:, i]) % p
            suffix[size - 1 - i] = (suffix[size - i] + letters[:, size - 1 - i] * power[i]) % p
            power.append(power[i] * base % p)
        without = (prefix[:size] * np.array(power[:size][::-1])[:, None] + suffix[1:]) % p
        whole = whole << np.uint64(31) | prefix[size]
        rest = rest << np.uint64(31) | without.T
    return whole.view("int64"), rest.view("int64")


def _fixed(flat: np.ndarray, size: int) -> pa.Array:
    """Binary values of one size from their bytes."""
    k = len(flat) // size
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(0, (k + 1) * size, size, dtype="int32")), pa.py_buffer(flat)])


def remainders(words: DataFrame) -> DataFrame:
    """key (hash), rest (its string, or its digest), id, n, place (-1 for the word itself) and first (whether no smaller place
    leaves the same)."""

    def emit(size: int, ids: np.ndarray, n: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, rest = hashes(letters.astype("uint64"))
        step = max(1, BATCH_BYTES // size)
        index = np.arange(size * len(ids))
        first = np.ones((len(ids), size), bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        for at in range(0, len(index), step):
            word, place = index[at : at + step] // size, index[at : at + step] % size
            if size <= LONG:
                without = np.arange(size - 1)[None, :] + (np.arange(size - 1)[None, :] >= place[:, None])
                strings = _fixed(np.ascontiguousarray(letters[word[:, None], without]).ravel(), size - 1)
            else:
                digests = b"".join(xxhash.xxh3_128_digest(letters[w, :i].tobytes() + letters[w, i + 1 :].tobytes()) for w, i in zip(word.tolist(), place.tolist()))
                strings = _fixed(np.frombuffer(digests, "uint8"), 16)
            yield batch(rest[word, place], strings, ids[word], n[word], place, first[word, place])
        strings = _fixed(letters.ravel(), size) if size <= LONG - 1 else _fixed(np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.tobytes()) for w in letters), "uint8"), 16)
        yield batch(whole, strings, ids, n, np.full(len(ids), -1), np.ones(len(ids), bool))

    def batch(key, rest, ids, n, place, first) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), rest, pa.array(ids), pa.array(n), pa.array(place.astype("int32")), pa.array(first)], ["key", "rest", "id", "n", "place", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            body = [w.encode("latin-1") for w in b.column(1).to_pylist()]
            sizes = np.array([len(w) for w in body], "int64")
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                rows = max(1, BATCH_BYTES // (size * 64))
                for i in range(0, len(some), rows):
                    at = some[i : i + rows]
                    letters = np.frombuffer(b"".join(body[j] for j in at), "uint8").reshape(-1, size)
                    yield from emit(size, ids[at], n[at], letters)

    return words.mapInArrow(run, "key long, rest binary, id long, n long, place int, first boolean")


def _near(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole runs of equal hashes to id, k (near words), best_n and best (the id of the best near word)."""
    key = group.column("key").to_numpy()
    same = np.append(False, key[1:] == key[:-1])
    group = group.filter(pa.array(same | np.append(same[1:], False)))
    if not group.num_rows:
        return
    n, ids, place, first = (group.column(c).to_numpy() for c in ("n", "id", "place", "first"))
    text = pc.dictionary_encode(group.column("rest").combine_chunks()).indices.to_numpy()
    out: list[tuple[np.ndarray, ...]] = []

    def others(rows: np.ndarray, by: tuple[np.ndarray, ...]) -> None:
        """The rows are groups by `by`; each row's others and the best of them."""
        rows = rows[np.lexsort((ids[rows], -n[rows], *(b[rows] for b in by)))]
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([b[rows][1:] != b[rows][:-1] for b in by])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(rows)))
        head, many = np.repeat(at, size), np.repeat(size, size)
        best = np.where(np.arange(len(rows)) == head, head + 1, head)
        more = many > 1
        mine, best = rows[more], rows[best[more]]
        out.append((ids[mine], many[more] - 1, n[best], ids[best]))

    others(np.flatnonzero(place >= 0), (place, text))
    words = np.flatnonzero(place < 0)
    centre = np.full(text.max() + 1, -1)
    centre[text[words]] = words
    longer = np.flatnonzero((place >= 0) & first & (centre[text] >= 0))
    if len(longer):
        c = centre[text[longer]]
        out.append((ids[longer], np.ones(len(longer), "int64"), n[c], ids[c]))
        order = longer[np.lexsort((ids[longer], -n[longer], text[longer]))]
        at = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
        c, best = centre[text[order[at]]], order[at]
        out.append((ids[c], np.diff(np.append(at, len(order))), n[best], ids[best]))
    columns = [np.concatenate(x) for x in zip(*out)]
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x.astype("int64")) for x in columns], ["id", "k", "best_n", "best"])


def near_words(words: DataFrame, n: int) -> DataFrame:
    """id, n_near, best_n and best of each word that has a near word."""
    rest = remainders(words).withColumn("radix", F.shiftright("key", 36))
    found = key_groups(rest, ["radix", "key"], _near, "id long, k long, best_n long, best long", n, least=ROWS)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("id").agg(F.sum("k").alias("n_near"), best.alias("b")).select("id", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: id, to (long). id and root: where the chain from id ends."""
    chain = stored(forms.toDF("id", "root"), "spelling-chain")
    while True:
        on = chain.toDF("_id", "_root")
        step = stored(chain.join(on, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-chain")
        chain = step.select("id", "root")
        if step.where("moved").isEmpty():
            return chain


def variants(docs: DataFrame, least_points: int = 6, least_n: int = 5, ratio: int = 5, planted: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    size = parts(docs, 8)
    words = stored(numbered(run_counts(docs, least_points, planted, key, text), least_n), "spelling-words")
    near = stored(near_words(words, size), "spelling-near")
    close = words.join(near, "id").where(F.col("best_n") >= ratio * F.col("n")).select("id", "best", "best_n")
    forms = stored(close, "spelling-forms")
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    ends = forms.join(roots(forms.select("id", "best")), "id").join(named("best"), "best").join(named("root"), "root")
    ends = ends.select("id", F.col("best_word").alias("form"), F.col("root_word").alias("_root"), F.col("best_n").alias("form_n"))
    out = words.join(near.select("id", "n_near"), "id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
t AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
o AS (SELECT i, r, count(*) AS n, hex(encode(i || ':' || r)) AS x FROM t WHERE length(r) >= 6 GROUP BY 1, 2),
b AS (SELECT i, r, n, list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT) AS b FROM o),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, tb),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT e.word AS a, e.n AS an, w.word AS b, w.n AS bn FROM e JOIN w ON e.rest = w.word),
p AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b, bn FROM d UNION ALL SELECT b, a, an FROM d),
s AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM p),
f AS (SELECT w.word, w.n, coalesce(s.k, 0)::BIGINT AS n_near, CASE WHEN s.n >= 5 * w.n THEN s.b END AS form, CASE WHEN s.n >= 5 * w.n THEN s.n END AS form_n FROM w LEFT JOIN s ON s.a = w.word AND s.r = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
