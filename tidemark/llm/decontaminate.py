"""Benchmark decontamination with templates.

Words are canonicalised: numbers, names (capitalised words) and units become typed placeholders, the
rest is lower-cased without outer punctuation. Windows of SIZE template words are hashed, and the
windows of documents are hash-joined to those of the benchmark. Each window is hashed in a second
form too, in which case is folded and capitalised words are literals; a window is hit if either form
agrees, so a copy in other case is found as one with other names is. For each document and item, the hits
near one alignment are counted, or along a chain of hits in the item's order within STRETCH words of the document
for each of the item's (LEAST_STRETCH at least), so that headings or answer fields may interrupt the item. The slots behind the placeholders are compared: a question with
other numbers or names has new slot values, but the same old value should always meet the same new
one. An item is leaked where hits cover at least SHARE of its windows and at least SHARE of the slot
positions follow such a mapping.

An item of fewer than SIZE words is one window of its own length, and documents are cut into windows of such lengths
too where items have them; it has to occur word for word, but for case and outer punctuation. Items below LEAST_WORDS
words are no evidence of a leak in a longer text: they match only documents that hold nothing else.

A window of placeholders alone says nothing, so it is hashed by its values. A document's windows of one hash travel as one row, so a text that repeats a window sends no row for each place. The
hashes of the benchmark's windows filter the documents' windows in the scan if the benchmark's files
are no larger than FILTER_BYTES; beyond that, all windows go to the join, without words.

Pairs of document and item are counted before any words meet: an item finds its documents by its rarest windows, so many of them that no
leak misses all, then the pairs' common windows are counted, and words are joined for those that reach the share. A window that many
items and documents share thus makes no pairs, as long as the items have others.

Defined results: null or empty texts, of items too, match nothing; null or repeated document numbers are judged row by
row (equal rows together, told apart by 128-bit keys of number and text); an empty table on either side gives no rows; columns other than those named are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import input_bytes, key_groups, parts, row_key, stored, table

SIZE, SHARE, FILTER_BYTES, LEAST_WORDS = 5, 0.8, 8 << 20, 3
STRETCH, LEAST_STRETCH = 4, 100

#: Words that a number may be written as, and units. Fixed values.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph km/h m/s hz khz mhz w kw v k "
    "cent cents dollar dollars euro euros usd eur gbp percent % degree degrees meter meters metre metres kilometer kilometers kilometre kilometres".split()
)
EDGE = ".,;:!?()[]{}\"'«»“”‘’…|*_"
NUMBER = re.compile(r"[+\-$€£]?\d[\d.,/:\-]*[%°]?[a-zA-Z]{0,3}$")
KINDS = ("", "<num>", "<name>", "<unit>")


SPECIAL = NUMBER_WORDS | UNITS
#: The hash of a name's placeholder.
NAME = xxhash.xxh3_64_intdigest(KINDS[2])


class Hashes(dict):
    """Columns of a table by word: 64-bit hashes of its template, folded and own forms, and whether the first two are literals
    (bits)."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.table = np.empty((4, 1 << 16), "uint64")
        self.n = 0

    def columns(self, words: list[str]) -> np.ndarray:
        """The table's columns of the words; it starts anew when it was full before."""
        if self.n >= self.most:
            self.clear()
            self.n = 0
        at = np.fromiter(map(self.__getitem__, words), "int64", len(words))
        return self.table[:, at]

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGE) or word
        low = core.lower()
        if core.isalpha() and core.isascii() and low not in SPECIAL and (core == low or core[0].isupper() and not core.isupper()):
            # plain words and names, as below
            h = xxhash.xxh3_64_intdigest(low)
            row = (h, h, h, 3) if core == low else (NAME, h, h, 2)
        else:
            form, kind = canonical(word)
            fold, fold_kind = canonical(word, True)
            h, g = xxhash.xxh3_64_intdigest(form), xxhash.xxh3_64_intdigest(fold)
            own = g if fold_kind == 0 else xxhash.xxh3_64_intdigest("=" + value(word))
            row = (h, g, own, (kind == 0) + 2 * (fold_kind == 0))
        if self.n == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
        i = self.n
        self.table[:, i] = row
        self.n += 1
        if len(word) < 100:
            self[word] = i
        return i


_seen = Hashes()


def canonical(word: str, folded: bool = False) -> tuple[str, int]:
    """A word's template form and kind: 0 literal, 1 number, 2 name (not in the folded form), 3 unit."""
    core = word.strip(EDGE) or word
    low = core.lower()
    if (NUMBER.match(core) if not core.isalpha() else low in NUMBER_WORDS):
        return KINDS[1], 1
    if not folded and core[0].isupper() and (len(core) == 1 or not core.isupper()):
        return KINDS[2], 2
    if low in UNITS:
        return KINDS[3], 3
    return core.casefold() if folded else low, 0


def value(word: str) -> str:
    """What a slot holds: values differ by more than case and outer punctuation."""
    return word.strip(EDGE).casefold()


def windows(words: list[str], size: int = SIZE) -> np.ndarray:
    """A 64-bit hash for each window of template words, and one for its folded form (two rows); one
    window if there are fewer words. A window of placeholders alone has the hash of its values."""
    if not words:
        return np.zeros((2, 0), "int64")
    columns, k = _seen.columns(words), min(size, len(words))
    n = len(words) - k + 1
    h, literal = [np.full(n, k, "uint64") for _ in range(3)], np.zeros(n, "uint64")
    for j in range(k):
        for x, c in zip(h, columns):
            x ^= c[j : j + n]
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
        literal |= columns[3, j : j + n]
    for bit, x in ((1, h[0]), (2, h[1])):
        np.copyto(x, h[2], where=(literal & np.uint64(bit)) == 0)
    return np.stack(h[:2]).view("int64")


def _window_rows(rows: DataFrame, size: int, only: np.ndarray | None, lengths: Sequence[int] = (), words: bool = True) -> DataFrame:
    """id, r (row key), wh, size (words of the window), n (windows of the text), pos (its places) and words (those of each
    place, one behind the other) of each window hash of a text that is in only (sorted); windows have size words, those of
    a shorter text its own number, and the lengths given besides. Without `words` pos and words are empty."""
    names = ["id", "r", "wh", "size", "n", "pos", "words"]
    key = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    kinds = (pa.int64(), key, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
    batch_of = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def hits(form: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
        if only is None:
            return np.arange(len(form))
        at = np.flatnonzero(bits[form & ((1 << 20) - 1)])
        return at[only[np.searchsorted(only, form[at]).clip(max=len(only) - 1)] == form[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if only is not None:
            if not len(only):
                return
            bits = np.zeros(1 << 20, bool)
            bits[only & ((1 << 20) - 1)] = True
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts = [(t.as_py() or "").split() for t in part.column(2)]
                ends = np.cumsum([0, *map(len, texts)])
                flat = [w for t in texts for w in t]
                found: dict[tuple[int, int, int], list[int]] = {}  # text, length, hash: places
                # the windows of many texts at a time, without those that reach into the next one
                for k in sorted({size, *lengths}):
                    if k > len(flat):
                        continue
                    h, folded = windows(flat, k)
                    for form in (h, folded):
                        at = hits(form, bits)
                        if form is folded:
                            at = at[form[at] != h[at]]
                        text = np.searchsorted(ends, at, "right") - 1
                        inside = at + k <= ends[text + 1]
                        at, text = at[inside], text[inside]
                        for i, x, p in zip(text.tolist(), form[at].tolist(), (at - ends[text]).tolist()):
                            found.setdefault((i, k, x), []).append(p)
                for i, t in enumerate(texts):
                    if 0 < len(t) < size and len(t) not in lengths:
                        h, folded = windows(t, len(t))
                        for x in {int(form[0]) for form in (h, folded) if len(hits(form, bits))}:
                            found[i, len(t), x] = [0]
                out, held = [[] for _ in names], 0
                ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                for (i, k, x), places in found.items():
                    n_places, places = len(places), places if words else []
                    for col, v in zip(out, (ids[i], keys[i], x, k, len(texts[i]) - k + 1, places, [w for p in places for w in texts[i][p : p + k]])):
                        col.append(v)
                    held += n_places
                    if held > 20_000:
                        yield batch_of(out)
                        out, held = [[] for _ in names], 0
                if out[0]:
                    yield batch_of(out)

    return rows.mapInArrow(run, "id long, r struct<a:long,b:long>, wh long, size int, n int, pos array<int>, words array<string>")


def slots(pairs: dict[int, tuple[str, str]]) -> tuple[int, int, int]:
    """Of aligned words (item's, document's) by position: slot positions, those with another value,
    those that follow the most frequent value for their old one."""
    new = defaultdict(Counter)
    n = changed = 0
    for a, b in pairs.values():
        kind = canonical(a)[1]
        if kind:
            x, y = value(a), value(b)
            new[kind, x][y] += 1
            n += 1
            changed += x != y
    return n, changed, sum(max(c.values()) for c in new.values())


def chain(pos: np.ndarray, ipos: np.ndarray) -> np.ndarray:
    """Indexes of a longest chain of hits with rising pos and ipos; of equally long ones, one with few changes of offset."""
    order = np.lexsort((-ipos, pos))
    p, q = pos[order], ipos[order]
    off, n = p - q, len(p)
    score, back = np.full(n, n + 1, "int64"), np.full(n, -1, "int64")  # (n + 1) for each hit, less the changes
    for i in range(1, n):
        via = np.where((p[:i] < p[i]) & (q[:i] < q[i]), score[:i] - (off[:i] != off[i]), 0)
        j = int(via.argmax())
        if via[j] > 0:
            score[i], back[i] = via[j] + n + 1, j
    out, i = [], int(score.argmax())
    while i >= 0:
        out.append(i)
        i = int(back[i])
    return order[out[::-1]]


def alignments(pos: np.ndarray, ipos: np.ndarray, total: int, size: int, share: float, stretch: int | None = STRETCH) -> Iterator[np.ndarray]:
    """Indexes of the hits near the most frequent offset, then of chains of hits, where they cover the share of the item's windows.
    A chain lies within `stretch` words of the document for each of the item's, or with None anywhere in it."""
    need = share * total
    if len(np.unique(ipos)) < need:
        return
    off = pos - ipos
    top = max(Counter(off.tolist()).most_common(), key=lambda x: (x[1], -x[0]))[0]
    near = np.flatnonzero(np.abs(off - top) <= size)  # a word more or less moves the alignment a little
    if len(np.unique(ipos[near])) >= need:
        yield near
    order = np.argsort(pos, kind="stable")
    at = pos[order]
    reach = max(LEAST_STRETCH, stretch * (total + size - 1)) if stretch is not None else int(at[-1]) + 1
    last = -1
    # a chain that covers enough begins among the item's first windows
    for p in np.unique(pos[ipos <= total - need]).tolist():
        a, b = np.searchsorted(at, (p, p + reach))
        if p <= last or len(np.unique(ipos[order[a:b]])) < need:
            continue
        here = order[a:b]
        found = here[chain(pos[here], ipos[here])]
        if len(found) >= need:
            yield found
            last = int(pos[found[0]])


def probes(theirs: DataFrame, share: float) -> DataFrame:
    """q and wh of the windows by which an item finds its documents. A leak hits all but total - need of an item's places, so among
    any total - need + 1 of them one is hit: the rarest in the benchmark are taken, whatever the documents hold often."""
    places = theirs.select("q", "n_windows", "wh", F.explode("ipos").alias("i"))
    held = theirs.groupBy("wh").agg(F.count("*").alias("_f"))
    rare = places.join(held, "wh").groupBy("q", "i", "n_windows").agg(F.sum("_f").alias("_f"), F.collect_set("wh").alias("_whs"))  # two forms at most
    order = F.row_number().over(Window.partitionBy("q").orderBy("_f", "i"))
    few = F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9) + 1
    return rare.withColumn("_o", order).where(F.col("_o") <= few).select("q", F.explode("_whs").alias("wh")).distinct()


def possible(slim: DataFrame, theirs: DataFrame, share: float) -> DataFrame:
    """slim: r, wh of the documents' windows; theirs: q, wh, ipos, n_windows. r and q of the pairs whose common windows cover the share
    of the item's places, counted without words: pairs that meet in a probe are joined to the item's windows, and those to the
    document's."""
    met = slim.join(probes(theirs, share), "wh").select("r", "q").distinct()
    full = met.join(theirs.select("q", "wh", F.size("ipos").alias("_n"), "n_windows"), "q").join(slim.select("r", "wh").distinct(), ["r", "wh"])
    return full.groupBy("r", "q").agg(F.sum("_n").alias("_n"), F.first("n_windows").alias("_t")).where(F.col("_n") >= F.col("_t") * share).select("r", "q")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = SHARE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS, stretch: int | None = STRETCH) -> DataFrame:
    """doc_id, r (row key of document and text), item_id, start_word, n_hits, n_windows, n_slots,
    n_changed (slots with other values than the item's) of each leaked item in each document. least_words 1 finds items of any
    length inside longer texts, stretch None items that are interrupted by any number of words."""
    items = benchmark.select(F.col(item).cast("long").alias("id"), row_key(item, item_text).alias("r"), F.col(item_text).alias("text")).distinct()
    theirs = _window_rows(items, size, None)
    theirs = stored(theirs.select(F.col("id").alias("item_id"), F.col("r").alias("q"), "wh", "size", F.col("pos").alias("ipos"), F.col("n").alias("n_windows"), F.col("words").alias("iwords")), "item-windows")
    # at most size lengths, and as many hashes as FILTER_BYTES of text have windows
    lengths = [x.size for x in theirs.where((F.col("size") < size) & (F.col("size") >= least_words)).select("size").distinct().collect()]
    only = np.unique(theirs.select("wh").toArrow().column(0).to_numpy()) if input_bytes(benchmark) <= FILTER_BYTES else None
    rows = docs.select(F.col(key).cast("long").alias("id"), row_key(key, text).alias("r"), F.col(text).alias("text"))
    if only is not None:  # few windows are left: they're kept with their words
        ours = stored(_window_rows(rows, size, only, lengths), "windows")
        pairs = stored(possible(ours, theirs, share), "leak-pairs")
    else:  # each window goes to the join, so words follow only where a pair is possible
        slim = _window_rows(rows, size, None, lengths, words=False).join(theirs.select("wh").distinct(), "wh", "left_semi")
        pairs = stored(possible(stored(slim.select("r", "wh"), "windows"), theirs, share), "leak-pairs")
        ours = _window_rows(rows.join(pairs.select("r").distinct(), "r", "left_semi").select("id", "r", "text"), size, None, lengths)
    hits = ours.select("id", "r", "wh", "pos", "words").join(pairs, "r").join(theirs, ["q", "wh"])
    hits = hits.select("id", F.col("r.a").alias("ra"), F.col("r.b").alias("rb"), F.col("q.a").alias("qa"), F.col("q.b").alias("qb"), "item_id", "size", "n_windows", "pos", "ipos", "words", "iwords")

    def align(group: pa.Table) -> Iterator[pa.RecordBatch]:
        total, k = group.column("n_windows")[0].as_py(), group.column("size")[0].as_py()
        if len(np.unique(pc.list_flatten(group.column("ipos")).to_numpy())) < share * total:
            return
        best = decided(group.select(["pos", "ipos", "words", "iwords"]).to_pylist(), total, k, size, share, stretch)
        if best is not None:
            one = lambda c: group.column(c)[0].as_py()
            n_hits, start, n, changed = best
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([one("id")], pa.int64()), "ra": [one("ra")], "rb": [one("rb")], "item_id": pa.array([one("item_id")], pa.int64()), "start_word": [start], "n_hits": [n_hits], "n_windows": [total], "n_slots": [n], "n_changed": [changed]})

    # a group holds the hits of one document in one item, bounded by the document
    found = key_groups(hits, ["ra", "rb", "qa", "qb"], align, "doc_id long, ra long, rb long, item_id long, start_word long, n_hits long, n_windows long, n_slots long, n_changed long", parts(docs, 64))
    return found.select("doc_id", F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("r"), "item_id", "start_word", "n_hits", "n_windows", "n_slots", "n_changed")


def decided(rows: list[dict], total: int, k: int, size: int, share: float, stretch: int | None) -> tuple[int, int, int, int] | None:
    """rows: the windows that a document and an item have in common, with their places and words (pos, words, ipos, iwords). n_hits, start,
    slots and changed slots of the best alignment that counts."""
    # each place of a window in the document meets each place of it in the item: row, and index in either list
    pairs = np.concatenate([np.stack([np.full(len(x["pos"]) * len(x["ipos"]), i), np.repeat(np.arange(len(x["pos"])), len(x["ipos"])), np.tile(np.arange(len(x["ipos"])), len(x["pos"]))]) for i, x in enumerate(rows)], axis=1)
    pos = np.concatenate([np.repeat(np.array(x["pos"], "int64"), len(x["ipos"])) for x in rows])
    ipos = np.concatenate([np.tile(np.array(x["ipos"], "int64"), len(x["pos"])) for x in rows])
    _, once = np.unique(pos << 32 | ipos, return_index=True)  # both forms may agree
    pos, ipos, pairs = pos[once], ipos[once], pairs[:, once]
    best = None
    for near in alignments(pos, ipos, total, k, share, stretch):
        n_hits = len(np.unique(ipos[near]))
        if best is not None and n_hits <= best[0]:
            continue
        met = {}
        for i, a, b in pairs[:, near].T.tolist():
            x = rows[i]
            for j in range(k):
                met[x["ipos"][b] + j] = (x["iwords"][b * k + j], x["words"][a * k + j])
        n, changed, follow = slots(met)
        if follow >= share * n and (k == size or not changed):
            best = n_hits, int(pos[near].min()), n, changed
            if n_hits == total:
                break
    return best


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a leaked item."""
    bad = leaks(docs, benchmark, key=key, text=text, **options).select("r").distinct().withColumnRenamed("r", "__leaked")
    return docs.join(bad, row_key(key, text) == F.col("__leaked"), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("r")
