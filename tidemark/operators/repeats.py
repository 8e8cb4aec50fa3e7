"""Transcript mining: repeated phrases, near repeats, false starts and self-corrections.

A transcript is rows media_id, pos (dense from 0), norm, raw, start_us, end_us. Windows over a media's words mark pauses, places
of cuts and markers; all detectors then run in one pass over the marked words of many media at a time, so that words are dealt out once
and neither joined nor broadcast. For each lag, equality with the word so far ahead is an array, and run lengths and mismatch counts are prefix
sums over it. Each detector takes its candidates in order, resuming behind each one taken.

Candidates: media_id, start_us, end_us, text, keep_text, type, confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.groups import key_groups, new_keys
from tidemark.shared import stored

COLUMNS = ("media_id", "start_us", "end_us", "text", "keep_text", "type", "confidence")


def _words_in_order():
    """A media's words; made on call, since it needs a session."""
    return Window.partitionBy("media_id").orderBy("pos")


def word_stream(segments: DataFrame) -> DataFrame:
    """segments: media_id, seg_no, words (array of struct word, start, end in seconds). The first token
    of a word is its norm, the empty string if it has none."""
    flat = segments.select("media_id", "seg_no", F.posexplode("words").alias("i", "w"))
    pos = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_no", "i")) - 1
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return flat.select("media_id", pos.alias("pos"), T.first_token(F.col("w.word")).alias("norm"), F.trim("w.word").alias("raw"), us("w.start").alias("start_us"), us("w.end").alias("end_us"))


def slim(segments: DataFrame) -> DataFrame:
    """A transcript's rows for review: trimmed text, and words as word, start and end with times to two decimals."""
    times = lambda x: F.struct(x["word"].alias("word"), F.bround(x["start"], 2).alias("start"), F.bround(x["end"], 2).alias("end"))
    return segments.select("media_id", "seg_no", F.trim("text").alias("text"), F.transform("words", times).alias("words"))


def _at(c: str, n: int) -> Column:
    """Column c, n rows ahead."""
    return F.lead(c, n).over(_words_in_order()) if n >= 0 else F.lag(c, -n).over(_words_in_order())


def snapped(words: DataFrame, min_pause_us: int = 450_000, max_back_us: int = 5_000_000) -> DataFrame:
    """snap: the place to which a cut at pos moves back: the last pause before it, no further than
    max_back_us of starts. snap_us is its start."""
    pause = F.col("start_us") - F.lag("end_us").over(_words_in_order()) >= min_pause_us
    last = F.max(F.when(pause, F.col("pos"))).over(_words_in_order().rowsBetween(Window.unboundedPreceding, 0))
    near = F.min("pos").over(Window.partitionBy("media_id").orderBy("start_us").rangeBetween(-max_back_us, 0))
    marked = words.withColumn("_p", F.coalesce(last, F.lit(0))).withColumn("snap", F.greatest("_p", near))
    return marked.drop("_p")


class _Words:
    """The words of several media, one behind the other: ids of equal words, media, place, and the end of each one's media."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("norm").combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.names = names
        new = new_keys(rows, ["media_id"])
        starts, self.n = np.flatnonzero(new), rows.num_rows
        self.pos = rows.column("pos").to_numpy()
        self.begin = starts[np.cumsum(new) - 1]
        self.end = np.append(starts[1:], self.n)[np.cumsum(new) - 1]
        plain = np.array([w != "" for w in names])[self.ids]
        self.plain = plain
        self.content = plain & ~np.array([w in T.STOP_WORDS for w in names])[self.ids]
        self.contents = np.append(0, np.cumsum(self.content))  # before each place

    def differs(self, lag: int) -> np.ndarray:
        """Whether a word isn't that so far ahead in its media."""
        out = np.ones(self.n, bool)
        if lag < self.n:
            out[: self.n - lag] = (self.ids[lag:] != self.ids[: self.n - lag]) | (np.arange(lag, self.n) >= self.end[: self.n - lag])
        return out

    def texts(self, a: int, b: int) -> list[str]:
        return [self.names[i] for i in self.ids[a:b]]

    def taken(self, at: list[int], b: list[int]) -> list[int]:
        """Indexes of the candidates that a scan of each media takes, resuming at b."""
        out, now, end = [], 0, -1
        for k, (i, j) in enumerate(zip(at, b)):
            if i >= end:
                now, end = i, int(self.end[i])
            if i >= now:
                out.append(k)
                now = j
        return out


def _exact(w: _Words, min_run: int, max_run: int, max_gap: int, min_content: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a run is followed by itself: place, length (the longest), lag (the smallest of those)."""
    places = np.arange(w.n)
    length, lag = np.zeros(w.n, "int64"), np.zeros(w.n, "int64")
    for d in range(min_run, max_run + max_gap + 1):
        breaks = np.where(w.differs(d), places, w.n)
        reach = np.minimum(np.minimum.accumulate(breaks[::-1])[::-1] - places, min(d, max_run))
        better = (reach >= max(min_run, d - max_gap)) & (reach > length)
        length[better], lag[better] = reach[better], d
    at = np.flatnonzero((length > 0) & w.plain)
    at = at[w.contents[at + length[at]] - w.contents[at] >= min_content]
    return at, length[at], lag[at]


def _nearly(w: _Words, min_run: int, max_run: int, max_gap: int, min_content: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a run comes again with one word changed: equal lengths within one edit differ in one place, so
    mismatches at each lag are counted, longest runs and smallest gaps first; difflib confirms."""
    places, open_ = np.arange(w.n), w.content.copy()
    missed = {d: np.append(0, np.cumsum(w.differs(d))) for d in range(min_run + 1, max_run + max_gap + 1)}
    tries = []
    for n in range(max_run, min_run - 1, -1):
        for g in range(1, max_gap + 1):
            at = places[open_ & (places + 2 * n + g <= w.end)]
            at = at[(missed[n + g][at + n] - missed[n + g][at] == 1) & (w.contents[at + n] - w.contents[at] >= min_content)]
            for i in at.tolist():
                x, y = w.texts(i, i + n), w.texts(i + n + g, i + 2 * n + g)
                if T.edits(x, y) <= 1:
                    open_[i] = False  # the first that fits decides
                    if not T.translated(x, y):
                        tries.append((i, n, n + g))
    tries.sort()
    return tuple(np.array(c, "int64") for c in zip(*tries)) if tries else (np.zeros(0, "int64"),) * 3


def _restarted(w: _Words, pause: np.ndarray, head: int, max_attempt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of content words whose first content words come again, one of them changed at most, behind the next pause: place, where
    it begins again. An alignment within one edit leaves one word of the opening without an equal, so only such places are compared."""
    places, at_pause, found = np.arange(w.n), np.flatnonzero(pause), np.flatnonzero(w.content)
    after = np.append(at_pause, w.n)[np.searchsorted(at_pause, places, "right")]  # the next pause
    ok = w.content & (after < np.minimum(w.end, places + max_attempt)) & (places - w.begin < w.end - w.begin - 2 * head)
    at = places[ok]
    b = after[at]

    def heads(x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first `head` content words from x on, and whether they lie within reach."""
        k = w.contents[x][:, None] + np.arange(head)
        spots = np.append(found, np.full(head, w.n))[np.minimum(k, len(found))]
        return spots, spots[:, -1] < np.minimum(x + reach, w.end[x])

    (x, whole), (y, again) = heads(at, head + 2), heads(b, head + 4)
    full = whole & again
    at, b, x, y = at[full], b[full], x[full], y[full]
    shared = (w.ids[x][:, :, None] == w.ids[y][:, None, :]).any(axis=2).sum(axis=1) if len(at) else np.zeros(0, int)
    hits = []
    for k in np.flatnonzero(shared >= head - 1).tolist():
        i, j = int(at[k]), int(b[k])
        opening, following = ([w.names[m] for m in w.ids[z[k]]] for z in (x, y))
        width = j - i
        if len(set(opening) & set(following)) >= len(set(opening)) - 1 and T.edits(opening, following) <= 1 and not T.translated(w.texts(i, j), w.texts(j, min(j + width, int(w.end[j])))):
            hits.append((i, j))
    return tuple(np.array(c, "int64") for c in zip(*hits)) if hits else (np.zeros(0, "int64"),) * 2


def _repeats(words: DataFrame, exact: dict | None, near: dict | None) -> DataFrame:
    """media_id, pos, length, b (start of the repeat), type: the repeats that a scan of each media takes."""

    def find(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        w, media = _Words(rows), rows.column("media_id").combine_chunks()
        for kind, options, search in (("verbatim_repeat", exact, _exact), ("near_repeat", near, _nearly)):
            if options is not None:
                at, length, lag = search(w, **options)
                keep = np.array(w.taken(at.tolist(), (at + lag).tolist()), "int64")
                at, length, lag = at[keep], length[keep], lag[keep]
                pos = w.pos[at]
                columns = [media.take(pa.array(at)), pa.array(pos, pa.int32()), pa.array(length), pa.array(pos + lag, pa.int32()), pa.array([kind] * len(at), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["media_id", "pos", "length", "b", "type"])

    head = f"media_id {words.schema['media_id'].dataType.simpleString()}, pos int, length long, b int, type string"
    return key_groups(words.select("media_id", "pos", "norm"), ["media_id"], ["pos"], find, head, least=50_000)


EXACT = {"min_run": 3, "max_run": 14, "max_gap": 4, "min_content": 2}
NEAR = {"min_run": 4, "max_run": 12, "max_gap": 5, "min_content": 3}


RESTART = {"head": 3, "min_pause_us": 350_000, "max_attempt": 12}
CORRECTION = {"look_back": 2, "retake_look_back": 10, "long_pause_us": 900_000}


def _cuts(words: DataFrame, exact: dict | None = None, near: dict | None = None, restart: dict | None = None, correction: dict | None = None) -> DataFrame:
    """The candidates of the detectors whose options are given. Cuts begin where a pause allows and end where the next word begins; a
    correction's begins a few words before its marker, not beyond a long pause, and ends with its last word."""
    gap = F.col("start_us") - F.lag("end_us").over(_words_in_order())
    marked = snapped(words).select("media_id", "pos", "norm", "raw", "start_us", "end_us", "snap", gap.alias("_gap"))
    gap = F.col("_gap")
    if restart:
        marked = marked.withColumn("_pause", F.coalesce(gap >= restart["min_pause_us"], F.lit(False)))
    if correction:
        options = CORRECTION | {k: v for k, v in correction.items() if k in CORRECTION}
        size, retake = marker_sizes(**{k: v for k, v in correction.items() if k not in CORRECTION})
        since = F.max(F.when(gap > options["long_pause_us"], F.col("pos"))).over(_words_in_order().rowsBetween(Window.unboundedPreceding, 0))
        back = F.when(retake, options["retake_look_back"]).otherwise(options["look_back"])
        marked = marked.withColumns({"_size": F.coalesce(size, F.lit(0)), "_from": F.greatest(F.col("pos") - back, since, F.lit(0)).cast("int")})

    def find(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        w = _Words(rows)
        column = lambda c: rows.column(c).to_numpy()
        snap, found = w.begin + column("snap"), []

        def take(kind: str, at, b, keep, confidence, a=None, least: int = 0) -> None:
            """at, b: candidates and where a scan resumes; keep: how many words from b on are shown; least: the shortest cut."""
            a = snap[at] if a is None else a
            ok = b - a >= least
            at, a, b, keep, confidence = at[ok], a[ok], b[ok], keep[ok], confidence[ok]
            got = np.array(w.taken(at.tolist(), b.tolist()), "int64")
            found.extend((kind, *x) for x in zip(a[got].tolist(), b[got].tolist(), np.minimum(b + keep, w.end[at])[got].tolist(), confidence[got].tolist()))

        for kind, options, search, base, step, most in (("verbatim_repeat", exact, _exact, 0.55, 0.08, 1.0), ("near_repeat", near, _nearly, 0.5, 0.06, 0.9)):
            if options:
                at, length, lag = search(w, **options)
                take(kind, at, at + lag, length + 5, np.minimum(most, base + step * length))
        if restart:
            at, b = _restarted(w, column("_pause").astype(bool), restart["head"], restart["max_attempt"])
            take("false_start", at, b, np.full(len(at), 12), np.full(len(at), 0.72), least=2)
        if correction:
            at = np.flatnonzero(column("_size") > 0)
            take("correction", at, at + column("_size")[at], np.full(len(at), 8), np.full(len(at), 0.7), a=w.begin[at] + column("_from")[at])
        raw, start, end, media = rows.column("raw"), rows.column("start_us"), rows.column("end_us"), rows.column("media_id")
        text = lambda i, j: " ".join(x for x in raw.slice(i, j - i).to_pylist() if x is not None).strip(" ")
        out = {c: [] for c in COLUMNS}
        for kind, a, b, keep, confidence in found:
            to = end[b - 1] if kind == "correction" else start[b]
            for c, v in zip(COLUMNS, (media[a].as_py(), start[a].as_py(), to.as_py(), text(a, b), text(b, keep), kind, round(confidence, 2))):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("media_id", media.type), ("start_us", pa.int64()), ("end_us", pa.int64()), ("text", pa.string()), ("keep_text", pa.string()), ("type", pa.string()), ("confidence", pa.float64())]))

    # a call takes several media, together at least so many words; a media's words fit a task
    head = f"media_id {words.schema['media_id'].dataType.simpleString()}, start_us long, end_us long, text string, keep_text string, type string, confidence double"
    return key_groups(marked.drop("_gap"), ["media_id"], ["pos"], find, head, least=50_000)


def verbatim_repeats(words: DataFrame, **options) -> DataFrame:
    return _cuts(words, exact=EXACT | options)


def near_repeats(words: DataFrame, **options) -> DataFrame:
    return _cuts(words, near=NEAR | options)


def marker_sizes(slips: tuple[str, ...] = T.SLIP_MARKERS, retakes: tuple[str, ...] = T.RETAKE_MARKERS) -> tuple[Column, Column]:
    """The number of words of the marker that begins at a word (null for none), and whether it asks for a retake. Slips of one word come
    before those of two, then retakes of three words, then of two."""
    grams = {1: F.col("norm"), 2: F.concat_ws(" ", F.col("norm"), _at("norm", 1)), 3: F.concat_ws(" ", F.col("norm"), _at("norm", 1), _at("norm", 2))}
    size, retake = F.lit(None).cast("int"), F.lit(False)
    order = [(slips, 1, False), (slips, 2, False), (retakes, 3, True), (retakes, 2, True)]
    for phrases, n, again in reversed(order):
        own = [p for p in phrases if len(p.split()) == n]
        if own:
            size, retake = F.when(grams[n].isin(*own), F.lit(n)).otherwise(size), F.when(grams[n].isin(*own), F.lit(again)).otherwise(retake)
    return size, retake


def corrections(words: DataFrame, **options) -> DataFrame:
    """Self-corrections: the words before a marker, back to a long pause, and the marker are cut."""
    return _cuts(words, correction=CORRECTION | options)


def false_starts(words: DataFrame, **options) -> DataFrame:
    """A sentence that breaks off at a pause and begins again with the same content words, or one
    of them changed."""
    return _cuts(words, restart=RESTART | options)


def _confidence(c: Column) -> Column:
    return F.bround(c, 2).cast("double")


def similar_segments(segments: DataFrame, threshold: float = 0.65, reach: int = 6, least: int = 4) -> DataFrame:
    """For transcripts without word times. segments: media_id, seg_no (dense), start_us, end_us, text. Each
    segment meets the next `reach` by an equi-join on the number; the most similar one counts, the
    first of equals. The fragment goes if the longest block begins it and covers 80 %, else the first."""
    s = segments.withColumn("toks", T.tokens(F.col("text"))).where(F.size("toks") >= least)
    left = s.withColumn("_j", F.explode(F.sequence(F.col("seg_no") + 1, F.col("seg_no") + reach))).alias("x")
    right = s.alias("y")
    pairs = left.join(right, (F.col("x.media_id") == F.col("y.media_id")) & (F.col("x._j") == F.col("y.seg_no")))
    side = lambda a: F.struct(*[F.col(f"{a}.{c}") for c in ("seg_no", "start_us", "end_us", "text", "toks")]).alias(a)
    pairs = pairs.select(F.col("x.media_id").alias("media_id"), side("x"), side("y"))
    # matching words are shared words, so neither measure can reach the threshold without enough of those
    distinct = lambda c: F.size(F.array_distinct(c))
    both, a, b = F.size(F.array_intersect("x.toks", "y.toks")), F.size("x.toks"), F.size("y.toks")
    spare = F.greatest(a - distinct("x.toks"), b - distinct("y.toks"))  # repeats of a word may match as well
    pairs = pairs.where((2 * (both + spare) >= threshold * (a + b)) | (both + spare >= 0.7 * F.least(a, b)))
    pairs = pairs.withColumn("sim", T.similarity("x.toks", "y.toks")).where(F.col("sim") > 0)
    best = pairs.groupBy("media_id", F.col("x.seg_no").alias("_i")).agg(F.max_by(F.struct("x", "y", "sim"), F.struct("sim", -F.col("y.seg_no"))).alias("m")).select("media_id", "m.*").where(F.col("sim") >= threshold)
    x_short = F.size("x.toks") <= F.size("y.toks")
    short, long = F.when(x_short, F.col("x")).otherwise(F.col("y")), F.when(x_short, F.col("y")).otherwise(F.col("x"))
    best = best.withColumns({"short": short, "long": long}).withColumn("block", T.longest_block("short.toks", "long.toks"))
    fragment = (F.col("block.start") == 0) & (F.col("block.size") >= F.size("short.toks") * 0.8)
    best = best.withColumns({"cut": F.when(fragment, F.col("short")).otherwise(F.col("x")), "keep": F.when(fragment, F.col("long")).otherwise(F.col("y"))})
    kind = F.when(F.col("sim") >= 0.8, "verbatim_repeat").otherwise("near_repeat")
    return best.select("media_id", "cut.start_us", "cut.end_us", "cut.text", F.col("keep.text").alias("keep_text"), kind.alias("type"), _confidence(F.col("sim")).alias("confidence"))


#: Rows of tokens are counted by so many values of their hash.
TOKEN_BUCKETS = 1 << 16


def _token_counts(sets: DataFrame) -> np.ndarray:
    """sets: h (hashed tokens). Rows of each bucket of tokens."""
    got = sets.select(F.explode("h").alias("w")).groupBy(F.pmod("w", F.lit(TOKEN_BUCKETS)).cast("int").alias("k")).count().toArrow()
    counts = np.zeros(TOKEN_BUCKETS, "int64")
    counts[got.column("k").to_numpy()] = got.column("count").to_numpy()
    return counts


def near_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left, right: id, t (distinct tokens). Pairs a, b that may have a Jaccard similarity of threshold or more. Such sets of n and m tokens
    share (n + m) * threshold / (1 + threshold) at least, so in any order of tokens they share one of the first n less that, and one, of either. The
    order is by counts of hashed tokens, the rarest first. An equi-join on those tokens; sizes, places and a bit for each token decide
    in the join, so that pairs that can't reach the threshold are never rows. Both sides are read twice."""
    share = threshold / (1 + threshold) - 1e-9  # a little less, so that rounding loses no pair
    left, right = (x.where(F.size("t") > 0).select("id", F.transform("t", lambda w: F.xxhash64(w)).alias("h")) for x in (left, right))
    weight = _token_counts(left) * _token_counts(right)
    rank = np.empty(TOKEN_BUCKETS, "int32")
    rank[np.argsort(weight, kind="stable")] = np.arange(TOKEN_BUCKETS, dtype="int32")
    alone = int((weight == 0).sum())  # lower ranks are of tokens that one side lacks

    def firsts(sets: DataFrame, side: str) -> DataFrame:
        """A set's first tokens that both sides have: hash, id, size, place and the set's bits."""

        def run(batches):
            for batch in batches:
                lists = batch.column("h")
                n, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64"), lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                bits = np.zeros(len(n), "int64")
                np.bitwise_or.at(bits, owner, np.int64(1) << (flat >> 32 & 63))
                flat = flat[np.lexsort((flat, rank[flat % TOKEN_BUCKETS], owner))]
                at = np.arange(len(flat)) - (np.cumsum(n) - n)[owner]
                # the smallest set that may be near leaves the most tokens to look at
                reach = n - np.ceil((n + np.ceil(n * (threshold - 1e-9))) * share) + 1
                keep = np.flatnonzero((at < reach[owner]) & (rank[flat % TOKEN_BUCKETS] >= alone))
                own = owner[keep]
                columns = [pa.array(flat[keep].astype("int32")), batch.column("id").take(pa.array(own)), pa.array(n[own].astype("int32")), pa.array(at[keep].astype("int32")), pa.array(bits[own])]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["w", side, f"{side}_n", f"{side}_at", f"{side}_bits"]
        return sets.mapInArrow(run, f"w int, {side} {sets.schema['id'].dataType.simpleString()}, {side}_n int, {side}_at int, {side}_bits long")

    x, y = firsts(left, "a"), firsts(right, "b")
    both = F.ceil((F.col("a_n") + F.col("b_n")) * F.lit(share))
    spare = lambda side: F.col(f"{side}_n") - both
    unlike = lambda x, y: F.bit_count(F.col(f"{x}_bits").bitwiseAND(F.bitwise_not(f"{y}_bits")))
    fits = (F.col("a_at") <= spare("a")) & (F.col("b_at") <= spare("b")) & (unlike("a", "b") <= spare("a")) & (unlike("b", "a") <= spare("b"))
    return x.join(y, (x["w"] == y["w"]) & fits).select("a", "b").distinct()


def rerank(candidates: DataFrame, history: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Candidates after past decisions (history: text, approved). Dropped: rejected at least twice and more than twice as
    often as approved. Raised by 0.15, to 0.99 at most: approved at least twice and more than twice as often as rejected.
    Equal sets of tokens have the same votes, so each set is looked up once; candidates are read three times."""
    of_set = F.array_join(F.array_sort(T.accent_tokens(F.col("text"))), " ")
    c = candidates.withColumn("_id", F.xxhash64(of_set))
    t = stored(candidates.select(of_set.alias("_set")).where("_set <> ''").distinct().select(F.xxhash64("_set").alias("_id"), "_set"), "candidate-sets")
    size = F.size(F.split("_set", " "))
    least, most = (n or 0 for n in t.agg(F.min(size), F.max(size)).first())
    h = history.where("text IS NOT NULL AND text <> ''").select(of_set.alias("_set"), F.coalesce("approved", F.lit(False)).alias("approved"))
    h = h.where((F.col("_set") != "") & size.between(least * (threshold - 1e-9), most / (threshold - 1e-9)))
    h = h.groupBy("_set").agg(F.count_if("approved").alias("_yes"), F.count_if(~F.col("approved")).alias("_no"))
    h = stored(h.select(F.monotonically_increasing_id().alias("_hid"), F.col("_set").alias("_hset"), "_yes", "_no"), "history-sets")
    toks = lambda c: F.split(c, " ")
    near = near_sets(t.select(F.col("_id").alias("id"), toks("_set").alias("t")), h.select(F.col("_hid").alias("id"), toks("_hset").alias("t")), threshold).toDF("_id", "_hid")
    votes = near.join(t, "_id").join(h, "_hid").where(T.jaccard(toks("_set"), toks("_hset")) >= threshold)
    votes = votes.groupBy("_id").agg(F.sum("_yes").alias("_yes"), F.sum("_no").alias("_no"))
    # votes go to the media that they concern, so that candidates with their texts are dealt out once, by media
    votes = c.select("media_id", "_id").distinct().join(votes, "_id")
    of_id = Window.partitionBy("media_id", "_id")
    got = c.withColumn("_own", F.lit(True)).unionByName(votes, allowMissingColumns=True).repartition("media_id")
    got = got.withColumns({v: F.coalesce(F.max(v).over(of_id), F.lit(0)) for v in ("_yes", "_no")}).where("_own")
    got = got.where(~((F.col("_no") >= 2) & (F.col("_no") > 2 * F.col("_yes"))))
    raised = F.when((F.col("_yes") >= 2) & (F.col("_yes") > 2 * F.col("_no")), _confidence(F.least(F.lit(0.99), F.col("confidence") + 0.15))).otherwise(F.col("confidence"))
    return got.withColumn("confidence", raised).select(*candidates.columns)


def suppress_overlaps(candidates: DataFrame, slack_us: int = 50_000) -> DataFrame:
    """In order of start: one that begins before the last survivor's end less slack replaces it if
    strictly more confident, else goes. Survivors before the last are not looked at again."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keep: list[int] = []
        new = new_keys(rows, ["media_id"]).tolist()
        s, e, c = (rows.column(x).to_pylist() for x in ("start_us", "end_us", "confidence"))
        for i in range(rows.num_rows):
            if new[i] or s[i] >= e[keep[-1]] - slack_us:
                keep.append(i)
            elif c[i] > c[keep[-1]]:
                keep[-1] = i
        yield from rows.take(pa.array(keep)).combine_chunks().to_batches()

    return key_groups(candidates, ["media_id"], ["start_us", "type", "end_us"], work, candidates.schema, least=20_000)


def find_repeats(words: DataFrame, history: DataFrame | None = None, min_confidence: float = 0.0) -> DataFrame:
    """All detectors, the confidence filter, past decisions, and overlap suppression."""
    found = _cuts(words, EXACT, NEAR, RESTART, CORRECTION).where(F.col("confidence") >= min_confidence)
    if history is not None:
        found = rerank(stored(found, "repeats"), history)
    return suppress_overlaps(found)


def review(candidates: DataFrame) -> DataFrame:
    """Rows of a review file: nothing approved yet, times in seconds to two decimals, halves away from zero."""
    s = lambda c: F.round(F.col(c) / 1e6, 2)
    return candidates.select(F.lit(False).alias("approve"), "media_id", s("start_us").alias("start"), s("end_us").alias("end"), "type", "confidence", F.col("text").alias("cut_text"), "keep_text")


def approved_cuts(reviewed: DataFrame, min_len_us: int = 50_000) -> DataFrame:
    """Cuts of a review's approved rows, longer than min_len_us."""
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    cuts = reviewed.where("approve").select("media_id", us("start").alias("start_us"), us("end").alias("end_us"))
    return cuts.where(F.col("end_us") - F.col("start_us") > min_len_us)
