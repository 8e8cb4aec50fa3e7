"""Removal of repeated byte strings with suffix sorting.

A byte goes if a string of WIDTH bytes that covers it also starts earlier: in a document of smaller
number, or earlier in the same one. Sorting all suffixes of a large corpus in one array is out of
reach, so suffixes are first dealt into independent parts that can be sorted alone:

* Windows. Only suffixes with WIDTH bytes left matter, cut to that length ("windows"). Equal windows
  have an equal anchor, the smallest hash of the K-byte strings inside, at the same place. Neighbouring windows
  with one anchor form a segment, about (WIDTH - K) / 2 windows long.
* Digests. Segments travel as (anchor, digest of the bytes, document, start, length), packed; equal
  segments beyond the first are repeats in whole, with no text moved.
* Sorting. Where one anchor has several different segments their bytes travel, one copy of each. The windows
  of many anchors at a time are put in order by deep-shallow sorting, anchor by anchor and by the anchor's place in
  the window: multikey quicksort on 8-byte characters to a shallow depth, then blind tries for the groups that
  still agree. Windows that share a leaf are equal; all but the first are repeats.
* Hot anchors. An anchor with more than HOT different segments would be too large a part. Its windows are sorted the
  same way twice: in each task, where local repeats drop out, and then in parts dealt by the digest of the whole window.

Tasks drop local repeats before the shuffle, so a text with millions of copies sends a few rows from
each task. Repeats return to their documents as packed intervals, merged into the removed spans. Texts
are looked up twice in a bucketed table in the shared folder, one row a document each time.

Defined results: a null or empty text has 0 bytes and the digest of no bytes; texts shorter than
WIDTH lose nothing. Documents are ordered by number; rows that repeat a number are one document
when they are equal (each gets the same result), else they are ordered by their digest; a null number
comes after all others. An empty table gives no rows; columns other than the two named are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, key_groups, parts, stored, table

#: Bytes of an anchor; shallow depth in bytes; bytes of a slice of a long text, and places in a slice.
K, SHALLOW, SLICE, PLACES = 32, 32, 1 << 20, 1 << 21

#: Different segments of one anchor beyond which its windows are dealt out alone; packed segments that a task holds;
#: segments and windows that are sorted at a time.
HOT, HELD, SEGMENTS, WINDOWS = 2000, 1_000_000, 4000, 100_000

#: A packed segment: anchor, digest, document key (two halves), start, windows, place of the anchor, whether several
#: segments of the anchor are known already.
SEG = np.dtype([("h", "<i8"), ("c", "<i8"), ("d", "<i8"), ("e", "<i8"), ("s", "<i8"), ("n", "<i2"), ("a", "<i2"), ("m", "<i2")])
#: A packed interval of windows.
RUNS = np.dtype([("s", "<i8"), ("n", "<i4")])
LAST = np.iinfo("int64").max


# ---- sorting -------------------------------------------------------------------------------------


class _Trie:
    """A blind trie over strings of one length: inner nodes hold the depth at which their strings part, edges one byte."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings, self.root = strings, [0]
        for i in range(1, len(strings)):
            self.add(i)

    def add(self, i: int) -> None:
        new, node = self.strings[i], self.root
        while isinstance(node, tuple):  # descend blindly: bytes between branching depths are skipped
            depth, edges = node
            node = edges.get(new[depth]) or next(iter(edges.values()))
        old = self.strings[node[0]]
        if old == new:
            node.append(i)
            return
        # the first byte that differs
        at = len(new) - ((int.from_bytes(old) ^ int.from_bytes(new)).bit_length() + 7) // 8
        above, below = None, self.root
        while isinstance(below, tuple) and below[0] < at:
            above, below = below, below[1][new[below[0]]]  # the string agrees to here
        if isinstance(below, tuple) and below[0] == at:
            below[1][new[at]] = [i]
            return
        fork = (at, {old[at]: below, new[at]: [i]})
        if above is None:
            self.root = fork
        else:
            above[1][new[above[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                yield node
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def deep_shallow(data: np.ndarray, starts: np.ndarray, width: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of width bytes at the starts in data (uint8), sorted within their groups: their order, and a mask of
    the places in it where a string differs from the one before.

    The quicksort is ternary and takes all open groups at a time: each has a pivot of its own, the median of three of its
    characters at its depth; strings below and above the pivot's are new groups at that depth, and those equal to it a
    group one character deeper. Groups that agree to SHALLOW bytes go to the tries."""
    n, chars = len(starts), -(-width // 8)
    data = np.concatenate([data, np.zeros(8, "uint8")])  # the last character may reach beyond the end
    view = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    cut = np.full(chars, np.iinfo("uint64").max, "uint64")
    if width % 8:
        cut[-1] <<= np.uint64(64 - width % 8 * 8)
    char = lambda rows, depth: view[starts[rows] + 8 * depth] & cut[depth]
    order = np.argsort(group, kind="stable")
    edge = np.append(True, group[order[1:]] != group[order[:-1]])[:n]
    depth = np.zeros(n, "int64")
    shallow = min(chars, SHALLOW // 8)

    def several(at: np.ndarray, deep: bool) -> np.ndarray:
        """Of places (whole groups) those in groups of several strings, above or at the shallow depth."""
        first = np.flatnonzero(edge[at])
        size = np.diff(np.append(first, len(at)))
        return at[np.repeat((size > 1) & ((depth[at[first]] == shallow) == deep), size)]

    at = several(np.arange(n), False)
    while len(at):
        new, rows = edge[at], order[at]
        gid, first = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        c = char(rows, depth[at])
        x, y, z = c[first], c[first + size // 2], c[first + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[gid]
        side = (c >= pivot).astype("int64") + (c > pivot)
        by = np.argsort(gid * 3 + side, kind="stable")
        order[at], side = rows[by], side[by]
        new[1:] |= side[1:] != side[:-1]
        edge[at] = new
        depth[at] += side == 1
        at = several(at, False)
    if shallow < chars:
        at = several(np.arange(n), True)
        if len(at):
            new, rows = edge[at], order[at]
            gid, first = np.cumsum(new) - 1, np.flatnonzero(new)
            leader, same = rows[first][gid], np.ones(len(at), bool)
            for k in range(shallow, chars):
                same &= char(rows, k) == char(leader, k)
            mixed = np.flatnonzero(~np.logical_and.reduceat(same, first))  # in the others the trie is one leaf
            ends = np.append(first, len(at))
            for g in mixed.tolist():
                own = rows[ends[g] : ends[g + 1]]
                strings = [data[b : b + width - 8 * shallow].tobytes() for b in (starts[own] + 8 * shallow).tolist()]
                place = at[ends[g]]
                for leaf in _Trie(strings).leaves():
                    order[place : place + len(leaf)] = own[leaf]
                    edge[place] = True
                    place += len(leaf)
    return order, edge


def later_ones(order: np.ndarray, edge: np.ndarray, d: np.ndarray, e: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of sorted strings those that are equal to one that starts earlier, by document (two halves) and start; a string that
    is given twice isn't earlier than itself."""
    if not len(order):
        return order
    by = np.lexsort((s, e, d))
    new = np.append(True, (d[by[1:]] != d[by[:-1]]) | (e[by[1:]] != e[by[:-1]]) | (s[by[1:]] != s[by[:-1]]))
    rank = np.empty(len(by), "int64")
    rank[by] = np.cumsum(new)
    r = rank[order]
    return order[r > np.minimum.reduceat(r, np.flatnonzero(edge))[np.cumsum(edge) - 1]]


# ---- segments ------------------------------------------------------------------------------------


def segments(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, starts, numbers of windows and places of the anchors of a text's segments."""
    n = len(data) - width + 1
    if n <= 0:
        z = np.zeros(0, "int64")
        return z, z, z, z
    w = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    last = len(data) - K + 1
    h = w[:last] * np.uint64(0x9E3779B97F4A7C15)
    for j, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0xD6E8FEB86659FD93), (24, 0xFF51AFD7ED558CCD)):
        h ^= h >> np.uint64(31)
        h += w[j : j + last] * np.uint64(odd)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    # the place in the low bits makes the leftmost of equal anchors the smallest, and cuts a segment
    # where the anchor moves: so no window occurs twice in a segment
    h &= ~np.uint64(PLACES - 1)
    h |= np.arange(last, dtype="uint64")
    span, got = width - K + 1, 1  # anchors in a window; how many m covers
    m = h
    while got * 2 <= span:
        m = np.minimum(m[:-got], m[got:])
        got *= 2
    if span > got:
        m = np.minimum(m[:n], m[span - got : span - got + n])
    starts = np.append(0, np.flatnonzero(m[1:] != m[:-1]) + 1)
    at = (m[starts] & np.uint64(PLACES - 1)).astype("int64")
    return (m[starts] // np.uint64(PLACES)).view("int64"), starts, np.diff(np.append(starts, n)), at - starts


def _first_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed segments in order, and a mask of the first of each anchor and digest."""
    a = a[np.lexsort((a["s"], a["e"], a["d"], a["c"], a["h"]))]
    # a row that is given twice has the same segments twice; they are one
    same = (a["h"][1:] == a["h"][:-1]) & (a["c"][1:] == a["c"][:-1]) & (a["d"][1:] == a["d"][:-1]) & (a["e"][1:] == a["e"][:-1]) & (a["s"][1:] == a["s"][:-1])
    a = a[np.append(True, ~same)]
    first = np.ones(len(a), bool)
    first[1:] = (a["h"][1:] != a["h"][:-1]) | (a["c"][1:] != a["c"][:-1])
    return a, first


def _by_doc(a: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, d, e, blob) of packed segments, a row for each document."""
    if not len(a):
        return
    a = a[np.lexsort((a["s"], a["e"], a["d"]))]
    other = np.append(True, (a["d"][1:] != a["d"][:-1]) | (a["e"][1:] != a["e"][:-1]))
    if kind == 0:  # windows that follow each other are one interval
        begin = np.flatnonzero(other | np.append(True, a["s"][1:] != a["s"][:-1] + a["n"][:-1]))
        packed = np.zeros(len(begin), RUNS)
        packed["s"], packed["n"] = a["s"][begin], np.add.reduceat(a["n"].astype("int64"), begin)
        a, other = a[begin], other[begin]
    else:
        packed = a
    starts = np.flatnonzero(other)
    ends = np.append(starts[1:], len(a))
    for at in range(0, len(ends), 5000):
        blobs = [packed[b:e].tobytes() for b, e in zip(starts[at : at + 5000].tolist(), ends[at : at + 5000].tolist())]
        f = starts[at : at + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array(a["d"][f]), pa.array(a["e"][f]), pa.array(blobs, pa.binary())], ["kind", "d", "e", "blob"])


ROWS = "kind int, d long, e long, blob binary"


def _packed(docs: DataFrame, width: int, buckets: int, most: int) -> DataFrame:
    """kind 0: repeats known inside a task; 1: segments for sorting of anchors that are hot inside a
    task; 2: packed segments for bucket d."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, first = _first_of(np.concatenate(held))
        yield from _by_doc(a[~first], 0)
        a = a[first]
        edge = np.append(True, a["h"][1:] != a["h"][:-1])
        which = np.cumsum(edge) - 1
        many = np.bincount(which)[which] > most
        # an anchor that is hot here needs no meeting in a bucket; two of its segments go there, so that others learn of it
        ahead = np.arange(len(a)) - np.flatnonzero(edge)[which]
        hot = a[many].copy()
        hot["m"] = 2
        yield from _by_doc(hot, 1)
        rest = a[~many | (ahead < 2)].copy()
        rest["m"] = np.where(many[~many | (ahead < 2)], 1, 0)
        bucket = (rest["h"].astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
        rest = rest[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cuts = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
        begin = np.concatenate([[0], cuts[:-1]])
        if len(rest):
            blobs = [rest[b:e].tobytes() for b, e in zip(begin.tolist(), cuts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([2] * len(blobs), pa.int32()), pa.array(bucket[begin].astype("int64")), pa.array([0] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["kind", "d", "e", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for d, e, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = t.as_py().encode() if t.is_valid else b""
                for off in range(0, len(whole) - width + 1, SLICE):
                    data = whole[off : off + SLICE + width - 1]
                    h, s, c, at = segments(data, width)
                    a = np.zeros(len(h), SEG)
                    a["h"], a["s"], a["n"], a["a"], a["d"], a["e"] = h, s + off, c, at, d, e
                    ends = (s + c + (width - 1)).tolist()
                    a["c"] = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(s.tolist(), ends)), "uint64", len(h)).view("int64")
                    held.append(a)
                    n += len(a)
                    if n >= HELD:
                        yield from flush(held)
                        held, n = [], 0
        if held:
            yield from flush(held)

    return docs.select("d", "e", "text").mapInArrow(run, ROWS)


def _met(packed: DataFrame, n: int, most: int) -> DataFrame:
    """Buckets meet: kind 0 rows are repeats, kind 1 rows segments that need sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            kinds = np.array(batch.column(0))
            done = kinds < 2
            if done.any():
                yield batch.filter(pa.array(done))
            held += [np.frombuffer(b.as_py(), SEG) for b, k in zip(batch.column(3), kinds.tolist()) if k == 2]
        if not held:
            return
        a, first = _first_of(np.concatenate(held))
        yield from _by_doc(a[~first], 0)
        a = a[first]
        which = np.cumsum(np.append(True, a["h"][1:] != a["h"][:-1])) - 1
        size = np.bincount(which)[which]
        told = np.zeros(which[-1] + 1, bool)
        np.logical_or.at(told, which, a["m"] > 0)
        a = a[(size > 1) | told[which]].copy()
        a["m"] = np.where((size > most) | told[which], 2, 1)[(size > 1) | told[which]]
        yield from _by_doc(a, 1)

    # repeats known already stay with any task; a bucket's segments meet in one
    salt = F.when(F.col("kind") == 2, F.col("d")).otherwise(F.xxhash64("d", "e"))
    return packed.repartition(n, salt).mapInArrow(run, ROWS)


SEGMENT_ROWS = "h long, hot boolean, d long, e long, s long, a int, body binary"


def _texts(need: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """h, hot, d, e, s, a and bytes of each segment that needs sorting; a document's text is looked up once."""
    own = need.groupBy("d", "e").agg(F.collect_list("blob").alias("blobs"))
    joined = own.join(docs, ["d", "e"]).select("blobs", "d", "e", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs, t in zip(batch.column(0), batch.column(3)):
                a, data = np.concatenate([np.frombuffer(b.as_py(), SEG) for b in blobs]), t.as_py().encode()
                for part in np.array_split(a, -(-len(a) // 20_000)):
                    body = [data[x:y] for x, y in zip(part["s"].tolist(), (part["s"] + part["n"] + (width - 1)).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(part["h"]), pa.array(part["m"] == 2), *(pa.array(part[c]) for c in "des"), pa.array(part["a"].astype("int32")), pa.array(body, pa.binary())], ["h", "hot", "d", "e", "s", "a", "body"])

    return joined.mapInArrow(run, SEGMENT_ROWS)


def _windows(rows: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """The windows of segments: their bytes, starts there, groups (anchor and its place), and d, e, s."""
    body = rows.column("body")
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    ends = np.frombuffer(body.buffers()[1], "int32")[body.offset : body.offset + len(body) + 1].astype("int64")
    data = np.frombuffer(body.buffers()[2], "uint8")
    col = lambda c: rows.column(c).to_numpy()
    n = np.diff(ends) - (width - 1)
    seg = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    _, h = np.unique(col("h"), return_inverse=True)
    return data, ends[:-1][seg] + j, h[seg] * width + col("a")[seg] - j, col("d")[seg], col("e")[seg], col("s")[seg] + j


def _repeats(d: np.ndarray, e: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = np.zeros(len(d), SEG)
    out["d"], out["e"], out["s"], out["n"] = d, e, s, 1
    yield from _by_doc(out, 0)


def _sorted_repeats(segs: DataFrame, width: int, n: int) -> DataFrame:
    """Repeats among the windows of each anchor that isn't hot."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, starts, group, d, e, s = _windows(rows, width)
        i = later_ones(*deep_shallow(data, starts, width, group), d, e, s)
        yield from _repeats(d[i], e[i], s[i])

    return key_groups(segs.where("NOT hot").drop("hot"), ["h"], run, ROWS, n, SEGMENTS)


def _hot_repeats(segs: DataFrame, width: int, n: int) -> DataFrame:
    """Repeats among the windows of hot anchors: sorted in each task, and the first ones of all tasks once more."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "d", "e", "blob", "x", "s", "body"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * SEGMENTS):
                data, starts, group, d, e, s = _windows(batch.slice(at, 2 * SEGMENTS), width)
                order, edge = deep_shallow(data, starts, width, group)
                later = later_ones(order, edge, d, e, s)
                for rows in _repeats(d[later], e[later], s[later]):
                    k = rows.num_rows
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
                gone = np.zeros(len(d), bool)
                gone[later] = True
                for i in np.array_split(np.flatnonzero(~gone), -(-len(d) // WINDOWS)):
                    body = [data[b : b + width].tobytes() for b in starts[i].tolist()]
                    x = np.fromiter(map(xxhash.xxh3_64_intdigest, body), "uint64", len(body)).view("int64")
                    k = len(body)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, "int32")), pa.array(d[i]), pa.array(e[i]), pa.nulls(k, pa.binary()), pa.array(x), pa.array(s[i]), pa.array(body, pa.binary())], names)

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        body = rows.column("body").combine_chunks()
        d, e, s, x = (rows.column(c).to_numpy() for c in "desx")
        _, group = np.unique(x, return_inverse=True)
        data, first = np.frombuffer(body.buffers()[2], "uint8"), np.frombuffer(body.buffers()[1], "int32")[body.offset]
        i = later_ones(*deep_shallow(data, first + np.arange(len(d)) * width, width, group), d, e, s)
        yield from _repeats(d[i], e[i], s[i])

    own = stored(segs.where("hot").select("h", "d", "e", "s", "a", "body").mapInArrow(firsts, ROWS + ", x long, s long, body binary"), "hot-windows")
    met = key_groups(own.where("kind = 1").select("x", "d", "e", "s", "body"), ["x"], run, ROWS, n, WINDOWS)
    return own.where("kind = 0").select("kind", "d", "e", "blob").unionByName(met)


def _spans(blobs: list[bytes], width: int) -> np.ndarray:
    """Removed spans (start, end) from packed windows; those that touch are one."""
    a = np.concatenate([np.frombuffer(b, RUNS) for b in blobs])
    a = a[np.argsort(a["s"], kind="stable")]
    ends = np.maximum.accumulate(a["s"] + a["n"] + (width - 1))
    new = np.append(True, a["s"][1:] > ends[:-1])
    return np.stack([a["s"][new], ends[np.append(new[1:], True)]], axis=1)


def dedup(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of struct start, end) and kept (the text's
    remaining bytes, binary)."""
    spark = docs.sparkSession
    n = parts(docs, 8)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(body).alias("e"), body.alias("text"))
    # texts are looked up twice by document; a bucketed table saves shuffling them each time
    texts = bucketed(rows, n, ["d", "e"], "suffix-texts")
    buckets = max(n, parts(docs, 4))
    met = stored(_met(_packed(texts, width, int(buckets), hot), n, hot), "suffix-met")
    segs = stored(_texts(met.where("kind = 1"), texts, width), "suffix-segments")
    repeats = met.where("kind = 0").select("d", "e", "blob").unionByName(_sorted_repeats(segs, width, n).select("d", "e", "blob")).unionByName(_hot_repeats(segs, width, n).select("d", "e", "blob"))
    per_doc = repeats.groupBy("d", "e").agg(F.collect_list("blob").alias("blobs"))  # a document's own intervals
    joined = texts.join(per_doc, ["d", "e"], "left").select("d", "text", "blobs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                cols = [[] for _ in range(6)]
                for d, t, blobs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = t.encode()
                    spans = _spans(blobs, width) if blobs else np.zeros((0, 2), "int64")
                    edges = [0, *spans.ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    for col, v in zip(cols, (None if d == LAST else d, len(data), len(data) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans.tolist()], kept)):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
x AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS h, least(500, n - 99 - o) AS k FROM (SELECT *, unnest(range(0, n - 99, 500)) AS o FROM d WHERE n >= 100)),
w AS (SELECT doc_id, o + i AS p, md5_number(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(range(0, k)) AS i FROM x)),
f AS (SELECT m, min(doc_id * 4294967296 + p) AS first FROM w GROUP BY m HAVING count(*) > 1),
l AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w JOIN f USING (m) WHERE doc_id * 4294967296 + p > first),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM l) GROUP BY doc_id, g),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM s
      UNION ALL SELECT doc_id, coalesce(max(s.b), 0), any_value(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS k FROM s GROUP BY doc_id)
SELECT doc_id, d.n AS n_bytes, coalesce(c.n, 0) AS n_removed, coalesce(c.k, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""



def plain(rows: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The result by brute force, for distinct document numbers; for tests."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - width + 1):
            s = data[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (len(data), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest())
    return out
