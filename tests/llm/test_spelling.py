"""Spelling variants against a plain comparison of every two words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, close = {}, {}
    for w in n:
        close[w] = [x for x in n if x != w and near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def variants(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, id int")
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    bases = ["correction", "banana", "aaaaaaa", "éèêëìí", "straße÷×ÿ", "Mississippi", "zzzzzzzzzzzz"]
    words = [(b, 1500) for b in bases]
    for b in bases:
        for k in range(40):
            w, times = b, r.choice([5, 6, 30, 200])
            for _ in range(r.choice([1, 1, 2, 3])):
                i, c = r.randrange(len(w) + 1), r.choice("abzéÿs")
                w = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.append((w, times))
    words += [("tooshort"[:5], 50), ("rarely", 4), ("exactly", 5)]
    flat = [w for w, k in words for _ in range(k)]
    r.shuffle(flat)
    rows = [(i, " ".join(flat[i * 40 : i * 40 + 40])) for i in range(len(flat) // 40 + 1)]
    return rows + [(None, "Correction banana, correctiom"), (None, None), (3, ""), (4, "漢字 123 _ '"), (5, "banana"), (5, "banana"), (7, "banana " * 30_000)]


def test_against_plain_comparison(spark, corpus):
    want = plain(corpus)
    assert sum(r[1] is not None for r in want) > 40 and any(r[2] not in (r[0], r[1]) for r in want)  # with chains
    assert variants(spark, corpus) == want


def test_long_words_and_ties(spark):
    """Words around and beyond the length up to which strings are held; near words that occur equally often."""
    rows = []
    for size in (126, 127, 128, 129, 130, 3000):
        w = "".join(chr(97 + (i * i) % 23) for i in range(size))
        rows += [(size, f"{w} " * 30), (size, f"{w[:50]}{w[51:]} " * 6), (size, f"{w[:60]}zz{w[62:]} " * 6), (size, f"{w}y " * 6)]
    rows += [(9, "abcdefx " * 25 + "abcdefy " * 25 + "abcdefz " * 5 + "abcdef " * 5)]
    assert variants(spark, rows) == plain(rows)


def test_colliding_hashes_are_told_apart(spark, corpus, monkeypatch):
    """With hashes of a few bits strings decide alone."""
    words = spark.createDataFrame(sorted({(w, n) for w, _, _, n, _, _ in plain(corpus)}), "word string, n long")
    rest = spelling.remainders(spelling.numbered(words)).collect()
    import pyarrow as pa

    rows = sorted(((r.key % 7, r.rest, r.id, r.n, r.place, r.first) for r in rest), key=lambda x: x[0])
    group = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["key", "rest", "id", "n", "place", "first"])
    count = Counter()
    for b in spelling._near(group):
        for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            count[i] += k
    named = {r.id: r.word for r in spelling.numbered(words).collect()}
    assert {named[i]: k for i, k in count.items()} == {w: k for w, _, _, _, k, _ in plain(corpus) if k}


def test_rolling_hashes():
    w = np.frombuffer(b"bananabandan", "uint8").reshape(2, 6).astype("uint64")
    whole, rest = spelling.hashes(w)
    for k, word in enumerate(("banana", "bandan")):
        for i in range(6):
            left = word[:i] + word[i + 1 :]
            assert rest[k, i] == spelling.hashes(np.frombuffer(left.encode(), "uint8").reshape(1, 5).astype("uint64"))[0][0]
    assert whole[0] != whole[1] and (whole >= 0).all() and (rest >= 0).all()


def test_empty(spark):
    assert variants(spark, []) == set()
    assert variants(spark, [(1, "one two")]) == set()
