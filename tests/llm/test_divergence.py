"""Source divergence against a plain count of every term of every group."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import source_divergence as sd

KEPT = {chr(c): chr(c + 32) for c in range(65, 91)}


def plain(rows, least_docs=3, top=200):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(KEPT)))) for a, b, t in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for a, b, words in docs:
        df[a].update(set(words))
        count[a, b].update(words)
        count[a,].update(words)
    out = set()
    p = {}
    for g in count.keys() | {(a, b) for a, b, _ in docs} | {(a,) for a, _, _ in docs}:
        kept = [t for t in df[g[0]] if df[g[0]][t] >= least_docs]
        n = sum(count[g][t] for t in kept)
        p[g] = {t: 1 + 10**9 * (count[g][t] + 1) // (n + len(kept)) for t in kept}
    f = lambda x, y: (x - y) ** 2 // y
    for g in [g for g in p if len(g) == 2]:
        pairs = [(h[1], sum(f(p[g][t], p[h][t]) for t in p[g])) for h in p if len(h) == 2 and h[0] == g[0] and h != g]
        terms = [(t, f(p[g][t], p[g[0],][t])) for t in p[g] if count[g][t] > 0 and p[g][t] > p[g[0],][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(*g, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)}
    return out


def rows_of(spark, rows, **kw):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = sd.audit(docs, **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [a + b for a in ("ka", "lo", "é", "MI", "ñu", "日本") for b in ("", "ta", "ra", "xx", "zo")]
    rows = []
    for i in range(160):
        lean = i % 7
        rows.append((r.choice(["en", "fr", None]), f"s{lean}", ", ".join(r.choice(words[lean : lean + 12] if r.random() < 0.6 else words) for _ in range(r.randrange(0, 60)))))
    # a group without terms, one with words that aren't kept, a language without kept terms, rows that repeat
    rows += [("en", "bare", None), ("en", "bare2", "12 34 _"), ("fr", "odd", "unseenword " * 50), ("xx", "a", "one two"), ("xx", "b", "one three"), ("xx", "c", "")]
    return rows + [("en", "s1", "ka ka ka lota")] * 5 + [("en", None, "ka " * 20_000)]


@pytest.mark.parametrize("top", [200, 5, 1])
def test_against_plain_counts(spark, corpus, top):
    assert rows_of(spark, corpus, top=top) == plain(corpus, top=top)


def test_ties_at_the_last_rank_are_whole(spark):
    """Equal values on both sides of the last rank: items decide, in whichever bucket they lie."""
    rows = [("en", "a", " ".join(f"w{chr(97 + i)}" for i in range(20)))] * 3 + [("en", "b", "other words here")] * 3
    assert rows_of(spark, rows, top=7) == plain(rows, top=7)


def test_small_holds_hand_on_sums(spark, corpus, monkeypatch):
    """What a task holds doesn't show in the result. Workers are started from this process, so the plain functions are called."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[{"gid": g, "p": 5 + g * k, "p0": 2} for g in range(k % 6)] for k in range(40)])], ["posts"])

    def sums():
        out = Counter()
        for b in sd._pair_sums(iter([batch])):
            for a, c, v in zip(*(x.to_pylist() for x in b.columns)):
                out[a, c] += v
        return out

    whole = sums()
    monkeypatch.setattr(sd, "HELD", 2)
    assert sums() == whole and len(whole) > 10


def test_empty(spark):
    assert sd.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
