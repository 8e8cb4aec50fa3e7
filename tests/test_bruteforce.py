"""Queries that SQL can't express, against plain loops over their own tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import repeats as R, signal as S
from tidemark.plans import catalogue, signals, transcript

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words(spark):
    return transcript.stutters(spark, DATA).cache()


@pytest.fixture(scope="module")
def media(words):
    """Words of each media in order: norm, start, end."""
    out = defaultdict(list)
    for r in sorted(words.collect(), key=lambda r: (r.media_id, r.pos)):
        out[r.media_id].append(r)
    return out


def content(ws):
    return [w for w in ws if w and w not in T.STOP_WORDS]


def exact(ws, i):
    for n in range(14, 2, -1):
        for lag in range(n, n + 5):
            if i + lag + n <= len(ws) and ws[i : i + n] == ws[i + lag : i + lag + n]:
                return (n, i + lag) if ws[i] and len(content(ws[i : i + n])) >= 2 else None


def near(ws, i):
    if not content(ws[i : i + 1]):
        return None
    for n in range(12, 3, -1):
        for lag in range(n + 1, n + 6):
            x, y = ws[i : i + n], ws[i + lag : i + lag + n]
            if len(y) == n and sum(a != b for a, b in zip(x, y)) == 1 and len(content(x)) >= 3 and T.edits(x, y) <= 1:
                return (n, i + lag) if not T.translated(x, y) else None


@pytest.mark.parametrize("find, exact_options, near_options", [(exact, R.EXACT, None), (near, None, R.NEAR)])
def test_repeats(words, media, find, exact_options, near_options):
    got = {(r.media_id, r.pos, r.length, r.b) for r in R._repeats(words, exact_options, near_options).collect()}
    want = set()
    for m, rows in media.items():
        ws, i = [r.norm for r in rows], 0
        while i < len(ws):
            hit = find(ws, i)
            if hit:
                want.add((m, i, *hit))
            i = hit[1] if hit else i + 1
    assert got == want and len(want) > 50


def snap(rows, i):
    """Where a cut at i begins: the last pause before, no further back than five seconds."""
    pause = max((k for k in range(1, i + 1) if rows[k].start_us - rows[k - 1].end_us >= 450_000), default=0)
    return max(pause, min(k for k in range(len(rows)) if rows[k].start_us >= rows[i].start_us - 5_000_000))


def cut(rows, a, b, keep_to, kind, confidence):
    raw = lambda x, y: " ".join(r.raw for r in rows[x:y]).strip()
    return rows[a].start_us, rows[b].start_us if b < len(rows) else None, raw(a, b), raw(b, keep_to), kind, confidence


def found(df):
    return {tuple(r) for r in df.select(*R.COLUMNS).collect()}


@pytest.mark.parametrize("name", ["repeats_exact", "near_repeats"])
def test_repeat_cuts(spark, media, name):
    find, kind = (exact, "verbatim_repeat") if name == "repeats_exact" else (near, "near_repeat")
    want = set()
    for m, rows in media.items():
        ws, i = [r.norm for r in rows], 0
        while i < len(ws):
            hit = find(ws, i)
            if hit:
                n, b = hit
                conf = min(1.0, 0.55 + 0.08 * n) if find is exact else min(0.9, 0.5 + 0.06 * n)
                want.add((m, *cut(rows, snap(rows, i), b, b + n + 5, kind, round(conf, 2))))
            i = hit[1] if hit else i + 1
    assert found(catalogue.QUERIES[name](spark, DATA)) == want


def test_false_starts(spark, media):
    want = set()
    for m, rows in media.items():
        ws, n, i = [r.norm for r in rows], len(rows), 0
        while i < n:
            b = next((k for k in range(i + 1, min(n, i + 12)) if rows[k].start_us - rows[k - 1].end_us >= 350_000), None)
            opening = content(ws[i : i + 5])[:3]
            hit = None
            if content(ws[i : i + 1]) and b is not None and len(opening) == 3 and i < n - 6:
                again = content(ws[b : b + 7])[:3]
                if len(again) == 3 and T.edits(opening, again) <= 1 and not T.translated(ws[i:b], ws[b : b + b - i][:12]):
                    a = snap(rows, i)
                    hit = (a, b) if b - a >= 2 else None
            if hit:
                want.add((m, *cut(rows, *hit, min(hit[1] + 12, n), "false_start", 0.72)))
            i = hit[1] if hit else i + 1
    assert found(catalogue.QUERIES["false_starts"](spark, DATA)) == want and want


def plain_similar(rows, threshold):
    """rows: media_id, seg_no, start, end, text, tokens of one media in order."""
    want = set()
    toks = [r[5] for r in rows]
    for i in range(len(rows)):
        tries = [(T.similar(toks[i], toks[j]), -j) for j in range(i + 1, min(len(rows), i + 7)) if len(toks[i]) >= 4 and len(toks[j]) >= 4]
        if tries and max(tries)[0] >= threshold:
            sim, j = max(tries)[0], -max(tries)[1]
            short, long = (i, j) if len(toks[i]) <= len(toks[j]) else (j, i)
            block = T.SequenceMatcher(None, toks[short], toks[long]).find_longest_match()
            c, k = (short, long) if block.a == 0 and block.size >= 0.8 * len(toks[short]) else (i, j)
            want.add((rows[i][0], rows[c][2], rows[c][3], rows[c][4], rows[k][4], "verbatim_repeat" if sim >= 0.8 else "near_repeat", round(sim, 2)))
    return want


def test_similar_segments(spark):
    rows = [
        (1, i, i * 1_000_000, i * 1_000_000 + 900_000, t)
        for i, t in enumerate(["the river flows north here", "the river flows north here today again", "nothing at all alike in this", "the river flows south here", "one two", "the the the river river flows"])
    ]
    got = found(R.similar_segments(spark.createDataFrame(rows, "media_id long, seg_no int, start_us long, end_us long, text string"), threshold=0.5))
    want = plain_similar([(*r, r[4].split()) for r in rows], 0.5)
    assert got == want and len(want) > 2


def test_similar_segments_of_conversations(spark):
    rows = defaultdict(list)
    for r in transcript.retold(spark, DATA).withColumn("toks", T.tokens(F.col("text"))).orderBy("media_id", "seg_no").collect():
        rows[r.media_id].append((r.media_id, r.seg_no, r.start_us, r.end_us, r.text, r.toks))
    want = set().union(*(plain_similar(x, 0.65) for x in rows.values()))
    rounded = lambda rs: {(*r[:6], round(r[6], 2)) for r in rs}
    assert rounded(found(catalogue.QUERIES["similar_segments"](spark, DATA))) == rounded(want) and len(want) >= 25


def plain_suppressed(rows):
    """rows: media_id, start, end, ..., confidence last, of one media: overlapping ones leave the surest, of equals the first."""
    out = []
    for r in sorted(rows, key=lambda r: r[1:3]):
        if not out or r[1] >= out[-1][2] - 50_000:
            out.append(r)
        elif r[-1] > out[-1][-1]:
            out[-1] = r
    return out


def test_repeat_candidates_equal_their_steps(spark):
    """The chain, which snaps and finishes all detectors' cuts at once, equals the detectors one by one, reranked together and suppressed by a
    plain loop."""
    words, names = transcript.stutters(spark, DATA), ("media_id", "start_us", "end_us", "text", "keep_text", "type", "confidence")
    parts = None
    for f in (R.verbatim_repeats, R.near_repeats, R.false_starts, R.corrections):
        one = f(words).select(*names)
        parts = one if parts is None else parts.unionByName(one)
    by = defaultdict(list)
    for r in R.rerank(parts, transcript._history(spark, DATA)).select(*names).collect():
        by[r.media_id].append(tuple(r))
    want = [r[:3] for rows in by.values() for r in plain_suppressed(rows)]
    got = catalogue.QUERIES["repeat_candidates"](spark, DATA).select(*names[:3]).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_repeat_candidates(spark):
    """The chain keeps only what the detectors found, at most one cut at a time, with confidence raised or as it was."""
    got = found(catalogue.QUERIES["repeat_candidates"](spark, DATA))
    words = transcript.stutters(spark, DATA)
    parts = set().union(*(found(f(words)) for f in (R.verbatim_repeats, R.near_repeats, R.false_starts, R.corrections)))
    assert {r[:6] for r in got} <= {r[:6] for r in parts} and len(got) > 50
    ends = defaultdict(list)
    for r in sorted(got, key=lambda r: (r[0], r[1])):
        ends[r[0]].append((r[1], r[2]))
    assert all(b[0] >= a[1] - 50_000 for spans in ends.values() for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("threshold", [0.05, 0.34, 0.6, 1.0])
def test_near_sets_lose_no_pair_and_make_few_others(spark, threshold):
    """Sets of few words, which often share some; a fifth are others' sets with a word changed, added or taken away."""
    rng, words = random.Random(7), [f"w{k}" for k in range(80)]
    sets = [rng.sample(words, rng.randint(0, 14)) for _ in range(400)]
    sets += [rng.choice([s, s[1:], [*s, "one"], [*s[1:], "more"]]) for s in rng.sample(sets, 100)]
    left, right = (dict(enumerate(sets[k::2])) for k in (0, 1))
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, t array<string>")
    got = {(r.a, r.b) for r in R.near_sets(frame(left), frame(right), threshold).collect()}
    near = {(a, b) for a, x in left.items() for b, y in right.items() if x and y and len({*x} & {*y}) / len({*x, *y}) >= threshold}
    assert near <= got and len(near) >= 10
    assert threshold < 0.6 or len(got) <= 2 * len(near)


def test_rerank_equals_votes_one_by_one(spark):
    rng, words = random.Random(8), [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.sample(words, rng.randint(0, 7))) for _ in range(120)] + ["W1, w2 w2 w1!", "", " . "]
    past = [(rng.choice([t, t, " ".join([*t.split()[1:], "w1"])]), rng.choice([True, False, False, None])) for t in rng.choices(texts, k=600)] + [(None, False), ("", False), (" ".join(words), True)]
    rows = [(k % 9, 0.5, t) for k, t in enumerate(texts + texts[:40])] + [(1, 0.5, None)]
    got = R.rerank(spark.createDataFrame(rows, "media_id long, confidence double, text string"), spark.createDataFrame(past, "text string, approved boolean"))
    bag = lambda t: {w for w in re.findall(r"[a-zà-ÿ0-9']+", (t or "").lower()) if len(w) > 1}
    want = []
    for media, confidence, text in rows:
        x = bag(text)
        votes = [bool(v) for t, v in past if x and bag(t) and len(x & bag(t)) / len(x | bag(t)) >= 0.6]
        yes, no = sum(votes), len(votes) - sum(votes)
        if not (no >= 2 and no > 2 * yes):
            want.append((media, 0.65 if yes >= 2 and yes > 2 * no else confidence, text))
    order = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert len(want) < len(rows) and any(r[1] > 0.5 for r in want)


def test_recovered_keep(spark):
    """The planted cuts come back to the sample, but for what a probe can't tell."""
    got = defaultdict(list)
    for r in catalogue.QUERIES["recovered_keep"](spark, DATA).collect():
        got[r.media_id].append((r.raw_start, r.raw_end))
    lengths = {r.media_id: r.n for r in signals.sounds(spark, DATA).select("media_id", F.size("raw").alias("n")).collect()}
    assert len(got) == len(lengths) > 1
    for m, spans in got.items():
        want = [(0, 400), (600, lengths[m])] if m % 2 == 0 else [(0, 700), (1000, 1900), (2300, lengths[m])]
        spans.sort()
        assert len(spans) == len(want)
        assert all(abs(a - b) <= 15 for x, y in zip(spans, want) for a, b in zip(x, y))


def test_recovered_keep_limits(spark):
    """Clamped to the raw sound, silence gives no ranges, and ranges of 50 ms or less go."""
    r = np.random.default_rng(4)
    raw = r.normal(size=4000)
    rows = [(1, raw.tolist(), np.concatenate([raw[:2000], raw[2600:], r.normal(size=300)]).tolist()), (2, raw.tolist(), [0.0] * 3000), (3, raw.tolist(), [])]
    got = defaultdict(list)
    for x in S.recovered_keep(spark.createDataFrame(rows, "media_id long, raw array<double>, edited array<double>"), rate=100).collect():
        got[x.media_id].append((x.raw_start, x.raw_end))
    assert set(got) == {1} and sorted(got[1])[-1][1] == 4000 and abs(sorted(got[1])[0][1] - 2000) <= 15


def test_offset_segments(spark):
    found = [(1, 0, 10), (1, 50, 61), (1, 100, 130), (1, 150, 181), (2, 0, 5)]
    df = spark.createDataFrame(found, "media_id long, edited_i long, raw_i long")
    assert {tuple(r) for r in S.offset_segments(df, 5).collect()} == {(1, 0, 50, 10), (1, 100, 150, 30), (2, 0, 0, 5)}


def test_greedy_clusters(spark):
    """With ties at the reach, which is exclusive."""
    def plain(points):
        groups = []
        for p in points:
            home = next((g for g in groups if all(abs(p[a] - float(np.median([q[a] for q in g]))) < 60 for a in (0, 1))), None)
            if home is None:
                groups.append(home := [])
            home.append(p)
        return [(len(g), *(float(np.median([q[a] for q in g])) for a in range(3))) for g in groups]

    points = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_suppkey AS k", "l_orderkey * 10 + l_linenumber AS ord", "l_quantity * 10 AS x", "l_discount * 1000 AS y", "l_tax * 100 AS r").orderBy("k", "ord").collect():
        points[r.k].append((r.x, r.y, r.r))
    got = defaultdict(list)
    for r in sorted(catalogue.QUERIES["greedy_clusters"](spark, DATA).collect(), key=lambda r: (r.k, r.cluster)):
        got[r.k].append((r.n, r.cx, r.cy, r.cr))
    assert {k: [tuple(map(float, g)) for g in v] for k, v in got.items()} == {k: [tuple(map(float, g)) for g in plain(v)] for k, v in points.items()}
    ties = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0), (1, 2, 60.0, 0.0, 1.0), (1, 3, 59.9, 0.0, 1.0)], "k long, ord long, cx double, cy double, cr double")
    assert sorted((r.n, r.cx) for r in S.greedy_clusters(ties, ["k"], "ord").collect()) == [(1, 60.0), (2, 29.95)]


def test_positions_and_zips(spark):
    """Keys of one row to thousands, null keys, equal rows, partners of unlike length, clashing columns."""
    import random

    from tidemark.operators.positions import positions, zipped

    r = random.Random(5)
    rows = lambda n: [(r.choice([1, 1, 1, 1, 1, 2, 3, None]), r.randrange(500), i, "x") for i in range(n)] + [(9, 1, -1, "y")] * 3
    a, b = rows(3000), rows(1500)
    names = "media_id long, t long, i long, pos_ string"
    da, db = (spark.createDataFrame(x, names).repartition(5) for x in (a, b))
    got = sorted((repr(x.media_id), x.pos, x.t, x.i) for x in positions(da, ["media_id"], ["t", "i"]).collect())
    want = []
    for k in {x[0] for x in a}:
        want += [(repr(k), n, t, i) for n, (_, t, i, _) in enumerate(sorted((x for x in a if x[0] == k), key=lambda x: x[1:3]))]
    assert got == sorted(want)
    pairs = [(repr(x.media_id), x.pos, x.t, x.b_t) for x in zipped(da, db, ["media_id"], ["t", "i"], ["t", "i"]).collect()]
    expect = []
    for k in {x[0] for x in a} & {x[0] for x in b}:
        side = [sorted((x for x in y if x[0] == k), key=lambda x: x[1:3]) for y in (a, b)]
        expect += [(repr(k), n, x[1], y[1]) for n, (x, y) in enumerate(zip(*side))]
    assert sorted(pairs) == sorted(expect)
    none = spark.createDataFrame([], names)
    assert positions(none, ["media_id"], ["t"]).count() == 0 and zipped(da, none, ["media_id"], ["t"], ["t"]).count() == 0
