"""Results derived by hand for small inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import edl, events as E, intervals as I, quality as Q, registry as G, repeats as R

S = 1_000_000


def spans(spark, rows, media=1):
    return spark.createDataFrame([(media, round(a * S), round(b * S)) for a, b in rows], "media_id long, start_us long, end_us long")


def pairs(df):
    return sorted((r.start_us / S, r.end_us / S) for r in df.collect())


def dur(spark, seconds):
    return spark.createDataFrame([(1, seconds * S)], "media_id long, dur_us long")


def bound(spark, hi):
    return spark.createDataFrame([(1, 0, hi * S)], "media_id long, lo_us long, hi_us long")


def test_speech_keep(spark):
    assert pairs(I.speech_keep(spans(spark, [(0.5, 2), (3, 4), (8, 9)]), dur(spark, 10))) == [(0.2, 4.3), (7.7, 9.3)]


def test_speech_keep_is_strict(spark):
    assert pairs(I.speech_keep(spans(spark, [(0, 1), (2.5, 3)]), dur(spark, 10))) == [(0, 1.3), (2.2, 3.3)]


def test_merge_with_slack(spark):
    assert pairs(I.merge_intervals(spans(spark, [(1, 2), (2.02, 3), (3.05, 4)]), slack_us=20_000)) == [(1, 3), (3.05, 4)]


def test_merge_in_chunks_is_the_same(spark):
    rows = spans(spark, [(0, 5), (1, 2), (4, 9), (20, 30), (29, 31), (100, 101)])
    assert pairs(I.merge_intervals(rows, chunk_us=3 * S)) == pairs(I.merge_intervals(rows))


def test_complement(spark):
    assert pairs(I.complement(spans(spark, [(1, 3), (2, 4), (7, 8)]), bound(spark, 10))) == [(0, 1), (4, 7), (8, 10)]
    assert pairs(I.complement(spans(spark, [(12, 13)]), bound(spark, 10))) == [(0, 10)]


def test_subtract(spark):
    assert pairs(I.subtract(spans(spark, [(0, 10)]), spans(spark, [(2, 3), (5, 6)]))) == [(0, 2), (3, 5), (6, 10)]
    assert pairs(I.subtract(spans(spark, [(0, 10)]), spans(spark, [(0.03, 10)]))) == []


def test_keep_intervals(spark):
    trims = spark.createDataFrame([(1, 1 * S, None, 8 * S)], "media_id long, trim_start_us long, trim_end_us long, dur_us long")
    assert pairs(edl.keep_intervals(spans(spark, [(4, 5), (0, 2)]), trims)) == [(2, 4), (5, 8)]


def test_segment_plan(spark):
    ins = spark.createDataFrame([(1, 5 * S, "A", 0), (1, 15 * S, "B", 1), (1, 40 * S, "A", 2)], "media_id long, at_us long, clip string, ord long")
    got = edl.plan_segments(spans(spark, [(0, 10), (20, 30)]), ins).orderBy("seg_no").collect()
    assert [(r.input, r.start_us and r.start_us // S or (0 if r.start_us == 0 else None), r.end_us and r.end_us // S) for r in got] == [(0, 0, 5), (1, None, None), (0, 5, 10), (2, None, None), (0, 20, 30), (1, None, None)]


def test_mutes_inside_a_segment(spark):
    got = I.intersect(spans(spark, [(10, 20)]), spans(spark, [(9, 10.5), (19.99, 25), (12, 13)]), relative=True)
    assert pairs(got) == [(0, 0.5), (2, 3)]


def test_tile(spark):
    assert pairs(I.tile(spans(spark, [(0, 5), (6, 8), (11, 12)]))) == [(0, 6), (6, 8), (11, 12)]


def test_suppression(spark):
    rows = [(1, 0, 5 * S, "x", 0.7), (1, S, 9 * S, "x", 0.9), (1, 8 * S, 10 * S, "x", 0.8), (1, 9_500_000, 11 * S, "x", 0.5)]
    got = R.suppress_overlaps(spark.createDataFrame(rows, "media_id long, start_us long, end_us long, type string, confidence double"))
    assert sorted((r.start_us / S, r.confidence) for r in got.collect()) == [(1, 0.9), (9.5, 0.5)]


def words(spark, text):
    rows = [(1, i, w, w, i * 400_000, i * 400_000 + 300_000) for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "media_id long, pos int, norm string, raw string, start_us long, end_us long")


def test_verbatim_repeat(spark):
    r = R.verbatim_repeats(words(spark, "push factor means push factor means leaving")).collect()
    assert [(x.start_us, x.end_us, x.text, x.confidence) for x in r] == [(0, 1_200_000, "push factor means", 0.79)]


def test_repeats_need_content(spark):
    assert R.verbatim_repeats(words(spark, "we want to we want to go")).count() == 0


def test_correction(spark):
    r = R.corrections(words(spark, "it is thirty sorry forty degrees")).collect()
    assert [(x.start_us, x.end_us, x.text, x.keep_text, x.confidence) for x in r] == [(400_000, 1_500_000, "is thirty sorry", "forty degrees", 0.7)]


def test_near_repeat(spark):
    r = R.near_repeats(words(spark, "green river valley flows north well green river canyon flows north today")).collect()
    assert len(r) == 1 and r[0].type == "near_repeat" and r[0].confidence == 0.8


def test_false_start(spark):
    rows = [(1, i, w, w, t, t + 300_000) for i, (w, t) in enumerate(zip("gaza strip covers uh gaza strip covers forty one kilometres today friends".split(), [0, 400_000, 800_000, 1_200_000] + [3_000_000 + 400_000 * k for k in range(8)]))]
    r = R.false_starts(spark.createDataFrame(rows, "media_id long, pos int, norm string, raw string, start_us long, end_us long")).collect()
    assert [(x.start_us, x.end_us, x.type) for x in r] == [(0, 3_000_000, "false_start")]


def test_detectors_deal_words_out_once(spark):
    rows = [(m, i, w, w, t, t + 300_000) for m in (1, 2) for i, (w, t) in enumerate(zip("gaza strip covers uh gaza strip covers forty one kilometres today friends".split(), [0, 400_000, 800_000, 1_200_000] + [3_000_000 + 400_000 * k for k in range(8)]))]
    found = R.false_starts(spark.createDataFrame(rows, "media_id long, pos int, norm string, raw string, start_us long, end_us long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    assert sorted((r.media_id, r.text, r.keep_text, r.confidence) for r in found.collect()) == [(m, "gaza strip covers uh", "gaza strip covers forty one kilometres today friends", 0.72) for m in (1, 2)]


def test_review_rounds_halves_away_from_zero(spark):
    rows = [(1, 1_704_067_200_005_000, 1_704_067_201_005_000, "x", 0.5, "t", "k"), (2, 1_704_067_200_015_000, 1_704_067_201_015_000, "x", 0.5, "t", "k")]
    c = spark.createDataFrame(rows, "media_id long, start_us long, end_us long, type string, confidence double, text string, keep_text string")
    got = R.approved_cuts(R.review(c).withColumn("approve", F.lit(True))).collect()
    assert sorted((r.media_id, r.start_us % S, r.end_us % S) for r in got) == [(1, 10_000, 10_000), (2, 20_000, 20_000)]


def history(spark, *votes):
    return spark.createDataFrame([("push factors leave home", v) for v in votes], "text string, approved boolean")


def test_rerank(spark):
    c = spark.createDataFrame([(1, "push factors leave home", 0.79)], "media_id long, text string, confidence double")
    assert R.rerank(c, history(spark, False, False)).count() == 0
    assert R.rerank(c, history(spark, True, True)).first().confidence == 0.94
    assert R.rerank(c, history(spark, True, False, False)).first().confidence == 0.79


def test_freeze_needs_motion_again(spark):
    f = lambda n: spark.createDataFrame([(1, i * 0.5, 0.0) for i in range(6)] + [(1, 3.0, 9.0)] * n, "media_id long, t double, diff_max double")
    loud = spark.createDataFrame([(1, i, -20.0) for i in range(10)], "media_id long, win_no long, db double")
    assert Q.freeze(f(1), loud).count() == 1 and Q.freeze(f(0), loud).count() == 0


def test_audio_dip(spark):
    def dips(levels):
        rows = [(1, i, v, True) for i, v in enumerate([-20.0] * 8 + levels)]
        return Q.audio_dip(spark.createDataFrame(rows, "media_id long, win_no long, db double, speech boolean")).count()

    assert dips([-27.0, -25.0, -25.0, -20.0]) == 1 and dips([-27.0, -25.0, -20.0]) == 0


def test_cooldown(spark):
    f = spark.createDataFrame([(1, i * 0.5, 20) for i in range(21)], "media_id long, t double, top_ink int")
    assert sorted(r.t for r in Q.top_cut(f).collect()) == [0.0, 8.5]


def test_samples_of_equal_times_go_by_event(spark):
    value = {1: 20, 3: 20, 2: 0, 4: 0, 5: 20}
    for order in ([1, 2, 3, 4, 5], [1, 3, 2, 4, 5], [5, 4, 3, 2, 1]):
        rows = spark.createDataFrame([(1, 2.0, k, value[k]) for k in order], "media_id long, t double, event_id long, top_ink int").coalesce(1)
        assert Q.top_cut(rows).count() == 0
        frames = rows.select("media_id", "t", "event_id", F.col("event_id").alias("top"), F.col("event_id").alias("bottom"))
        slides = spark.createDataFrame([(1, 7, 0.0, 9.0)], "media_id long, slide long, t0 double, t1 double")
        assert [(r.top, r.bottom) for r in Q.slide_ink(slides, frames).collect()] == [(1, 1)]


def test_short_phases_are_one(spark):
    rows = [(1, i * S, v, 0, 4 * S) for i, v in enumerate([100.0, 150.0, 175.0, 180.0])]
    got = E.phases(spark.createDataFrame(rows, "media_id long, t_us long, bottom double, slide_start long, slide_end long"), ["media_id"], "t_us", "bottom").collect()
    assert [(r.start, r.end) for r in got] == [(0, 4 * S)]


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first().c


def test_titles_and_labels(spark):
    assert one(spark, T.title_key(F.lit("Pets & Animals (edited)"))) == "petsanimals"
    assert one(spark, T.bracket_title(F.lit("X (Hess's Law (& energy))"), F.lit("a/b.mp4"))) == "Hess's Law (& energy)"
    assert one(spark, T.clock(F.lit(75.25))) == "1:15.2"
    for label, kind, act in (("MUTE_BREATH", "BREATH", "mute"), ("CUT_FILLER_SOUND", "FILLER_SOUND", "cut"), ("DEADAIR", "DEADAIR", "cut")):
        assert (one(spark, T.base_type(F.lit(label))), one(spark, T.action(F.lit(label)))) == (kind, act)


def test_queue_position(spark):
    jobs = spark.createDataFrame([("a", "done", 0, 1), ("b", "running", 1, 1), ("c", "queued", 2, 1), ("x", "queued", 3, 1), ("y", "queued", 4, 2)], "id string, status string, seq long, queue int")
    got = {r.id: r.position for r in G.queue_position(jobs, ["queue"]).collect()}
    assert (got["x"], got["y"], got["a"]) == (2, 0, None)
    with pytest.raises(ValueError):
        G.queue_position(jobs, [])


def test_merged_length(spark):
    assert one(spark, edl.length_ok(F.lit(100 * S), F.lit(99.4 * S))) and not one(spark, edl.length_ok(F.lit(100 * S), F.lit(99.2 * S)))


def test_joins_on_time_are_hashed(spark):
    a, b = spans(spark, [(0, 10)]), spans(spark, [(2, 3)])
    plan = I.overlap_join(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_that_cannot_be_planned_are_findings(spark):
    media = spark.createDataFrame([(1,)], "media_id long")
    got = Q.united({"broken": lambda: Q.top_cut(media)}, media).collect()
    assert [(r.kind, r.level) for r in got] == [("qa-error", "warn")]
