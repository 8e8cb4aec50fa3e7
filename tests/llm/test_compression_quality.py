"""The compression classifier on rows that it hasn't learned from, and on awkward ones."""

import zlib

import pandas as pd
import pytest

from tidemark.llm import compression_quality as cq


@pytest.mark.parametrize("sf, least_right, most_lost", [("sf0.01", 0.95, 0.03), ("sf0.1", 0.98, 0.01)])
def test_held_out_rows(spark, sf, least_right, most_lost):
    data = f"/root/testdata/{sf}"
    got = cq.op12(spark, data).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{data}/documents.parquet")
    assert sorted(got.index) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.index]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    marks = pd.read_parquet(f"{data}/labels.parquet").set_index("doc_id").quality
    seen = got[got.held_out].join(marks, how="inner")
    assert (seen.predicted == seen.quality).mean() >= least_right
    assert (seen[seen.quality == 1].predicted == 0).mean() <= most_lost
    # calibrated: in all, scores promise as many good rows as there are
    assert abs(seen.score.mean() - seen.quality.mean()) < 0.03


def test_nothing_but_text_counts(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = cq.train(docs, labels)
    held = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert cq.train(docs, held) == model  # labels of held-out rows are never seen
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'x' AS lang", "'y' AS source")
    assert {r.doc_id - 1_000_000: r.score for r in cq.scores(other, model).collect()} == {r.doc_id: r.score for r in cq.scores(docs, model).collect()}


def test_awkward_rows(spark):
    rows = [(None, None), (None, ""), (1, ""), (2, "é" * 9), (2, "same text"), (3, "same text"), (4, "word " * 60_000)]
    docs = spark.createDataFrame([(d, t, 0.5, 1, "a", 7, "b", 3) for d, t in rows], "doc_id long, text string, score double, y int, line string, f int, k string, gain int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (4, 0), (None, 1), (1, 5)], "doc_id long, quality int")
    for marks in (labels, labels.where("false"), labels.where("quality = 0")):
        got = cq.scores(docs, cq.train(docs, marks)).collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(d) for d, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        score = {}
        for r, t in zip(sorted(got, key=lambda r: (r.doc_id or 0)), [t for _, t in sorted(rows, key=lambda x: x[0] or 0)]):
            score.setdefault(t or "", set()).add(r.score)
        assert len(score[""]) == 1
    assert cq.scores(docs.where("false"), cq.train(docs, labels)).count() == 0
    assert cq.scores(docs, cq.train(docs.where("false"), labels)).select("score").distinct().collect()[0][0] == 0.5


def test_training_is_bounded_and_repeatable(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    small = cq.train(docs, labels, sample=150, pieces=500)
    assert small == cq.train(docs.repartition(7), labels.repartition(5), sample=150, pieces=500)
    assert max(len(small.good), len(small.bad)) <= 500 * 4 * cq.PIECE
