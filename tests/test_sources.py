import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import registry
from tidemark.sources import readers, sinks


def test_probe_json(spark):
    good = json.dumps({"streams": [{"codec_type": "audio", "duration": "9.5"}, {"codec_type": "video", "width": 1920, "height": 1080, "duration": "x", "r_frame_rate": "30000/1001"}], "format": {"duration": "10.0"}})
    raw = spark.createDataFrame([(1, good), (2, "not json"), (3, None)], "media_id long, json string")
    got = {r.media_id: r for r in readers.probes(raw).collect()}
    assert (got[1].w, got[1].h, got[1].duration, round(got[1].fps, 2)) == (1920, 1080, 10.0, 29.97) and got[2].w is None
    s = readers.streams(raw)
    assert [(r.codec_type, r.duration) for r in s.collect()] == [("audio", 9.5)]
    assert [r.media_id for r in readers.has_audio(raw.select("media_id"), s).collect()] == [1]


def test_tab_separated_labels(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("0.5\t1.0\tMUTE_BREATH\nshort\tline\n2\t3\tDEADAIR\nx\ty\tz\n")
    got = sorted((r.start, r.end, r.type, r.action) for r in readers.disfluencies(spark, str(tmp_path)).collect())
    assert got == [(0.5, 1.0, "BREATH", "mute"), (2.0, 3.0, "DEADAIR", "cut")]


def test_silence_log(spark):
    log = "[a] silence_start: 1.5\n[a] silence_end: 2.5 | x\n[a] silence_start: 8"
    got = readers.silences(spark.createDataFrame([(1, log, 10.0)], "media_id long, log string, duration double")).collect()
    assert sorted((r.start_us, r.end_us) for r in got) == [(1_500_000, 2_500_000), (8_000_000, 10_000_000)]


def test_signatures(spark):
    lines = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b")], "media_id long, line string")
    assert len({r.signature for r in readers.signatures(lines).collect()}) == 1


def test_outputs(spark, tmp_path):
    for name in ("j1/out/a.mp4", "j1/out/a.orig.mp4", "j2/in/b.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [(r.folder, r.length) for r in readers.outputs(spark, str(tmp_path)).collect()] == [("j1", 1)]


def test_paged_listing(spark):
    class Two(readers.PagedListing):
        @staticmethod
        def page(folder, token):
            return ([(f"{folder}{token or 0}", "n", "video/mp4")], "1" if token is None else None)

    spark.dataSource.register(Two)
    got = spark.read.format("paged_listing").option("folders", "a,b").load().collect()
    assert sorted((r.id, r.parent) for r in got) == [("a0", "a"), ("a1", "a"), ("b0", "b"), ("b1", "b")]


def test_feedback_and_review(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", "x", 0.5, i % 2 == 0) for i in range(7)] + [(" ", "x", 0.1, True)], "text string, type string, confidence double, approved boolean")
    sinks.append_feedback(rows, str(tmp_path / "f"))
    assert sinks.compact_feedback(spark, str(tmp_path / "f"), str(tmp_path / "g"), 5).count() == 5
    c = spark.createDataFrame([(1, 1_250_000, 2_000_000, "x", 0.7, "cut", "keep")], "media_id long, start_us long, end_us long, type string, confidence double, text string, keep_text string")
    sinks.write_review(c, str(tmp_path / "r"))
    assert [(r.start, r.approve, r.cut_text) for r in sinks.read_review(spark, str(tmp_path / "r")).collect()] == [(1.25, False, "cut")]


def test_sample_times(spark):
    m = spark.createDataFrame([(1, 10.0)], "media_id long, duration double")
    assert [r.t for r in readers.sample_times(m, 2).orderBy("i").collect()] == [2.5, 7.5]
    assert [r.t for r in readers.sample_times(m, 4, "inner").orderBy("i").collect()] == [2.0, 4.0, 6.0, 8.0]


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1}, {"id": "y", "n": null}]')
    (tmp_path / "b.json").write_text("no json at all {")
    read = lambda name: sorted((r.id, r.n) for r in readers.json_table(spark, str(tmp_path / name), "id string, n long").collect())
    assert read("a.json") == [("x", 1), ("y", None)]
    assert read("b.json") == [] and read("missing.json") == []


def test_listing_and_names(spark, tmp_path):
    for name in ("b.mp4", "a.mp4", "skip.mp4", "c.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in readers.listing(spark, str(tmp_path), but="skip.mp4").collect()] == ["a.mp4", "b.mp4"]
    df = spark.createDataFrame([("A.MOV", None), ("a.txt", "video/mp4"), ("a.txt", None), ("x.mp4.bak", "text/plain")], "name string, mime string")
    assert [r.v for r in df.select(readers.is_video(F.col("name"), F.col("mime")).alias("v")).collect()] == [True, True, False, False]
    names = spark.createDataFrame([("a/b: c?é_1",), ("?!",)], "n string")
    assert [r.s for r in names.select(T.safe_name(F.col("n"), "clip").alias("s")).collect()] == ["ab cé_1", "clip"]
    urls = spark.createDataFrame([("https://x.example/file/d/AbC-1_2/view",), ("https://x.example/drive/folders/Zz9?usp=1",), ("https://x.example/open?a=1&id=Q7",), ("https://x.example/",)], "u string")
    assert [r.i for r in urls.select(T.link_id(F.col("u")).alias("i")).collect()] == ["AbC-1_2", "Zz9", "Q7", None]
    words = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.g for r in words.select(T.ngrams(F.col("w"), 2).alias("g")).collect()] == [["a b", "b c"], [], []]


def test_registry_files(spark, tmp_path):
    disk = spark.createDataFrame([("a", "done", "render"), ("b", "queued", "render")], "id string, status string, kind string")
    memory = spark.createDataFrame([("b", "running", "render"), ("c", "queued", "edit")], "id string, status string, kind string")
    sinks.save_registry(disk, memory, str(tmp_path / "reg"))
    assert {(r.id, r.status) for r in spark.read.parquet(str(tmp_path / "reg")).collect()} == {("a", "done"), ("b", "running"), ("c", "queued")}
    sinks.write_sidecars(spark.createDataFrame([(1, "x"), (2, "y")], "job_id long, title string"), str(tmp_path / "side"))
    assert {(r.job_id, r.title) for r in spark.read.json(str(tmp_path / "side")).collect()} == {(1, "x"), (2, "y")}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "cache_key string")
    assert {r.cache_key for r in sinks.uncached(keys("p", "q", "r"), keys("q", "q")).collect()} == {"p", "r"}
    entries = spark.createDataFrame([(3, "n", "f"), (2, "n", "f"), (1, "it's", "f"), (4, "n", "g")], "id long, name string, parent string")
    wanted = spark.createDataFrame([("f", "n"), ("f", "it's"), ("g", "none")], "parent string, name string")
    assert {(r.parent, r.name, r.id) for r in registry.find_in_folder(entries, wanted).collect()} == {("f", "n", 2), ("f", "it's", 1)}
    asked = spark.createDataFrame([(1, True), (2, False)], "request_id long, ok boolean")
    assert registry.require(asked.where("ok")).count() == 1
    with pytest.raises(Exception, match="a part is not finished: 2"):
        registry.require(asked).collect()


def test_specs_are_nested_both_ways(spark, tmp_path):
    cut = "array<struct<start: double, end: double>>"
    rows = [("a", (1.0, None), [(2.0, 3.0), (4.0, 5.5)], True, "It's \"x\""), ("b", None, None, None, None), ("c", (0.0, 9.0), [], False, "é")]
    specs = spark.createDataFrame(rows, f"job_id string, trim struct<start: double, end: double>, cuts {cut}, mute_original boolean, title string")
    sinks.write_specs(specs, str(tmp_path / "specs"))
    got = {r.job_id: r.spec for r in sinks.read_specs(spark, str(tmp_path / "specs")).collect()}
    assert (got["a"].trim.start, got["a"].trim.end, [tuple(c) for c in got["a"].cuts], got["a"].mute_original, got["a"].title) == (1.0, None, [(2.0, 3.0), (4.0, 5.5)], True, 'It\'s "x"')
    assert got["a"].texts is None and (got["b"] is None or got["b"].cuts is None) and got["c"].cuts == [] and got["c"].mute_original is False
    text = spark.createDataFrame([('{"cuts": [{"start": 1}], "texts": [{"text": "t", "size": 9}]}',), ("no json",), (None,)], "t string").select(sinks.parsed_spec(F.col("t")).alias("s")).collect()
    assert text[0].s.cuts[0].start == 1.0 and text[0].s.texts[0].size == 9 and (text[1].s is None or text[1].s.cuts is None) and text[2].s is None
