"""Each stage against brute force on its own input, and the whole run."""

import pandas as pd

import corpus_pipeline
from tidemark.llm import bpe

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, frames = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs.toPandas())
        assert name == "encoding" or docs.columns == columns
    start, good, single, clean, safe, last = frames
    from test_operators import plain_components, plain_quality

    def passes(t):
        n, chars, symbols, lines, dup, rep = plain_quality(t)
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > 3 * n or 2 * dup > lines or chars > 12 * n or 2 * chars < 5 * n)

    assert set(good.doc_id) == {d for d, t in zip(start.doc_id, start.text) if passes(t)}
    groups = plain_components(list(zip(good.doc_id, good.text)), 80)
    assert set(single.doc_id) == {d for d, (_, c, _) in groups.items() if c == d}
    items = pd.read_parquet(f"{DATA}/benchmark.parquet").text
    assert set(clean.doc_id) == {d for d, t in zip(single.doc_id, single.text) if not any(x in t for x in items)}
    assert set(safe.doc_id) == set(clean.doc_id) and (safe.text.str.len() == safe.n_chars).all()
    e = bpe.encoder(bpe.default_path())
    text = dict(zip(safe.doc_id, safe.text))
    assert all(list(ids) == e.encode(text[d]).tolist() for d, ids in zip(last.doc_id, last.ids))


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows and numbers, near copies without a number, and clashing columns."""
    good = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    texts = [(1, good(1)), (2, good(1) + " end"), (2, good(2)), (2, good(2)), (None, good(2) + " end"), (None, good(3)), (None, good(3)), (3, None), (4, ""), (5, "few words"), (6, good(4) + " " * 5000 + "z" * 30_000), (None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _t string, _w int, n_words int, row string, kept string, _row string, fail_bits int, words string, r int"
    docs = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), "a", 1, 2, "b", "c", "d", 3, "e", 4) for d, t in texts], names)
    left = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        left.append(sorted((repr((r.doc_id, (r.text or "")[:9])) for r in docs.collect())))
    assert left[0] == sorted(repr((d, t[:9])) for d, t in texts if t and len(t.split()) >= 50 and d != 6)  # a word of 30,000 letters is no good
    assert left[1] == left[2] == left[3] == sorted(repr((d, good(k)[:9])) for d, k in ((1, 1), (2, 2), (None, 3)))
    ids = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert sorted(r.n_tokens for r in ids) == sorted(len(bpe.encoder(bpe.default_path()).encode(r.text)) for r in docs.collect())


def test_secrets_are_redacted_whole(spark):
    """What the stage leaves in texts: quoted values with blanks, passwords of URLs and tokens of letters alone are gone."""
    name, stage = corpus_pipeline.STAGES[3]
    assert name == "secrets"
    secrets = ["k9 Vx2q Lm4w Tz8p", "s3cretPassw0rd", "abcDEFghiJKLmnoPQRstu", "qwmzkxjvbnplrtyaskdjfhgqpwoeiruz", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    texts = [f'before password = "{secrets[0]}" after', f"see postgres://user:{secrets[1]}@host/db for it", f"Authorization: Bearer {secrets[2]} sent", f"my key {secrets[3]} ok", f'a token = "{secrets[4]}" b', "a clean text about the secret garden stays as it is", None]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t) if t else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in stage(spark, docs, DATA).collect()}
    marks = ["assigned", "url", "assigned", "assigned", "assigned"]
    assert [got[i].text for i in range(5)] == [t.replace(s, f"<secret:{m}>") for t, s, m in zip(texts, secrets, marks)]
    assert all(got[i].n_chars == len(got[i].text) for i in range(6))
    assert got[5].text == texts[5] and got[6].text is None
