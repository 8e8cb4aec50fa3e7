"""Quality classifier by compression: which of two zstandard dictionaries suits a text better.

One dictionary is built from good labelled text, one from bad. A text is compressed in blocks of BLOCK bytes with each;
short blocks keep a text's own repetitions from hiding what a dictionary knows. The difference of the two compressed sizes over the
text's bytes, x = (bad - good) / (bytes + BASE), is high for text like the good one, and near 0 where neither
dictionary matters, as in endless repetition. A logistic curve in x and 1 / (bytes + BASE), so that short texts lean on the
share of good ones, makes it a probability.

Learning sees labelled rows alone, SAMPLE of them at most (by a hash; in expectation), and PIECES pieces of lines for a dictionary. Lines that
both classes have are in neither dictionary. The curve is fitted on texts that their dictionaries haven't seen: rows are
in FOLDS folds by their text, so copies stay together, and each fold is compressed with dictionaries of the others. What the driver
collects is bounded by SAMPLE and PIECES. Scoring covers every row and the whole text, without a shuffle.

Defined results: null and empty texts have no bytes, and one score; without labelled rows of both classes every score is the
share of good ones, or 0.5 without any; labels other than 0 and 1 aren't used; a number with several labels counts once for
each; rows with a null number have no label and are scored like others; equal texts have equal scores; an empty table gives no
rows; columns other than the two named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, text_or_empty

#: Labelled rows and pieces of a class that are learned from at most, bytes of a dictionary.
SAMPLE, PIECES, DICTIONARY = 20_000, 40_000, 112 << 10
#: Bytes of a block, letters of a piece, bytes added to a text's own, folds, compression level.
BLOCK, PIECE, BASE, FOLDS, LEVEL = 256, 256, 64, 4, 1


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text (empty without text to learn from), and the curve's weights."""

    bad: bytes
    good: bytes
    weights: tuple[float, float, float]


def dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary of the pieces; of few ones their last bytes as they are."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **held)


def gain(text: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> int:
    """Bytes by which the good dictionary compresses a text better."""
    total = 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        total += len(bad.compress(block)) - len(good.compress(block))
    return total


def features(gains: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sizes)), gains / (sizes + BASE), BASE / (sizes + BASE)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Logistic weights of the features, by Newton steps with a small penalty."""
    scale = np.append(1.0, x[:, 1:].std(axis=0) + 1e-9)
    a, w, penalty = x / scale, np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _gains(rows: DataFrame, pairs: list[tuple[bytes, bytes]]) -> DataFrame:
    """rows: f (which pair of dictionaries), y, text (binary). y, gain and size of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(_compressor(a), _compressor(b)) for a, b in pairs]
        for batch in batches:
            f, texts = batch.column(0).to_pylist(), batch.column(2)
            gains, sizes = [], []
            for i, k in enumerate(f):
                text = memoryview(texts[i].as_buffer()).tobytes()
                gains.append(gain(text, *made[k]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(gains, pa.int64()), pa.array(sizes, pa.int64())], ["y", "gain", "size"])

    return rows.select("f", "y", "text").mapInArrow(run, "y int, gain long, size long")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, pieces: int = PIECES) -> Model:
    """A model from the labelled rows that aren't held out."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("k"))).distinct()
    n = marks.count()
    some = marks.where(F.pmod(F.xxhash64("k"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, sample / max(1, n))))
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(some, "k")
    rows = stored(rows.select("y", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("f")), "labelled")
    lines = rows.select("y", "f", F.explode(F.split("text", "\n")).alias("line")).distinct()
    own = lines.join(lines.groupBy("line").agg((F.min("y") == F.max("y")).alias("own")).where("own").select("line"), "line")
    starts = F.sequence(F.lit(1), F.greatest(F.length("line"), F.lit(1)), F.lit(PIECE))
    cut = own.select("y", "f", F.explode(F.transform(starts, lambda i: F.substr("line", i, F.lit(PIECE)))).alias("piece")).where(F.length("piece") >= 8).distinct()
    held: dict[int, list[tuple[int, bytes]]] = {}
    for y in (0, 1):
        found = cut.where(F.col("y") == y).orderBy(F.xxhash64("piece"), "piece", "f").limit(pieces).collect()
        held[y] = [(r.f, r.piece.encode()) for r in found]
    mean = rows.agg(F.avg("y")).first()[0]
    if not held[0] or not held[1]:
        share = min(0.999, max(0.001, mean)) if mean is not None else 0.5
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0))
    without = lambda k: tuple(dictionary([p for f, p in held[y] if f != k] or [p for _, p in held[y]]) for y in (0, 1))
    seen = _gains(rows.select("f", "y", F.encode("text", "UTF-8").alias("text")), [without(k) for k in range(FOLDS)]).orderBy("y", "gain", "size").toPandas()  # in one order, so that sums repeat
    bad, good = without(FOLDS)
    return Model(bad, good, fit(features(seen["gain"].to_numpy(), seen["size"].to_numpy()), seen["y"].to_numpy("float64")))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = _compressor(model.bad), _compressor(model.good)
        for batch in batches:
            texts = batch.column(1)
            gains, sizes = np.zeros(len(texts)), np.zeros(len(texts))
            for i in range(len(texts)):
                body = memoryview(texts[i].as_buffer()).tobytes()
                gains[i], sizes[i] = gain(body, bad, good) if model.weights[1] else 0, len(body)
            z = features(gains, sizes) @ np.array(model.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.encode(text_or_empty(text), "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
