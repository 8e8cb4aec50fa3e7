"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt out by ranges of their number. Each task encodes its range, appends the end id
to each document and writes three files: `<part>.bin`, the ids as flat little-endian unsigned
integers (16 bits where the vocabulary allows, else 32), `<part>.off`, the 64-bit offset of each
document in ids plus the end of the last, and `<part>.doc`, the document numbers. Task summaries go to the
`index` table; the start of each part among all ids is a prefix sum over it, in blocks of parts. Readers
memory-map the files, or read them whole where the store can't map.

A task writes under a name of its own attempt and renames at the end, so a repeated task leaves
one complete part. Part names carry the task's partition, whose range stays the same when an
executor is lost.

Defined results: a null or empty text has the end id alone; null document numbers come last;
rows that repeat a document number are written each, in order of their text's digest; an empty
table gives no parts and no rows; columns other than the two named are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import default_path, encoder
from tidemark.llm.common import parts, scratch, table

NO_ID = np.iinfo("int64").max
#: Parts whose bases are summed in one window; its square is above MOST_PARTS, so one window holds the blocks.
BLOCK = 1024
INDEX = "part int, bits int, n_docs long, n_ids long, path string"


def place(uri: str):
    """The file system of a URI and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _put(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, bits: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files below out; returns the index: a row for each part that holds documents."""
    rows = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    order = [F.col("d").asc_nulls_last(), F.xxhash64("t")]
    dealt = rows.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order)
    kind = np.dtype(f"<u{bits // 8}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, enc = task.partitionId(), encoder(tokenizer)
        store, base = place(out)
        name, own = f"{base}/{part:07d}", f"{base}/.{part:07d}-{task.taskAttemptId()}"
        n, docs_in, ends, stream = 0, [], [0], None
        for batch in batches:
            if stream is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{own}.bin")
            for begin in range(0, batch.num_rows, 2000):
                some = batch.slice(begin, 2000)
                ids, stops = enc.encode_batch(some.column(1))
                ids = np.insert(ids, stops[1:], end_id)
                stops = stops[1:] + np.arange(1, len(stops))
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"id {ids.max()} needs more than {bits} bits")
                stream.write(ids.astype(kind).tobytes())
                ends += (n + stops).tolist()
                n += len(ids)
                docs_in += [NO_ID if d is None else d for d in some.column(0).to_pylist()]
        if stream is None:
            return
        stream.close()
        _put(store, f"{own}.off", np.array(ends, "<u8").tobytes())
        _put(store, f"{own}.doc", np.array(docs_in, "<i8").tobytes())
        for end in ("off", "doc", "bin"):
            store.move(f"{own}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], "int32"), "bits": pa.array([bits], "int32"), "n_docs": [len(docs_in)], "n_ids": [n], "path": [f"{out}/{part:07d}"]})

    dealt.mapInArrow(put, INDEX).write.parquet(f"{out}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{out}/index")


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, else read."""
    store, path = place(uri)
    if store.type_name == "local":
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def based(index: DataFrame) -> DataFrame:
    """The index with base: the ids in all parts before. Prefix sums in two levels: over the parts of each
    block of BLOCK, and over the blocks, of which there are at most MOST_PARTS / BLOCK."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = index.withColumns({"_block": F.floor(F.col("part") / BLOCK), "_top": F.floor(F.col("part") / (BLOCK * BLOCK))})
    blocks = rows.groupBy("_top", "_block").agg(F.sum("n_ids").alias("n_ids"))
    blocks = blocks.select("_block", before(Window.partitionBy("_top").orderBy("_block")).alias("_before"))
    within = rows.withColumn("_own", before(Window.partitionBy("_block").orderBy("part")))
    return within.join(blocks, "_block").withColumn("base", F.col("_before") + F.col("_own")).select(*index.columns, "base")


def read(index: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and, by what is asked for, ids or ids_crc32, from the files."""
    spark = index.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, ends = mapped(r["path"] + ".doc", "<i8"), mapped(r["path"] + ".off", "<u8").astype("int64")
                ids = mapped(r["path"] + ".bin", f"<u{r['bits'] // 8}")
                for at in range(0, len(docs), 1000):
                    to = min(len(docs), at + 1000)
                    spans = [ids[ends[i] : ends[i + 1]] for i in range(at, to)]
                    held = pa.array([zlib.crc32(s.astype("<u4")) for s in spans], pa.int64()) if digest else pa.array([s.astype("int32") for s in spans], last[1])
                    d = docs[at:to]
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NO_ID), pa.array(ends[at:to] + r["base"]), pa.array(ends[at + 1 : to + 1] - ends[at:to]), held], ["doc_id", "start", "n_tokens", last[0]])

    schema = f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}"
    return based(index).repartition(n, "part").mapInArrow(get, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "documents"), scratch(spark, "token-files"), default_path())
    return read(index, digest=True)
