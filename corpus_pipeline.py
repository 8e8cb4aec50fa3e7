"""A corpus pipeline of training-data operators over documents.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's docs. All but the last
return the columns of documents.

Defined results: each stage's are those of its operator; a row with a null or repeated document
number passes or goes like others. Of near duplicates the row of the smallest number stays (a null number comes last; of
equal numbers the smaller key of the text), and of rows equal in number and text one; texts without words all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, near_dup, quality_rules, secret_scan
from tidemark.llm.common import row_key, scratch, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")  # so that no column's name meets the ledger's
    return quality_rules.kept(quality_rules.ledger(packed, carry=("doc",))).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    found = near_dup.near_duplicates(docs, percent=80).where("group_id IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    # as a table of its own, so that the join on a large group can be split
    first = stored(found.groupBy("group_id").agg(F.min(place).alias("f"), F.count("*").alias("k")).where("k > 1"), "group-firsts")
    gone = found.join(first, "group_id").where(place != F.col("f")).select(F.col("row").alias("__gone")).distinct()
    rows = docs.withColumn("__row", row_key()).join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    # of rows that repeat number and text one stays, whichever; keys alone are counted, so that a row repeated without end gathers nowhere
    twice = found.groupBy("row").agg(F.count("*").alias("k")).where("k > 1").select(F.col("row").alias("__twice"))
    rows = rows.join(twice, F.col("__row") == F.col("__twice"), "left")
    alone = rows.where("__twice IS NULL").select(*docs.columns)
    again = rows.where("__twice IS NOT NULL").select(F.struct(*docs.columns).alias("__doc"), "__row").groupBy("__row").agg(F.first("__doc").alias("__doc"))
    return alone.unionByName(again.select("__doc.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted and n_chars counted anew."""
    forest = secret_scan.train(spark)
    clean = secret_scan.redact(docs, forest, bpe.default_path())
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each document; the ids decode to the document's tokens."""
    rows = bpe.encode(docs, bpe.default_path(), carry=("doc_id", "lang", "source"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Connected components, forests and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
