"""From raw documents to token counts: judge quality, drop copies, near copies and benchmark leaks, encode.

Every stage works on all rows that the one before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontaminate, exact, near_duplicates, quality
from ledgerlark.llm.common import cut, text_mark

#: Column of the row key while a stage works.
KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key by which stages tell rows apart: doc_id, which may be null or repeated, and the text's hash."""
    mark = F.nullif(text_mark(), F.lit(""))  # never null, but of a type that may be, as operators declare theirs
    return docs.withColumn(KEY, F.struct("doc_id", mark.alias("mark")))


def _by_key(docs: DataFrame) -> DataFrame:
    """The key in place of doc_id, in whose order it is, and the text."""
    return _keyed(docs).select(F.col(KEY).alias("doc_id"), "text")


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` joined (semi or anti) to ``keys`` (doc_id, mark)."""
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"))
    keyed = docs.withColumn(KEY, text_mark())
    return keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["key_id"]) & (keyed[KEY] == keys["key_mark"]), how).drop(KEY)


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on these documents and the labels table."""
    model, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    groups = cut(exact.exact_groups(docs), "groups")
    out = _joined(docs, groups.where("kept"), "left_semi")
    repeated = groups.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    return _keyed(out).dropDuplicates([KEY]).drop(KEY) if repeated else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    groups = near_duplicates.near_duplicates(_by_key(docs))
    return _joined(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select("doc_id.*"), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.contamination(_by_key(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _joined(docs, found.where("contaminated").select("doc_id.*").distinct(), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality classifier", accept),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]
#: No stage but the second is expressible in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
