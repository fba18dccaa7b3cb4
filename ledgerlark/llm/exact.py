"""Operator 8: exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass writes a narrow probe per row; the second reads full content only of rows whose length and prefix
another row shares.  Counts are partial aggregates and the way back is an equi-join, which Spark splits when one
length holds most rows; no group is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, null_safe, ship, text_mark

WHITE = b" \t\n\x0b\x0c\r"
PREFIX_BYTES = 256


def _bytes(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text_mark().alias("mark"), F.length(text).alias("n_chars"), text.cast("binary").alias("raw"))


def exact_groups(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: the row of its group that stays, the group's size, and whether this row stays.

    Texts are equal if they are identical without white space.  The row with most code points stays, then the least
    doc_id (null before all).  Null text is empty text, and all such rows form one group.  A repeated row (same
    doc_id, same text) counts in the size, and one of its copies is marked kept.  Rows of one doc_id, or of none, with
    different texts are different rows: ``mark``, the hash of the text, tells them apart.  ``digest`` adds ``text_sha256``, which the first pass computes for the caller; grouping
    does not use it.  No rows give no rows.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = [v.as_py().translate(None, WHITE) for v in batch.column("raw")]
            columns = {
                "doc_id": batch.column("doc_id"),
                "mark": batch.column("mark"),
                "n_chars": batch.column("n_chars"),
                "size": pa.array([len(v) for v in bare], pa.int64()),
                "prefix": pa.array([xxhash.xxh64_intdigest(v[:PREFIX_BYTES]) - (1 << 63) for v in bare], pa.int64()),
            }
            if digest:
                columns["text_sha256"] = pa.array([hashlib.sha256(v).hexdigest() for v in bare], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([hashlib.sha256(v.as_py().translate(None, WHITE)).digest() for v in batch.column("raw")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "mark", "n_chars", "size", "prefix")), hashes], names=["doc_id", "mark", "n_chars", "size", "prefix", "whole"])

    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark string, n_chars int, size long, prefix long"
    rows = _bytes(docs)
    probes = cut(rows.mapInArrow(probe, key + (", text_sha256 string" if digest else "")), "probes")
    narrow = probes.select("doc_id", "mark", "size", "prefix")
    by_size = narrow.join(narrow.groupBy("size").count().where("count > 1").select("size"), "size")
    shared = by_size.groupBy("size", "prefix").count().where("count > 1").select("size", "prefix")
    left = by_size.join(shared, ["size", "prefix"]).groupBy("doc_id", "mark").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    survivors = rows.join(left, null_safe(rows, left, "doc_id", "mark")).select(rows["doc_id"], rows["mark"], "n_chars", "raw", "size", "prefix")
    hashed = cut(survivors.mapInArrow(full, key + ", whole binary"), "hashed")
    groups = (
        hashed.groupBy("size", "whole")
        .agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("least"), F.col("doc_id"), F.col("mark"))).alias("stays"))
        .where("group_size > 1")
        .select("size", "whole", "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.mark").alias("keep_mark"))
    )
    named = hashed.join(groups, ["size", "whole"]).groupBy("doc_id", "mark").agg(*(F.first(c).alias(c) for c in ("group_size", "keep_id", "keep_mark")), F.lit(True).alias("grouped"))
    out = probes.join(named, null_safe(probes, named, "doc_id", "mark"), "left").select(
        probes["doc_id"],
        probes["mark"],
        F.coalesce("keep_mark", probes["mark"]).alias("keep_mark"),
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(probes["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        *(["text_sha256"] if digest else []),
    )
    turn = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    return out.withColumn("kept", stays & (turn == 1)).drop("keep_mark")


def op8_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM n
"""
