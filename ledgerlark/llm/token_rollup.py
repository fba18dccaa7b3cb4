"""Operator 4: token counts kept as additive totals by signed deltas.

A change carries what a document counted before and after it: an insert has no before, a delete no after, a revised
count both.  Changes become signed rows, are summed per key in front of the shuffle, and are committed as one batch.
A batch is visible through a marker file.  The marker is written under another name and then renamed, which fails where
it is there already: committing a batch again changes nothing, and an attempt that dies at any point leaves no marker,
so the batch can be sent again.  Totals are the sum over the committed batches; no document is ever read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

KEY = ("source", "lang", "tokenizer")
WORDS = r"[^\x20\x09-\x0D]+"
MARKS = r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def signed(changes: DataFrame) -> DataFrame:
    """Delta per key from changes (source, lang, tokenizer, before, after); a null before or after means no document.

    Null keys are keys of their own.  A change with neither side adds nothing.  Keys whose sums are all zero are left out.
    """
    docs = F.sum(F.col("after").isNotNull().cast("long") - F.col("before").isNotNull().cast("long"))
    tokens = F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))
    return changes.groupBy(*KEY).agg(docs.alias("d_docs"), tokens.cast("long").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0")


class Rollup:
    """Committed batches of deltas below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def committed(self) -> dict[str, str]:
        """Attempt of each committed batch; markers without an attempt commit nothing."""
        folder = self._at("commits")
        if not self._fs.exists(folder):
            return {}
        out = {}
        for status in self._fs.listStatus(folder):
            if not status.getLen():
                continue
            stream = self._fs.open(status.getPath())
            out[status.getPath().getName()] = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes once; False if the batch is in already, whatever it holds now."""
        if self._is_in(batch):
            return False
        attempt = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/deltas/{batch}/{attempt}")
        return self._mark(batch, attempt)

    def _is_in(self, batch: str) -> bool:
        marker = self._at("commits", batch)
        return bool(self._fs.exists(marker) and self._fs.getFileStatus(marker).getLen())

    def _mark(self, batch: str, attempt: str) -> bool:
        """Make the attempt the batch's own; False if another writer was first."""
        staged, marker = self._at("staged", attempt), self._at("commits", batch)
        stream = self._fs.create(staged, False)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        if self._fs.exists(marker) and not self._is_in(batch):
            self._fs.delete(marker, False)
        self._fs.mkdirs(self._at("commits"))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(staged, marker, options)
        except Exception:
            if self._is_in(batch):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens per key over all committed batches; keys without documents are gone."""
        paths = [f"{self.path}/deltas/{batch}/{attempt}" for batch, attempt in sorted(self.committed().items())]
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its words, its words that hold a letter or digit, its bytes, and a digest of its text.

    Null text counts as empty; other columns than doc_id, source, lang and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", text.alias("text")).select(
        "doc_id", "source", "lang", F.md5("text").alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
        F.regexp_count(F.regexp_replace("text", MARKS, ""), F.lit(WORDS)).cast("long").alias("plain"), F.octet_length("text").cast("long").alias("bytes"),
    )


def _changes(rows: DataFrame, **versions: tuple[Column, Column]) -> DataFrame:
    """Changes of several tokenizer versions per row."""
    each = [F.struct(F.lit(name).alias("tokenizer"), before.cast("long").alias("before"), after.cast("long").alias("after")) for name, (before, after) in versions.items()]
    return rows.select("source", "lang", F.explode(F.array(*each)).alias("v")).select("source", "lang", "v.*")


def maintain(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after three batches over ``docs``: all inserts, a revised word count, and deletes of exact copies.

    The revision counts only words that hold a letter or digit.  Of equal texts the least doc_id stays; rows that
    repeat it stay too, and so do rows without an id.  The second batch is sent twice, as a restarted job would.
    """
    store = Rollup(docs.sparkSession, path or f"{shared_dir(docs.sparkSession)}/rollup-{uuid.uuid4().hex}")
    none = F.lit(None)
    rows = cut(counted(docs), "counted")
    store.commit("1-inserts", _changes(rows, space_words=(none, F.col("words")), utf8_bytes=(none, F.col("bytes"))))
    revised = _changes(rows.where("words <> plain"), space_words=(F.col("words"), F.col("plain")))
    store.commit("2-revised", revised)
    store.commit("2-revised", revised)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = rows.join(first, "digest").where("doc_id <> first")
    store.commit("3-copies", _changes(copies, space_words=(F.col("plain"), none), utf8_bytes=(F.col("bytes"), none)))
    return store.totals()


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH c AS (
  SELECT source, lang, doc_id, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy, strlen(coalesce(text, '')) AS bytes,
         len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'), '[^\x20\x09-\x0D]+')) AS plain
  FROM documents
), v AS (
  SELECT source, lang, 'space_words' AS tokenizer, plain AS n FROM c WHERE NOT coalesce(copy, false)
  UNION ALL
  SELECT source, lang, 'utf8_bytes', bytes FROM c WHERE NOT coalesce(copy, false)
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM v GROUP BY ALL
"""
