"""Operator 10: benchmark passages in documents, by winnowing.

Each item window of ten words has six 5-grams; the least of their hashes is its fingerprint.  A passage shared
with a document has the same windows, hence the same fingerprints, so every shared span of ten words meets.
Documents keep only windows whose fingerprint sits in a bitmap of the items' fingerprints (fixed 1 MB, so it may
be shipped whatever the benchmark's size), then join on the fingerprint and extend the hit to the full window,
word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SLICE_ROWS, by_row, cut, gram_hashes, hash_words, null_safe, picked, ship, texts

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
GRAM = 5
BITMAP_BITS = 1 << 23

HITS = "doc_id {id}, n_words long, hits array<struct<print:long,start:int,size:int,words:string>>"


def _words(text: str) -> list[str]:
    return ITEM_WORD.findall(text.encode().lower().decode())  # bytes.lower() knows A-Z alone


def _prints(words: list[str], x: np.ndarray, size: int, window: int, gram: int) -> np.ndarray:
    """Fingerprint of every run of ``size`` words: the least gram hash in it, or for a short item's size the run's own hash."""
    if len(words) < size:
        return np.empty(0, np.int64)
    if size < window:
        return (gram_hashes(x, size) ^ np.uint64(size)).view(np.int64)
    grams = gram_hashes(x, gram)
    return grams[picked(grams, window - gram + 1)].view(np.int64)


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Windows of benchmark items: (item_id, print, size, words); an item of fewer words than a window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = _words(text)
                size = min(window, len(words))
                if size:
                    prints = _prints(words, hash_words(words), size, window, gram).tolist()
                    out += [(p, size, " ".join(words[s : s + size])) for s, p in enumerate(prints)]
                    row += [i] * len(prints)
            if out:
                ids = batch.column("item_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string())))], names=["item_id", "print", "size", "words"])

    ship(items.sparkSession)
    items = items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, print long, size int, words string")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: its words, those inside an occurrence of an item's window, and the items that occur.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case.  Null or empty texts
    have no words and are clean; items without words or id occur nowhere.  Rows are told apart by doc_id and text, so
    different texts under one id, or without id, get results of their own; equal rows get equal ones.  A doc_id that is
    a struct is the caller's own key of a row.  Repeated items count once by item_id.  An empty benchmark leaves all
    clean.  ``items_sha256`` hashes the sorted item ids, joined by commas (of the empty string if there are none).
    """
    if isinstance(docs.schema["doc_id"].dataType, StructType):
        return _contamination(docs, items, window, gram)
    found = _contamination(by_row(docs.select("doc_id", "text")), items, window, gram)
    return found.withColumn("doc_id", F.col("doc_id.doc_id"))


def _contamination(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    windows = cut(item_windows(items, window, gram).distinct(), "items")
    bit = F.pmod(F.col("print"), F.lit(BITMAP_BITS))
    marks = windows.select(bit.alias("bit")).groupBy((F.col("bit") / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for batch in marks.toArrow().to_batches():  # at most one row per byte of the bitmap
        bitmap[batch.column("byte").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint8)
    short = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shipped.value, np.uint8)
        schema = pa.schema([("n", pa.int64()), ("hits", pa.list_(pa.struct([("print", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("words", pa.string())])))])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, counts, hits = batch.slice(at, SLICE_ROWS), [], []
                for text in part.column("text").to_pylist():
                    words = _words(text)
                    x, own = hash_words(words), []
                    for size in [*short, window]:
                        prints = _prints(words, x, size, window, gram)
                        spot = np.mod(prints, BITMAP_BITS)
                        met = np.flatnonzero(marked[spot >> 3] >> (spot & 7) & 1)
                        own += [{"print": p, "start": s, "size": size, "words": " ".join(words[s : s + size])} for s, p in zip(met.tolist(), prints[met].tolist())]
                    counts.append(len(words))
                    hits.append(own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, schema.field("hits").type)], names=["doc_id", "n_words", "hits"])

    scanned = cut(texts(docs).mapInArrow(scan, HITS.format(id=id_type)), "hits")
    met = scanned.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").distinct()
    # Items with the same windows would multiply every hit; the windows of a text are joined once, its ids later.
    texts_of = windows.groupBy("item_id").agg(F.min("words").alias("a"), F.sum(F.xxhash64("words", "size").cast("decimal(38,0)")).alias("b"), F.count("*").alias("c"))
    same = texts_of.groupBy("a", "b", "c").agg(F.min("item_id").alias("kind"))
    kinds = cut(texts_of.join(same, ["a", "b", "c"]).select("item_id", "kind"), "kinds")
    of_kind = windows.join(kinds.where("item_id = kind").select("item_id"), "item_id").withColumnRenamed("item_id", "kind")
    extended = cut(met.join(of_kind, ["print", "size", "words"]).select("doc_id", "start", "size", "kind"), "extended")
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = extended.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    hit = (
        spans.withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
        .groupBy("doc_id").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    )
    found = (
        extended.select("doc_id", "kind").distinct().join(kinds, "kind")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    hit = hit.join(found, null_safe(hit, found, "doc_id")).select(hit["doc_id"], "n_hit", "items")
    return scanned.join(hit, null_safe(scanned, hit, "doc_id"), "left").select(
        scanned["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
