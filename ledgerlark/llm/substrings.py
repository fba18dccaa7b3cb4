"""Operator 7: long repeated word spans, found in a compacted graph of word k-mers.

Edges of the graph are word k-mers that a sliding minimum picks, at least one in every window; an occurrence of
an edge stands for the windows that picked it.  An edge that occurs once is dead.  If all occurrences of an edge
lie in the same words (the union of its windows), the path through it does not branch there: its windows all
repeat, and neighbours of that kind merge into one span per document.  Where paths branch, each distinct
surrounding of the edge writes the 128-bit hashes of its windows from the source coordinates, and only windows
met twice count.  So no position of the corpus is shuffled unless it lies at a branch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, SpanHasher, WORD, by_row, cut, gram_hashes, hash_words, null_safe, picked, texts

WINDOW = 35
K = 8
SETTLED, SHOWN, AWAITED = 0, 1, 2  # all windows repeat; the same, and they are shown to others; to be decided by others

EDGES = "doc_id {id}, edge long, around long, at long"
FIRST = "doc_id {id}, n_words long, n_removed long, kept_sha256 string, text string, spans array<long>, shown array<struct<i:int,a:long,b:long,weight:int,awaited:boolean>>"
LAST = "doc_id {id}, n_words long, n_removed long, kept_sha256 string"


def _edges(words: list[str], window: int, k: int) -> tuple[np.ndarray, ...]:
    """Picked k-mers of one text: hash, hash of the words of all windows that picked it, and first window * 256 + count."""
    x = hash_words(words)
    grams = gram_hashes(x, k)
    place = picked(grams, window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.append(first[1:], len(place))
    a, b = SpanHasher(x).spans(first, end - 1 + window)
    return grams[place[first]].view(np.int64), a ^ (b << 1) ^ (place[first] - first), first * 256 + (end - first)


def _covered(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    if ranges:
        r = np.minimum(np.asarray(ranges, np.int64), n)
        np.add.at(steps, r[:, 0], 1)
        np.add.at(steps, r[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(words: list[str], ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    gone = _covered(len(words), ranges)
    text = " ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
    return len(words), int(gone.sum()), hashlib.sha256(text.encode()).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of ``docs``: words, removed words, and the SHA-256 of the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it starts anywhere else too, in the same text or another.
    Null and empty texts have no words; texts shorter than the window keep all.  A row that is repeated counts as a
    second place, so both lose every window.  Rows are told apart by doc_id and text, so different texts under one id,
    or without id, are judged each by itself.  No rows give no rows.  ``window`` may be up to 255 and must exceed ``k``.
    """
    return _remove_repeats(by_row(docs.select("doc_id", "text")), window, k).withColumn("doc_id", F.col("doc_id.doc_id"))


def _remove_repeats(docs: DataFrame, window: int, k: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found, row = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = WORD.findall(text)
                    if len(words) >= window:
                        found.append(_edges(words, window, k))
                        row.append(np.full(len(found[-1][0]), i))
                if found:
                    ids = part.column("doc_id").take(pa.array(np.concatenate(row)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in zip(*found))], names=["doc_id", "edge", "around", "at"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", batch_id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("spans", pa.list_(pa.int64())),
            ("shown", pa.list_(pa.struct([("i", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("weight", pa.int32()), ("awaited", pa.bool_())]))),
        ])
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                out = [_settle(t, e or (), window) for t, e in zip(part.column("text").to_pylist(), part.column("entries").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), type=f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                out = [
                    _kept(WORD.findall(t), [*zip(s[::2], s[1::2]), *((i, i + window) for i in found or ())])
                    for t, s, found in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "found")))
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c)) for c in zip(*out))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    docs = texts(docs)
    edges = cut(docs.mapInArrow(scan, EDGES.format(id=id_type)), "edges")
    repeated = (
        edges.groupBy("edge").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
        .where("n > 1").select("edge", (F.col("low") == F.col("high")).alias("straight"))
    )
    met = cut(edges.join(repeated, "edge"), "met")
    branching = met.where(~F.col("straight"))
    kinds = branching.groupBy("edge", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("one"))
    decided = branching.join(kinds, ["edge", "around"]).select(
        "doc_id", "at",
        F.when(F.col("n") == 1, AWAITED).when(F.col("one").eqNullSafe(F.struct("doc_id", "at")), SHOWN).otherwise(SETTLED).alias("kind"),
    )
    entries = (
        met.where("straight").select("doc_id", "at", F.lit(SETTLED).alias("kind")).unionByName(decided)
        .groupBy("doc_id").agg(F.collect_list(F.col("at") * 4 + F.col("kind")).alias("entries"))
    )
    joined = docs.join(entries, null_safe(docs, entries, "doc_id"), "left").select(docs["doc_id"], "text", "entries")
    first = cut(joined.mapInArrow(settle, FIRST.format(id=id_type)), "settled")
    shown = first.where("text is not null").select("doc_id", F.explode("shown").alias("w")).select("doc_id", "w.*")
    twice = shown.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight > 1").select("a", "b")
    found = shown.where("awaited").join(twice, ["a", "b"]).groupBy("doc_id").agg(F.collect_set("i").alias("found"))
    waiting = first.where("text is not null").select("doc_id", "text", "spans")
    waiting = waiting.join(found, null_safe(waiting, found, "doc_id"), "left").select(waiting["doc_id"], "text", "spans", "found")
    done = first.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(waiting.mapInArrow(finish, LAST.format(id=id_type)))


def _settle(text: str, entries: list[int], window: int) -> tuple:
    """First verdict on one text: final unless some window waits for, or is shown to, windows elsewhere."""
    words = WORD.findall(text)
    ranges, starts, weights, awaited = [], [], [], []
    for e in sorted(entries):
        kind, first, count = e & 3, (e >> 2) // 256, (e >> 2) % 256
        if kind != AWAITED:
            if ranges and first <= ranges[-1][1] - window + 1:  # the path goes on
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], first + count - 1 + window))
            else:
                ranges.append((first, first + count - 1 + window))
        if kind != SETTLED:
            i = np.arange(first, first + count)
            starts.append(i[i + window <= len(words)])
            weights.append(np.full(len(starts[-1]), 1 if kind == AWAITED else 2))
            awaited.append(np.full(len(starts[-1]), kind == AWAITED))
    if not starts:
        return *_kept(words, ranges), None, None, None
    i = np.concatenate(starts)
    a, b = SpanHasher(hash_words(words)).spans(i, i + window)
    shown = [dict(zip(("i", "a", "b", "weight", "awaited"), row)) for row in zip(*(c.tolist() for c in (i, a, b, np.concatenate(weights), np.concatenate(awaited))))]
    return len(words), None, None, text, [int(v) for r in ranges for v in r], shown


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
