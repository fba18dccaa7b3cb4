"""Shared pieces of the text operators: words, hashes, shared tables, typed Arrow mapping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Runs of anything but ASCII white space; every operator that speaks of words without saying more means these.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of a text column that a task turns into Python strings at a time.
SLICE_ROWS = 256
#: Entries that a worker's word memo holds before it starts afresh.
MEMO_WORDS = 200_000

M64 = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session one made here."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerlark-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that their functions import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped_to:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="ledgerlark-code-"), "ledgerlark_code.zip")
        with zipfile.ZipFile(base, "w") as z:
            for name in ("ledgerlark/__init__.py", *(f"ledgerlark/llm/{f}" for f in os.listdir(os.path.dirname(os.path.abspath(__file__))) if f.endswith(".py"))):
                z.write(os.path.join(root, name), name)
        spark.sparkContext.addPyFile(base)
        _shipped_to.add(app)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """Only the key, the named columns and the text, with null text as empty; other columns cannot clash with results."""
    ship(docs.sparkSession)
    return docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_mark() -> Column:
    """Hash of a row's whole text, null as empty; with doc_id it tells rows apart that share an id or have none."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and a hash of the text as doc_id: rows that share an id, or have none, are told apart by it."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark")))


def map_rows(df: DataFrame, row: Callable[..., tuple], schema: str, keep: str = "doc_id") -> DataFrame:
    """One output row per input row: the kept column and what ``row(text)`` returns, a few hundred texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [row(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(keep), *(pa.array(list(c), type=f) for c, f in zip(zip(*out), types))], names=names)

    key_type = df.schema[keep].dataType.simpleString()
    full = StructType.fromDDL(f"{keep} {key_type}, {schema}")
    arrow = to_arrow_schema(full)
    names, types = arrow.names, list(arrow.types)[1:]
    return df.mapInArrow(run, full)


def null_safe(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of keys under which null equals null."""
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return on


class WordMemo(dict):
    """Word to 64-bit hash, kept per worker and emptied when it has grown to ``MEMO_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


_memo = WordMemo()


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Another 64-bit value for each one, unrelated to it by any sum (the finaliser of a public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (Horner's rule modulo 2**64, then mixed)."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * ODD + x[j : j + n]
    return mixed(h)


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, ODD)]))
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD_INVERSE)]))


class SpanHasher:
    """128-bit hashes of arbitrary word spans of one text in constant time each, from two prefix sums."""

    def __init__(self, x: np.ndarray) -> None:
        _grow(len(x) + 1)
        zero = np.zeros(1, np.uint64)
        self.one = np.concatenate([zero, np.cumsum(mixed(x) * _powers[: len(x)])])
        self.two = np.concatenate([zero, np.cumsum(mixed(x ^ ODD) * _powers[: len(x)])])

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = (end - start).astype(np.uint64)
        a = (self.one[end] - self.one[start]) * _inverse[start]
        b = (self.two[end] - self.two[start]) * _inverse[start]
        return mixed(a + length).view(np.int64), mixed(b ^ length).view(np.int64)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    n = len(v) - w + 1
    if n <= 0:
        return np.empty(0, v.dtype)
    span, cur = 1, v
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = w - span
    return np.minimum(cur[:n], cur[rest : rest + n]) if rest else cur[:n]


def picked(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` grams the place of its least one, the leftmost of equals (winnowing)."""
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    v = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(v, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
