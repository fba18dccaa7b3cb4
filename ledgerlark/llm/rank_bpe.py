"""Operator 12: byte-level BPE by a rank file, encoded by the tiktoken library and decoded to raw bytes.

The library encodes each match of the split pattern separately.  Long texts are first cut at safe boundaries: places
that no match of the pattern can span and at which no look-ahead looks across, so that the parts encode as the whole
does.  Very long runs of white space, on which the library's pattern matcher overflows its stack, are single matches
by the pattern and go to the merges as such.  The rank file is a parameter; the driver reads it, workers build their
tables once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SLICE_ROWS, map_rows, ship, texts

#: Characters that the library encodes at a time; longer texts are cut at the next safe boundary.
PART_CHARS = 1 << 16
#: White space that the library's own pattern reads; longer runs are taken out before.
WHITE_RUN = 1 << 12

_WHITE = r"\t-\r\x20\x85\xA0  -     　"
LONG_WHITE = re.compile(rf"[{_WHITE}]{{{WHITE_RUN},}}")
#: A safe boundary: white space begins, a run of ASCII letters or digits ends, or the last white space before a word.
SAFE = re.compile(
    rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{{-~])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    rf"|(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])"
)


def parts(text: str, size: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """Parts of a text that encode as the whole does, and whether a part is one match of the pattern."""
    at = 0
    for run in LONG_WHITE.finditer(text):
        # In front of a word the run's last character is not part of its match; it may begin the word's.
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _cut(text, at, run.start(), size))
        yield text[run.start() : end], True
        at = end
    yield from ((p, False) for p in _cut(text, at, len(text), size))


def _cut(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        m = SAFE.search(text, at + size, end)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, file: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        self.library = tiktoken.Encoding("rank file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= WHITE_RUN:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part, whole in parts(text):
            ids += self.library._encode_single_piece(part) if whole else self.library.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


_coders: dict[tuple[str, str], Coder] = {}


class Shipped:
    """A rank file on its way to the workers: a few MB, whatever the data."""

    def __init__(self, spark: SparkSession, ranks: str) -> None:
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as f:
            file = f.read()
        self.key = hashlib.sha256(file).hexdigest(), PATTERN
        self.file = spark.sparkContext.broadcast(file)

    def coder(self) -> Coder:
        if self.key not in _coders:
            _coders[self.key] = Coder(self.file.value, self.key[1])
        return _coders[self.key]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """Token ids per row of ``docs``: (doc_id, ids).  Null or empty text has no ids; no rows give no rows."""
    shipped = Shipped(docs.sparkSession, ranks)
    return map_rows(texts(docs), lambda text: (shipped.coder().encode(text),), "ids array<int>")


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """Raw bytes per row of (doc_id, ids), which need not be valid UTF-8; null ids give no bytes."""
    shipped = Shipped(tokens.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [shipped.coder().decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "raw"])

    ship(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, raw binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per row of ``docs``: token count, and digests of its ids and of the bytes decoded from them.

    No special tokens exist; their strings are ordinary text.  Null or empty text has no tokens and the digests of
    the empty string; repeated rows get equal results; texts of any length are encoded whole; no rows give no rows.
    """
    shipped = Shipped(docs.sparkSession, ranks)

    def row(text: str) -> tuple[int, str, str]:
        own = shipped.coder()
        ids = own.encode(text)
        listed = " ".join(map(own.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return map_rows(texts(docs), row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_ranks())
