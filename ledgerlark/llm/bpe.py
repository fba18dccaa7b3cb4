"""Operator 2: byte-pair encoding and decoding over a rank array.

A word is a row of symbols and, beside it, the ranks of its adjacent pairs.  The least rank is found by a scan, its
boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank.  Words too long for
scans to pay use a heap with the same order (rank, then place).  The vocabulary file is a parameter; the driver
reads it and ships its bytes, workers build the tables once.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_rows, texts

NO_RANK = 1 << 30
#: Symbols up to which a word is merged by scanning.
SHORT_WORD = 96
#: Chunks whose ids a worker remembers before it starts afresh.
MEMO_CHUNKS = 250_000
#: Pieces of chunks that it remembers besides.
MEMO_PIECES = 350_000

#: White space, and how text is split before merging.
WHITE = regex.compile(r"[\t-\r\x20\x85\xA0  -     　]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xA0  -     　\p{L}\p{N}]+")
#: Lower case of letters that Python's own tables do not know yet.
YOUNG_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
YOUNG_CASE |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Characters that the tokenizer's tables do not know as letters or digits.
YOUNG = regex.compile(
    r"["
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
    r"]"
)
UNKNOWN = "\ue000"  # stands for them
ODD_SPLITS = regex.compile(r"[\x1C-\x1F]")  # str.split() takes these for white space, the tokenizer does not


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a mapping it holds the ids of white-space separated chunks."""

    def __init__(self, file: bytes) -> None:
        super().__init__()
        spec = json.loads(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in itertools.chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + end] for c in byte_symbols()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.pieces: dict[str, tuple[int, ...]] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(chunk) if self.cut and "<" in chunk else ():
            ids += self._plain(chunk[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        ids += self._plain(chunk[at:])
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        if len(chunk) > 256:
            return tuple(ids)
        kept = self[chunk] = tuple(ids)
        return kept

    def _plain(self, text: str) -> list[int]:
        """Ids of a chunk without special tokens; it holds no white space, and pieces without case come from a memo too."""
        if text.isascii():
            shape = text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(YOUNG_CASE)  # by character: no final sigma
            shape = YOUNG.sub(UNKNOWN, text)
        out: list[int] = []
        for m in PIECE.finditer(shape):
            piece = text if m.end() - m.start() == len(text) else text[m.start() : m.end()]
            ids = self.pieces.get(piece)
            if ids is None:
                raw = piece.encode()
                ids = [self.inner[b] for b in raw[:-1]]
                ids.append(self.last[raw[-1]])
                ids = self.merge(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids)
                if len(piece) <= 64:
                    if len(self.pieces) >= MEMO_PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = tuple(ids)
            out += ids
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Symbols of a word after all merges, by scans of the rank array."""
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in itertools.pairwise(ids)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words: places keep their neighbours, a heap orders pairs by rank and place."""
        rank, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank(ids[i] << 20 | ids[j], NO_RANK) != r:
                continue  # one of the two has changed since
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank(ids[i] << 20 | ids[after[i]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank(ids[before[i]] << 20 | ids[i], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (s, before[i]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        chunks = WHITE.split(text) if ODD_SPLITS.search(text) else text.split()
        return list(itertools.chain.from_iterable(map(self.__getitem__, chunks)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; this vocabulary has no decoder of its own, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


_codecs: dict[bytes, Codec] = {}


def codec(file: bytes) -> Codec:
    """The worker's codec of a vocabulary file; a bytes object keeps its hash, so only the first text pays for it."""
    if file not in _codecs:
        _codecs[file] = Codec(file)
    return _codecs[file]


def _shipped(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the data


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids per row of ``docs``: (doc_id, ids).  Null or empty text has no ids; no rows give no rows."""
    file = _shipped(docs.sparkSession, vocabulary)
    return map_rows(texts(docs), lambda text: (codec(file.value).encode(text),), "ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """Text per row of (doc_id, ids), special tokens included; null ids give an empty text."""
    file = _shipped(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [codec(file.value).decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: token count, and digests of its ids and of the text decoded from them.

    Encoding adds no special tokens, but their strings in a text are those tokens.  Null or empty text has no tokens
    and the digests of the empty string; repeated rows get equal results; no rows give no rows.
    """
    file = _shipped(docs.sparkSession, vocabulary)

    def row(text: str) -> tuple[int, str, str]:
        own = codec(file.value)
        ids = own.encode(text)
        listed = " ".join(map(own.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    return map_rows(texts(docs), row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
