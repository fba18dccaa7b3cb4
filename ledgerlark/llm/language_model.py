"""Operator 6: documents scored by prediction by partial matching over bytes, beside a smoothed unigram score.

The model is a trie of byte contexts up to ``ORDER``: a node's count of a symbol is how often the symbol followed
those bytes in training texts.  A symbol unseen in a context costs an escape, estimated from the number of distinct
symbols there (method C), and shorter contexts exclude the symbols of the longer one.  Code lengths depend only on
the ORDER+1 bytes up to a symbol, so one table of distinct grams holds them all; it is computed by joins between
the levels of the trie.  Documents are dealt into blocks of bounded bytes; a block asks for its distinct grams and
words only, and gets their figures back, so neither the trie nor the counts ever meet in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WORD, cut, hash_words, texts

ORDER = 4
BLOCK_BYTES = 8 << 20
#: Bytes of text that are cut into grams at a time.
PIECE_BYTES = 1 << 20
START, END, SYMBOLS = 0xFE, 0xFF, 257  # neither byte occurs in UTF-8; symbols are 256 bytes and the end
END_WORD = "\n"  # no word holds white space
ALPHA = 0.1

ASKED = "block int, bucket int, gram long, n long, words binary, counts binary"
SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pieces(table: pa.Table):
    """Rows of a block as (rows, lower-case texts), about ``PIECE_BYTES`` at a time."""
    at, own, size = 0, [], 0
    for batch in table.select(["text"]).to_batches(max_chunksize=SLICE_ROWS):
        for text in batch.column(0).to_pylist():
            own.append(text.encode().lower())
            size += len(own[-1])
            if size >= PIECE_BYTES:
                yield at, own
                at, own, size = at + len(own), [], 0
    if own:
        yield at, own


def _grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all symbols of some texts, and where each text's grams start."""
    pad, end = bytes([START]) * ORDER, bytes([END])
    b = np.frombuffer(b"".join(pad + t + end for t in raw), np.uint8).astype(np.int64)
    g = np.zeros(len(b) - ORDER, np.int64)
    for j in range(ORDER + 1):
        g = g << 8 | b[j : len(b) - ORDER + j]
    sizes = np.array([len(t) + 1 for t in raw])
    return g[b[ORDER:] != START], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _ask(buckets: int):
    """What a block needs to know: its distinct grams, and its distinct words dealt into buckets, with training counts."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        held = np.array(table.column("held_out").to_pylist(), bool)
        words = Counter({END_WORD: int((~held).sum())})
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, raw in _pieces(table):
            for train in (True, False):
                own = [t for t, h in zip(raw, held[at : at + len(raw)]) if h != train]
                if not own:
                    continue
                k, n = np.unique(_grams(own)[0], return_counts=True)
                keys.append(k)
                counts.append(n if train else np.zeros_like(n))
                for t in own:
                    found = WORD.findall(t.decode())
                    if train:
                        words.update(found)
                    else:
                        for w in found:
                            if w not in words:
                                words[w] = 0
            if len(keys) > 16:
                keys, counts = ([x] for x in _merge(keys, counts))
        k, n = _merge(keys, counts)
        listed = list(words)
        totals = np.fromiter(words.values(), np.int64, len(listed))
        bucket = (hash_words(listed) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        packed = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        m = len(packed)
        return pa.table({
            "block": pa.array([block] * (len(k) + m), pa.int32()),
            "bucket": pa.array([None] * len(k) + [int(bucket[p[0]]) for p in packed], pa.int32()),
            "gram": pa.concat_arrays([pa.array(k, pa.int64()), pa.nulls(m, pa.int64())]),
            "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(m, pa.int64())]),
            "words": pa.array([None] * len(k) + [" ".join([listed[i] for i in p]).encode() for p in packed], pa.binary()),
            "counts": pa.array([None] * len(k) + [totals[p].tobytes() for p in packed], pa.binary()),
        })

    return run


def _total(table: pa.Table) -> pa.Table:
    """Corpus counts of the words of one bucket, in the order in which each block asked for them; then their sum and number."""
    asked = [(b, w.decode().split(" "), np.frombuffer(c, np.int64)) for b, w, c in zip(*(table.column(x).to_pylist() for x in ("block", "words", "counts")))]
    totals: dict[str, int] = {}
    for _, words, counts in asked:
        for w, n in zip(words, counts.tolist()):
            totals[w] = totals.get(w, 0) + n
    return pa.table({
        "block": pa.array([b for b, _, _ in asked] + [None], pa.int32()),
        "words": pa.array([*table.column("words").to_pylist(), None], pa.binary()),
        "counts": pa.array([np.fromiter(map(totals.__getitem__, words), np.int64, len(words)).tobytes() for _, words, _ in asked] + [None], pa.binary()),
        "tokens": pa.array([None] * len(asked) + [sum(totals.values())], pa.int64()),
        "distinct": pa.array([None] * len(asked) + [sum(n > 0 for n in totals.values())], pa.int64()),
    })


def code_lengths(grams: DataFrame) -> DataFrame:
    """log10 probability of each distinct gram from (gram, n): n is its training count, 0 for grams only asked for."""
    levels = {ORDER: grams.where("n > 0")}
    for k in range(ORDER - 1, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))
    # Per context: its count, its distinct symbols, and what those symbols count for in the next shorter context.
    nodes = {}
    for k in range(ORDER, -1, -1):
        own = levels[k].withColumn("context", F.shiftright("gram", 8))
        if k:
            low = levels[k - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("low"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(low, "suffix")
        else:
            own = own.withColumn("low", F.lit(0))
        nodes[k] = own.groupBy("context").agg(F.sum("n").alias("count"), F.count("*").alias("kinds"), F.sum("low").alias("hidden"))
    left = grams.select("gram", F.lit(0.0).alias("lp"), F.lit(0).alias("hidden"), F.lit(0).alias("known"))
    done = []
    for k in range(ORDER, -1, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        met = levels[k].select(F.col("gram").alias("own"), F.col("n").alias("hit"))
        node = nodes[k].select("context", "count", "kinds", F.col("hidden").alias("below"))
        step = left.withColumn("own", low).withColumn("context", F.shiftright("own", 8)).join(met, "own", "left").join(node, "context", "left")
        count, kinds = F.col("count") - F.col("hidden"), F.col("kinds") - F.col("known")
        step = cut(step.select(
            "gram", "hit", (F.col("lp") + F.when(F.col("hit").isNotNull(), F.log10(F.col("hit") / (count + kinds))).when(kinds > 0, F.log10(kinds / (count + kinds))).otherwise(0.0)).alias("lp"),
            F.coalesce("below", F.lit(0)).alias("hidden"), F.coalesce("kinds", F.lit(0)).alias("known"),
        ), f"level{k}")
        done.append(step.where("hit is not null").select("gram", "lp"))
        left = step.where("hit is null").drop("hit")
    done.append(left.select("gram", (F.col("lp") - F.log10(F.lit(float(SYMBOLS)) - F.col("known"))).alias("lp")))
    return reduce(DataFrame.unionByName, done)


def _score(tokens: int, distinct: int):
    """Scores of a block's documents from the figures of its grams and words."""
    floor = math.log10(tokens + ALPHA * (distinct + 1))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = told.filter(pc.is_valid(told.column("gram")))
        keys, lps = known.column("gram").to_numpy(), known.column("lp").to_numpy()
        order = np.argsort(keys)
        keys, lps = keys[order], lps[order]
        named, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        packed = told.filter(pc.is_valid(told.column("words"))).select(["words", "counts"])
        del told, known
        for row in packed.to_batches(max_chunksize=1):
            w, c = row.column(0)[0].as_py(), row.column(1)[0].as_py()
            named.append(hash_words(w.decode().split(" ")))
            counts.append(np.frombuffer(c, np.int64))
        del packed
        named, counts = np.concatenate(named), np.concatenate(counts).astype(float)
        order = np.argsort(named)
        named, counts = named[order], counts[order]
        n_tokens, n_known, base, score = [], [], [], []
        for _, raw in _pieces(docs):
            g, first = _grams(raw)
            score += np.add.reduceat(lps[np.searchsorted(keys, g)], first).tolist()
            for t in raw:
                c = counts[np.searchsorted(named, hash_words([*WORD.findall(t.decode()), END_WORD]))]
                n_tokens.append(len(c))
                n_known.append(int(np.count_nonzero(c)))
                base.append(float(np.log10(c + ALPHA).sum() - floor * len(c)))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: tokens, known tokens, the smoothed unigram score, and the model's log10 probability.

    Rows whose crc32 of doc_id (as text, null as empty) is divisible by ten are held out; all others train, a
    repeated row as often as it stands there.  Texts are read with A-Z in lower case, in whole, followed by an end
    symbol (bytes) or end token (words); null text is empty text and holds just that end.  Both scores are log10.
    With no training rows every byte costs log10 257.  No rows give no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = texts(docs).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = cut(dealt.groupBy("block").applyInArrow(_ask(4 * blocks), ASKED), "asked")
    grams = asked.where("bucket is null").select("block", "gram", "n")
    lengths = code_lengths(cut(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams"))
    words = asked.where("bucket is not null").select("block", "bucket", "words", "counts")
    totals = cut(words.groupBy("bucket").applyInArrow(_total, "block int, words binary, counts binary, tokens long, distinct long"), "totals")
    sums = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = grams.join(lengths, "gram").select("block", "gram", "lp", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("counts"))
    told = told.unionByName(totals.where("words is not null").select("block", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("lp"), "words", "counts"))
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(int(sums[0]), int(sums[1])), SCORED.format(id=id_type))
    return scored.withColumn("train_tokens", F.lit(int(sums[0])).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
