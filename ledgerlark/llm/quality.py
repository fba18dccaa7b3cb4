"""Operator 5: a quality classifier without hand labels as its base.

Overlapping heuristics vote on each text whether it is junk, and whether it is abusive, or abstain.  Expectation
maximisation over the counts of vote patterns of all texts (their number is bounded by the heuristics, not by the
data) estimates how often each heuristic is right.  The posteriors label a bounded sample of texts, gold labels
replace them where the labels table has some, and two linear scorers over hashed words and style figures are
trained on it.  The scorers then judge every text.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, ship, texts

#: The bound on the texts that train the scorers; they are those of least hashed doc_id.
SAMPLE_ROWS = 8000
BITS = 18
ROUNDS = 80
PENALTY = 3e-4
#: Hashed words need to stand in this many sampled texts to get a weight.
LEAST_TEXTS = 3
REJECT = 0.4
STYLES = 10
STEM = 5

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SYMBOLS = b"%&*$#@^~<>{}[]=+\\/_"
LETTERS = re.compile(r"[^\W\d_]+")
#: Two word lists of abuse, from different views, so that they vote apart.
PERSONS = frozenset("idiot idiots moron morons stupid loser losers clown clowns fool dumb imbecile jerk creep".split())
CONTEMPT = frozenset("trash scum worthless pathetic disgusting garbage filthy useless disgrace".split())

JUNK = ("repeats", "monotony", "shouting", "exclamation", "symbols", "bars", "letters")
ABUSE = ("persons", "contempt", "rate", "pair")


def style(text: str) -> tuple[np.ndarray, list[str]]:
    """Style figures between 0 and 1, and the words in lower case."""
    raw, parts = text.encode(), text.split()
    n = max(1, len(parts))
    solid = max(1, len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    upper, lower = (len(raw) - len(raw.translate(None, c)) for c in (UPPER, LOWER))
    words = LETTERS.findall(text.lower())
    own = set(words)
    figures = (
        sum(map(operator.eq, parts, parts[1:])) / n,
        1 - len(own) / max(1, len(words)) if len(words) >= 20 else 0.0,
        upper / max(1, upper + lower),
        min(1.0, raw.count(b"!") / n),
        (len(raw) - len(raw.translate(None, SYMBOLS))) / solid,
        parts.count("|") / n,
        min(1.0, sum(map(len, words)) / max(1, len(text) - text.count(" ") - text.count("\n"))),
        min(1.0, len(parts) / 50),
        min(1.0, len(own & PERSONS) / 3),
        min(1.0, len(own & CONTEMPT) / 3),
    )
    return np.array(figures), words


def _vote(value: float, fine: float, bad: float) -> int:
    return 2 if value >= bad else 0 if value <= fine else 1


def votes(text: str, seen: tuple | None = None) -> tuple[int, int]:
    """Votes on junk and on abuse as base-3 codes: 0 fine, 1 abstains, 2 bad."""
    f, words = seen or style(text)
    junk = (
        _vote(f[0], 0.05, 0.25), _vote(f[1], 0.6, 0.93), _vote(f[2], 0.2, 0.4), _vote(f[3], 0.05, 0.3), _vote(f[4], 0.01, 0.06), _vote(f[5], 0.02, 0.15),
        _vote(1 - f[6], 0.12, 0.3),
    )
    own = set(words)
    persons, contempt = len(own & PERSONS), len(own & CONTEMPT)
    hits = sum(w in PERSONS or w in CONTEMPT for w in words) if persons or contempt else 0
    abuse = (2 if persons else 0, 2 if contempt else 0, _vote(hits / max(1, len(words)), 0.0, 0.01), 2 if persons + contempt >= 2 else 1 if hits else 0)
    return sum(v * 3**i for i, v in enumerate(junk)), sum(v * 3**i for i, v in enumerate(abuse))


def learn_votes(codes: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of "bad" per vote pattern, and each voter's accuracy, by expectation maximisation.

    The start is the share of votes for "bad", and every voter begins with a few imagined votes that agree with it,
    so that silent voters stay harmless.
    """
    v = codes[:, None] // 3 ** np.arange(voters) % 3
    weight = counts.astype(float)
    post = np.clip((v == 2).sum(1) / np.maximum(1, (v != 1).sum(1)), 0.02, 0.98)
    accuracy = np.ones(voters)
    for _ in range(rounds):
        prior = (post @ weight + 1) / (weight.sum() + 2)
        logit = np.full(len(codes), math.log(prior / (1 - prior)))
        for j in range(voters):
            table = np.array([[((p * weight)[v[:, j] == k]).sum() for k in range(3)] for p in (1 - post, post)])
            table = table + np.array([[6.0, 2.0, 0.5], [0.5, 2.0, 6.0]])
            table /= table.sum(1, keepdims=True)
            logit += np.log(table[1] / table[0])[v[:, j]]
            fine, bad = (1 - prior) * table[0], prior * table[1]
            accuracy[j] = (fine[0] + bad[2]) / (fine[0] + bad[0] + fine[2] + bad[2])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(codes.tolist(), post.tolist())), accuracy


class _Features(dict):
    """Hashed places of a distinct word and, if it is long, of its stem, so that a stem counts its words; kept per worker."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        forms = (word, "^" + word[:STEM]) if len(word) > STEM else (word,)
        value = self[word] = tuple(xxhash.xxh64_intdigest(f.encode()) & ((1 << BITS) - 1) for f in forms)
        return value


_features = _Features()


def features(text: str, seen: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    figures, words = seen or style(text)
    return np.array(sorted(itertools.chain.from_iterable(map(_features.__getitem__, set(words)))), np.int32), figures


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of hashed words, and of style figures with the bias last: logistic loss, L1 on words, by proximal steps."""
    size = 1 << BITS
    words, dense = np.zeros(size), np.zeros(STYLES + 1)
    if not rows or target.min() == target.max():
        dense[-1] = 8.0 if len(target) and target.min() > 0.5 else -8.0
        return words, dense
    lengths = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([f for f, _ in rows])
    keep = np.bincount(flat, minlength=size)[flat] >= LEAST_TEXTS
    row = np.repeat(np.arange(len(rows)), lengths)[keep]
    flat = flat[keep]
    style_rows = np.column_stack([np.stack([s for _, s in rows]) * 8, np.ones(len(rows))])
    n, bad = len(rows), max(1e-9, target.mean())
    balance = np.where(target > 0.5, 0.5 / bad, 0.5 / max(1e-9, 1 - bad)) ** 0.5
    g2, d2 = np.full(size, 1e-8), np.full(STYLES + 1, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(row, words[flat], n) + style_rows @ dense
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g, d = np.bincount(flat, err[row], size), style_rows.T @ err
        g2 += g * g
        d2 += d * d
        step = 0.5 / np.sqrt(g2)
        words -= step * g
        words = np.sign(words) * np.maximum(0, np.abs(words) - step * PENALTY)
        dense -= 0.5 * d / np.sqrt(d2)
    return words, dense


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Model:
    """What scoring ships to the tasks: of fixed size, whatever the corpus."""

    def __init__(self, junk: tuple, abuse: tuple, junk_posterior: dict, abuse_posterior: dict) -> None:
        self.junk, self.abuse = junk, abuse
        self.junk_posterior, self.abuse_posterior = junk_posterior, abuse_posterior

    def score(self, text: str, seen: tuple | None = None) -> tuple[float, float]:
        own, figures = features(text, seen)
        dense = np.append(figures * 8, 1.0)
        return tuple(round(_logistic(float(w[own].sum() + d @ dense)), 6) for w, d in (self.junk, self.abuse))


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> tuple[Model, dict[str, float]]:
    """The model, and the accuracy that expectation maximisation gives each heuristic.

    Vote patterns are counted over all rows.  ``labels`` (doc_id, quality, toxic; nulls are unknown) is optional.
    """
    docs = texts(docs)

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                junk, abuse = zip(*map(votes, batch.slice(at, SLICE_ROWS).column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(junk, pa.int32()), pa.array(abuse, pa.int32())], names=["junk", "abuse"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                own = [(*votes(t), *features(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([o[0] for o in own], pa.int32()), pa.array([o[1] for o in own], pa.int32()),
                    pa.array([o[2].tobytes() for o in own], pa.binary()), pa.array([o[3].tobytes() for o in own], pa.binary()),
                ], names=["doc_id", "junk", "abuse", "words", "style"])

    counted = docs.mapInArrow(ballots, "junk int, abuse int").groupBy("junk", "abuse").count().toArrow().to_pandas()  # at most 3**11 rows
    total = int(counted["count"].sum())
    learnt = {}
    for name, voters in (("junk", JUNK), ("abuse", ABUSE)):
        own = counted.groupby(name)["count"].sum()
        learnt[name] = learn_votes(own.index.to_numpy(np.int64), own.to_numpy(), len(voters))
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 30))
    rate = (1 << 30) * min(1.0, sample_rows / max(1, total))
    sample = docs.where(place(F.col("doc_id")) < rate).mapInArrow(featured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, junk int, abuse int, words binary, style binary")
    if labels is None:
        sample = sample.withColumns({"quality": F.lit(None).cast("double"), "toxic": F.lit(None).cast("double")})
    else:
        gold = labels.where(place(F.col("doc_id")) < rate).groupBy("doc_id").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
        sample = sample.join(gold, "doc_id", "left")
    got = sample.select("junk", "abuse", "words", "style", "quality", "toxic").toArrow().to_pylist()
    rows = [(np.frombuffer(r["words"], np.int32), np.frombuffer(r["style"], np.float64)) for r in got]
    junk = np.array([learnt["junk"][0][r["junk"]] if r["quality"] is None else 1 - r["quality"] for r in got])
    abuse = np.array([learnt["abuse"][0][r["abuse"]] if r["toxic"] is None else r["toxic"] for r in got])
    accuracies = {n: float(a) for names, (_, acc) in zip((JUNK, ABUSE), learnt.values()) for n, a in zip(names, acc)}
    return Model(train(rows, junk), train(rows, abuse), learnt["junk"][0], learnt["abuse"][0]), accuracies


def judge(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """Per row of ``docs``: scores of junk and abuse, the heuristics' posteriors, and whether the text is kept.

    Null text is empty text; texts without a word are judged by style alone, like any other.  Repeated rows get equal
    results; no rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = []
                for text in part.column("text").to_pylist():
                    seen = style(text)
                    scores, (junk, abuse) = own.score(text, seen), votes(text, seen)
                    out.append((*scores, round(own.junk_posterior.get(junk, 0.5), 6), round(own.abuse_posterior.get(abuse, 0.5), 6), max(scores) < reject))
                types = (*[pa.float64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), type=t) for c, t in zip(zip(*out), types))], names=["doc_id", "junk", "abuse", "junk_posterior", "abuse_posterior", "kept"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, junk double, abuse double, junk_posterior double, abuse_posterior double, kept boolean")


def keep_accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are; rows are judged where they lie."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                kept = [max(shipped.value.score(text or "")) < reject for text in part.column("text").to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on ``docs`` and judge them; see ``fit`` and ``judge``."""
    return judge(docs, fit(docs, labels, sample_rows)[0])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
