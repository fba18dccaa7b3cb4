"""Operator 11: exact ranked lexical search by inner products in sparse ball trees.

A document is a sparse vector of saturated term frequencies, a query one of term weights times repeats, and a score
their integer inner product.  Tasks gather documents into blocks of bounded size and build a balanced ball tree over
each: halves by distance to two far documents, leaves of a few.  A node keeps its centroid and, for each of ``BANDS``
bands of terms, the radius around it.  By Cauchy's inequality in each band no document below a node scores above
sum over bands of <q, c> + |q| r, where only the query's terms that occur below the node count in |q|; floating-point
bounds are widened by more than their rounding.  A query takes nodes best bound first and ends at the first bound
below its twentieth score; leaves are scored in 64-bit integers.  Queries come in blocks of bounded size, and only
their terms matter, so documents are stored as short lists of those.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE_ROWS, cut, ship, text_mark, texts

#: Text of the distinct queries that are searched at a time, in bytes; the longest query may come on top.
QUERY_BYTES = 4 << 20
#: Documents and stored terms up to which a tree grows.
BLOCK_DOCS, BLOCK_TERMS = 8192, 2_000_000
LEAF, BANDS = 32, 128
#: Documents, by expectation, that give the first lower bounds of the scores; they only save work.
SEED_DOCS = 8192
#: Bounds are widened by these, far more than their rounding errors (about 1e-15 for each term added up).
WIDER, WIDER_SQUARE = 1 + 1e-6, 1e-7
#: Terms are scaled by this power of their weight in documents, by the rest in queries; any value gives right results.
SHARE = 0.5
NO_ID = (1 << 63) - 1

#: ASCII characters that part terms, as spaces.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text: runs of ASCII letters and digits and of all that is not ASCII, A-Z in lower case."""
    return text.encode().lower().translate(_TABLE).split()


class Queries(NamedTuple):
    """A block of queries: the vocabulary, and per query its terms and their repeats."""

    marks: list[str]
    vocabulary: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def query_block(rows: list[tuple[str, str]]) -> Queries:
    place: dict[bytes, int] = {}
    own, repeats = [], []
    for _, text in rows:
        c = Counter(terms(text))
        own.append(np.array([place.setdefault(t, len(place)) for t in c], np.int64))
        repeats.append(np.array(list(c.values()), np.int64))
    return Queries([m for m, _ in rows], list(place), own, repeats)


# --- Documents as stored terms ------------------------------------------------------------------------------------

STORED = "doc_id {id}, n long, terms array<int>, tf array<int>"


def _store(queries):
    """A document's number of terms, and its terms that some query has, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(queries.value.vocabulary)}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n, ends, own, tf = [], [0], [], []
                for text in part.column("text").to_pylist():
                    found = terms(text)
                    c = Counter(map(place.get, found))
                    c.pop(None, None)
                    n.append(len(found))
                    for t in sorted(c):
                        own.append(t)
                        tf.append(c[t])
                    ends.append(len(own))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (own, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return run


# --- The tree -----------------------------------------------------------------------------------------------------


class Block(NamedTuple):
    """Documents in rows: where their terms start, terms, integer parts of their scores; ids and which of them are null."""

    starts: np.ndarray
    terms: np.ndarray
    parts: np.ndarray
    ids: np.ndarray
    null: np.ndarray

    def rows(self, order: np.ndarray) -> Block:
        sizes = np.diff(self.starts)[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[order] - starts[:-1], sizes) + np.arange(starts[-1])
        return Block(starts, self.terms[at], self.parts[at], self.ids[order], self.null[order])


class Tree:
    """A balanced ball tree over a block; node 0 is the root, nodes 2i+1 and 2i+2 are below i, leaves come last."""

    def __init__(self, block: Block, scale: np.ndarray) -> None:
        n = len(block.ids)
        self.depth = max(0, math.ceil(math.log2(n / LEAF))) if n else 0
        self.leaves = 1 << self.depth
        self.scratch = np.zeros(len(scale))
        self.scale = scale
        self.block = block.rows(self._order(block))
        self.cuts = np.array(self._cuts(0, n, self.depth) + [n])
        self._balls()

    def _cuts(self, a: int, b: int, depth: int) -> list[int]:
        """Where the leaves start; halves as in ``_order``."""
        if not depth:
            return [a]
        mid = (a + b) // 2
        return self._cuts(a, mid, depth - 1) + self._cuts(mid, b, depth - 1)

    def _order(self, block: Block) -> np.ndarray:
        """Documents in the order of the leaves: each part is halved by distance to two documents far from each other."""

        def halves(own: Block, rows: np.ndarray, depth: int) -> np.ndarray:
            if not depth:
                return rows
            x = own.parts * self.scale[own.terms]
            norm = np.add.reduceat(x * x, own.starts[:-1])

            def away(i: int) -> np.ndarray:
                a, b = own.starts[i], own.starts[i + 1]
                self.scratch[own.terms[a:b]] = x[a:b]
                dot = np.add.reduceat(self.scratch[own.terms] * x, own.starts[:-1])
                self.scratch[own.terms[a:b]] = 0
                return norm + norm[i] - 2 * dot

            first = away(int(np.argmax(away(0))))
            order = np.argsort(first - away(int(np.argmax(first))), kind="stable")
            mid = len(rows) // 2
            return np.concatenate([halves(own.rows(part), rows[part], depth - 1) for part in (order[:mid], order[mid:])])

        return halves(block, np.arange(len(block.ids)), self.depth)

    def _balls(self) -> None:
        """Centroids of all nodes by term, and radii by node and band, leaves first."""
        b, width, nodes = self.block, len(self.scale), 2 * self.leaves - 1
        members = np.diff(self.cuts)
        leaf = np.repeat(np.arange(self.leaves), members)
        entry_leaf = np.repeat(leaf, np.diff(b.starts))
        x = b.parts * self.scale[b.terms]
        key, back = np.unique(entry_leaf * width + b.terms, return_inverse=True)
        centre = np.bincount(back, x, len(key)) / members[key // width]
        band = b.terms % BANDS
        doc = np.repeat(np.arange(len(b.ids)), np.diff(b.starts))
        square = np.bincount((key // width) * BANDS + key % width % BANDS, centre * centre, self.leaves * BANDS).reshape(-1, BANDS)
        by = doc * BANDS + band
        size = len(b.ids) * BANDS
        own = np.bincount(by, x * x, size).reshape(-1, BANDS)
        apart = own - 2 * np.bincount(by, x * centre[back], size).reshape(-1, BANDS) + square[leaf]
        apart = np.maximum(apart, 0) + WIDER_SQUARE * (own + square[leaf])
        self.radius = np.zeros((nodes, BANDS))
        at = self.leaves - 1
        full = members > 0
        self.radius[at:][full] = np.sqrt(np.maximum.reduceat(apart, self.cuts[:-1][full], axis=0)) if full.any() else 0
        keys, centres, level_of = [key % width], [centre], [key // width + at]
        while at:
            up, under = (at - 1) // 2, members
            members = under.reshape(-1, 2).sum(1)
            merged, back = np.unique((key // width // 2) * width + key % width, return_inverse=True)
            mean = np.bincount(back, centre * under[key // width], len(merged)) / np.maximum(1, members[merged // width])
            # Squared distance of a parent's centroid to each child's, by band.
            k = len(under)
            cell = (key // width) * BANDS + key % width % BANDS
            small = np.bincount(cell, centre * centre, k * BANDS).reshape(k, BANDS)
            both = np.bincount(cell, centre * mean[back], k * BANDS).reshape(k, BANDS)
            large = np.bincount((merged // width) * BANDS + merged % width % BANDS, mean * mean, k // 2 * BANDS).reshape(-1, BANDS).repeat(2, axis=0)
            gap = np.sqrt(np.maximum(small + large - 2 * both, 0) + WIDER_SQUARE * (small + large))
            below = np.where(under[:, None] > 0, gap + self.radius[at : at + k], 0)
            self.radius[up:at] = below.reshape(-1, 2, BANDS).max(1)
            at, key, centre = up, merged, mean
            keys.append(key % width)
            centres.append(centre)
            level_of.append(key // width + at)
        term, centre, node = np.concatenate(keys), np.concatenate(centres), np.concatenate(level_of)
        order = np.argsort(term, kind="stable")
        self.term_starts = np.searchsorted(term[order], np.arange(width + 1))
        self.centre, self.node = centre[order], node[order]

    def bounds(self, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For every node a number that no document below it exceeds in its score for a query of ``own`` terms."""
        q = weight / self.scale[own]
        sizes = self.term_starts[own + 1] - self.term_starts[own]
        ends = np.cumsum(sizes)
        at = np.repeat(self.term_starts[own] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        node, each = self.node[at], np.repeat(q, sizes)
        nodes = len(self.radius)
        dot = np.bincount(node, each * self.centre[at], nodes)
        norm = np.bincount(node * BANDS + np.repeat(own % BANDS, sizes), each * each, nodes * BANDS).reshape(-1, BANDS)
        return (dot + np.einsum("ij,ij->i", np.sqrt(norm), self.radius)) * WIDER + 1

    def search(self, own: np.ndarray, weight: np.ndarray, dense: np.ndarray, found: Found) -> int:
        """Best-first search; ``dense`` holds the query's weights by term.  Returns the number of leaves scored."""
        bound = self.bounds(own, weight)
        heap, scored, inner = [(-bound[0], 0)], 0, self.leaves - 1
        while heap:
            top, i = heapq.heappop(heap)
            if -top < found.least:
                break
            if i < inner:
                for j in (2 * i + 1, 2 * i + 2):
                    if bound[j] >= found.least:
                        heapq.heappush(heap, (-bound[j], j))
                continue
            a, b = self.cuts[i - inner], self.cuts[i - inner + 1]
            if a == b:
                continue
            scored += 1
            s, e = self.block.starts[a], self.block.starts[b]
            score = np.add.reduceat(dense[self.block.terms[s:e]] * self.block.parts[s:e], self.block.starts[a:b] - s)
            good = np.flatnonzero(score >= found.least)
            if len(good):
                found.add(score[good], self.block.ids[a:b][good], self.block.null[a:b][good])
        return scored


class Found:
    """The best documents of a query so far; ``least`` is the score that another needs at least."""

    def __init__(self, top: int, least: int) -> None:
        self.top, self.least = top, max(1, least)
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.null, null)))
        best = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.ids, self.null = score[best], ids[best], null[best]
        if len(best) == self.top:
            self.least = max(self.least, int(self.score[-1]))


# --- Jobs ---------------------------------------------------------------------------------------------------------


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) per term, 0 for terms that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def score_parts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a term's weight multiplies, per occurrence count and its document's number of terms."""
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Block]:
    """A task's documents with stored terms, in blocks."""

    def block() -> Block:
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return Block(starts, np.concatenate(own), np.concatenate(part), np.concatenate(ids), np.concatenate(null))

    sizes, own, part, ids, null, docs, total = [], [], [], [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = batch.slice(at, SLICE_ROWS)
            size = np.diff(rows.column("terms").offsets.to_numpy())
            n, tf = rows.column("n").to_numpy(), rows.column("tf").flatten().to_numpy().astype(np.int64)
            keep = size > 0
            sizes.append(size[keep])
            own.append(rows.column("terms").flatten().to_numpy().astype(np.int64))
            part.append(score_parts(tf, np.repeat(n, size), n_docs, n_terms))
            doc = rows.column("doc_id")
            null.append(doc.is_null().to_numpy(zero_copy_only=False)[keep])
            ids.append(doc.fill_null(NO_ID).to_numpy()[keep])
            docs, total = docs + int(keep.sum()), total + int(size.sum())
            if docs >= BLOCK_DOCS or total >= BLOCK_TERMS:
                yield block()
                sizes, own, part, ids, null, docs, total = [], [], [], [], [], 0, 0
    if docs:
        yield block()


RANKED = "query int, doc_id long, score long"


def _search(queries, weight: np.ndarray, n_docs: int, n_terms: int, top: int, least: dict[int, int]):
    """A task's best documents of every query, and how many leaves it scored of those it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.maximum(weight, 1).astype(float) ** SHARE
        asked = [(i, t[weight[t] > 0], r[weight[t] > 0]) for i, (t, r) in enumerate(zip(queries.value.terms, queries.value.repeats))]
        found = {i: Found(top, least.get(i, 0)) for i, _, _ in asked}
        dense = np.zeros(len(weight), np.int64)
        for block in _blocks(batches, n_docs, n_terms):
            tree = Tree(block, scale)
            for i, own, repeats in asked:
                if len(own):
                    w = weight[own] * repeats
                    dense[own] = w
                    tree.search(own, w, dense, found[i])
                    dense[own] = 0
        for i, f in found.items():
            if len(f.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f.ids), i), pa.int32()), pa.array(f.ids, mask=f.null), pa.array(f.score)], names=["query", "doc_id", "score"])

    return run


def _best(ranked: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: Queries, top: int) -> DataFrame | None:
    """The best documents of a block of queries: (mark, rank, doc_id, score)."""
    spark = docs.sparkSession
    queries = spark.sparkContext.broadcast(block)
    stored = cut(docs.mapInArrow(_store(queries), STORED.format(id="long")).where("n > 0"), "terms")
    n_docs, n_terms = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(block.vocabulary), np.int64)
    for term, count in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the queries' terms
        df[term] = count
    weight = weights(df, n_docs)

    def ranked(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        return _best(rows.mapInArrow(_search(queries, weight, n_docs, n_terms, top, least), RANKED), top)

    share = max(1, n_docs // SEED_DOCS)
    seeds = ranked(stored.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0), {}).where(F.col("rank") == top)
    least = {r["query"]: r["score"] for r in seeds.collect()}  # a row for each query at most
    marks = spark.createDataFrame(list(enumerate(block.marks)), "query int, mark string")
    return ranked(stored, least).join(marks, "query").select("mark", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` documents of highest score above 0 per row of ``items``: (item_id, rank, doc_id, score).

    ``docs`` has doc_id (integers) and text, ``items`` item_id and text; null text has no terms.  Equal scores go by
    doc_id, null last; a repeated document counts and ranks as often as it stands there, a repeated item is answered
    as often.  Items without terms in any document have no rows; nor has anything without documents or items.  A term's
    weight is the larger the fewer documents hold it.  Distinct item texts are searched ``QUERY_BYTES`` at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    own = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    asked = items.select("item_id", text_mark().alias("mark"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    distinct = cut(asked.groupBy("mark").agg(F.first("text").alias("text")), "queries")
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    out = spark.createDataFrame([], "mark string, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == b).orderBy("mark").collect()  # about QUERY_BYTES
        block = query_block([(r["mark"], r["text"]) for r in rows])
        found = _search_block(own, block, top) if block.vocabulary else None
        if found is not None:
            out = out.unionByName(found)
    return asked.select("item_id", "mark").join(out, "mark").select("item_id", "rank", "doc_id", "score")


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
q AS MATERIALIZED (
  SELECT r, item_id, term, count(*) AS k FROM (
    SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY r, item_id, term
),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
x AS (
  SELECT q.r, q.item_id, p.doc_id, CAST(sum(q.k * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * p.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY q.r, q.item_id, p.r, p.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0
) WHERE rank <= 20
"""
