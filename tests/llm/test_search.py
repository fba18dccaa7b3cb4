"""Operators 11 to 13 against brute force, the library itself and SQL."""

import base64
import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF, no_rows, rows_of, texts_of
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import ball_tree, centroids, rank_bpe

sha = lambda b: hashlib.sha256(b).hexdigest()


# --- Ranked search ------------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, top=20):
    own = [(i, Counter(plain_terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(plain_terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return out


COLUMNS = ("item_id", "rank", "doc_id", "score")
ranked = lambda df: sorted(rows_of(df, *COLUMNS), key=repr)


def test_search_of_awkward_rows(spark, awkward):
    items = [(1, "One TWO three four"), (1, "lorem w30 w31 w31 v3 v3"), (2, None), (3, ""), (4, "no such terms here"), (None, "é wide SPACES a"), (5, "one two"), (5, "one two"), (6, "long12 long13 " * 500)]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, mark string, query int")
    got = ball_tree.search(awkward, asked)
    assert ranked(got) == sorted(plain_ranking(texts_of(awkward), items), key=repr)
    assert ball_tree.search(no_rows(awkward), asked).count() == 0 and ball_tree.search(awkward, no_rows(asked)).count() == 0
    assert ball_tree.search(no_rows(awkward), asked).columns == got.columns


def test_search_of_documents(spark, documents, monkeypatch):
    """Small blocks, leaves and query blocks; many trees, ties among copies, thresholds from a seed of a few rows."""
    for name, value in (("BLOCK_DOCS", 50), ("LEAF", 4), ("QUERY_BYTES", 3000), ("SEED_DOCS", 60)):
        monkeypatch.setattr(ball_tree, name, value)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    copies = documents.unionByName(documents.limit(30))
    got = ball_tree.search(copies, items)
    assert ranked(got) == sorted(plain_ranking(texts_of(copies), [(r["item_id"], r["text"]) for r in items.collect()]), key=repr)


def _random_block(rng, docs, width):
    sizes = rng.integers(1, 12, docs)
    rows = [np.sort(rng.choice(width, s, replace=False)) for s in sizes]
    return ball_tree.Block(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(rows), rng.integers(1, 10**6, sizes.sum()), np.arange(docs), np.zeros(docs, bool))


@given(st.integers(0, 10**6), st.integers(1, 300))
@settings(max_examples=40, deadline=None)
def test_bounds_hold_below_every_node(seed, docs):
    rng = np.random.default_rng(seed)
    block, weight = _random_block(rng, docs, 40), rng.integers(1, 30000, 40)
    tree = ball_tree.Tree(block, weight.astype(float) ** 0.5)
    own = np.sort(rng.choice(40, 6, replace=False))
    dense = np.zeros(40, np.int64)
    dense[own] = weight[own]
    score = np.add.reduceat(dense[tree.block.terms] * tree.block.parts, tree.block.starts[:-1])
    bound = tree.bounds(own, weight[own])
    for i in range(len(bound)):
        low, high = i, i
        while low < tree.leaves - 1:
            low, high = 2 * low + 1, 2 * high + 2
        below = score[tree.cuts[low - tree.leaves + 1] : tree.cuts[high - tree.leaves + 2]]
        assert not len(below) or below.max() <= bound[i]
    found = ball_tree.Found(5, 0)
    tree.search(own, weight[own], dense, found)
    want = sorted((-int(s), int(i)) for s, i in zip(score, tree.block.ids) if s > 0)[:5]
    assert [(-int(s), int(i)) for s, i in zip(found.score, found.ids)] == want


def test_subtrees_are_pruned():
    """Documents of four vocabularies: a query of one of them leaves most leaves unread."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(np.arange(50) + 50 * (i % 4), 10, replace=False)) for i in range(2000)]
    block = ball_tree.Block(np.arange(2001) * 10, np.concatenate(rows), rng.integers(1, 10**6, 20000), np.arange(2000), np.zeros(2000, bool))
    weight = np.full(200, 1000)
    tree = ball_tree.Tree(block, weight.astype(float) ** 0.5)
    dense = np.zeros(200, np.int64)
    own = np.array([3, 17, 44])
    dense[own] = 1000
    assert tree.search(own, weight[own], dense, ball_tree.Found(20, 0)) < 0.3 * tree.leaves


def test_search_sql(spark):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    assert ranked(ball_tree.op11_ball_tree_search(spark, SF)) == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ball_tree.OP11_SQL})").fetchall(), key=repr)


# --- Byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(rank_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(rank_bpe.default_ranks(), "rb") as f:
        return rank_bpe.Coder(f.read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_digests_equal_the_library(request, library, table):
    docs = request.getfixturevalue(table)
    want = []
    for i, t in texts_of(docs):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    got = rank_bpe.digests(docs, rank_bpe.default_ranks())
    assert sorted(rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), key=repr) == sorted(want, key=repr)
    assert rank_bpe.digests(no_rows(docs), rank_bpe.default_ranks()).count() == 0


@given(st.text(alphabet="aZ9 \n\t'sreé字!\x85　\x1c-🙂", max_size=120), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_parts_encode_as_the_whole(library, text, size):
    ids = []
    for part, whole in rank_bpe.parts(text, size):
        ids += library._encode_single_piece(part) if whole else library.encode_ordinary(part)
    assert ids == library.encode_ordinary(text)


@given(st.lists(st.sampled_from(["word", "é", "12", "'s", "字", "\n", "!"]), max_size=6), st.lists(st.integers(1, 40), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_runs_of_white_space_encode_as_the_whole(library, words, runs):
    old = rank_bpe.LONG_WHITE
    rank_bpe.LONG_WHITE = re.compile(old.pattern.replace(f"{{{rank_bpe.WHITE_RUN},}}", "{5,}"))
    try:
        text = "".join(w + " " * runs[i % len(runs)] + "\n" * (runs[i % len(runs)] % 3) for i, w in enumerate(words))
        ids = []
        for part, whole in rank_bpe.parts(text, 7):
            ids += library._encode_single_piece(part) if whole else library.encode_ordinary(part)
        assert ids == library.encode_ordinary(text)
    finally:
        rank_bpe.LONG_WHITE = old


def test_very_long_texts(coder, library):
    for text in (" " * 1_500_000 + "x", "\n" * 1_500_000, "z" * 1_500_000, "字" * 300_000, "ab 12, c's\n" * 60_000, "<|endoftext|>" * 20_000):
        assert coder.decode(coder.encode(text)) == text.encode()
    text = "ab 12, c's\n\n  d" * 60_000
    assert coder.encode(text) == library.encode_ordinary(text)


def test_round_trip_and_raw_bytes(spark, awkward):
    tokens = rank_bpe.encode(awkward, rank_bpe.default_ranks())
    back = rank_bpe.decode(tokens, rank_bpe.default_ranks())
    assert sorted(((r[0], bytes(r[1])) for r in rows_of(back, "doc_id", "raw")), key=repr) == sorted(((i, t.encode()) for i, t in texts_of(awkward)), key=repr)
    first = rank_bpe.encode(spark.createDataFrame([(1, "🙂")], "doc_id long, text string"), rank_bpe.default_ranks()).first()["ids"][:1]
    halves = spark.createDataFrame([(1, first), (2, None)], "doc_id long, ids array<int>")
    raw = [bytes(r[0]) for r in rows_of(rank_bpe.decode(halves, rank_bpe.default_ranks()).orderBy("doc_id"), "raw")]
    assert raw[1] == b"" and raw[0] and "🙂".encode().startswith(raw[0]) and raw[0] != "🙂".encode()


# --- Clusters -----------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}".encode()), r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    return [(i, n, d, inertia[n], inertia.total(), sha(",".join(map(str, centres[n])).encode())) for i, d, n in found]


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_equal_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    one = rows[0][1]
    rows += [rows[3], (None, rows[5][1]), (900, one[:63]), (901, None), (902, [None, *one[1:]]), (903, [float("nan"), *one[1:]]), (904, [float("inf"), *one[1:]]), (905, [-7.25] * 64), (905, [0.0] * 64), (None, [-0.001] * 64)]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x int")
    rows = [(r[0], r[1]) for r in rows_of(table, "vec_id", "embedding")]
    got = centroids.cluster(table)
    assert sorted(rows_of(got, *CLUSTERED), key=repr) == sorted(plain_clusters(rows), key=repr)
    assert centroids.cluster(no_rows(table)).count() == 0 and centroids.cluster(no_rows(table)).columns == got.columns
    few = table.where("vec_id in (905, 1)")
    assert sorted(rows_of(centroids.cluster(few), *CLUSTERED), key=repr) == sorted(plain_clusters([(r[0], r[1]) for r in rows_of(few, "vec_id", "embedding")]), key=repr)


def test_huge_components_are_held(spark):
    table = spark.createDataFrame([(i, [s * 3e38] * 64) for i, s in ((1, 1.0), (2, -1.0), (3, 0.0))], "vec_id long, embedding array<float>")
    assert {r["distance"] for r in centroids.cluster(table, k=2).collect()} <= {0, *(64 * (x * 2**26) ** 2 for x in (1, 2)), 64 * 2**50}


@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_orchard_equals_full_search(seed, k, n):
    """Small integer coordinates make many ties, at exactly twice the distance too."""
    rng = np.random.default_rng(seed)
    centres, x = rng.integers(-3, 4, (k, 2)), rng.integers(-4, 5, (n, 2))
    cur, dist, measured = centroids.Orchard(centres).nearest(x)
    full = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (cur == full.argmin(1)).all() and (dist == full.min(1)).all() and measured <= n * k


def test_orchard_measures_few():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 10**6, (400, 2))
    x = centres[rng.integers(0, 400, 500)] + rng.integers(-9, 10, (500, 2))
    assert centroids.Orchard(centres).nearest(x)[2] < 0.3 * 400 * 500


def test_clusters_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(CLUSTERED)} FROM ({centroids.OP13_SQL})").fetchall()
    assert sorted(rows_of(centroids.op13_orchard_clusters(spark, SF), *CLUSTERED)) == sorted(want)
