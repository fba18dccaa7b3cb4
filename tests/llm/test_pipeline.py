"""Rollups, the classifier and the pipeline."""

import hashlib
import uuid

import duckdb
import numpy as np
import pytest
from conftest import SF, no_rows, rows_of
from test_near import plain_groups
from test_texts import plain_contamination

from ledgerlark.llm import bpe, exact, quality, token_rollup
from ledgerlark.llm.common import shared_dir
from ledgerlark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(rows_of(got, *names), key=repr) == sorted(cur.fetchall(), key=repr)


def test_rollup_of_awkward_rows(awkward):
    total = token_rollup.maintain(awkward)
    con = duckdb.connect()
    documents = awkward.select("doc_id", "text", "source", "lang").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    want = con.execute(token_rollup.OP4_SQL).fetchall()
    assert sorted(rows_of(total, "source", "lang", "tokenizer", "n_docs", "n_tokens"), key=repr) == sorted(want, key=repr)
    assert token_rollup.maintain(no_rows(awkward)).count() == 0


def test_batches_commit_once(spark):
    store = token_rollup.Rollup(spark, f"{shared_dir(spark)}/test-{uuid.uuid4().hex}")
    change = lambda *rows: spark.createDataFrame(list(rows), "source string, lang string, tokenizer string, before long, after long")
    assert store.totals().count() == 0
    assert store.commit("a", change(("s", "en", "t", None, 5), ("s", "en", "t", None, 7), (None, None, "t", None, 0)))
    assert not store.commit("a", change(("s", "en", "t", None, 100)))
    assert store.commit("b", change(("s", "en", "t", 5, 6), ("s", "en", "t", 7, None), (None, None, "t", 0, None), ("x", "en", "t", None, None)))
    assert rows_of(store.totals(), "source", "n_docs", "n_tokens") == [("s", 1, 6)]
    # An empty marker commits nothing and does not stand in the way; of two attempts at one batch only the first counts.
    empty = store._at("commits", "d")
    store._fs.create(empty, False).close()
    assert "d" not in store.committed() and rows_of(store.totals(), "source", "n_docs", "n_tokens") == [("s", 1, 6)]
    assert store.commit("d", change(("y", "en", "t", None, 2)))
    assert not store._mark("d", "another") and not store.commit("d", change(("y", "en", "t", None, 2)))
    assert sorted(rows_of(store.totals(), "source", "n_docs", "n_tokens")) == [("s", 1, 6), ("y", 1, 2)]
    assert store.commit("e", change(("y", "en", "t", 2, None)))
    # A failed attempt leaves files but no marker.
    token_rollup.signed(change(("s", "en", "t", None, 9))).write.parquet(f"{store.path}/deltas/c/failed")
    assert rows_of(store.totals(), "source", "n_docs", "n_tokens") == [("s", 1, 6)]


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.2
    rates = (0.95, 0.85, 0.7)
    votes = np.stack([np.where(rng.random(20000) < r, truth, ~truth) * 2 for r in rates], 1)
    codes, counts = np.unique(votes @ 3 ** np.arange(3), return_counts=True)
    posterior, accuracy = quality.learn_votes(codes, counts, 3)
    assert np.abs(accuracy - rates).max() < 0.04
    assert ((np.vectorize(posterior.get)(votes @ 3 ** np.arange(3)) > 0.5) == truth).mean() > 0.94


def test_quality_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["kept"] for r in quality.op5_quality(spark, folder).collect()}
    gold = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean = [got[r["doc_id"]] for r in gold if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[r["doc_id"]] for r in gold if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(clean) > 0.97 and np.mean(bad) < 0.35


def test_quality_of_awkward_rows(spark, awkward):
    got = quality.classify(awkward)
    assert got.count() == awkward.count()
    model, _ = quality.fit(awkward)
    kept = quality.keep_accepted(awkward, model)
    assert kept.schema == awkward.schema and kept.count() == got.where("kept").count()
    assert quality.classify(no_rows(awkward)).count() == 0


def test_pipeline_is_its_parts(spark):
    import corpus_pipeline

    model, _ = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if max(model.score(t)) < quality.REJECT]
    best = {}
    for i, t in rows:
        bare = t.encode().translate(None, exact.WHITE)
        best[bare] = min(best.get(bare, (1, 0, "")), (-len(t), i, t))
    rows = [(i, t) for _, i, t in best.values()]
    stay = {g for _, _, g, *_ in plain_groups(rows)}
    rows = [(i, t) for i, t in rows if i in stay]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, *_, hit in plain_contamination(rows, items) if hit}
    with open(bpe.default_vocabulary(), "rb") as f:
        codec = bpe.Codec(f.read())
    want = [(i, hashlib.sha256(" ".join(map(str, codec.encode(t))).encode()).hexdigest()) for i, t in rows if i not in leaks]
    assert sorted(rows_of(corpus_pipeline.run(spark, SF), "doc_id", "ids_sha256")) == sorted(want)
    assert 0 < len(want) < len(rows) + len(leaks)


def test_stages_on_awkward_rows(spark, awkward):
    import corpus_pipeline

    for docs in (awkward, no_rows(awkward)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SF)
            out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out


def test_rows_without_an_id_of_their_own(spark):
    """Null ids, and an id of two sources, over different texts: each row has its own group and its own fate."""
    import corpus_pipeline

    leak = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    long = [" ".join(f"{a}{i}" for i in range(80)) for a in "pqr"]
    rows = [(None, "first text"), (None, "second text, alone"), (None, "third  text"), (5, "third text"), (5, "another one"), (5, "first text"), (7, "seven"), (7, "seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(rows_of(exact.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept"), key=repr)
    want = [(None, None, 2, True), (None, None, 1, True), (None, None, 2, True), (5, None, 2, False), (5, 5, 1, True), (5, None, 2, False), (7, 7, 2, True), (7, 7, 2, False)]
    assert got == sorted(want, key=repr)
    kept = rows_of(corpus_pipeline.drop_copies(spark, docs, SF), "doc_id", "text")
    assert sorted(kept, key=repr) == sorted([*rows[:3], rows[4], rows[6]], key=repr)
    near = [(None, long[0]), (None, long[0] + " end"), (None, long[1]), (3, long[2]), (3, long[1] + " end")]
    kept = rows_of(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(near, "doc_id long, text string"), SF), "doc_id", "text")
    assert len(kept) == 3 and {near[2], near[3]} <= set(kept) and near[4] not in kept
    leaked = [(None, leak), (None, long[0]), (4, leak), (4, long[1])]
    kept = rows_of(corpus_pipeline.drop_leaks(spark, spark.createDataFrame(leaked, "doc_id long, text string"), SF), "doc_id", "text")
    assert sorted(kept, key=repr) == sorted([leaked[1], leaked[3]], key=repr)
