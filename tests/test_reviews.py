"""Review transitions on a handful of runs."""

import datetime as dt
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlark.operators import joins, reviews
from ledgerlark.plans import adapters, queries_reviews

NOW = dt.datetime(2024, 5, 1, 12)
RUN = (
    "run_id long, match_id long, manual_review_status string, manual_review_reason string, manual_review_resolved_at timestamp, recommended_outcome string, final_home_prob double,"
    " market_odds_home double, ev_home double, confidence_score double, quality_score double, model_agreement double, effective_recommendation string, effective_stake_pct double, effective_action_source string"
)


def _run(run_id, match_id, status="pending", reason="", outcome="home", p=0.5, odds=2.4):
    return run_id, match_id, status, reason, None, outcome, p, odds, p * odds - 1.0, 0.7, 0.8, 0.8, "", 0.0, ""


def _frames(spark, decisions):
    runs = spark.createDataFrame(
        [_run(1, 1), _run(2, 1), _run(3, 2, reason="why"), _run(4, 3), _run(5, 3, status="resolved"), _run(6, None), _run(7, 4), _run(8, 5, outcome="")], RUN
    )
    for o in ("draw", "away"):
        runs = runs.withColumns({f"final_{o}_prob": F.lit(0.25), f"market_odds_{o}": F.lit(3.0), f"ev_{o}": F.lit(-0.25)})
    later, gone = dt.datetime(2024, 5, 2), dt.datetime(2024, 4, 30)
    matches = spark.createDataFrame([(1, later), (2, gone), (2, gone), (3, later), (4, gone), (5, None)], "match_id long, match_time timestamp")
    return runs, spark.createDataFrame(decisions, "decision_id long, run_id long, action string, notes string"), matches


def test_decisions_by_their_match(spark):
    decided = [
        (1, 1, "main", ""), (2, 2, "perhaps", ""), (3, 2, " 轻仓 now", " ok "), (4, 2, "main", "late"), (5, 3, "main", ""), (6, 5, "main", ""), (7, 6, "Main", None),
        (8, 99, "main", ""), (9, None, "main", ""), (10, 8, "light", ""), (11, 6, "", ""),
    ]
    args = _frames(spark, decided)
    out = {r["run_id"]: r for r in reviews.resolve_reviews(*args, F.lit(NOW)).collect()}
    assert len(out) == 8
    status = {k: r["manual_review_status"] for k, r in out.items()}
    # run 4's match was decided about through run 5, which waits for nothing; match 4 has started, but nobody asked
    assert status == {1: "superseded", 2: "resolved", 3: "expired", 4: "pending", 5: "resolved", 6: "resolved", 7: "pending", 8: "resolved"}
    assert (out[2]["effective_recommendation"], out[2]["manual_review_notes"], out[2]["effective_action_source"]) == ("light", "ok", "manual_review")
    assert out[3]["manual_review_reason"] == "why" and out[1]["manual_review_reason"] == "replaced by a newer run"
    assert out[5]["effective_action_source"] == "" and out[7]["manual_review_resolved_at"] is None
    # quarter Kelly of (0.5 * 2.4 - 1) / 1.4, tilted by 0.55 + 0.0675 + 0.02 + 0.0375 + 0.03
    assert out[6]["effective_stake_pct"] == round(0.2 / 1.4 * 25 * 0.705, 2) and out[8]["effective_stake_pct"] == 0.0
    why = {r["decision_id"]: r["reject_reason"] for r in reviews.rejected_decisions(*args, F.lit(NOW)).collect()}
    assert why == {1: "superseded", 2: "unknown_action", 3: "", 4: "resolved", 5: "expired", 6: "resolved", 7: "", 8: "unknown_run", 9: "unknown_run", 10: "", 11: "resolved"}


def test_no_decisions_change_nothing(spark):
    runs, decisions, matches = _frames(spark, [])
    assert {r["manual_review_status"] for r in reviews.resolve_reviews(runs, decisions, matches, F.lit(NOW)).collect()} == {"pending", "resolved"}
    assert reviews.rejected_decisions(runs, decisions, matches, F.lit(NOW)).count() == 0
    assert {r["run_id"] for r in reviews.supersede_reviews(runs, F.lit(NOW)).where("manual_review_status = 'superseded'").collect()} == {1, 4}


def _expected(runs, decisions, matches):
    """Decisions applied in plain Python."""
    known = lambda a: {"main": "main", "light": "light", "轻仓": "light", "hold": "watch"}.get((a or "").strip().lower())
    asked, word = {}, {}
    for d, run, action, notes in sorted(decisions):
        asked[run] = True
        if known(action) and run not in word:
            word[run] = known(action), (notes or "").strip()
    gone = {m for m, t in matches if t is not None and t <= NOW}
    out = {}
    for run, match, status in runs:
        mates = [r for r in runs if r[1] == match] if match is not None else [(run, match, status)]
        waiting = [r[0] for r in mates if r[2] == "pending" and r[0] in asked]
        newest, any_asked = max(r[0] for r in mates), match is not None and any(r[0] in asked for r in mates)
        over = any_asked and match in gone
        if status == "pending":
            if over:
                status = "expired"
            elif any_asked and run != newest and any(w != newest for w in waiting):
                status = "superseded"
            elif run == newest and run in word:
                status = "resolved"
                out[run] = status, word[run][0], word[run][1]
                continue
        out[run] = status, "", ""
    return out


@pytest.mark.parametrize("pending", [0.0, 0.05, 0.4, 1.0])
def test_decisions_equal_plain_python(spark, monkeypatch, pending):
    rng = random.Random(int(pending * 100))
    other = ["resolved", "expired", "", "superseded"]
    runs = [(i * 7, rng.choice([None, *range(60)]) if i % 3 else 7, "pending" if rng.random() < pending else rng.choice(other)) for i in range(400)]
    decisions = [(i, rng.choice([None, 5, *[r[0] for r in runs[::2]]]), rng.choice(["main", "hold", " 轻仓 x", "", None, "later"]), rng.choice([None, " n ", ""])) for i in range(300)]
    matches = [(m, rng.choice([None, dt.datetime(2024, 5, 2), dt.datetime(2024, 4, 30)])) for m in range(50)]
    plain = [(d, r, "轻仓" if a == " 轻仓 x" else a, n) for d, r, a, n in decisions if r is not None]
    want = _expected(runs, plain, matches)
    frame = spark.createDataFrame([_run(r, m, s) for r, m, s in runs], RUN)
    for o in ("draw", "away"):
        frame = frame.withColumns({f"final_{o}_prob": F.lit(0.25), f"market_odds_{o}": F.lit(3.0), f"ev_{o}": F.lit(-0.25)})
    args = frame, spark.createDataFrame(decisions, "decision_id long, run_id long, action string, notes string"), spark.createDataFrame(matches, "match_id long, match_time timestamp")
    for words in (joins.SIEVE_WORDS, 1):  # a sieve that keeps most out, and one that lets all pass
        monkeypatch.setattr(joins, "SIEVE_WORDS", words)
        found = reviews.resolve_reviews(*args, F.lit(NOW)).collect()
        assert len(found) == len(runs)
        assert {r.run_id: (r.manual_review_status, r.effective_recommendation, r.manual_review_notes) for r in found} == want


def test_a_sieve_loses_no_key(spark):
    keys = spark.range(0, 5000, 10).withColumnRenamed("id", "k")
    rows = spark.range(5000).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k, 1L AS v"))
    out = joins.sieved(rows, "k", keys)
    assert out.columns == ["k", "v"] and out.where("k % 10 = 0 AND v = 2 * k").count() == 500
    assert out.count() < 510


def _rows_shuffled(plan):
    """Rows that the exchanges of an executed plan wrote, those of a reused one once."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _rows_shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _rows_shuffled(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    below = sum(_rows_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))
    return below + (plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)


def test_only_matches_with_a_pending_review_are_shuffled_by_run(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        df = queries_reviews.resolve_reviews(spark, SF)
        assert len(df.collect()) == 6000
        moved = _rows_shuffled(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(key, before)
    assert moved < 24000  # line items, orders and customers to build runs, and little else; 68,242 when whole runs and all decisions moved


def test_decisions_are_the_same_from_one_pass(spark):
    once, twice = (adapters.view(spark, SF, t) for t in (queries_reviews._DECISIONS_ONCE, queries_reviews.DECISIONS))
    assert once.columns == twice.columns and once.dtypes == twice.dtypes
    assert once.count() == twice.count() and once.exceptAll(twice).count() == 0
