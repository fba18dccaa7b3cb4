"""Hand-written cases with known answers."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.fixed_values import OUTCOMES
from ledgerlark.functions import labels, policy, probs
from ledgerlark.operators import extract, ledger, metrics

THRESHOLDS = {
    "main": {"ev": 0.12, "confidence": 0.66, "market_bias": 0.04, "quality": 0.70},
    "light": {"ev": 0.06, "confidence": 0.56, "market_bias": 0.025, "quality": 0.60},
}


def forecast(spark, p, odds, market, legacy, quality=0.90, agreement=0.90):
    names = [f"{k}_{o}" for k in ("p", "market_odds", "m", "l") for o in OUTCOMES]
    row = tuple(float(x) for group in (p, odds, market, legacy) for x in group) + (quality, agreement)
    df = spark.createDataFrame([row], [*names, "quality_score", "model_agreement"])
    for o in OUTCOMES:
        df = df.withColumn(f"market_{o}_prob", F.col(f"m_{o}")).withColumn(f"legacy_{o}_prob", F.col(f"l_{o}"))
    return df, {o: F.col(f"p_{o}") for o in OUTCOMES}


def run_policy(spark, *args):
    df, p = forecast(spark, *args)
    return policy.action_policy(df, p, policy.literal_gates(THRESHOLDS)).first()


def test_strong_edge_is_main(spark):
    row = run_policy(spark, (0.70, 0.18, 0.12), (1.62, 4.60, 7.20), (0.56, 0.25, 0.19), (0.68, 0.19, 0.13))
    assert row.policy_outcome == "home" and row.policy_action == "main"
    assert row.policy_score >= 0.74 and row.policy_stake > 0


def test_negative_bias_is_watch(spark):
    row = run_policy(spark, (0.44, 0.30, 0.26), (2.60, 3.05, 3.20), (0.48, 0.28, 0.24), (0.46, 0.29, 0.25))
    assert row.policy_outcome == "home" and row.policy_ev > 0 and row.policy_bias < 0
    assert row.policy_action == "watch" and row.policy_stake == 0.0


def test_direction_follows_market(spark):
    df, p = forecast(spark, (0.44, 0.29, 0.27), (2.10, 3.40, 4.20), (0.47, 0.29, 0.24), (0.45, 0.29, 0.26))
    row = policy.outcome_policy(policy.market_position(df, p)).first()
    assert (row.predicted_outcome, row.value_outcome, row.market_outcome) == ("home", "away", "home")


def test_backtest_totals(spark):
    base = dict(market_odds_home=2.5, market_odds_draw=3.2, market_odds_away=3.8, effective_recommendation="", effective_stake_pct=0.0,
                manual_review_status="", recommended_outcome="home", actual_result="home", handicap_recommendation="watch",
                handicap_recommended_side="", handicap_line=0.0, handicap_home_odds=2.0, handicap_away_odds=2.0,
                algo_recommendation="light", algo_recommended_outcome="home", algo_suggested_stake_pct=10.0)
    rows = [dict(base, recommendation="watch", suggested_stake_pct=0.0, actual_score="2-1"),
            dict(base, recommendation="light", suggested_stake_pct=10.0, actual_score="1-0")]
    df = metrics.with_settlement(spark.createDataFrame(rows))
    total = metrics.feedback_summary(df).first()
    assert (total.total_predictions, total.hit_predictions, total.miss_predictions) == (2, 2, 0)
    assert total.total_roi == pytest.approx(0.15)
    final, algo = metrics.executed_metrics(df).first(), metrics.algorithm_metrics(df).first()
    assert (final.action_count, final.total_roi) == (1, pytest.approx(0.15))
    assert (algo.action_count, algo.total_roi) == (2, pytest.approx(0.30))


def test_action_steps_and_labels(spark):
    df = spark.createDataFrame([("Hold on", "main", "watch"), ("轻仓", "light", "main"), ("", "watch", "main"), ("涓绘帹", "main", "odd")], "a string, c string, t string")
    rows = df.select(labels.action_label("a").alias("l"), labels.step_down(F.col("c"), F.col("t")).alias("d"), labels.step_up(F.col("c"), F.col("t")).alias("u")).collect()
    assert [r.l for r in rows] == ["watch", "light", "watch", "main"]
    assert [r.d for r in rows] == ["light", "light", "watch", "main"]
    assert [r.u for r in rows] == ["main", "main", "light", "main"]


@pytest.mark.parametrize("score,line,result", [("2-1", -1.0, "push"), ("2:1", -0.5, "home"), ("0-1", 0.5, "away"), ("x", 0.0, "")])
def test_handicap_result(spark, score, line, result):
    df = spark.createDataFrame([(score, line)], "s string, l double")
    assert df.select(labels.handicap_result("s", F.col("l")).alias("r")).first().r == result


def test_handicap_wording(spark):
    cases = {"半球": 0.5, "受半球": -0.5, "平手": 0.0, "一球/球半": 1.25, "-0.75": -0.75, "球半/两球": 1.75, "": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", extract.handicap_line(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_record_text_with_wide_spaces(spark):
    text = "近10场　 6胜2平2负，进18球失9球，胜率60%，赢盘率50%，大球率40%"
    df = spark.createDataFrame([(text,)], "t string")
    cols = [c.alias(n) for n, c in extract.record_metrics("g").items()]
    from ledgerlark.fixed_values import RECORD_PATTERN

    row = extract.with_captures(df, {"g": ("t", RECORD_PATTERN, 9)}).select(*cols).first()
    assert (row.matches, row.points_per_game, row.goal_diff_per_game, row.win_rate) == (10, 2.0, 0.9, 0.6)


def test_carried_settlement_keeps_manual_return(spark):
    from ledgerlark.plans import adapters

    runs = adapters.load(spark, "/root/testdata/sf0.001", "runs")
    feedback = adapters.load(spark, "/root/testdata/sf0.001", "feedback").drop("period")
    new = adapters.load(spark, "/root/testdata/sf0.001", "wide").filter("match_id = 8")
    picks = spark.createDataFrame([("x", 1, 8, 1)], "period string, rank int, match_id long, run_id long")
    out = ledger.replace_runs(runs, new, feedback, picks)
    assert out["runs"].filter("match_id = 8").count() == 1
    assert out["top_picks"].count() == 0
    before = {r.feedback_id: r.roi_delta for r in feedback.filter("match_id = 8").collect()}
    after = out["feedback"].filter("match_id = 8").collect()
    assert after and all(r.roi_delta == before[r.feedback_id] for r in after)
