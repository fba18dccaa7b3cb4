"""Feature payloads, history import, final actions, stored strategies and rule searches on small cases."""

import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlark import fixed_values as V
from ledgerlark.operators import extract, features, history, joins, learning, profile, resolution, what_if
from ledgerlark.plans import adapters, queries_features, queries_learning, queries_profile

ROWS = {
    "recent_form_home": "近10场  6胜2平2负，进18球失9球，胜率60%，赢盘率50%，大球率40%", "recent_form_away": "近8场  2胜2平4负，进7球失12球，胜率25%，赢盘率40%，大球率30%",
    "home_away_form": "主场 4胜1平1负，进10失4 | 客场 1胜2平3负，进5失9", "head_to_head_summary": "近6次交锋 3胜1平2负，进9球失7球", "elo_home": "第3/20，40分，12胜4平6负，进30，失20，净胜10", "elo_away": "",
    "european_odds_movement_summary": "初赔 2.10/3.20/3.40", "asian_handicap_summary": "", "betting_heat_summary": "", "market_value_summary": "", "injury_or_lineup_notes": "",
    "motivation_or_schedule_notes": "参考最近交锋", "list_odds_win": "1.5", "list_odds_draw": "3.5", "list_odds_loss": "6.0", "period": "101",
}


def analyses(spark, ids):
    names = ["match_id", *ROWS]
    return spark.createDataFrame([(i, *ROWS.values()) for i in ids], names)


def test_payload_and_text_give_equal_features(spark):
    """A snapshot taken from a text, read back, equals what the text gives; so do snapshots whose payload is unreadable."""
    rows = analyses(spark, range(6))
    shots = features.feature_snapshots(rows, F.lit("2024-01-01")).withColumn("snapshot_id", F.col("match_id") + 1)
    texts = {1: "", 2: '{"recent_home": {"points_per', 3: "[1, 2]", 4: '{"recent_home": {}, "h2h": null}'}
    spoiled = shots.where("match_id > 0")
    for i, t in texts.items():
        spoiled = spoiled.withColumn("feature_payload", F.when(F.col("match_id") == i, t).otherwise(F.col("feature_payload")))
    keep = ["recent_home", "recent_away", "split", "h2h", "market_odds", "market_probs", "strength_home", "away_rating", "form_residual_gap", "motivation_signal"]
    found = {r["match_id"]: tuple(r[k] for k in keep) for r in features.match_features(rows, spoiled).collect()}
    assert len(found) == 6 and len({repr(v) for v in found.values()}) == 1
    ratings = {round(r["home_rating"], 2) for r in features.match_features(rows, spoiled).collect()}  # stored ones have three digits
    assert len(ratings) == 1
    first = found[0]
    assert first[0]["points_per_game"] == 2.0 and first[4]["home"] == 2.1 and first[7] == 1500.0 and first[9] == 0.15


def test_payload_wins_group_by_group(spark):
    payload = {"recent_home": {"points_per_game": "3"}, "lineup_raw": {"home_missing": ["A"]}}
    shots = spark.createDataFrame([(1, 5, "b", json.dumps(payload)), (1, 9, "a", "{}")], "match_id long, snapshot_id long, snapshot_at string, feature_payload string")
    shots = shots.withColumns({c: F.lit(1600.0) for c in ("home_rating", "away_rating", "rest_days_home", "rest_days_away")} | {c: F.lit(0) for c in ("schedule_load_home", "schedule_load_away")})
    row = features.data_quality(features.match_features(analyses(spark, [1]), shots)).first()
    assert row["recent_home"]["points_per_game"] == 3.0 and row["recent_home"]["matches"] == 0 and row["recent_away"]["matches"] == 8
    assert row["feature_snapshot_id"] == 5 and row["check_lineup"] and "recent_form" in row["problems"]


def copies(spark):
    feedback = [("a", 7, 1, "m1", 1.0), ("a", 8, 2, "m1", 2.0), ("a", 9, 3, None, 3.0), ("b", 7, 1, "m2", 4.0), ("b", 8, 2, "m0", 5.0), ("b", 9, 4, "m3", 6.0)]
    runs = [("a", 1, "m1", "12", 5), ("a", 2, "m1", "3", 0), ("a", 3, None, "1", 0), ("b", 1, "m2", "2", 5), ("b", 2, "m0", "2", 0), ("b", 4, "m3", " ", 0)]
    return {
        "feedback": spark.createDataFrame(feedback, "source string, feedback_id long, prediction_run_id long, match_id string, amount double"),
        "runs": spark.createDataFrame(runs, "source string, run_id long, match_id string, period string, feature_snapshot_id long"),
        "snapshots": spark.createDataFrame([("a", 5, "m1"), ("b", 6, "m2")], "source string, snapshot_id long, match_id string"),
        "matches": spark.createDataFrame([("a", "m1", 1.0), ("b", "m1", 9.0), ("b", "m2", 2.0)], "source string, match_id string, price double"),
    }


def test_import_hands_out_keys_and_is_idempotent(spark):
    stored = {
        "feedback": spark.createDataFrame([(100, 200, "m0", 0.0, "x")], "feedback_id long, prediction_run_id long, match_id string, amount double, note string"),
        "runs": spark.createDataFrame([(200, "m0", "1", 0)], "run_id long, match_id string, period string, feature_snapshot_id long"),
        "snapshots": spark.createDataFrame([(300, "m0")], "snapshot_id long, match_id string"), "matches": spark.createDataFrame([("m2", 7.0)], "match_id string, price double"),
    }
    new, counters = history.import_history(stored, copies(spark))
    assert sorted(tuple(r) for r in counters.collect()) == [("a", 1, 1, 1, 1), ("b", 1, 1, 0, 1)]
    assert sorted(tuple(r) for r in new["feedback"].collect()) == [(101, 201, "m1", 2.0, None), (102, 202, "m2", 4.0, None)]
    assert sorted(tuple(r) for r in new["runs"].collect()) == [(201, "m1", "3", 0), (202, "m2", "2", 0)]  # b has no snapshot 5
    assert new["snapshots"].count() == 0 and [tuple(r) for r in new["matches"].collect()] == [("m1", 1.0)]
    after = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in history.imported(stored, new).items()}
    again, counters = history.import_history(after, copies(spark))
    assert all(t.count() == 0 for t in again.values()) and {r["imported"] for r in counters.collect()} == {0}


def test_transition_table():
    assert [resolution.moved("down", a, t) for a in range(3) for t in range(3)] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert [resolution.moved("up", a, t) for a in range(3) for t in range(3)] == [0, 1, 1, 1, 1, 2, 2, 2, 2]


CASES = [
    # algorithm, review, arbiter, expert -> final, effective, source, status
    (("main", "keep", "main"), None, None, "main", "main", "model", "executable"),
    (("main", "downgrade", "watch"), None, None, "light", "light", "model", "executable"),
    (("light", "promote", "main"), None, None, "main", "main", "model", "executable"),
    (("watch", "promote", "main"), None, None, "watch", "watch", "model", "executable"),
    (("main", "abstain", "main"), None, None, "watch", "watch", "model", "executable"),
    (("main", "downgrade", "watch"), ("allow_with_uplift", "main"), None, "watch", "main", "arbiter_uplift", "arbiter_uplifted"),
    (("light", "keep", "light"), ("allow_with_uplift", "main"), None, "light", "light", "model", "executable"),
    (("main", "keep", "main"), ("downgrade", "main"), None, "main", "light", "arbiter", "arbiter_downgraded"),
    (("main", "keep", "main"), ("manual_review", "main"), None, "watch", "", "", "manual_review_pending"),
    (("main", "keep", "main"), ("manual_review", "main"), ("completed", "light", 0.5), "watch", "light", "expert_llm", "expert_review_resolved"),
    (("main", "keep", "main"), ("manual_review", "main"), ("failed", "light", 0.5), "watch", "watch", "expert_llm_failed", "expert_review_failed"),
    (("main", "keep", "main"), ("skip", "main"), None, "watch", "watch", "arbiter", "arbiter_downgraded"),
]


def test_resolved_actions(spark):
    rows = []
    for i, ((algo, decision, target), arb, expert, *_) in enumerate(CASES):
        rows.append((i, algo, "home", 0.2, 0.1, 0.7, 2.0, False, 0.9, 0.9, 0.1, 0.05, 0.8, 0.9, "completed", decision, target, "strong", None, 0.0, "confirm", "", "completed" if arb else None, *(arb or (None, None)), "r", *((expert[0], expert[1], "strong", expert[2]) if expert else (None, None, None, None))))
    names = (
        "id int, policy_action string, policy_outcome string, policy_ev double, policy_bias double, policy_confidence double, policy_stake double, favourite_guard boolean, policy_score double, quality_score double, _kelly double, _gap double,"
        " _quality double, _agreement double, review_status string, review_decision string, review_target_action string, review_evidence_grade string, review_stake_multiplier double, review_confidence_delta double, review_outcome_decision string,"
        " review_target_outcome string, arbiter_status string, arbiter_decision string, arbiter_target_action string, arbiter_reason string, expert_status string, expert_target_action string, expert_evidence_grade string, expert_stake_multiplier double"
    )
    got = resolution.resolve_actions(spark.createDataFrame(rows, names), at=F.lit("now")).orderBy("id").collect()
    assert [(r["final_action"], r["effective_recommendation"], r["effective_action_source"], r["execution_status"]) for r in got] == [c[3:] for c in CASES]
    assert got[9]["effective_stake_pct"] == pytest.approx(0.5 * min(1.5, got[0]["final_stake"]), abs=0.4) and got[8]["manual_review_reason"] == "r"


def test_first_alternative_that_passes_decides(spark):
    rows = queries_profile.settled(spark, SF).limit(200)
    never, first, second = {"odds_max": 0.5}, {"direction_source": "low_odds"}, {"direction_source": "current"}
    texts = {"both": json.dumps({"any_rules": [never, first, second], "stake_pct": 2}), "one": json.dumps({**first, "stake_pct": 2}), "none": json.dumps({"any_rules": [never]}), "broken": "{"}
    got = {(r["match_id"], r["strategy"]): r for r in profile.replay(rows, texts).collect()}
    ids = {m for m, _ in got}
    assert {s for _, s in got} >= {"both", "one", "none"}
    for m in ids:
        both, one, none = (got[m, s] for s in ("both", "one", "none"))
        assert (both["strategy_action"], both["strategy_outcome"], both["strategy_roi"]) == (one["strategy_action"], one["strategy_outcome"], one["strategy_roi"]) or one["strategy_action"] == "watch"
        assert none["strategy_action"] == "watch" and none["strategy_stake"] == 0.0


def test_bare_expanded_rules_are_the_base_grid(spark):
    rows = queries_learning.rows(spark, SF)
    base = {r["rule_id"]: (r["train_actions"], r["validation_hits"]) for r in learning.outcome_rules(rows).collect()}
    bare = learning.expanded_rules(rows).where("cat = 0 and struct = 0").collect()
    assert {r["rule_id"] // learning.VARIANTS_PER_RULE: (r["train_actions"], r["validation_hits"]) for r in bare} == base


def test_quadratic_equals_direct_score(spark):
    rows = queries_profile.settled(spark, SF)
    got = {(r["variant"], r["alpha"]): r["brier_score"] for r in what_if.shrinkage_what_if(rows, (0.0, 1.0)).collect()}
    assert got["constant", 1.0] == pytest.approx(got["final", 1.0], abs=2e-6) and got["constant", 0.0] == pytest.approx(got["market", 0.0], abs=2e-6)
    assert what_if.shrinkage_what_if(rows.limit(0)).count() == 0


def test_no_theta_join_for_both_teams(spark):
    plan = queries_features.both_team_metrics(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_no_shuffle_of_matches_by_league_code(spark):
    plan = queries_features.both_team_metrics(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and "_salt" in plan
    matches = spark.createDataFrame([(1, ["x", "b", "a"], ["One", "one (W)"], ["Two FC"]), (2, ["b"], ["One"], ["Three"]), (3, ["a", "b"], ["On"], ["Two"]), (4, ["a"], None, ["Two"])],
                                    "match_id long, codes array<string>, home_aliases array<string>, away_aliases array<string>")
    teams = spark.createDataFrame([("a", "One", 1, 5), ("a", "Two", 2, 6), ("b", "One", 1, 7), ("b", "Four", 2, 8)], "code string, title string, place long, games long")
    got = sorted(tuple(r) for r in joins.both_team_metrics(matches, teams, ["games"]).collect())
    assert got == [(1, "a", "One", "Two", 5, 6), (3, "a", "One", "Two", 5, 6)]


def test_wide_rows_are_dealt_in_proportion_to_the_input(spark):
    orders = adapters.table(spark, SF, "orders")
    assert adapters.wide(spark, SF).rdd.getNumPartitions() >= adapters.TASKS_PER_SPLIT * orders.rdd.getNumPartitions()


def test_medians_take_one_shuffle_and_read_a_line_once(spark):
    lines = spark.createDataFrame([(1, "a 1.50 3.10 5.00 1.60 3.20 4.80\nb 1.70 3.30 5.20 1.40 3.00 5.60\nc 9.99"), (2, "a 2.00 3.00 4.00 2.10 3.10 3.90 7.00"), (3, None)], "id long, line string")
    found = extract.median_odds(extract.bookmaker_rows(lines, "id", "line"), "id")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1.6, 3.2, 5.1, 1.5, 3.1, 5.2, -0.1, -0.1, 0.1), (2, 2.0, 3.0, 4.0, 2.1, 3.1, 3.9, 0.1, 0.1, -0.1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_levels_are_known():
    assert set(resolution.LEVELS) == set(V.ACTIONS)
