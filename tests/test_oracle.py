"""A slice of the catalogue against DuckDB on the smallest scale; the driver checks all of it."""

import math

import pytest
from conftest import SF

from ledgerlark.plans.catalogue import ORACLES, QUERIES

FAST = [
    "model_scores_by_league", "feedback_summary_by_period", "executed_action_metrics", "backtest_filter_set", "action_policy_rows",
    "current_policy_replay", "strategy_picks", "strategy_comparison", "rolling_report", "observation_deltas", "coverage_fill_candidates",
    "upsert_match_feed", "replace_forecast_runs", "update_run_fields", "profile_states", "cascade_delete_counts", "import_counters",
    "canonical_runs", "asof_latest_run", "resolve_team_names", "period_top_picks", "settled_top_picks", "settle_batch",
    "chain_audit_findings", "fit_calibrator", "handicap_rule_grid", "fit_outcome_rules", "fit_handicap_buckets", "extract_market_quotes",
    "extract_lineups", "bookmaker_median_odds", "stored_review_payloads", "loose_match_times", "goal_model", "handicap_cover_probabilities",
    "fit_expanded_outcome_rules", "both_team_metrics", "feature_snapshots", "match_features", "data_quality_scores", "imported_runs", "history_counters", "resolved_actions", "or_rule_metrics", "profile_replay",
    "collection_failure_reasons", "retry_summary", "resolve_reviews", "rejected_decisions", "gate_search_totals", "shrinkage_what_if", "orphan_rows", "import_settlements",
]


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.4f}".replace("-0.0000", "0.0000")
    return str(value)


def _same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: [_key(v) for v in r])
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=lambda r: [_key(v) for v in r])
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not any(n.startswith("op") and n[2:].isdigit() for n in QUERIES)
