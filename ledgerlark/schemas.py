"""Declared schemas of the ledger's base tables.

Readers use these, so a missing column is added with its default instead of
being inferred; empty string and 0 mean "missing" at rest.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**groups: str) -> T.StructType:
    """``kind="a b c"`` -> fields of that kind, in the order given."""
    kinds = {
        "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
        "timestamp": T.TimestampType(),
    }
    fields = []
    for kind, names in groups.items():
        fields += [T.StructField(n, kinds[kind.split("_")[0]], True) for n in names.split()]
    return T.StructType(fields)


MATCHES = _struct(
    long="match_id", string="period league match_no", timestamp="match_time",
    string_2="home_team away_team source_url list_odds_win list_odds_draw list_odds_loss",
    timestamp_2="sync_time", string_3="actual_result actual_score result_status result_source_url",
    timestamp_3="result_synced_at",
)
ANALYSES = _struct(
    long="match_id", timestamp="collected_at",
    string=(
        "elo_home elo_away market_value_summary recent_form_home recent_form_away home_away_form head_to_head_summary "
        "injury_or_lineup_notes motivation_or_schedule_notes european_odds_movement_summary asian_handicap_summary "
        "betting_heat_summary media_source_links collected_sources collection_quality_summary remarks"
    ),
)
RUNS = _struct(
    long="run_id match_id", timestamp="created_at", string="period",
    double="final_home_prob final_draw_prob final_away_prob market_odds_home market_odds_draw market_odds_away quality_score confidence_score",
    string_2="recommendation recommended_outcome", double_2="suggested_stake_pct",
    string_3="effective_recommendation", double_3="effective_stake_pct", string_4="effective_action_source manual_review_status",
    string_5="handicap_recommendation handicap_recommended_side", double_4="handicap_line handicap_home_odds handicap_away_odds",
)
FEEDBACK = _struct(
    long="feedback_id run_id match_id", string="actual_result actual_score", timestamp="settled_at",
    int="hit_recommendation", double="roi_delta", string_2="handicap_actual_result", int_2="handicap_hit",
    double_2="handicap_roi_delta", string_3="roi_source notes",
)
TOP_PICKS = _struct(
    string="period", int="rank", long="match_id run_id",
    double="composite_score confidence_score ev_score quality_score", string_2="reason",
)
PROFILES = _struct(
    long="profile_id", timestamp="event_at", string="status calibrator_params threshold_params train_metrics validation_metrics",
)
RESULT_COLUMNS = ("actual_result", "actual_score", "result_status", "result_source_url", "result_synced_at")
MUTABLE_RUN_COLUMNS = (
    "recommendation", "recommended_outcome", "suggested_stake_pct", "effective_recommendation", "effective_stake_pct",
    "effective_action_source", "manual_review_status", "handicap_recommendation", "handicap_recommended_side",
    "handicap_line", "handicap_home_odds", "handicap_away_odds",
)
