"""Building blocks of the DuckDB statements the results are checked against.

Written from the rules, not generated from the Spark plans: only the adapter
view text is shared.
"""

from __future__ import annotations

import re

from .adapters import wide_cte


def with_ctes(body: str, *ctes: str) -> str:
    """Chained CTEs are materialised: inlining a dozen layers explodes the expressions."""
    head = re.sub(r"\b(\w+) AS \(\s*SELECT", r"\1 AS MATERIALIZED (SELECT", ", ".join(ctes))
    return f"WITH {head} {body}"


def with_wide(body: str, *ctes: str) -> str:
    return with_ctes(body, wide_cte(), *ctes)


def ratio(a: str, b: str, digits: int = 6) -> str:
    return f"coalesce(round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits}), 0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def argmax(h: str, d: str, a: str) -> str:
    return f"(CASE WHEN {h} >= {d} AND {h} >= {a} THEN 'home' WHEN {d} >= {a} THEN 'draw' ELSE 'away' END)"


def top_gap(h: str, d: str, a: str) -> str:
    """Best minus second best, via a sorted list."""
    return f"(list_sort([{h}, {d}, {a}], 'DESC')[1] - list_sort([{h}, {d}, {a}], 'DESC')[2])"


def by_outcome(outcome: str, h: str, d: str, a: str, other: str = "0e0") -> str:
    return f"(CASE {outcome} WHEN 'home' THEN {h} WHEN 'draw' THEN {d} WHEN 'away' THEN {a} ELSE {other} END)"


def odds_of(outcome: str) -> str:
    return by_outcome(outcome, "market_odds_home", "market_odds_draw", "market_odds_away")


def margin_of(outcome: str, h: str, d: str, a: str) -> str:
    return by_outcome(
        outcome, f"{h} - greatest({d}, {a})", f"{d} - greatest({h}, {a})", f"{a} - greatest({h}, {d})"
    )


def clip(x: str, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


DIRECTION = (
    "(CASE WHEN predicted_score = '' THEN ''"
    " WHEN CAST(split_part(predicted_score, '-', 1) AS INT) > CAST(split_part(predicted_score, '-', 2) AS INT) THEN 'home'"
    " WHEN CAST(split_part(predicted_score, '-', 1) AS INT) = CAST(split_part(predicted_score, '-', 2) AS INT) THEN 'draw'"
    " ELSE 'away' END)"
)
EFFECTIVE_ACTION = (
    "(CASE WHEN effective_recommendation <> '' THEN effective_recommendation"
    " WHEN manual_review_status IN ('pending', 'expired', 'superseded') THEN 'watch' ELSE recommendation END)"
)
EFFECTIVE_STAKE = (
    "(CASE WHEN effective_recommendation <> '' THEN effective_stake_pct"
    " WHEN manual_review_status IN ('pending', 'expired', 'superseded') THEN 0e0 ELSE suggested_stake_pct END)"
)


def roi(action: str, outcome: str, stake: str) -> str:
    return (
        f"(CASE WHEN {action} = 'watch' OR {stake} <= 0 THEN 0e0"
        f" WHEN {outcome} = actual_result AND {odds_of(outcome)} > 0 THEN round({stake} / 100e0 * ({odds_of(outcome)} - 1e0), 4)"
        f" WHEN {outcome} = actual_result THEN 0e0 ELSE round(-{stake} / 100e0, 4) END)"
    )


def _settled() -> str:
    goal = lambda i: f"CAST(split_part(actual_score, '-', {i}) AS INT)"
    odds = "(CASE WHEN handicap_recommended_side = 'home' THEN handicap_home_odds ELSE handicap_away_odds END)"
    return f"""
settled_a AS (
  SELECT *, {EFFECTIVE_ACTION} AS effective_action, {EFFECTIVE_STAKE} AS effective_stake,
         CAST({goal(1)} - {goal(2)} AS DOUBLE) + handicap_line AS adjusted,
         CASE WHEN {odds} > 0 AND {odds} < 1.5 THEN {odds} + 1e0 ELSE {odds} END AS side_odds
  FROM wide),
settled_b AS (
  SELECT *, CAST(recommended_outcome = actual_result AS INT) AS hit_recommendation,
         {roi('effective_action', 'recommended_outcome', 'effective_stake')} AS roi_delta,
         CASE WHEN adjusted > 0 THEN 'home' WHEN adjusted < 0 THEN 'away' ELSE 'push' END AS handicap_actual_result,
         CASE WHEN suggested_stake_pct > 0 THEN suggested_stake_pct WHEN effective_action = 'watch' THEN 0e0
              ELSE effective_stake END / 100e0 AS handicap_units
  FROM settled_a),
settled AS (
  SELECT *,
         CAST(handicap_recommendation <> 'watch' AND handicap_actual_result = handicap_recommended_side AS INT) AS handicap_hit,
         CASE WHEN handicap_recommendation = 'watch' OR handicap_actual_result = 'push' THEN 0e0
              WHEN handicap_actual_result = handicap_recommended_side AND side_odds > 0
                   THEN round(handicap_units * (side_odds - 1e0), 4)
              ELSE round(-handicap_units, 4) END AS handicap_roi_delta
  FROM settled_b)"""


SETTLED = _settled()

# --- strategies --------------------------------------------------------------


def _pick(outcome: str, tier: str, reason: str, stake: str = "1e0") -> str:
    return f"{{'outcome': {outcome}, 'tier': '{tier}', 'reason': {reason}, 'stake': {stake}}}"


def _watch(reason: str) -> str:
    return _pick("''", "watch", reason, "0e0")


def _chain() -> list[tuple[str, str]]:
    o = lambda v: f"{v}.outcome"
    r = lambda v: f"{v}.reason"
    veto = lambda parent, *rules: "CASE " + " ".join(f"WHEN {c} THEN {_watch(w)}" for c, w in rules) + f" ELSE {parent} END"
    fill = lambda out, why: _pick(out, "standard", f"'{why}'")
    guarded = "league IN ('挪超', '欧罗巴', '意甲')"
    mid = (
        "(steady.outcome = 'home' AND steady.reason = 'existing' AND " + odds_of("steady.outcome") + " >= 1.3 AND "
        + odds_of("steady.outcome") + " < 1.45 AND market_draw_prob >= 0.18 AND market_away_prob >= 0.13 AND h2h_edge >= 0)"
    )
    home_odds = "(mtop = 'home' AND market_odds_home >= 1.8 AND market_odds_home < 2.2)"
    thin = "(ltop = 'home' AND lgap >= 0.05 AND lgap < 0.10)"
    base = (
        "CASE WHEN act <> 'watch' AND stk > 0 AND out IN ('home', 'draw', 'away')"
        " AND NOT (out = 'away' AND (dir <> 'away' OR gf_gap > -0.6)) THEN " + _pick("out", "core", "'existing'", "stk")
        + " WHEN ltop = 'away' AND mgap >= 0.16 AND confidence_score <= 0.86 AND legacy_away_prob >= 0.40 AND gf_gap >= -0.8 THEN "
        + fill("'away'", "R1_legacy_away")
        + " WHEN mtop = 'home' AND mgap >= 0.16 AND mgap <= 0.34 AND confidence_score <= 0.88 AND market_home_prob >= 0.44"
        " AND home_absent_count <= away_absent_count THEN " + fill("'home'", "R2_market_home")
        + " WHEN mtop = 'away' AND mgap >= 0.10 AND confidence_score <= 0.88 AND market_away_prob >= 0.52 THEN "
        + _pick("'away'", "core", "'R3_market_away'")
        + " WHEN dir = 'draw' AND confidence_score <= 0.82 THEN " + _pick("'draw'", "core", "'R4_score_draw'")
        + f" ELSE {_watch(chr(39) + 'watch' + chr(39))} END"
    )
    lit = lambda s: f"'{s}'"
    return [
        ("base", base),
        ("league_guarded", veto("base", (f"{o('base')} <> '' AND {guarded}", lit("league_guard")))),
        ("selective", veto("base", (
            f"{o('base')} = 'home' AND {r('base')} = 'existing' AND (confidence_score > 0.90"
            " OR home_absent_count - away_absent_count > 2 OR h2h_edge < 0)", lit("selective_existing_home_guard")))),
        ("selective_league_guarded", veto("selective", (f"{o('selective')} <> '' AND {guarded}", lit("league_guard")))),
        ("strict", veto("selective_league_guarded", (
            f"{o('selective_league_guarded')} = 'home' AND {r('selective_league_guarded')} = 'R2_market_home'"
            " AND (dir IN ('draw', 'away') OR confidence_score > 0.84)", lit("strict_R2_home_guard")))),
        ("deep", veto("strict", (
            f"{o('strict')} <> '' AND {r('strict')} = 'existing' AND dir <> '' AND dir <> {o('strict')}",
            lit("deep_existing_score_conflict_guard")))),
        ("refined", veto("deep", (
            f"{o('deep')} <> '' AND {r('deep')} = 'existing' AND league = '法甲' AND {odds_of(o('deep'))} < 1.6",
            lit("refined_existing_low_odds_league_guard")))),
        ("hardened", veto("refined", (f"{o('refined')} = 'away' AND h2h_edge <= -0.8", lit("hardened_away_h2h_guard")))),
        ("polished", veto("hardened", (
            f"{o('hardened')} = 'away' AND {r('hardened')} = 'existing' AND market_odds_away < 1.55 AND market_draw_prob > 0.21",
            lit("polished_existing_away_draw_risk_guard")))),
        ("steady", veto("polished", (
            f"{o('polished')} = 'home' AND {r('polished')} = 'R2_market_home' AND market_odds_home >= 1.5"
            " AND market_odds_home < 1.8 AND market_draw_prob >= 0.245", lit("steady_R2_home_draw_pressure_guard")))),
        ("precise", veto("steady",
            (f"{o('steady')} <> '' AND league = '英冠'", lit("precise_league_guard")),
            (f"{o('steady')} <> '' AND market_draw_prob >= 0.30", lit("precise_market_draw_pressure_guard")),
            (mid, lit("precise_existing_home_midlow_draw_risk_guard")))),
        ("rescue",
            f"CASE WHEN {o('precise')} <> '' THEN precise WHEN {o('steady')} = '' THEN steady"
            f" WHEN market_draw_prob >= 0.19 AND h2h_edge >= 0 AND {odds_of(o('steady'))} < 3.2 THEN"
            " {'outcome': steady.outcome, 'tier': steady.tier, 'reason': concat('rescue_', precise.reason), 'stake': steady.stake}"
            f" ELSE {_watch(r('precise'))} END"),
        ("broad", veto("steady",
            (mid, lit("broad_existing_home_midlow_draw_risk_guard")),
            (f"{o('steady')} <> '' AND market_draw_prob >= 0.29", lit("broad_market_draw_pressure_guard")))),
        ("cautious", veto("steady", (f"{o('steady')} <> '' AND league = '英冠'", lit("cautious_league_guard")))),
        ("ultra", veto("steady",
            (f"{r('steady')} = 'R4_score_draw' AND (market_home_prob < 0.39 OR market_away_prob > market_home_prob"
             " OR legacy_away_prob >= 0.40)", lit("ultra_draw_away_pressure_guard")),
            (mid, lit("ultra_existing_home_midlow_draw_risk_guard")))),
        ("clean", veto("steady", (
            "steady.outcome <> '' AND (rescue.outcome = '' OR broad.outcome = '' OR cautious.outcome = '' OR ultra.outcome = '')",
            lit("clean_observation_flag_guard")))),
        ("coverage_push",
            f"CASE WHEN {o('base')} <> '' THEN base WHEN {home_odds} THEN {fill(lit('home'), 'fill_market_home_odds_180_220')}"
            f" WHEN {thin} THEN {fill(lit('home'), 'fill_legacy_home_margin_05_10')} ELSE {_watch(lit('coverage_push_watch'))} END"),
        ("coverage_stable",
            f"CASE WHEN {o('base')} <> '' THEN base"
            f" WHEN {home_odds} AND league NOT IN ('西甲', '挪超') THEN {fill(lit('home'), 'fill_stable_market_home_odds_180_220')}"
            f" WHEN {thin} THEN {fill(lit('home'), 'fill_stable_legacy_home_margin_05_10')}"
            f" WHEN mtop = 'home' AND market_draw_prob >= 0.30 THEN {fill(lit('home'), 'fill_stable_market_home_draw_ge_30')}"
            f" WHEN dir <> '' AND confidence_score <= 0.80 THEN {fill('dir', 'fill_stable_score_conf80')}"
            f" ELSE {_watch(lit('coverage_stable_watch'))} END"),
        ("coverage_refined",
            "CASE WHEN coverage_stable.outcome <> '' AND NOT (coverage_stable.outcome = 'home' AND market_draw_prob >= 0.31) THEN coverage_stable"
            f" WHEN mtop = 'home' AND market_home_prob >= 0.50 AND market_draw_prob < 0.22 THEN {fill(lit('home'), 'fill_refined_market_home_prob50_low_draw')}"
            f" ELSE {_watch(lit('coverage_refined_watch'))} END"),
        ("coverage_value_guarded",
            "CASE WHEN coverage_refined.outcome <> '' AND NOT (coverage_refined.outcome = 'home'"
            " AND starts_with(coverage_refined.reason, 'fill_') AND value_ratio >= 3) THEN coverage_refined"
            f" WHEN {home_odds} AND dir = 'home' AND (value_ratio = 0 OR value_ratio >= 0.9) THEN"
            f" {fill(lit('home'), 'fill_value_guarded_home_odds_180_220_score_home')} ELSE {_watch(lit('coverage_value_guarded_watch'))} END"),
        ("coverage_xg_guarded", veto("coverage_value_guarded", (
            "coverage_value_guarded.outcome = 'home' AND starts_with(coverage_value_guarded.reason, 'fill_') AND xg_on AND xg_gap < -0.5",
            lit("xg_guarded_home_fill_net_gap_guard")))),
    ]


def _picks() -> str:
    lp = ("legacy_home_prob", "legacy_draw_prob", "legacy_away_prob")
    mp = ("market_home_prob", "market_draw_prob", "market_away_prob")
    batch = "effective_action_source = 'target_batch_strategy'"
    ctes = [f"""p0 AS (SELECT *,
  CASE WHEN {batch} THEN algo_recommendation ELSE {EFFECTIVE_ACTION} END AS act,
  CASE WHEN {batch} THEN algo_recommended_outcome ELSE recommended_outcome END AS out,
  CASE WHEN {batch} THEN algo_suggested_stake_pct ELSE {EFFECTIVE_STAKE} END AS stk,
  {argmax(*lp)} AS ltop, {top_gap(*lp)} AS lgap, {argmax(*mp)} AS mtop, {top_gap(*mp)} AS mgap, {DIRECTION} AS dir,
  recent_home_gf_pg - recent_away_gf_pg AS gf_gap, home_split_ppg - away_split_ppg AS split_gap,
  (home_xg - home_xga) - (away_xg - away_xga) AS xg_gap, xg_coverage <> 0 AS xg_on FROM wide)"""]
    names = [name for name, _ in _chain()]
    for i, (name, expr) in enumerate(_chain()):
        ctes.append(f"p{i + 1} AS (SELECT *, {expr} AS {name} FROM p{i})")
    last = f"p{len(names)}"
    cvg = "coverage_value_guarded"
    ctes.append(f"""cand AS (SELECT *,
  {cvg}.outcome <> '' AND NOT ({cvg}.outcome = 'home' AND starts_with({cvg}.reason, 'fill_') AND xg_on AND xg_gap < 0.25) AS kept,
  CASE WHEN mtop = 'home' AND dir = 'home' THEN 'home' WHEN dir = 'draw' AND market_draw_prob >= 0.27 THEN 'draw'
       WHEN mtop = 'away' AND dir = 'away' THEN 'away' END AS c_out,
  CASE WHEN mtop = 'home' AND dir = 'home' THEN
         greatest(0, market_home_prob - 0.44) * 10e0 + greatest(0, 0.30 - market_draw_prob) * 5e0 + greatest(0, split_gap) * 0.5
         + CASE WHEN xg_on THEN greatest(0, xg_gap) * 0.8 ELSE 0 END
         + CASE WHEN market_odds_home >= 1.5 AND market_odds_home < 2.3 THEN 0.8 ELSE 0 END
         - CASE WHEN value_available <> 0 AND value_ratio >= 8 THEN 1.2 ELSE 0 END
       WHEN dir = 'draw' AND market_draw_prob >= 0.27 THEN
         (market_draw_prob - 0.27) * 8e0 + (0.5 - least(abs(xg_gap), 0.5)) * 0.5
         + CASE WHEN market_odds_draw >= 2.8 AND market_odds_draw < 3.6 THEN 0.5 ELSE 0 END
       WHEN mtop = 'away' AND dir = 'away' THEN
         greatest(0, market_away_prob - 0.44) * 10e0 + greatest(0, 0.28 - market_draw_prob) * 4e0
         - CASE WHEN value_available <> 0 AND value_ratio > 1.2 THEN 1e0 ELSE 0 END END AS c_score
  FROM {last})""")
    ctes.append("""best AS (SELECT match_id AS best_id, row_number() OVER (PARTITION BY period ORDER BY c_score DESC, feedback_id DESC) AS rn
  FROM cand WHERE NOT kept AND c_score >= 2)""")
    ctes.append(f"""picks AS (SELECT cand.*, CASE WHEN kept THEN {cvg}
  WHEN best_id IS NOT NULL THEN {_pick('c_out', 'standard', "concat('draw_rescue_rank_', c_out)")}
  WHEN c_out = 'draw' AND c_score >= 0.5 AND (NOT xg_on OR xg_gap >= 0.5) AND split_gap >= 0 THEN
       {_pick("'draw'", 'standard', "'draw_rescue_xg_split_draw'")}
  ELSE {_watch("'coverage_draw_rescue_watch'")} END AS coverage_draw_rescue
  FROM cand LEFT JOIN best ON match_id = best_id AND rn = 1)""")
    return ",\n".join(ctes)


PICKS = _picks()
VARIANTS = [name for name, _ in _chain()] + ["coverage_draw_rescue"]


def facts(pick: str) -> str:
    """Additive facts of one pick column."""
    odds = odds_of(f"{pick}.outcome")
    return (
        f"CAST({pick}.outcome <> '' AND {pick}.outcome = actual_result AS BIGINT) AS hit,"
        f" {pick}.stake / 100e0 AS units,"
        f" CASE WHEN {pick}.outcome = '' THEN 0e0 WHEN {pick}.outcome = actual_result AND {odds} > 0"
        f" THEN {pick}.stake / 100e0 * ({odds} - 1e0) ELSE -({pick}.stake / 100e0) END AS roi"
    )


def variant_periods(variants=None) -> str:
    arms = " UNION ALL ".join(
        f"SELECT '{v}' AS variant, period, CAST({v}.outcome <> '' AS BIGINT) AS acted, {facts(v)} FROM picks"
        for v in (variants or VARIANTS)
    )
    return (
        f"long_picks AS ({arms}), vp AS (SELECT variant, period, count(*) AS samples, {big('sum(acted)')} AS actions,"
        f" {big('sum(hit)')} AS hits, sum(roi) AS roi, sum(units) AS stake FROM long_picks GROUP BY 1, 2)"
    )


WINDOWS = f"""
vr AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY CAST(period AS BIGINT), period) AS rank,
              count(*) OVER (PARTITION BY variant) AS periods FROM vp),
win_sums AS (SELECT variant, rank, period AS end_period,
         first_value(period) OVER w AS start_period, {big('sum(actions) OVER w')} AS actions, {big('sum(hits) OVER w')} AS hits,
         sum(roi) OVER w AS roi, sum(stake) OVER w AS stake FROM vr
         WINDOW w AS (PARTITION BY variant ORDER BY rank ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
win AS (SELECT *, {ratio('hits', 'actions')} AS hit_rate, {ratio('roi', 'stake')} AS roi_on_stake FROM win_sums WHERE rank >= 10)"""

PICK_METRICS = (
    f"count(*) AS action_count, {big('sum(hit)')} AS hit_count, {big('count(*) - sum(hit)')} AS miss_count,"
    f" {ratio('sum(hit)', 'count(*)')} AS hit_rate, round(sum(roi), 6) AS total_roi, {ratio('sum(roi)', 'sum(units)')} AS roi_on_stake"
)
FLAGS = (
    "list_filter([CASE WHEN rescue.outcome = '' THEN 'rescue' END, CASE WHEN broad.outcome = '' THEN 'broad' END,"
    " CASE WHEN cautious.outcome = '' THEN 'cautious' END, CASE WHEN ultra.outcome = '' THEN 'ultra' END], lambda x: x IS NOT NULL)"
)
ODDS_BAND = lambda x: (
    f"CASE WHEN {x} <= 0 THEN 'unknown' WHEN {x} < 1.6 THEN '<1.60' WHEN {x} < 2 THEN '1.60-1.99'"
    f" WHEN {x} < 2.5 THEN '2.00-2.49' WHEN {x} < 3 THEN '2.50-2.99' ELSE '>=3.00' END"
)


def production_actions(strategy: str = "steady") -> str:
    return (
        f"prod AS (SELECT *, {strategy}.outcome AS outcome, {strategy}.reason AS reason, {strategy}.tier AS tier,"
        f" {odds_of(strategy + '.outcome')} AS pick_odds, {facts(strategy)}, {FLAGS} AS flags"
        f" FROM picks WHERE {strategy}.outcome <> '')"
    )
