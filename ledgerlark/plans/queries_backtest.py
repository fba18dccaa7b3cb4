"""Back-test, strategy comparison and observation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import ratio as spark_ratio
from ..functions.numeric import round_to
from ..operators import metrics, observation, stability, strategies
from . import adapters
from .oracle import (
    DIRECTION, EFFECTIVE_ACTION, EFFECTIVE_STAKE, FLAGS, ODDS_BAND, PICK_METRICS, PICKS, SETTLED, VARIANTS, WINDOWS,
    argmax, big, by_outcome, clip, facts, margin_of, odds_of, production_actions, ratio, roi, top_gap, variant_periods,
    with_wide,
)
from .registry import query


def settled(spark, sf_dir):
    return metrics.with_settlement(adapters.wide(spark, sf_dir))


def picks(spark, sf_dir):
    return strategies.all_picks(adapters.wide(spark, sf_dir))


def row_picks(spark, sf_dir, upto=None):
    return strategies.row_picks(adapters.wide(spark, sf_dir), upto)


# --- proper scores and action metrics ---------------------------------------


def _score_arm(name, prefix):
    h, d, a = (f"{prefix}_{o}_prob" for o in ("home", "draw", "away"))
    ind = lambda o: f"CASE WHEN actual_result = '{o}' THEN 1e0 ELSE 0e0 END"
    return (
        f"SELECT league, '{name}' AS model, (pow({h} - {ind('home')}, 2) + pow({d} - {ind('draw')}, 2) + pow({a} - {ind('away')}, 2)) / 3e0 AS brier,"
        f" -ln(greatest({by_outcome('actual_result', h, d, a)}, 1e-6)) AS ll,"
        f" CAST({argmax(h, d, a)} = actual_result AS INT) AS hit FROM wide"
    )


_SCORES = "scores AS (" + " UNION ALL ".join(
    _score_arm(n, p) for n, p in (("market", "market"), ("legacy", "legacy"), ("independent", "final"))
) + ")"
_SCORE_COLS = "count(*) AS sample_count, round(avg(brier), 6) AS brier_score, round(avg(ll), 6) AS log_loss, round(avg(hit), 6) AS hit_rate"


@query("model_scores_by_league", with_wide(f"SELECT league, model, {_SCORE_COLS} FROM scores GROUP BY 1, 2", _SCORES))
def model_scores_by_league(spark, sf_dir):
    return metrics.model_scores(adapters.wide(spark, sf_dir), ["league"])


@query("model_scores", with_wide(f"SELECT model, {_SCORE_COLS} FROM scores GROUP BY 1", _SCORES))
def model_scores(spark, sf_dir):
    return metrics.model_scores(adapters.wide(spark, sf_dir))


_SUMMARY_ACTED = "handicap_recommendation <> 'watch'"
_SUMMARY = f"""count(*) AS total_predictions, {big('sum(hit_recommendation)')} AS hit_predictions,
 {big('count(*) - sum(hit_recommendation)')} AS miss_predictions, {ratio('sum(hit_recommendation)', 'count(*)')} AS hit_rate,
 round(sum(roi_delta), 6) AS total_roi, {ratio('sum(roi_delta)', 'count(*)')} AS avg_roi,
 count(*) FILTER ({_SUMMARY_ACTED}) AS handicap_total_predictions,
 count(*) FILTER ({_SUMMARY_ACTED} AND handicap_hit = 1) AS handicap_hit_predictions,
 count(*) FILTER ({_SUMMARY_ACTED} AND handicap_hit <> 1) AS handicap_miss_predictions,
 {ratio(f'count(*) FILTER ({_SUMMARY_ACTED} AND handicap_hit = 1)', f'count(*) FILTER ({_SUMMARY_ACTED})')} AS handicap_hit_rate,
 round(sum(handicap_roi_delta) FILTER ({_SUMMARY_ACTED}), 6) AS handicap_total_roi,
 {ratio(f'sum(handicap_roi_delta) FILTER ({_SUMMARY_ACTED})', f'count(*) FILTER ({_SUMMARY_ACTED})')} AS handicap_avg_roi"""


@query("feedback_summary", with_wide(f"SELECT {_SUMMARY} FROM settled", SETTLED))
def feedback_summary(spark, sf_dir):
    return metrics.feedback_summary(settled(spark, sf_dir))


@query("feedback_summary_by_period", with_wide(f"SELECT period, {_SUMMARY} FROM settled GROUP BY 1", SETTLED))
def feedback_summary_by_period(spark, sf_dir):
    return metrics.feedback_summary(settled(spark, sf_dir), ["period"])


@query("settlement_rows", with_wide(
    "SELECT match_id, run_id, effective_action, effective_stake, hit_recommendation, round(roi_delta, 4) AS roi_delta,"
    " handicap_actual_result, handicap_hit, round(handicap_roi_delta, 4) AS handicap_roi_delta FROM settled", SETTLED))
def settlement_rows(spark, sf_dir):
    return settled(spark, sf_dir).select(
        "match_id", "run_id", "effective_action", "effective_stake", "hit_recommendation", "roi_delta",
        "handicap_actual_result", "handicap_hit", "handicap_roi_delta",
    )


def _action_sql(action, outcome, stake, value=None, acted=None, extra="", group=""):
    acted = acted or f"{action} <> 'watch'"
    value = value or roi(action, outcome, stake)
    f = f"FILTER ({acted})"
    return (
        f"SELECT {extra} count(*) AS sample_count, count(*) {f} AS action_count,"
        f" {ratio(f'count(*) FILTER ({acted} AND {outcome} = actual_result)', f'count(*) {f}')} AS hit_rate,"
        f" coalesce(round(sum({value}) {f}, 6), 0) AS total_roi, {ratio(f'sum({value}) {f}', f'count(*) {f}')} AS avg_roi,"
        f" {ratio(f'sum({stake}) {f}', f'count(*) {f}')} AS avg_stake_pct FROM settled {group}"
    )


@query("algorithm_action_metrics", with_wide(
    _action_sql("algo_recommendation", "algo_recommended_outcome", "algo_suggested_stake_pct", extra="league,", group="GROUP BY league"), SETTLED))
def algorithm_action_metrics(spark, sf_dir):
    return metrics.algorithm_metrics(settled(spark, sf_dir), ["league"])


@query("executed_action_metrics", with_wide(
    _action_sql("effective_action", "recommended_outcome", "effective_stake", value="roi_delta",
                acted="effective_action <> 'watch' AND effective_stake > 0", extra="period,", group="GROUP BY period"), SETTLED))
def executed_action_metrics(spark, sf_dir):
    return metrics.executed_metrics(settled(spark, sf_dir), ["period"])


_BUCKET = (
    "CASE WHEN review_status = 'failed' THEN 'failed' WHEN review_status = 'skipped' OR review_decision IN ('abstain', '')"
    " THEN 'skipped' ELSE review_decision END"
)


@query("review_bucket_metrics", with_wide(
    _action_sql("recommendation", "recommended_outcome", "suggested_stake_pct", value="roi_delta",
                extra=f"{_BUCKET} AS review_bucket,", group="GROUP BY 1"), SETTLED))
def review_bucket_metrics(spark, sf_dir):
    return metrics.review_metrics(settled(spark, sf_dir))


_EV = by_outcome("recommended_outcome", "ev_home", "ev_draw", "ev_away")


@query("backtest_filter_set", with_wide(
    f"SELECT {_SUMMARY} FROM settled WHERE league = '英超' AND strftime(created_at, '%Y-%m-%d %H:%M:%S') LIKE '1997%'"
    f" AND {odds_of('recommended_outcome')} >= 1.4 AND {odds_of('recommended_outcome')} <= 3.5"
    f" AND confidence_score >= 0.60 AND {_EV} >= -0.20", SETTLED))
def backtest_filter_set(spark, sf_dir):
    rows = metrics.backtest_filter(
        adapters.wide(spark, sf_dir), league="英超", month="1997", odds_min=1.4, odds_max=3.5, confidence_min=0.60, ev_min=-0.20
    )
    return metrics.feedback_summary(metrics.with_settlement(rows))


@query("latest_settled_rows", with_wide(
    f"SELECT match_id, feedback_id, period, round({odds_of('recommended_outcome')}, 6) AS recommended_odds, round({_EV}, 6) AS recommended_ev"
    f" FROM wide WHERE {_EV} >= 0 ORDER BY feedback_id DESC LIMIT 50"))
def latest_settled_rows(spark, sf_dir):
    from ..functions import probs
    from ..functions.numeric import num

    rows = metrics.backtest_filter(adapters.wide(spark, sf_dir), ev_min=0.0, limit=50)
    return rows.select(
        "match_id", "feedback_id", "period",
        round_to(metrics.recommended(probs.market_odds()), 6).alias("recommended_odds"),
        round_to(metrics.recommended({o: num(f"ev_{o}") for o in ("home", "draw", "away")}), 6).alias("recommended_ev"),
    )


@query("positive_ev_share", with_wide(
    f"SELECT count(*) AS total_settled, round(avg(CASE WHEN {_EV} > 0 THEN 1 ELSE 0 END), 6) AS positive_ev_share FROM wide"))
def positive_ev_share(spark, sf_dir):
    return metrics.positive_ev_share(adapters.wide(spark, sf_dir))


@query("window_sample_summary", with_wide(
    f"""SELECT count(*) AS sample_count, arg_min(period, (created_at, run_id)) AS first_period, arg_max(period, (created_at, run_id)) AS last_period,
    strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_created_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_created_at,
    count(*) FILTER (actual_result = 'home') AS home_count, count(*) FILTER (actual_result = 'draw') AS draw_count,
    count(*) FILTER (actual_result = 'away') AS away_count,
    count(*) FILTER ({EFFECTIVE_ACTION} <> 'watch' AND {EFFECTIVE_STAKE} > 0) AS actionable_samples FROM wide"""))
def window_sample_summary(spark, sf_dir):
    return metrics.sample_summary(adapters.wide(spark, sf_dir))


def _cnt(c, n):
    return f"count(*) FILTER ({c}) AS {n}"


@query("review_signal_summary", with_wide(
    "SELECT *, " + ", ".join(f"{ratio(c, 'sample_count')} AS {c}_share" for c in
                             ("review_completed", "arbiter_completed", "expert_source", "arbiter_source"))
    + " FROM (SELECT count(*) AS sample_count, "
    + ", ".join([
        _cnt("review_status = 'completed'", "review_completed"), _cnt("review_decision = 'keep'", "review_keep"),
        _cnt("review_decision = 'downgrade'", "review_downgrade"), _cnt("review_decision = 'abstain'", "review_abstain"),
        _cnt("arbiter_status = 'completed'", "arbiter_completed"),
        _cnt("arbiter_decision IN ('allow', 'downgrade', 'skip', 'manual_review')", "arbiter_actioned"),
        _cnt("effective_action_source = 'expert_llm'", "expert_source"), _cnt("effective_action_source = 'arbiter'", "arbiter_source"),
    ]) + " FROM wide)"))
def review_signal_summary(spark, sf_dir):
    return metrics.review_signals(adapters.wide(spark, sf_dir))


_RAW = "CASE WHEN effective_recommendation <> '' THEN effective_recommendation ELSE recommendation END"
_RAWS = "CASE WHEN effective_recommendation <> '' THEN effective_stake_pct ELSE suggested_stake_pct END"


@query("period_action_counts", with_wide(
    f"""SELECT period, count(*) AS sample_count, count(*) FILTER (m) AS main_action_count, count(*) FILTER (NOT m) AS main_watch_count,
    count(*) FILTER (h) AS handicap_action_count, count(*) FILTER (NOT h) AS handicap_watch_count
    FROM (SELECT period, {_RAW} <> 'watch' AND {_RAWS} > 0 AS m, handicap_recommendation <> 'watch' AS h FROM wide) GROUP BY 1"""))
def period_action_counts(spark, sf_dir):
    return metrics.period_actions(adapters.wide(spark, sf_dir))


# --- current policy replay ----------------------------------------------------

_FP = ("p_home", "p_draw", "p_away")
_MP = ("market_home_prob", "market_draw_prob", "market_away_prob")
_LP = ("legacy_home_prob", "legacy_draw_prob", "legacy_away_prob")
_EVS = ("v_home", "v_draw", "v_away")


def policy_ctes(source="wide", gates=None):
    """CTEs ending in ``policy`` with policy_* columns for the default gates."""
    g = gates or {"me": 0.08, "mc": 0.58, "mb": 0.02, "mq": 0.68, "le": 0.02, "lc": 0.48, "lb": 0.005, "lq": 0.58}
    comp = lambda v, t: clip(f"({v}) / {t}", "0e0", "1e0")
    score = (
        f"round({clip(' + '.join([comp('p_ev', g['me']) + ' * 0.26', comp(f'p_conf - {g[chr(108)+chr(99)]}', '(' + str(g['mc']) + '::DOUBLE - ' + str(g['lc']) + '::DOUBLE)') + ' * 0.14', comp(f'quality_score - {g[chr(108)+chr(113)]}', '(' + str(g['mq']) + '::DOUBLE - ' + str(g['lq']) + '::DOUBLE)') + ' * 0.14', comp('p_bias', g['mb']) + ' * 0.16', comp('ev_gap', 0.08) + ' * 0.12', comp('model_agreement - 0.56', 0.28) + ' * 0.08', 'align * 0.04', comp('p_prob - 0.18', 0.18) + ' * 0.06']), '0e0', '1e0')}, 4)"
    )
    return f"""
pz AS (SELECT *, {', '.join(f"CASE WHEN calibrated_home_prob + calibrated_draw_prob + calibrated_away_prob > 0.01 THEN calibrated_{o}_prob ELSE final_{o}_prob END AS p_{o}" for o in ('home', 'draw', 'away'))} FROM {source}),
pa AS (SELECT *, {argmax(*_MP)} AS p_out,
   CASE WHEN market_odds_home > 0 THEN p_home * market_odds_home - 1e0 ELSE -1e0 END AS v_home,
   CASE WHEN market_odds_draw > 0 THEN p_draw * market_odds_draw - 1e0 ELSE -1e0 END AS v_draw,
   CASE WHEN market_odds_away > 0 THEN p_away * market_odds_away - 1e0 ELSE -1e0 END AS v_away,
   market_home_prob + market_draw_prob + market_away_prob AS m_sum FROM pz),
pb AS (SELECT *, {by_outcome('p_out', *_EVS)} AS p_ev, {by_outcome('p_out', *_FP)} AS p_prob, {odds_of('p_out')} AS p_odds,
   {by_outcome('p_out', *[f'{p} - {m} / m_sum' for p, m in zip(_FP, _MP)])} AS p_bias,
   {margin_of('p_out', *_EVS)} AS ev_gap, {margin_of('p_out', *_FP)} AS p_gap,
   abs({by_outcome('p_out', *_LP)} - {by_outcome('p_out', *_FP)}) AS gap,
   {clip(f'0.30 + quality_score * 0.34 + model_agreement * 0.26 + {top_gap(*_FP)} * 0.14', 0.18, 0.92)} AS p_conf FROM pa),
pc AS (SELECT *, CASE WHEN quality_score >= 0.70 THEN 1e0 ELSE {clip('1e0 - greatest(gap - 0.10, 0e0) / 0.20', '0e0', '1e0')} END AS align,
   p_out <> 'draw' AND p_odds > 0 AND p_odds <= 1.55 AND quality_score >= 0.58 AND model_agreement >= 0.55 AND p_prob >= 0.52 AS fav,
   CASE WHEN p_prob <= 0 OR p_odds <= 1 THEN 0e0 ELSE {clip('(p_prob * p_odds - 1e0) / (p_odds - 1e0)', '0e0', '1e0')} END AS kelly FROM pb),
pd AS (SELECT *, {score} AS p_score FROM pc),
pe AS (SELECT *,
   CASE WHEN p_out = 'draw' THEN p_odds <= 4.2 AND p_ev >= 0.18 AND p_bias >= 0.08 AND ev_gap >= 0.16 AND p_gap >= 0.06 AND p_score >= 0.9
        WHEN p_out = 'away' AND NOT fav THEN p_odds <= 2 AND p_ev >= 0.32 AND p_bias >= 0.22 AND ev_gap >= 0.7 AND p_gap >= 0.5 AND p_score >= 0.95
        WHEN p_out = 'home' AND p_odds > 1.65 AND NOT fav THEN p_ev >= 0.7 AND p_bias >= 0.35 AND ev_gap >= 0.8 AND p_gap >= 0.45 AND p_score >= 0.98
        ELSE true END AS guard FROM pd),
pf AS (SELECT *, p_ev >= {g['le']} AND p_bias >= {g['lb']} AND p_conf >= {g['lc']} AND quality_score >= {g['lq']} AND ev_gap >= 0.005
   AND p_prob >= 0.14 AND p_gap >= -0.14 AND model_agreement >= 0.55 AND (quality_score >= 0.70 OR gap <= 0.24) AND p_score >= 0.5 AND guard AS lp FROM pe),
pg AS (SELECT *, CASE WHEN fav AND NOT lp THEN CASE WHEN p_score >= 0.70 THEN 'main' ELSE 'light' END
   WHEN lp AND p_ev >= {g['me']} AND p_bias >= {g['mb']} AND p_conf >= {g['mc']} AND quality_score >= {g['mq']} AND ev_gap >= 0.03 AND p_prob >= 0.20
        AND p_gap >= -0.06 AND model_agreement >= 0.70 AND (quality_score >= 0.70 OR gap <= 0.16) AND p_score >= 0.74 AND p_out <> 'draw' THEN 'main'
   WHEN lp THEN 'light' ELSE 'watch' END AS p_action FROM pf),
policy AS (SELECT *, CASE
   WHEN p_action = 'watch' THEN 0e0
   WHEN kelly > 0 THEN round(CASE p_action WHEN 'main' THEN {clip('pct', 0.5, 4.0)} ELSE {clip('pct', 0.2, 1.5)} END, 2)
   ELSE round(CASE p_action WHEN 'main' THEN {clip('fb * 12e0', 0.5, 4.0)} ELSE {clip('fb * 6e0', 0.2, 1.5)} END, 2) END AS p_stake
 FROM (SELECT *, greatest(p_ev, 0e0) * p_conf AS fb, kelly * 0.25 * 100e0
   * {clip('0.55 + (p_conf - 0.55) * 0.45 + (p_score - 0.55) * 0.40 + (model_agreement - 0.65) * 0.25 + (quality_score - 0.65) * 0.20', 0.40, 1.30)}
   * CASE WHEN quality_score < 0.70 AND gap > 0.10 THEN {clip('1e0 - (gap - 0.10) * 1.6', 0.55, '1e0')} ELSE 1e0 END AS pct FROM pg))"""


_LOWERED = lambda cur, target: (
    f"CASE WHEN {cur} = 'main' AND {target} IN ('watch', 'light') THEN 'light'"
    f" WHEN {cur} = 'light' AND {target} = 'watch' THEN 'watch' ELSE {cur} END"
)
_GATED = f"""
replay AS (SELECT *, CASE WHEN p_action = 'watch' OR manual_review_status IN ('pending', 'expired', 'superseded') OR review_status = 'failed' THEN 'watch'
   WHEN review_status = 'completed' AND review_decision = 'abstain' AND NOT fav THEN 'watch'
   WHEN review_status = 'completed' AND review_decision = 'downgrade' AND {_LOWERED('p_action', 'review_target_action')} <> p_action
        THEN {_LOWERED('p_action', 'review_target_action')}
   WHEN arbiter_status = 'failed' OR (arbiter_status = 'completed' AND arbiter_decision IN ('skip', 'manual_review')) THEN 'watch'
   WHEN arbiter_status = 'completed' AND arbiter_decision = 'downgrade' THEN {_LOWERED('p_action', 'arbiter_target_action')}
   ELSE p_action END AS r_action FROM policy),
replayed AS (SELECT *, CASE WHEN r_action = 'watch' THEN 0e0 ELSE p_stake END AS r_stake FROM replay)"""
_RV = (
    "CASE WHEN p_out = actual_result AND p_odds > 0 THEN round(r_stake / 100e0 * (p_odds - 1e0), 4) ELSE round(-r_stake / 100e0, 4) END"
)
_RA = "FILTER (r_action <> 'watch' AND r_stake > 0)"


@query("current_policy_replay", with_wide(
    f"""SELECT coalesce(r_action, 'all') AS action, coalesce(p_out, 'all') AS outcome, count(*) AS sample_count, count(*) {_RA} AS action_count,
    {ratio(f"count(*) FILTER (r_action <> 'watch' AND r_stake > 0 AND p_out = actual_result)", f"count(*) {_RA}")} AS hit_rate,
    coalesce(round(sum({_RV}) {_RA}, 4), 0) AS total_roi, {ratio(f"sum({_RV}) {_RA}", f"count(*) {_RA}")} AS avg_roi,
    {ratio(f"sum(r_stake) {_RA}", f"count(*) {_RA}")} AS avg_stake_pct
    FROM replayed GROUP BY GROUPING SETS ((), (r_action, p_out))""", policy_ctes(), _GATED))
def current_policy_replay(spark, sf_dir):
    return metrics.current_policy_metrics(adapters.wide(spark, sf_dir))


@query("action_policy_rows", with_wide(
    "SELECT match_id, p_out AS policy_outcome, p_action AS policy_action, round(p_stake, 2) AS policy_stake, round(p_score, 4) AS policy_score,"
    " round(p_ev, 6) AS policy_ev, round(p_conf, 6) AS policy_confidence, fav AS favourite_guard,"
    " CASE WHEN p_conf >= 0.78 THEN 'low' WHEN p_conf >= 0.62 THEN 'medium' WHEN p_conf >= 0.48 THEN 'high' ELSE 'very_high' END AS risk FROM policy", policy_ctes()))
def action_policy_rows(spark, sf_dir):
    rows = metrics.current_policy_rows(adapters.wide(spark, sf_dir))
    return rows.select(
        "match_id", "policy_outcome", "policy_action", "policy_stake", "policy_score",
        round_to("policy_ev", 6).alias("policy_ev"), round_to("policy_confidence", 6).alias("policy_confidence"),
        "favourite_guard", labels.risk_level(F.col("policy_confidence")).alias("risk"),
    )


_VE, _VP = _EVS, _FP


@query("outcome_policy_rows", with_wide(
    f"""SELECT match_id, predicted AS predicted_outcome, vo AS value_outcome, p_out AS market_outcome, round(ve, 6) AS value_ev, round(vb, 6) AS value_bias,
    round({clip(' + '.join([
        clip('ve / (CASE WHEN vo = ' + chr(39) + 'draw' + chr(39) + ' THEN 0.08 ELSE 0.12 END)', '0e0', '1e0') + ' * 0.24',
        clip('vb / 0.05', '0e0', '1e0') + ' * 0.16',
        clip('vp / (CASE WHEN vo = ' + chr(39) + 'draw' + chr(39) + ' THEN 0.28 ELSE 0.36 END)', '0e0', '1e0') + ' * 0.16',
        clip('vem / 0.10', '0e0', '1e0') + ' * 0.16',
        clip('(vpm + 0.10) / 0.20', '0e0', '1e0') + ' * 0.10',
        'CASE WHEN quality_score >= 0.70 THEN 1e0 ELSE ' + clip('1e0 - greatest(vg - 0.10, 0e0) / 0.20', '0e0', '1e0') + ' END * 0.04',
        clip('quality_score / 0.82', '0e0', '1e0') + ' * 0.08',
        clip('model_agreement / 0.86', '0e0', '1e0') + ' * 0.06']), '0e0', '1e0')}, 4) AS value_score
    FROM (SELECT *, {argmax(*_FP)} AS predicted, {by_outcome('vo', *_EVS)} AS ve, {by_outcome('vo', *_FP)} AS vp,
       {by_outcome('vo', *[f'{p} - {m} / m_sum' for p, m in zip(_FP, _MP)])} AS vb, {margin_of('vo', *_EVS)} AS vem, {margin_of('vo', *_FP)} AS vpm,
       abs({by_outcome('vo', *_LP)} - {by_outcome('vo', *_FP)}) AS vg
       FROM (SELECT *, {argmax(*_EVS)} AS vo FROM pa))""", policy_ctes()))
def outcome_policy_rows(spark, sf_dir):
    from ..functions import policy

    staged = policy.outcome_policy(policy.market_position(adapters.wide(spark, sf_dir), policy.stored_probabilities()))
    return staged.select(
        "match_id", "predicted_outcome", "value_outcome", "market_outcome", round_to("value_ev", 6).alias("value_ev"),
        round_to("value_bias", 6).alias("value_bias"), "value_score",
    )


@query("backtest_report", None)
def backtest_report(spark, sf_dir):
    return metrics.report(settled(spark, sf_dir))


# --- strategies ------------------------------------------------------------------


@query("strategy_picks", with_wide(
    "SELECT match_id, " + ", ".join(f"concat_ws('|', {v}.outcome, {v}.tier, {v}.reason, CAST(CAST({v}.stake AS INT) AS VARCHAR)) AS {v}" for v in VARIANTS)
    + " FROM picks", PICKS))
def strategy_picks(spark, sf_dir):
    df = picks(spark, sf_dir)
    cols = [
        F.concat_ws("|", *[strategies.part(v, f) for f in ("outcome", "tier", "reason")],
                    strategies.part(v, "stake").cast("int").cast("string")).alias(v)
        for v in VARIANTS
    ]
    return df.select("match_id", *cols)


_COMPARE = f"""SELECT s.variant, CASE WHEN s.variant IN ('steady', 'coverage_draw_rescue') THEN 'production'
    WHEN s.variant IN ('clean', 'precise', 'rescue', 'broad', 'cautious', 'ultra', 'coverage_push', 'coverage_stable', 'coverage_refined',
                       'coverage_value_guarded', 'coverage_xg_guarded') THEN 'observation' ELSE 'candidate' END AS role,
  {big('sum(samples)')} AS sample_count, {big('sum(actions)')} AS action_count, {ratio('sum(actions)', 'sum(samples)')} AS action_share,
  {ratio('sum(hits)', 'sum(actions)')} AS hit_rate, round(sum(roi), 6) AS total_roi, {ratio('sum(roi)', 'sum(stake)')} AS roi_on_stake,
  {big('coalesce(sum(actions) FILTER (rank > periods - 10), 0)')} AS latest_10_action_count,
  {ratio('sum(hits) FILTER (rank > periods - 10)', 'sum(actions) FILTER (rank > periods - 10)')} AS latest_10_hit_rate,
  {ratio('sum(roi) FILTER (rank > periods - 10)', 'sum(stake) FILTER (rank > periods - 10)')} AS latest_10_roi_on_stake,
  coalesce(min(w.mh), 0) AS rolling_10_min_hit_rate, coalesce(min(w.mr), 0) AS rolling_10_min_roi_on_stake
  FROM vr s LEFT JOIN (SELECT variant, min(hit_rate) AS mh, min(roi_on_stake) AS mr FROM win GROUP BY 1) w ON w.variant = s.variant GROUP BY 1"""


@query("strategy_comparison", with_wide(_COMPARE, PICKS, variant_periods(), WINDOWS))
def strategy_comparison(spark, sf_dir):
    return stability.comparison(stability.variant_periods(picks(spark, sf_dir)))


@query("recommended_strategy", with_wide(
    f"""SELECT * EXCLUDE (stable, seq) FROM (SELECT t.*, rolling_10_min_hit_rate >= 0.7 AND rolling_10_min_roi_on_stake >= 0 AS stable,
      list_position([{', '.join(f"'{v}'" for v in ('base', 'league_guarded', 'selective', 'selective_league_guarded', 'strict', 'deep', 'refined', 'hardened', 'polished', 'steady', 'clean', 'precise', 'rescue', 'broad', 'cautious', 'ultra', 'coverage_push', 'coverage_stable', 'coverage_refined', 'coverage_value_guarded', 'coverage_xg_guarded', 'coverage_draw_rescue'))}], variant) AS seq
      FROM ({_COMPARE}) t WHERE action_count > 0) ORDER BY stable DESC, roi_on_stake DESC, hit_rate DESC, action_count DESC, seq LIMIT 1""",
    PICKS, variant_periods(), WINDOWS))
def recommended_strategy(spark, sf_dir):
    return stability.recommended(strategy_comparison(spark, sf_dir))


@query("rolling_windows", with_wide(
    "SELECT variant, start_period, end_period, actions, hits, hit_rate, roi_on_stake FROM win", PICKS, variant_periods(), WINDOWS))
def rolling_windows(spark, sf_dir):
    frame = stability.variant_periods(picks(spark, sf_dir))
    return stability.rolling(frame).select(
        "variant", "start_period", "end_period", "actions", "hits", "hit_rate", "roi_on_stake"
    )


@query("rolling_report", with_wide(
    """SELECT variant, count(*) AS window_count, min(hit_rate) AS min_hit_rate, min(roi_on_stake) AS min_roi_on_stake,
    round(avg(hit_rate), 6) AS avg_hit_rate, round(avg(roi_on_stake), 6) AS avg_roi_on_stake,
    arg_min(start_period, (hit_rate, rank)) AS worst_hit_start, arg_min(end_period, (hit_rate, rank)) AS worst_hit_end,
    arg_min(actions, (hit_rate, rank)) AS worst_hit_actions, arg_min(start_period, (roi_on_stake, rank)) AS worst_roi_start,
    arg_min(end_period, (roi_on_stake, rank)) AS worst_roi_end, arg_min(actions, (roi_on_stake, rank)) AS worst_roi_actions
    FROM win GROUP BY 1""", PICKS, variant_periods(), WINDOWS))
def rolling_report(spark, sf_dir):
    return stability.rolling_report(stability.variant_periods(picks(spark, sf_dir)))


def _latest(n):
    f = f"FILTER (rank > periods - {n})"
    return (
        f"{big(f'sum(samples) {f}')} AS latest{n}_samples, {big(f'sum(actions) {f}')} AS latest{n}_actions, {big(f'sum(hits) {f}')} AS latest{n}_hits,"
        f" round(sum(roi) {f}, 6) AS latest{n}_roi, round(sum(stake) {f}, 6) AS latest{n}_stake"
    )


@query("latest_period_metrics", with_wide(
    f"""SELECT variant, max(periods) AS periods, {big('sum(samples)')} AS samples, {big('sum(actions)')} AS actions, {big('sum(hits)')} AS hits,
    round(sum(roi), 6) AS roi, round(sum(stake), 6) AS stake, {_latest(6)}, {_latest(10)} FROM vr GROUP BY 1""", PICKS, variant_periods(), WINDOWS))
def latest_period_metrics(spark, sf_dir):
    s = stability.summary(stability.variant_periods(picks(spark, sf_dir)))
    return s.select(*[round_to(c, 6).alias(c) if c.endswith(("roi", "stake")) else F.col(c) for c in s.columns])


_CHUNK = "CAST(greatest(ceil(periods / 3e0), 1) AS BIGINT)"
_RANK_THIRD = f"CASE (rank - 1) // {_CHUNK} WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'recent' END"


@query("strategy_thirds", with_wide(
    f"""SELECT third, variant, {big('sum(actions)')} AS action_count, {big('sum(hits)')} AS hit_count, {ratio('sum(hits)', 'sum(actions)')} AS hit_rate
    FROM (SELECT *, {_RANK_THIRD} AS third FROM vr) GROUP BY 1, 2""", PICKS, variant_periods(), WINDOWS))
def strategy_thirds(spark, sf_dir):
    frame = stability.thirds(stability.variant_periods(picks(spark, sf_dir)))
    return frame.groupBy("third", "variant").agg(
        F.sum("actions").alias("action_count"), F.sum("hits").alias("hit_count"),
        round_to(spark_ratio(F.sum("hits"), F.sum("actions")), 6).alias("hit_rate"),
    )


@query("batch_strategy_target", with_wide(
    f"""SELECT *, CASE WHEN target_met THEN 'met' ELSE 'gap' END AS status FROM (SELECT t.*, CAST(ceil(sample_count * 0.6::DOUBLE) AS BIGINT) AS required_actions,
    action_count >= ceil(sample_count * 0.6::DOUBLE) AND hit_rate >= 0.7 AND rolling_10_min_hit_rate >= 0.7 AS target_met
    FROM ({_COMPARE}) t WHERE variant = 'coverage_draw_rescue')""", PICKS, variant_periods(), WINDOWS))
def batch_strategy_target(spark, sf_dir):
    return stability.batch_target(stability.variant_periods(picks(spark, sf_dir), ["coverage_draw_rescue"]))


_LINE = "CASE WHEN coverage_value_guarded.outcome = '' THEN 'watch' ELSE coverage_value_guarded.outcome END"


@query("strategy_grouping_report", with_wide(
    f"""SELECT CASE WHEN grouping(period) = 0 THEN 'period' WHEN grouping(league) = 0 THEN 'league' WHEN grouping(reason) = 0 THEN 'bucket'
       WHEN grouping(tier) = 0 THEN 'tier' ELSE 'total' END AS scope,
    CASE WHEN grouping(period) = 0 THEN period WHEN grouping(league) = 0 THEN league WHEN grouping(reason) = 0 THEN concat(tier, ':', reason, ':', outcome)
       WHEN grouping(tier) = 0 THEN tier ELSE 'all' END AS key,
    count(*) AS sample_count, {big('sum(acted)')} AS action_count, {ratio('sum(acted)', 'count(*)')} AS action_share, {ratio('sum(hit)', 'sum(acted)')} AS hit_rate,
    round(sum(roi), 6) AS total_roi, {ratio('sum(roi)', 'sum(units)')} AS roi_on_stake, {ratio('sum(units) * 100e0', 'sum(acted)')} AS avg_stake_pct
    FROM (SELECT league, period, coverage_value_guarded.tier AS tier, coverage_value_guarded.reason AS reason, {_LINE} AS outcome,
          CAST(coverage_value_guarded.outcome <> '' AS INT) AS acted, {facts('coverage_value_guarded')} FROM picks)
    GROUP BY GROUPING SETS ((), (tier), (tier, reason, outcome), (league), (period))""", PICKS))
def strategy_grouping_report(spark, sf_dir):
    return observation.pick_summary(row_picks(spark, sf_dir, "coverage_value_guarded"), "coverage_value_guarded")


_PROD = production_actions()
_CB = "CASE WHEN confidence_score < 0.7 THEN '<0.70' WHEN confidence_score < 0.8 THEN '0.70-0.79' WHEN confidence_score < 0.9 THEN '0.80-0.89' ELSE '>=0.90' END"
_SA = "CASE WHEN dir = '' THEN 'score_missing' WHEN outcome = dir THEN 'score_aligned' ELSE 'score_conflict' END"


@query("action_diagnostics", with_wide(
    " UNION ALL ".join(
        f"SELECT '{n}' AS dimension, {e} AS key, {PICK_METRICS} FROM prod GROUP BY 2"
        for n, e in (("outcome", "outcome"), ("reason", "reason"), ("odds_band", ODDS_BAND("pick_odds")), ("confidence_band", _CB), ("score_alignment", _SA))
    ), PICKS, _PROD))
def action_diagnostics(spark, sf_dir):
    return observation.diagnostics(row_picks(spark, sf_dir), "steady")


@query("action_breakdown_by_league", with_wide(
    f"""SELECT * FROM (SELECT league AS key, row_number() OVER (ORDER BY count(*) - sum(hit) DESC, count(*) DESC, league) AS place, {PICK_METRICS}
    FROM prod GROUP BY 1) WHERE place <= 6""", PICKS, _PROD))
def action_breakdown_by_league(spark, sf_dir):
    return observation.breakdown(strategies.actions_of(row_picks(spark, sf_dir), "steady"), "league", 6)


@query("newest_misses_by_league", with_wide(
    """SELECT league, period, match_id, outcome, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY CAST(period AS BIGINT) DESC, feedback_id DESC) AS place
    FROM prod WHERE hit = 0) WHERE place <= 3""", PICKS, _PROD))
def newest_misses_by_league(spark, sf_dir):
    misses = strategies.actions_of(row_picks(spark, sf_dir), "steady").filter("hit = 0")
    return observation.newest_examples(misses, 3, ["league"]).select("league", "period", "match_id", "outcome", "reason", "place")


@query("recent_actions", with_wide(
    """SELECT period, match_id, league, outcome, actual_result, predicted_score, reason, hit, round(roi, 6) AS roi, pick_odds FROM prod
    ORDER BY CAST(period AS BIGINT) DESC, feedback_id DESC LIMIT 12""", PICKS, _PROD))
def recent_actions(spark, sf_dir):
    rows = observation.newest_examples(strategies.actions_of(row_picks(spark, sf_dir), "steady"), 12)
    return rows.select(
        "period", "match_id", "league", "outcome", "actual_result", "predicted_score", "reason", "hit",
        round_to("roi", 6).alias("roi"), "pick_odds",
    )


@query("observation_risk_buckets", with_wide(
    f"""SELECT b.bucket, {PICK_METRICS.replace('count(*)', 'count(hit)').replace('sum(hit)', 'coalesce(sum(hit), 0)').replace('round(sum(roi), 6)', 'coalesce(round(sum(roi), 6), 0)')}
    FROM (VALUES ('clean'), ('single'), ('stacked'), ('resonance')) b(bucket) LEFT JOIN
    (SELECT *, CASE WHEN len(flags) >= 3 THEN 'resonance' WHEN len(flags) = 2 THEN 'stacked' WHEN len(flags) = 1 THEN 'single' ELSE 'clean' END AS bucket FROM prod) p
    ON p.bucket = b.bucket GROUP BY 1""", PICKS, _PROD))
def observation_risk_buckets(spark, sf_dir):
    return observation.risk_buckets(row_picks(spark, sf_dir))


@query("observation_combos", with_wide(
    f"""SELECT CASE WHEN len(flags) = 0 THEN 'clean' ELSE array_to_string(flags, '+') END AS combo, len(flags) AS flag_count, {PICK_METRICS}
    FROM prod GROUP BY 1, 2""", PICKS, _PROD))
def observation_combos(spark, sf_dir):
    return observation.combo_buckets(row_picks(spark, sf_dir))


_RES = "(list_contains(flags, 'rescue') AND len(flags) >= 3)"
_SCEN = " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, period, hit, roi, units, {c} AS x FROM prod" for n, c in (
        ("rescue_high_resonance", _RES),
        ("rescue_high_resonance_r4_draw", f"{_RES} AND reason = 'R4_score_draw' AND outcome = 'draw'"),
        ("rescue_high_resonance_existing_home", f"{_RES} AND reason = 'existing' AND outcome = 'home'"),
    )
)


@query("observation_scenarios", with_wide(
    f"""SELECT scenario, count(*) AS production_action_count, {big('sum(hit)')} AS production_hit_count, {ratio('sum(hit)', 'count(*)')} AS production_hit_rate,
    count(*) FILTER (NOT x) AS kept_action_count, {big('coalesce(sum(hit) FILTER (NOT x), 0)')} AS kept_hit_count,
    {ratio('sum(hit) FILTER (NOT x)', 'count(*) FILTER (NOT x)')} AS kept_hit_rate, coalesce(round(sum(roi) FILTER (NOT x), 6), 0) AS kept_roi,
    {ratio('sum(roi) FILTER (NOT x)', 'sum(units) FILTER (NOT x)')} AS kept_roi_on_stake,
    count(*) FILTER (x) AS filtered_count, {big('coalesce(sum(hit) FILTER (x), 0)')} AS filtered_hit_count,
    count(DISTINCT period) FILTER (x) AS filtered_period_count, coalesce(max(period) FILTER (x), '') AS filtered_latest_period,
    {ratio('max(pc)', 'count(*) FILTER (x)')} AS max_period_filtered_share
    FROM (SELECT *, count(*) FILTER (x) OVER (PARTITION BY scenario, period) AS pc FROM scen) GROUP BY 1""", PICKS, _PROD, f"scen AS ({_SCEN})"))
def observation_scenarios(spark, sf_dir):
    return observation.scenarios(row_picks(spark, sf_dir))


_DELTA = "delta AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS layer, period, hit, roi, units, {v}.outcome = '' AS x, {v}.reason AS why FROM prod" for v in observation.DELTA_LAYERS
) + ")"


@query("observation_deltas", with_wide(
    f"""SELECT layer, count(*) FILTER (x) AS filtered_count, {big('coalesce(sum(hit) FILTER (x), 0)')} AS filtered_hit_count,
    {big('count(*) FILTER (x) - coalesce(sum(hit) FILTER (x), 0)')} AS filtered_miss_count, {ratio('sum(hit) FILTER (x)', 'count(*) FILTER (x)')} AS filtered_hit_rate,
    {big('sum(hit)')} AS production_hit_count, {big('count(*) - sum(hit)')} AS production_miss_count,
    {ratio('count(*) FILTER (x AND hit = 0)', 'count(*) FILTER (hit = 0)')} AS miss_capture_rate, {ratio('sum(hit) FILTER (x)', 'sum(hit)')} AS hit_filter_rate,
    coalesce(round(sum(roi) FILTER (x), 6), 0) AS filtered_roi, {ratio('sum(roi) FILTER (x)', 'sum(units) FILTER (x)')} AS filtered_roi_on_stake,
    count(DISTINCT period) FILTER (x) AS filtered_period_count, coalesce(max(period) FILTER (x), '') AS filtered_latest_period,
    {ratio('max(pc)', 'count(*) FILTER (x)')} AS max_period_filtered_share, {ratio('max(pm)', 'count(*) FILTER (x AND hit = 0)')} AS max_period_miss_share
    FROM (SELECT *, count(*) FILTER (x) OVER w AS pc, count(*) FILTER (x AND hit = 0) OVER w AS pm FROM delta WINDOW w AS (PARTITION BY layer, period)) GROUP BY 1""",
    PICKS, _PROD, _DELTA))
def observation_deltas(spark, sf_dir):
    return observation.deltas(row_picks(spark, sf_dir))


@query("observation_delta_reasons", with_wide(
    f"""SELECT layer, why AS reason, {PICK_METRICS}, count(DISTINCT period) AS period_count, max(period) AS latest_period FROM delta WHERE x GROUP BY 1, 2""",
    PICKS, _PROD, _DELTA))
def observation_delta_reasons(spark, sf_dir):
    return observation.delta_reasons(row_picks(spark, sf_dir))


@query("observation_transition", with_wide(
    f"""SELECT 'precise_to_rescue' AS transition, {PICK_METRICS}, count(DISTINCT period) AS period_count, coalesce(max(period), '') AS latest_period
    FROM prod WHERE precise.outcome = ''""", PICKS, production_actions("rescue")))
def observation_transition(spark, sf_dir):
    return observation.transition(row_picks(spark, sf_dir), "precise", "rescue")


@query("observation_period_thirds", with_wide(
    f"""SELECT third, layer, min(period) AS period_from, max(period) AS period_to, count(DISTINCT period) AS period_count,
    count(hit) AS production_action_count, {ratio('sum(hit)', 'count(hit)')} AS production_hit_rate, count(hit) FILTER (NOT x) AS action_count,
    {ratio('sum(hit) FILTER (NOT x)', 'count(hit) FILTER (NOT x)')} AS hit_rate, count(hit) FILTER (x) AS filtered_count,
    {big('coalesce(sum(hit) FILTER (x), 0)')} AS filtered_hit_count
    FROM (SELECT period, l.layer, {_RANK_THIRD} AS third FROM (SELECT period, row_number() OVER (ORDER BY CAST(period AS BIGINT)) AS rank, count(*) OVER () AS periods
          FROM (SELECT DISTINCT period FROM wide)) CROSS JOIN (VALUES ('rescue'), ('broad')) l(layer)) axis LEFT JOIN delta USING (period, layer) GROUP BY 1, 2""",
    PICKS, _PROD, _DELTA))
def observation_period_thirds(spark, sf_dir):
    return observation.period_thirds(row_picks(spark, sf_dir))


_PROFILE = " UNION ALL ".join(
    f"SELECT flags, hit, '{n}' AS field, {c} AS v FROM prod" for n, c in observation.PROFILE_FIELDS.items()
)


@query("observation_feature_profiles", with_wide(
    f"""SELECT CASE WHEN {_RES} THEN 'rescue_high_resonance' WHEN len(flags) > 0 THEN 'other_flagged' ELSE 'clean' END AS segment, field,
    count(*) AS action_count, {big('sum(hit)')} AS hit_count, count(*) FILTER (v > 0) AS value_count, coalesce(round(avg(v) FILTER (v > 0), 6), 0) AS avg_value,
    coalesce(round(min(v) FILTER (v > 0), 6), 0) AS min_value, coalesce(round(max(v) FILTER (v > 0), 6), 0) AS max_value FROM ({_PROFILE}) GROUP BY 1, 2""",
    PICKS, _PROD))
def observation_feature_profiles(spark, sf_dir):
    return observation.feature_profiles(row_picks(spark, sf_dir))


@query("observation_readiness", with_wide(
    f"""SELECT c.variant, CASE WHEN c.action_count < 80 OR coalesce(p, 0) < 5 OR coalesce(ms, 0) >= 0.40 THEN 'needs_more_samples'
      WHEN coalesce(mc, 0) >= 0.8 AND coalesce(hf, 0) <= 0.05 AND c.hit_rate >= 0.95 THEN 'candidate' ELSE 'watch' END AS status,
    c.action_count, c.action_share, c.hit_rate, coalesce(p, 0) AS filtered_period_count, coalesce(ms, 0) AS max_period_filtered_share,
    coalesce(mc, 0) AS miss_capture_rate, coalesce(hf, 0) AS hit_filter_rate FROM ({_COMPARE}) c LEFT JOIN (
      SELECT layer, count(DISTINCT period) FILTER (x) AS p, {ratio('max(pc)', 'count(*) FILTER (x)')} AS ms,
      {ratio('count(*) FILTER (x AND hit = 0)', 'count(*) FILTER (hit = 0)')} AS mc, {ratio('sum(hit) FILTER (x)', 'sum(hit)')} AS hf
      FROM (SELECT *, count(*) FILTER (x) OVER (PARTITION BY layer, period) AS pc FROM delta) GROUP BY 1) d ON d.layer = c.variant
    WHERE c.role = 'observation'""", PICKS, variant_periods(), WINDOWS, _PROD, _DELTA))
def observation_readiness(spark, sf_dir):
    rows = row_picks(spark, sf_dir)
    frame = stability.variant_periods(rows, strategies.ROW_LOCAL)
    return observation.readiness(stability.comparison(frame), observation.deltas(rows))


@query("coverage_targets", with_wide(
    f"""SELECT *, greatest(required_actions - action_count, 0) AS additional_needed, action_count >= required_actions AND hit_rate >= 0.7 AS target_met FROM (
    SELECT variant, {big('sum(samples)')} AS sample_count, CAST(ceil(sum(samples) * 0.6::DOUBLE) AS BIGINT) AS required_actions, {big('sum(actions)')} AS action_count,
    {ratio('sum(actions)', 'sum(samples)')} AS action_share, {ratio('sum(hits)', 'sum(actions)')} AS hit_rate, round(sum(roi), 6) AS total_roi,
    {ratio('sum(roi)', 'sum(stake)')} AS roi_on_stake FROM vp GROUP BY 1)""", PICKS, variant_periods(observation.TARGET_LAYERS)))
def coverage_targets(spark, sf_dir):
    return observation.coverage_targets(stability.variant_periods(picks(spark, sf_dir), observation.TARGET_LAYERS))


def _fill_arm(key, test, outcome):
    return (
        f"SELECT '{key}' AS key, o <> '' AS a, o <> '' AND o = actual_result AS h, CASE WHEN o = '' THEN 0e0 WHEN o = actual_result AND {odds_of('o')} > 0"
        f" THEN 0.01::DOUBLE * ({odds_of('o')} - 1e0) ELSE -0.01::DOUBLE END AS roi FROM (SELECT *, CASE WHEN base.outcome = '' AND {test} THEN {outcome} ELSE '' END AS o FROM picks)"
    )


_FILLS = " UNION ALL ".join([
    _fill_arm("legacy_home_margin_05_10", "ltop = 'home' AND lgap >= 0.05 AND lgap < 0.10", "'home'"),
    _fill_arm("score_low_confidence", "dir <> '' AND confidence_score <= 0.82", "dir"),
    _fill_arm("market_home_prob_50", "mtop = 'home' AND market_home_prob >= 0.5", "'home'"),
    _fill_arm("market_home_odds_180_220", "mtop = 'home' AND market_odds_home >= 1.8 AND market_odds_home < 2.2", "'home'"),
])


@query("coverage_fill_candidates", with_wide(
    f"""SELECT key, row_number() OVER (ORDER BY hit_rate >= 0.7 DESC, action_count DESC, hit_rate DESC, key) AS place, sample_count, action_count, action_share, hit_rate,
    total_roi, roi_on_stake, hit_rate >= 0.7 AS reaches_target FROM (SELECT key, count(*) AS sample_count, count(*) FILTER (a) AS action_count,
    {ratio('count(*) FILTER (a)', 'count(*)')} AS action_share, {ratio('count(*) FILTER (h)', 'count(*) FILTER (a)')} AS hit_rate, round(sum(roi), 6) AS total_roi,
    {ratio('sum(roi)', '0.01::DOUBLE * count(*) FILTER (a)')} AS roi_on_stake FROM ({_FILLS}) GROUP BY 1)""", PICKS))
def coverage_fill_candidates(spark, sf_dir):
    return observation.fill_candidates(row_picks(spark, sf_dir, "base"))


_LOW = "low AS (SELECT start_period, end_period, actions, hits, hit_rate FROM win WHERE actions > 0 ORDER BY hit_rate, rank LIMIT 1)"


@query("low_window", with_wide("SELECT * FROM low", PICKS, variant_periods(["coverage_stable"]), WINDOWS, _LOW))
def low_window(spark, sf_dir):
    return observation.low_window(row_picks(spark, sf_dir, "coverage_stable"))


@query("low_window_breakdown", with_wide(
    f"""SELECT * FROM (SELECT reason AS key, row_number() OVER (ORDER BY count(*) - sum(hit) DESC, count(*) DESC, reason) AS place, {PICK_METRICS}
    FROM prod, low WHERE period BETWEEN start_period AND end_period GROUP BY 1) WHERE place <= 8""",
    PICKS, variant_periods(["coverage_stable"]), WINDOWS, _LOW, production_actions("coverage_stable").replace(f", {FLAGS} AS flags", "")))
def low_window_breakdown(spark, sf_dir):
    rows = row_picks(spark, sf_dir)
    return observation.low_window_breakdown(rows, "reason")
