"""Queries of the final action: reviewers folded over the algorithm's action, and what is executed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import policy, probs
from ..functions.numeric import num, round_to
from ..operators import resolution
from .adapters import ctes, plain, view
from .oracle import clip, with_ctes
from .queries_backtest import _LOWERED, policy_ctes
from .registry import query

_pick = lambda key, *values: f"CASE {key} {' '.join(f'WHEN {i} THEN ' + ('NULL' if v is None else repr(v)) for i, v in enumerate(values))} END"
_HIDDEN = "review_status, review_decision, review_target_action, arbiter_status, arbiter_decision, arbiter_target_action"
_KEPT = (
    "match_id, quality_score, model_agreement, confidence_score, market_odds_home, market_odds_draw, market_odds_away, market_home_prob, market_draw_prob, market_away_prob, legacy_home_prob, legacy_draw_prob, legacy_away_prob,"
    " final_home_prob, final_draw_prob, final_away_prob, calibrated_home_prob, calibrated_draw_prob, calibrated_away_prob"
)
#: Every match with all that reviewers may have said; a third of the matches had no arbiter, half no expert.
REVIEWED = f"""SELECT {_KEPT}, {_pick('k % 5', 'completed', 'completed', 'skipped', 'completed', 'failed')} AS review_status, {_pick('(k * 3 + c) % 6', 'keep', 'downgrade', 'promote', 'promote', 'abstain', 'reject')} AS review_decision,
  {_pick('(k * 11 + c) % 5', 'watch', 'light', 'main', '', '主推')} AS review_target_action, {_pick('(k * 7 + c) % 6', 'strong', 'adequate', 'Weak ', 'strong', '', 'unsafe')} AS review_evidence_grade,
  CASE WHEN k % 9 = 0 THEN NULL ELSE (k * 7 + c) % 14 / 10e0 END AS review_stake_multiplier, ((k * 3 + c) % 41 - 20) / 100e0 AS review_confidence_delta, {_pick('(k + c) % 6', 'confirm', '', 'veto_to_watch', 'challenge', 'confirm', 'confirm')} AS review_outcome_decision,
  {_pick('(k * 5 + c) % 4', 'home', 'draw', 'away', '')} AS review_target_outcome, {_pick('(k * 13 + c) % 6', 'completed', 'completed', None, 'completed', 'failed', None)} AS arbiter_status,
  {_pick('(k * 17 + c * 3) % 5', 'allow', 'allow_with_uplift', 'downgrade', 'manual_review', 'skip')} AS arbiter_decision, {_pick('(k * 13 + c * 5) % 4', 'watch', 'light', 'main', '')} AS arbiter_target_action, concat('because ', CAST(k % 10 AS {{string}})) AS arbiter_reason,
  {_pick('(k * 19 + c) % 4', 'completed', None, 'failed', None)} AS expert_status, {_pick('(k * 23 + c) % 3', 'main', 'light', 'watch')} AS expert_target_action, {_pick('(k * 29 + c) % 4', 'strong', 'unsafe', 'weak', 'adequate')} AS expert_evidence_grade, (k * 31 + c) % 12 / 10e0 AS expert_stake_multiplier
  FROM (SELECT *, match_id AS k, team_key AS c FROM {{wide}}) keyed"""

_G = V.DEFAULT_GATES
_LV = lambda a: f"(CASE {a} WHEN 'main' THEN 2 WHEN 'light' THEN 1 ELSE 0 END)"
_AC = lambda n: f"(CASE {n} WHEN 2 THEN 'main' WHEN 1 THEN 'light' ELSE 'watch' END)"
_LB = lambda a: f"(CASE {a} WHEN '主推' THEN 'main' WHEN '' THEN 'watch' ELSE {a} END)"
_PCT = f"(kelly * 25e0 * {clip('0.55 + (conf - 0.55) * 0.45 + (p_score - 0.55) * 0.40 + (model_agreement - 0.65) * 0.25 + (quality_score - 0.65) * 0.20', 0.40, 1.30)} * CASE WHEN quality_score < 0.70 AND gap > 0.10 THEN {clip('1e0 - (gap - 0.10) * 1.6', 0.55, '1e0')} ELSE 1e0 END)"


def _stake(a: str) -> str:
    fb = "(greatest(p_ev, 0e0) * conf)"
    return (
        f"(CASE WHEN {a} = 'watch' THEN 0e0 WHEN kelly > 0 THEN round(CASE {a} WHEN 'main' THEN {clip(_PCT, 0.5, 4.0)} ELSE {clip(_PCT, 0.2, 1.5)} END, 2)"
        f" ELSE round(CASE {a} WHEN 'main' THEN {clip(f'{fb} * 12e0', 0.5, 4.0)} ELSE {clip(f'{fb} * 6e0', 0.2, 1.5)} END, 2) END)"
    )


_P = _G["promote"]
_CHAIN = f"""r0 AS (SELECT *, review_status = 'completed' AS done, CASE WHEN review_target_action = '' THEN p_action ELSE {_LB('review_target_action')} END AS tgt,
  CASE WHEN review_status = 'completed' THEN {clip('coalesce(review_stake_multiplier, 1e0)', '0e0', '1e0')} ELSE 1e0 END AS share,
  {clip(f"p_conf + CASE WHEN review_status = 'completed' THEN {clip('review_confidence_delta', '-0.12::DOUBLE', '0.08::DOUBLE')} ELSE 0e0 END", '0.18::DOUBLE', '0.88::DOUBLE')} AS conf, lower(trim(review_evidence_grade)) AS grade FROM policy),
r1 AS (SELECT *, CASE WHEN NOT done OR review_decision = 'keep' OR (review_decision = 'abstain' AND fav) THEN p_action WHEN review_decision = 'downgrade' THEN {_LOWERED('p_action', 'tgt')}
  WHEN review_decision = 'promote' THEN CASE WHEN NOT (p_action = 'watch' AND tgt = 'main') AND quality_score >= {_P['quality']} AND p_conf >= {_P['confidence']} AND p_ev >= {_P['ev']} AND p_bias >= {_P['market_bias']} AND p_conf >= 0.48
    AND {_LV('tgt')} > {_LV('p_action')} THEN {_AC(f"least({_LV('p_action')} + 1, {_LV('tgt')})")} ELSE p_action END ELSE 'watch' END AS a1 FROM r0),
r2 AS (SELECT *, CASE WHEN NOT done OR (fav AND review_decision = 'abstain') THEN a1 WHEN review_decision = 'abstain' OR grade = 'unsafe' OR share <= 0 THEN 'watch' WHEN grade = 'weak' AND a1 = 'main' THEN 'light' ELSE a1 END AS a2 FROM r1),
r3 AS (SELECT *, CASE WHEN NOT done OR (fav AND review_outcome_decision IN ('veto_to_watch', 'challenge')) THEN a2 WHEN review_outcome_decision = 'veto_to_watch' THEN 'watch'
  WHEN review_outcome_decision = 'challenge' AND review_target_outcome <> '' AND review_target_outcome <> p_out THEN 'watch' ELSE a2 END AS a3 FROM r2),
r4 AS (SELECT *, CASE WHEN NOT done THEN a3 ELSE CASE WHEN (CASE WHEN a3 = 'main' AND conf < {_G['main']['confidence']}::DOUBLE THEN 'light' ELSE a3 END) = 'light' AND conf < {_G['light']['confidence']}::DOUBLE THEN 'watch'
  WHEN a3 = 'main' AND conf < {_G['main']['confidence']}::DOUBLE THEN 'light' ELSE a3 END END AS a4 FROM r3),
r5 AS (SELECT *, CASE WHEN arbiter_status IS NULL THEN a4 WHEN review_status = 'failed' THEN 'watch' WHEN done AND (review_decision = 'reject' OR (review_decision = 'abstain' AND NOT fav)) THEN 'watch'
  WHEN done AND review_decision = 'downgrade' THEN {_LOWERED('a4', _LB('review_target_action'))} ELSE a4 END AS a5 FROM r4),
r6 AS (SELECT *, CASE WHEN arbiter_status IS NULL OR a5 <> a4 THEN a5 WHEN arbiter_status = 'failed' OR (arbiter_status = 'completed' AND arbiter_decision IN ('skip', 'manual_review')) THEN 'watch'
  WHEN arbiter_status = 'completed' AND arbiter_decision = 'downgrade' THEN {_LOWERED('a5', _LB('arbiter_target_action'))} ELSE a5 END AS fin FROM r5),
r7 AS (SELECT *, CASE WHEN fin = 'watch' THEN 0e0 WHEN done THEN round((CASE WHEN p_stake > 0 THEN least({_stake('fin')}, p_stake) ELSE {_stake('fin')} END) * CASE WHEN fav AND share <= 0 THEN 1e0 ELSE share END, 2) ELSE {_stake('fin')} END AS fin_stake,
  CASE WHEN arbiter_target_action = '' THEN fin ELSE {_LB('arbiter_target_action')} END AS atgt, arbiter_status = 'completed' AS heard, {clip('expert_stake_multiplier', '0e0', '1e0')} AS eshare FROM r6),
r8 AS (SELECT *, {_AC(f"least({_LV('p_action')}, greatest({_LV('atgt')}, {_LV('fin')}))")} AS raised, CASE WHEN {_LOWERED('fin', 'atgt')} <> fin THEN {_LOWERED('fin', 'atgt')} ELSE {_AC(f"greatest({_LV('fin')} - 1, 0)")} END AS lowered,
  CASE WHEN expert_status = 'completed' AND expert_evidence_grade <> 'unsafe' AND eshare > 0 THEN expert_target_action ELSE 'watch' END AS word FROM r7),
r9 AS (SELECT *, CASE WHEN heard IS NOT TRUE THEN 'model' WHEN arbiter_decision = 'allow_with_uplift' AND raised <> fin THEN 'uplift' WHEN arbiter_decision = 'downgrade' THEN 'lower' WHEN arbiter_decision = 'manual_review' AND expert_status IS NOT NULL THEN 'expert'
  WHEN arbiter_decision = 'manual_review' THEN 'pending' WHEN arbiter_decision = 'skip' THEN 'skip' ELSE 'model' END AS kase FROM r8)"""
_CHANGES = ", ".join(f"CASE WHEN {after} <> {before} THEN concat('{by}:', {after}) END" for by, before, after in (
    ("review", "p_action", "a1"), ("evidence", "a1", "a2"), ("outcome", "a2", "a3"), ("confidence", "a3", "a4"), ("hearing", "a4", "a5"), ("arbiter", "a5", "fin")))


def staged(spark, sf_dir):
    df = view(spark, sf_dir, REVIEWED)
    market = probs.effective_market(probs.triple("market"), probs.market_odds())
    return policy.action_policy(df, policy.stored_probabilities(), selected=probs.argmax(market))


@query("resolved_actions", with_ctes(
    f"""SELECT match_id, p_action AS policy_action, fin AS final_action, round(conf, 6) AS final_confidence, round(fin_stake, 2) AS final_stake, CASE WHEN conf >= 0.78 THEN 'low' WHEN conf >= 0.62 THEN 'medium' WHEN conf >= 0.48 THEN 'high' ELSE 'very_high' END AS final_risk,
    array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL), ',') AS path,
    CASE kase WHEN 'uplift' THEN raised WHEN 'lower' THEN lowered WHEN 'expert' THEN word WHEN 'pending' THEN '' WHEN 'skip' THEN 'watch' ELSE fin END AS effective_recommendation,
    round(CASE kase WHEN 'uplift' THEN {_stake('raised')} WHEN 'lower' THEN {_stake('lowered')} WHEN 'expert' THEN CASE WHEN word = 'watch' THEN 0e0 ELSE round({_stake('word')} * eshare, 2) END WHEN 'model' THEN fin_stake ELSE 0e0 END, 2) AS effective_stake_pct,
    CASE kase WHEN 'uplift' THEN 'arbiter_uplift' WHEN 'lower' THEN 'arbiter' WHEN 'skip' THEN 'arbiter' WHEN 'expert' THEN CASE WHEN expert_status = 'completed' THEN 'expert_llm' ELSE 'expert_llm_failed' END WHEN 'pending' THEN '' ELSE 'model' END AS effective_action_source,
    CASE kase WHEN 'expert' THEN 'resolved' WHEN 'pending' THEN 'pending' ELSE '' END AS manual_review_status, CASE WHEN kase IN ('expert', 'pending') THEN arbiter_reason ELSE '' END AS manual_review_reason,
    CASE WHEN kase IN ('expert', 'pending') THEN '2024-01-20 12:00:00' ELSE '' END AS manual_review_requested_at, CASE WHEN kase = 'expert' THEN '2024-01-20 12:00:00' ELSE '' END AS manual_review_resolved_at,
    CASE kase WHEN 'uplift' THEN 'arbiter_uplifted' WHEN 'lower' THEN 'arbiter_downgraded' WHEN 'skip' THEN 'arbiter_downgraded' WHEN 'expert' THEN CASE WHEN expert_status = 'completed' THEN 'expert_review_resolved' ELSE 'expert_review_failed' END
      WHEN 'pending' THEN 'manual_review_pending' ELSE 'executable' END AS execution_status FROM r9""", *ctes("wide"), f"reviewed AS ({plain(REVIEWED)})", policy_ctes("reviewed"), _CHAIN))
def resolved_actions(spark, sf_dir):
    df = resolution.resolve_actions(staged(spark, sf_dir), at=F.lit("2024-01-20 12:00:00"))
    return df.select(
        "match_id", "policy_action", "final_action", round_to("final_confidence", 6).alias("final_confidence"), round_to("final_stake", 2).alias("final_stake"), "final_risk", F.array_join("resolution_path", ",").alias("path"),
        "effective_recommendation", round_to(num("effective_stake_pct"), 2).alias("effective_stake_pct"), "effective_action_source", "manual_review_status", "manual_review_reason", "manual_review_requested_at",
        "manual_review_resolved_at", "execution_status",
    )
