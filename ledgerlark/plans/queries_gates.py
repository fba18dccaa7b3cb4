"""Queries of the gate search: totals of all 19,683 configurations, and the best of them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import learning
from .oracle import SETTLED, big, clip, odds_of, with_wide
from .queries_backtest import _LOWERED, policy_ctes
from .queries_learning import _ROWS, rows
from .queries_resolution import _AC, _LV, _stake
from .registry import query

CALIBRATOR = {"temperature": 1.1, "biases": {"home": 0.05, "draw": -0.1, "away": 0.05}}
#: What reviewers wrote beside their verdict: none, broken, and four kinds of evidence.
RAW = """CASE match_id % 6 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '{"confidence_delta": 0.05, "stake_multiplier": 0.8, "evidence_grade": "weak"}'
  WHEN 3 THEN '{"confidence_delta": -0.2, "stake_multiplier": "0.5", "evidence_grade": "Strong"}' WHEN 4 THEN '{"stake_multiplier": 0, "evidence_grade": "adequate"}' ELSE '{"confidence_delta": 0.02, "evidence_grade": "unsafe"}' END"""
COLUMNS = [f"{split}_{kind}_{c}" for split in ("train", "validation") for kind in ("algo", "final") for c in ("actions", "roi")]


def search(spark, sf_dir):
    return learning.gate_search(rows(spark, sf_dir).withColumn("review_raw", F.expr(RAW)), CALIBRATOR)


# --- the same in DuckDB: every row under every one of the 729 gates, 27 promotions for the promoted ----------

_G = V.GATE_GRID
_grid = ", ".join(f"({i}, {', '.join(f'{x}::DOUBLE' for x in combo)})" for i, combo in enumerate(product(*[_G[n] for n in learning.GATE_NAMES])))
_q = lambda o: f"greatest(final_{o}_prob, 1e-6) / (greatest(final_home_prob, 1e-6) + greatest(final_draw_prob, 1e-6) + greatest(final_away_prob, 1e-6))"
_soft = lambda o: f"exp((ln(greatest({_q(o)}, 1e-6)) + {CALIBRATOR['biases'][o]}::DOUBLE) / {CALIBRATOR['temperature']}::DOUBLE)"
_fit = lambda o: f"{_soft(o)} / ({' + '.join(_soft(x) for x in V.OUTCOMES)})"
_count = lambda x, gate: "(" + " + ".join(f"CASE WHEN {x} >= {v}::DOUBLE THEN 1 ELSE 0 END" for v in _G[gate]) + ")"
_roi = lambda s: f"(CASE WHEN {s} <= 0 THEN 0e0 WHEN hit AND {odds_of('p_out')} > 0 THEN round({s} / 100e0 * ({odds_of('p_out')} - 1e0), 4) WHEN hit THEN 0e0 ELSE round(-{s} / 100e0, 4) END)"


def _left(x: str) -> str:
    """An action after evidence and confidence gates."""
    graded = f"(CASE WHEN done AND (grade = 'unsafe' OR share <= 0) THEN 'watch' WHEN done AND grade = 'weak' AND {x} = 'main' THEN 'light' ELSE {x} END)"
    main = f"(CASE WHEN done AND {graded} = 'main' AND conf < mc THEN 'light' ELSE {graded} END)"
    return f"(CASE WHEN done AND {main} = 'light' AND conf < lc THEN 'watch' ELSE {main} END)"


_own = lambda a: f"(CASE WHEN done THEN round({_stake(a)} * share, 2) ELSE {_stake(a)} END)"
_splits = (("train", "NOT val"), ("validation", "val"))
_CTES = [
    f"""gsrc AS (SELECT lr.* REPLACE (c_home AS calibrated_home_prob, c_draw AS calibrated_draw_prob, c_away AS calibrated_away_prob), g.* FROM (SELECT *, {', '.join(f'{_fit(o)} AS c_{o}' for o in V.OUTCOMES)} FROM lr) lr,
  (VALUES {_grid}) g(gate_id, me, mc, mb, le, lc, lb))""",
    policy_ctes("gsrc", {"me": "me", "mc": "mc", "mb": "mb", "mq": 0.68, "le": "le", "lc": "lc", "lb": "lb", "lq": 0.58}),
    f"""g1 AS (SELECT *, p_out = actual_result AS hit, review_status = 'completed' AS done, CASE WHEN review_target_action = '' THEN p_action ELSE review_target_action END AS tgt,
  CASE WHEN review_status <> 'completed' THEN 1e0 ELSE CASE match_id % 6 WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.5::DOUBLE WHEN 4 THEN 0e0 ELSE 1e0 END END AS share, CASE match_id % 6 WHEN 2 THEN 'weak' WHEN 3 THEN 'strong' WHEN 4 THEN 'adequate' WHEN 5 THEN 'unsafe' ELSE '' END AS grade,
  {clip("p_conf + CASE WHEN review_status <> 'completed' THEN 0e0 ELSE CASE match_id % 6 WHEN 2 THEN 0.05::DOUBLE WHEN 3 THEN -0.12::DOUBLE WHEN 5 THEN 0.02::DOUBLE ELSE 0e0 END END", '0.18::DOUBLE', '0.88::DOUBLE')} AS conf FROM policy),
g2 AS (SELECT *, CASE WHEN done AND review_decision = 'downgrade' THEN {_LOWERED('p_action', 'tgt')} WHEN done AND review_decision = 'abstain' THEN 'watch' ELSE p_action END AS plain,
  done AND review_decision = 'promote' AND quality_score >= 0.70::DOUBLE AND p_conf >= 0.48::DOUBLE AND NOT (p_action = 'watch' AND tgt = 'main') AS can,
  CASE WHEN {_LV('tgt')} > {_LV('p_action')} THEN {_AC(f"least({_LV('p_action')} + 1, {_LV('tgt')})")} ELSE p_action END AS raised FROM g1 WHERE p_action <> 'watch' OR (done AND review_decision = 'promote')),
g3 AS (SELECT *, {_left('plain')} AS x_plain, {_left('raised')} AS x_raised FROM g2),
g4 AS (SELECT *, {_own('x_plain')} AS s_plain, CASE WHEN can THEN {_own('x_raised')} ELSE 0e0 END AS s_raised FROM g3),
g5 AS MATERIALIZED (SELECT gate_id, val, can, {_count('p_ev', 'promote_ev')} AS je, {_count('p_conf', 'promote_confidence')} AS jc, {_count('p_bias', 'promote_market_bias')} AS jb, CAST(p_stake > 0 AS INT) AS an, {_roi('p_stake')} AS ar, CAST(s_plain > 0 AS INT) AS pn, {_roi('s_plain')} AS pr,
  CAST(s_raised > 0 AS INT) AS qn, {_roi('s_raised')} AS qr FROM g4),
gbase AS (SELECT gate_id, {', '.join(f'coalesce(sum({c}) FILTER ({f}), 0) AS {s}_{n}' for s, f in _splits for n, c in (('algo_actions', 'an'), ('algo_roi', 'ar'), ('final_actions', 'pn'), ('final_roi', 'pr')))} FROM g5 GROUP BY 1),
gup AS (SELECT gate_id, promote_id, {', '.join(f'coalesce(sum({c}) FILTER ({f}), 0) AS {s}_{n}' for s, f in _splits for n, c in (('n', 'qn - pn'), ('r', 'qr - pr')))} FROM g5, (SELECT e * 9 + c * 3 + b AS promote_id, e, c, b FROM range(3) t1(e), range(3) t2(c), range(3) t3(b)) p
  WHERE can AND je > e AND jc > c AND jb > b GROUP BY 1, 2),
gtot AS MATERIALIZED (SELECT CAST(g.gate_id AS INTEGER) AS gate_id, CAST(p.promote_id AS INTEGER) AS promote_id, {', '.join(f"{big(f'{s}_algo_actions')} AS {s}_algo_actions, round({s}_algo_roi, 4) AS {s}_algo_roi, {big(f'{s}_final_actions + coalesce({s}_n, 0)')} AS {s}_final_actions, round({s}_final_roi + coalesce({s}_r, 0), 4) AS {s}_final_roi" for s, _ in _splits)}
  FROM gbase g CROSS JOIN (SELECT range AS promote_id FROM range(27)) p LEFT JOIN gup u ON u.gate_id = g.gate_id AND u.promote_id = p.promote_id)""",
]
_BASE = f"gate_id = {learning._base_position(learning.GATE_NAMES)} AND promote_id = {learning._base_position(learning.PROMOTE_NAMES)}"
_better = lambda k: f"(t.validation_{k}_roi > b.validation_{k}_roi + 1e-9 AND t.validation_{k}_actions >= greatest(1, ceil(b.validation_{k}_actions * 0.35::DOUBLE)))"


@query("gate_search_totals", with_wide(f"SELECT gate_id, promote_id, {', '.join(COLUMNS)} FROM gtot", SETTLED, _ROWS, *_CTES))
def gate_search_totals(spark, sf_dir):
    return search(spark, sf_dir)


@query("gate_search_best", with_wide(
    f"""SELECT t.gate_id, t.promote_id, {', '.join(f't.{c}' for c in COLUMNS)}, CASE WHEN greatest(b.train_final_actions, b.train_algo_actions) < {V.GATE_MIN_TRAIN_ACTIONS} OR greatest(b.validation_final_actions, b.validation_algo_actions) < {V.GATE_MIN_VALIDATION_ACTIONS} THEN 'insufficient_samples'
      WHEN {_better('algo')} OR {_better('final')} THEN 'ready' ELSE 'no_gain' END AS status FROM gtot t, (SELECT * FROM gtot WHERE {_BASE}) b WHERE greatest(t.train_final_actions, t.train_algo_actions) >= {V.GATE_MIN_TRAIN_ACTIONS}
    ORDER BY greatest(t.train_final_roi, t.train_algo_roi) DESC, t.train_final_roi DESC, t.train_algo_roi DESC, abs(t.train_final_actions - b.train_final_actions), t.gate_id, t.promote_id LIMIT 1""", SETTLED, _ROWS, *_CTES))
def gate_search_best(spark, sf_dir):
    return learning.fit_gates(search(spark, sf_dir))
