"""Queries of stored strategies: alternatives in order, and the active profile over all settled rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numeric import round_to
from ..operators import ledger, metrics, profile
from . import adapters
from .adapters import plain, view
from .oracle import SETTLED, argmax, big, by_outcome, margin_of, odds_of, ratio, with_wide
from .queries_ledger import LOG
from .registry import query

STRATEGIES = {
    "plain": {"direction_source": "model", "odds_max": 2.0, "prob_min": 0.5, "quality_min": 0.7, "outcomes": ["home", "away"], "stake_pct": 1.5},
    "first_of_three": {
        "any_rules": [
            {"direction_source": "low_odds", "odds_max": 1.5, "market_prob_min": 0.55},
            {"direction_source": "ev", "ev_min": 0.1, "rating_gap_min": 0.0, "final_actions": ["main", "轻仓"]},
            {"direction_source": "current", "arbiter_decisions": ["keep"], "score_outcomes": ["draw", "home"], "score_confidence_min": 0.2},
        ],
        "stake_pct": 1.0,
    },
    "calibrated": {
        "any_rules": [
            {"direction_source": "algo", "llm_decisions": ["keep", "promote"], "agreement_min": 0.8, "goal_for_gap_min": 0.5, "schedule_gap_min": 0},
            {"direction_source": "model", "h2h_edge_min": 0.3, "rest_gap_min": -2, "absence_gap_min": -0.05, "prob_margin_min": 0.05},
        ],
        "stake_pct": 2.0, "calibrator": {"temperature": 1.2, "biases": {"home": 0.1, "draw": -0.05, "away": -0.05}},
    },
}
TEXTS = {name: json.dumps(rule, ensure_ascii=False) for name, rule in STRATEGIES.items()}

# --- the same in DuckDB: each strategy's alternatives written out ---------------------------------------

_MPS = tuple(f"market_{o}_prob" for o in V.OUTCOMES)
_Q = lambda o: f"greatest(final_{o}_prob, 1e-6) / (greatest(final_home_prob, 1e-6) + greatest(final_draw_prob, 1e-6) + greatest(final_away_prob, 1e-6))"
_BIAS = STRATEGIES["calibrated"]["calibrator"]
_soft = lambda o: f"exp((ln(greatest(q_{o}, 1e-6)) + {_BIAS['biases'][o]}::DOUBLE) / {_BIAS['temperature']}::DOUBLE)"
_PRICE = tuple(f"(CASE WHEN market_odds_{o} > 0 THEN -market_odds_{o} ELSE -99e0 END)" for o in V.OUTCOMES)
_evs = lambda p: tuple(f"(CASE WHEN market_odds_{o} > 0 THEN {p}_{o} * market_odds_{o} - 1e0 ELSE -1e0 END)" for o in V.OUTCOMES)
_gap = lambda oc, g: f"(CASE {oc} WHEN 'home' THEN {g} WHEN 'away' THEN -({g}) ELSE -abs({g}) END)"
_named = lambda p: {
    "market": argmax(*_MPS), "model": argmax(*(f"{p}_{o}" for o in V.OUTCOMES)), "current": "recommended_outcome", "algo": "algo_recommended_outcome", "low_odds": argmax(*_PRICE), "ev": argmax(*_evs(p)),
}
_SCORE = "CASE WHEN predicted_score = '' THEN '' WHEN split_part(predicted_score, '-', 1)::INT > split_part(predicted_score, '-', 2)::INT THEN 'home' WHEN split_part(predicted_score, '-', 1)::INT = split_part(predicted_score, '-', 2)::INT THEN 'draw' ELSE 'away' END"
_BASE = f"""b0 AS (SELECT *, {', '.join(f'{_Q(o)} AS q_{o}' for o in V.OUTCOMES)}, {_SCORE} AS score_way FROM settled),
b1 AS (SELECT *, {', '.join(f"{_soft(o)} / ({' + '.join(_soft(x) for x in V.OUTCOMES)}) AS c_{o}" for o in V.OUTCOMES)} FROM b0),
b2 AS (SELECT *, {', '.join(f'{e} AS q_{n}' for n, e in _named('q').items())}, {_named('c')['model']} AS c_model FROM b1)"""


def _case(name: str, arms: list[tuple[str, str]], stake: float) -> str:
    first = arms[0][0]
    whens = lambda value: " ".join(f"WHEN {odds_of(oc)} > 0 AND {test} THEN {value(oc)}" for oc, test in arms)
    return f"""SELECT '{name}' AS strategy, actual_result, CASE {whens(lambda _: "'light'")} ELSE 'watch' END AS act, CASE {whens(lambda oc: oc)} ELSE {first} END AS oc, {stake}::DOUBLE AS stake,
      market_odds_home, market_odds_draw, market_odds_away FROM b2"""


_qp = lambda oc: by_outcome(oc, "q_home", "q_draw", "q_away")
_CASES = {
    "plain": _case("plain", [("q_model", f"{odds_of('q_model')} <= 2 AND {_qp('q_model')} >= 0.5 AND quality_score >= 0.7::DOUBLE AND q_model IN ('home', 'away')")], 1.5),
    "first_of_three": _case("first_of_three", [
        ("q_low_odds", f"{odds_of('q_low_odds')} <= 1.5 AND {by_outcome('q_low_odds', *_MPS)} >= 0.55::DOUBLE"),
        ("q_ev", f"{odds_of('q_ev')} <= 10 AND {by_outcome('q_ev', *_evs('q'))} >= 0.1::DOUBLE AND {_gap('q_ev', 'home_rating - away_rating')} >= 0 AND recommendation IN ('main', 'light')"),
        ("q_current", f"{odds_of('q_current')} <= 10 AND arbiter_decision = 'keep' AND score_way IN ('draw', 'home') AND predicted_score_confidence >= 0.2::DOUBLE"),
    ], 1.0),
    "calibrated": _case("calibrated", [
        ("q_algo", f"{odds_of('q_algo')} <= 10 AND review_decision IN ('keep', 'promote') AND model_agreement >= 0.8::DOUBLE AND {_gap('q_algo', 'recent_home_gf_pg - recent_away_gf_pg')} >= 0.5 AND {_gap('q_algo', 'schedule_load_away - schedule_load_home')} >= 0"),
        ("c_model", f"{odds_of('c_model')} <= 10 AND {_gap('c_model', 'h2h_edge')} >= 0.3::DOUBLE AND {_gap('c_model', 'rest_days_home - rest_days_away')} >= -2 AND {_gap('c_model', 'away_absence_impact - home_absence_impact')} >= -0.05::DOUBLE"
                    f" AND {margin_of('c_model', 'c_home', 'c_draw', 'c_away')} >= 0.05::DOUBLE"),
    ], 2.0),
}


def _metrics(source: str) -> str:
    return f"""SELECT strategy, coalesce(bucket, 'all') AS bucket, n AS sample_count, a AS action_count, n - a AS watch_count, h AS hits, {ratio('h', 'a')} AS hit_rate, {ratio('a', 'n')} AS action_share, round(r, 4) AS total_roi,
      {ratio('r', 'a')} AS avg_roi, {ratio('s', 'a')} AS avg_stake_pct FROM (SELECT strategy, bucket, count(*) AS n, count(*) FILTER (act <> 'watch') AS a, {big("coalesce(sum(hit) FILTER (act <> 'watch'), 0)")} AS h,
      coalesce(sum(roi) FILTER (act <> 'watch'), 0) AS r, coalesce(sum(stake) FILTER (act <> 'watch'), 0) AS s FROM (SELECT strategy, act, stake, concat(act, ':', oc) AS bucket, CAST(oc = actual_result AS INT) AS hit,
        CASE WHEN oc = actual_result AND {odds_of('oc')} > 0 THEN round(stake / 100e0 * ({odds_of('oc')} - 1e0), 4) WHEN oc = actual_result THEN 0e0 ELSE round(-stake / 100e0, 4) END AS roi FROM {source}) GROUP BY GROUPING SETS ((strategy), (strategy, bucket)))"""


def rounded(df):
    rates = ("hit_rate", "action_share", "avg_roi", "avg_stake_pct")
    return df.select("strategy", "bucket", "sample_count", "action_count", "watch_count", "hits", *[round_to(c, 6).alias(c) for c in rates], "total_roi")


def settled(spark, sf_dir):
    return metrics.with_settlement(adapters.wide(spark, sf_dir))


@query("or_rule_metrics", with_wide(_metrics("cases"), SETTLED, _BASE, f"cases AS ({' UNION ALL '.join(_CASES.values())})"))
def or_rule_metrics(spark, sf_dir):
    return rounded(profile.replay_metrics(profile.replay(settled(spark, sf_dir), TEXTS)))


#: Every profile of the log has one of the three strategies as its stored parameters.
PROFILES = "SELECT user_id AS profile_id, CASE user_id % 3 " + " ".join(
    f"WHEN {i} THEN '{t.replace('{', '{{').replace('}', '}}')}'" for i, t in enumerate(TEXTS.values())) + " END AS params FROM {events} GROUP BY user_id"
_ACTIVE = f"""active AS (SELECT arg_max(profile_id, (act, -profile_id)) AS id FROM (SELECT profile_id, arg_max(status, (event_at, event_id)) AS last_status, max((event_at, event_id)) FILTER (status = 'active') AS act FROM ({plain(LOG)}) GROUP BY 1)
  WHERE last_status = 'active')"""


@query("profile_replay", with_wide(_metrics("mine"), SETTLED, _BASE, f"cases AS ({' UNION ALL '.join(_CASES.values())})", _ACTIVE,
    f"mine AS (SELECT cases.* REPLACE (CAST(id AS VARCHAR) AS strategy) FROM cases JOIN active ON strategy = CASE id % 3 {' '.join(f'WHEN {i} THEN {n!r}' for i, n in enumerate(TEXTS))} END)"))
def profile_replay(spark, sf_dir):
    states = ledger.profile_state(view(spark, sf_dir, LOG))
    found = profile.active_parameters(states, view(spark, sf_dir, PROFILES))
    if not found:
        found = {"": "null"}
    return rounded(profile.replay_metrics(profile.replay(settled(spark, sf_dir), found)))
