"""Queries of the chain from stored text to match features, their quality checks, and both teams' metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import models
from ..functions.numeric import round_to
from ..operators import features, joins
from .adapters import ctes, load, plain, view
from .oracle import clip, with_ctes
from .queries_extract import _D2, N, TEXTS, _cat
from .registry import query


def sql(body: str, *views: str, extra=()) -> str:
    return with_ctes(plain(body), *ctes(*views), *[plain(e) for e in extra])


# Texts of all matches; every third lacks the away form, every fourth the away rank, every seventh the quoted odds.
_SWAPPED = {
    "form": _cat("=近", "n", "=场  ", "l", "=胜", "d", "=平", "w", "=负，进", "ga", "=球失", "gf", "=球，胜率", "hr", "=%，赢盘率", "wr", "=%，大球率", "orr", "=%"),
    "elo": _cat("=第", "rk", "=/", "tc", "=，", "pts", "=分，", "l", "=胜", "d", "=平", "w", "=负，进", "ga", "=，失", "gf", "=，净胜", "gd"),
}
_ODDS = TEXTS[TEXTS.index("concat('初赔 '") : TEXTS.index(" AS european_odds_movement_summary")]
ANALYSES = (
    TEXTS.replace("'暂无' AS recent_form_away", f"CASE WHEN k % 3 = 0 THEN '暂无' ELSE {_SWAPPED['form']} END AS recent_form_away")
    .replace("'' AS elo_away", f"CASE WHEN k % 4 = 0 THEN '' ELSE {_SWAPPED['elo']} END AS elo_away")
    .replace(_ODDS, f"CASE WHEN k % 7 = 0 THEN '' ELSE {_ODDS} END")
    .replace("SELECT match_id, k, ", "SELECT match_id, k, period, league, home_team, away_team, match_time, market_odds_home AS list_odds_win, market_odds_draw AS list_odds_draw,"
             " market_odds_away AS list_odds_loss, CASE WHEN k % 5 < 2 THEN '参考最近交锋，连续客场' ELSE '无' END AS motivation_or_schedule_notes, ", 1)
)
ANALYSES = ANALYSES[: ANALYSES.rindex(" FROM (")] + " FROM (SELECT *, match_id AS k FROM {wide}) nums"

#: Team metrics per league code; "Team 1" is also the beginning of "Team 12".
_CODE = "concat('L', CAST(({0}) % 3 AS {{string}}))"
TEAMS = f"""SELECT {_CODE.format('match_id')} AS code, home_team AS title, min(match_id) AS place, count(*) AS games, round(avg(home_rating), 6) AS rating
    FROM {{wide}} WHERE length(home_team) + match_id % 3 <> 7 GROUP BY 1, 2"""
PAIRED = f"""SELECT match_id, {_CODE.format('match_id * 2')} AS code_a, {_CODE.format('match_id * 2 + 1')} AS code_b,
    concat(home_team, CASE WHEN match_id % 4 = 0 THEN ' FC' ELSE '' END) AS home_name, concat(away_team, ' (W)') AS away_name FROM {{wide}}"""


@query("both_team_metrics", sql(
    """SELECT match_id, b.code, home_title, away_title, h.games AS home_games, a.games AS away_games, h.rating AS home_rating, a.rating AS away_rating FROM (
      SELECT * FROM (SELECT x.match_id, x.code, x.t AS home_title, y.t AS away_title, row_number() OVER (PARTITION BY x.match_id ORDER BY x.c) AS rn
        FROM hit x JOIN hit y USING (match_id, c) WHERE x.side = 'home' AND y.side = 'away') WHERE rn = 1) b
    JOIN teams h ON h.code = b.code AND h.title = home_title JOIN teams a ON a.code = b.code AND a.title = away_title""",
    "wide", extra=[f"teams AS ({TEAMS})", f"paired AS ({PAIRED})", """codes AS (SELECT match_id, 0 AS c, code_a AS code FROM paired UNION ALL SELECT match_id, 1, code_b FROM paired)""",
    """names AS (SELECT match_id, 'home' AS side, 0 AS pos, lower(home_name) AS a FROM paired UNION ALL SELECT match_id, 'away', 0, lower(replace(away_name, ' (W)', '')) FROM paired
      UNION ALL SELECT match_id, 'away', 1, lower(away_name) FROM paired)""",
    """hit AS (SELECT * FROM (SELECT n.match_id, c.c, c.code, n.side, t.title AS t, row_number() OVER (PARTITION BY n.match_id, c.c, n.side ORDER BY n.pos, CASE WHEN n.a = lower(t.title) THEN 0 ELSE 1 END, t.place) AS rn
      FROM names n JOIN codes c USING (match_id) JOIN teams t ON t.code = c.code AND (starts_with(n.a, lower(t.title)) OR starts_with(lower(t.title), n.a))) WHERE rn = 1)"""]))
def both_team_metrics(spark, sf_dir):
    matches = view(spark, sf_dir, PAIRED).select(
        "match_id", F.array("code_a", "code_b").alias("codes"), *[joins.alias_list(F.col(f"{s}_name")).alias(f"{s}_aliases") for s in ("home", "away")],
    )
    return joins.both_team_metrics(matches, view(spark, sf_dir, TEAMS), ["games", "rating"])


def analyses(spark, sf_dir):
    return view(spark, sf_dir, ANALYSES)


def stored_xg(wide):
    return wide.select("match_id", F.col("xg_coverage").alias("coverage"), "home_xg", "away_xg", "home_xga", "away_xga")


# --- the same in DuckDB: from the numbers that the texts were written from -----------------

_n = lambda c: f"({N[c]})"
_played = f"greatest({_n('w')} + {_n('d')} + {_n('l')}, 1)::DOUBLE"
_rate = lambda gf, ga, w: clip(
    f"1450e0 + (0.5::DOUBLE - ({_n('rk')} - 1) / ({_n('tc')} - 1)::DOUBLE) * 180e0 + {_n('pts')} * 2.4::DOUBLE + {_n('gd')} * 3e0 + {_n(w)} * 1.5::DOUBLE", "1325e0", "1875e0")
_quoted = lambda now, then: f"CASE WHEN k % 2 = 0 THEN {_n(now)} ELSE {_n(then)} END / 100e0"
_DERIVED = f"""games AS (SELECT team, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT home_team AS team, match_time AS ts FROM wide UNION ALL SELECT away_team, match_time FROM wide) GROUP BY 1, 2),
loads AS (SELECT team, day, coalesce(date_diff('day', lag(day) OVER w, day), 0)::DOUBLE AS rest,
  CAST(coalesce(sum(n) OVER (PARTITION BY team ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS load FROM games WINDOW w AS (PARTITION BY team ORDER BY day)),
der AS (SELECT w.*, match_id AS k, lh.rest AS d_rest_home, la.rest AS d_rest_away, lh.load AS d_load_home, la.load AS d_load_away,
  {_n('n')} AS rh_n, ({_n('w')} * 3 + {_n('d')}) / {_n('n')}::DOUBLE AS rh_ppg, ({_n('gf')} - {_n('ga')}) / {_n('n')}::DOUBLE AS rh_gd, {_n('gf')} / {_n('n')}::DOUBLE AS rh_gf, {_n('ga')} / {_n('n')}::DOUBLE AS rh_ga,
  CASE WHEN k % 3 = 0 THEN 0 ELSE {_n('n')} END AS ra_n, CASE WHEN k % 3 = 0 THEN 0e0 ELSE ({_n('l')} * 3 + {_n('d')}) / {_n('n')}::DOUBLE END AS ra_ppg,
  CASE WHEN k % 3 = 0 THEN 0e0 ELSE ({_n('ga')} - {_n('gf')}) / {_n('n')}::DOUBLE END AS ra_gd, CASE WHEN k % 3 = 0 THEN 0e0 ELSE {_n('ga')} / {_n('n')}::DOUBLE END AS ra_gf, CASE WHEN k % 3 = 0 THEN 0e0 ELSE {_n('gf')} / {_n('n')}::DOUBLE END AS ra_ga,
  ({_n('w')} * 3 + {_n('d')}) / {_played} AS sp_home, ({_n('d')} * 3 + {_n('l')}) / {_played} AS sp_away, {_n('w')} + {_n('d')} + {_n('l')} AS sp_n,
  {_n('n')} AS hh_n, ({_n('w')} - {_n('l')}) / {_n('n')}::DOUBLE AS hh_edge, {_n('rk')} AS rank_home, {_n('tc')} AS teams_home, {_rate('gf', 'ga', 'w')} AS rate_home,
  CASE WHEN k % 4 = 0 THEN 0 ELSE {_n('rk')} END AS rank_away, CASE WHEN k % 4 = 0 THEN 0 ELSE {_n('tc')} END AS teams_away, CASE WHEN k % 4 = 0 THEN 1500e0 ELSE {_rate('ga', 'gf', 'l')} END AS rate_away,
  CASE WHEN k % 7 = 0 THEN market_odds_home ELSE {_quoted('o2', 'o1')} END AS o_home, CASE WHEN k % 7 = 0 THEN market_odds_draw ELSE {_quoted('o3', 'o2')} END AS o_draw, CASE WHEN k % 7 = 0 THEN market_odds_away ELSE {_quoted('o1', 'o3')} END AS o_away,
  CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS mv_on, CASE WHEN k % 3 = 0 THEN 0e0 ELSE round(ln(1e0 + (1000 + k % 9000) / 100e0) - ln(1e0 + (200 + k % 700) / 100e0), 6) END AS mv_gap,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS lu_on, CASE WHEN k % 3 = 0 THEN 1e0 - (0.03::DOUBLE + 8 * 0.015::DOUBLE) ELSE 0.92::DOUBLE END AS lu_home, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS lu_doubt
  FROM (SELECT *, match_id AS k FROM wide) w LEFT JOIN loads lh ON lh.team = home_team AND lh.day = CAST(match_time AS DATE) LEFT JOIN loads la ON la.team = away_team AND la.day = CAST(match_time AS DATE))"""
_inv = lambda o: f"CASE WHEN o_{o} > 0 THEN 1e0 / o_{o} ELSE 0.33::DOUBLE END"
_PRICED = f"SELECT *, {', '.join(f'greatest({_inv(o)}, 0.001::DOUBLE) AS v_{o}' for o in V.OUTCOMES)}"
_prob = lambda o: f"v_{o} / (v_home + v_draw + v_away)"


@query("feature_snapshots", sql(
    f"""SELECT match_id, period, round(rate_home, 3) AS home_rating, round(rate_away, 3) AS away_rating, round(rh_ppg, 4) AS recent_home_ppg, round(ra_ppg, 4) AS recent_away_ppg, round(rh_gf, 4) AS recent_home_gf_pg, round(ra_ga, 4) AS recent_away_ga_pg,
    round(sp_home, 4) AS home_split_ppg, round(sp_away, 4) AS away_split_ppg, CAST(lu_doubt AS INT) AS home_doubtful_count, round(lu_home, 4) AS lineup_home_availability, d_rest_home AS rest_days_home, CAST(d_load_away AS INT) AS schedule_load_away,
    round(hh_edge, 4) AS h2h_edge, {', '.join(f'round({_prob(o)}, 6) AS market_{o}_prob' for o in V.OUTCOMES)}, CAST(rh_n AS INT) AS p_recent_matches, round(ra_gd, 6) AS p_away_goal_diff, CAST(rank_away AS INT) AS p_away_rank, o_home AS p_home_odds, mv_gap AS p_value_gap,
    round(CASE WHEN xg_coverage = 0 THEN 0e0 ELSE home_xg END, 6) AS p_home_xg, 13 AS p_groups FROM ({_PRICED} FROM der)""", "wide", extra=[_DERIVED]))
def feature_snapshots(spark, sf_dir):
    wide = load(spark, sf_dir, "wide")
    found = features.feature_snapshots(analyses(spark, sf_dir), F.current_timestamp(), features.team_schedule(wide), stored_xg(wide))
    read = {"recent_home": "matches int", "recent_away": "goal_diff_per_game double", "strength_away": "rank int", "market_odds": "home double", "market_value": "log_gap double", "xg": "home_xg double"}
    found = found.withColumn("_read", F.from_json("feature_payload", ", ".join(f"{g} struct<{f.replace(' ', ': ')}>" for g, f in read.items())))
    at = lambda path: F.col(f"_read.{path}")
    return found.select(
        "match_id", "period", "home_rating", "away_rating", "recent_home_ppg", "recent_away_ppg", "recent_home_gf_pg", "recent_away_ga_pg", "home_split_ppg", "away_split_ppg", "home_doubtful_count", "lineup_home_availability",
        "rest_days_home", "schedule_load_away", "h2h_edge", *[f"market_{o}_prob" for o in V.OUTCOMES], at("recent_home.matches").alias("p_recent_matches"), round_to(at("recent_away.goal_diff_per_game"), 6).alias("p_away_goal_diff"),
        at("strength_away.rank").alias("p_away_rank"), at("market_odds.home").alias("p_home_odds"), at("market_value.log_gap").alias("p_value_gap"), round_to(at("xg.home_xg"), 6).alias("p_home_xg"),
        F.size(F.json_object_keys("feature_payload")).alias("p_groups"),
    )


# Stored snapshots of any age and shape: none, empty, broken, no object, some groups, empty groups; an older one beside each.
_GIVEN = (
    '{"recent_home": {"matches": 9, "points_per_game": "2.5", "goal_diff_per_game": 1.25}, "h2h": {"matches": 4, "edge": -0.5}, "market_odds": {"home": 2.0, "draw": 3.2, "away": 4.0},'
    ' "schedule": {"home_rest_days": 6, "away_rest_days": 3.0, "home_load_14": 2, "away_load_14": 4}, "strength_home": {"rank": 2, "team_count": 20}, "market_value": {"coverage": 1, "log_gap": -0.8},'
    ' "lineup_raw": {"home_lineup": ["A"]}, "xg": {"coverage": 1, "home_xg": 1.5}}'
)
_HOLLOW = '{"recent_home": {}, "h2h": null, "split": [], "market_probs": {"home": 0.5, "draw": "0.25", "away": 0.25}, "lineup_raw": {"home_lineup": []}}'
SNAPSHOTS = f"""SELECT match_id, match_id * 2 + age AS snapshot_id, date_add(DATE '2020-01-01', CAST(1 - age AS INT)) AS snapshot_at, 1480e0 + match_id % 50 AS home_rating, 1470e0 + match_id % 70 AS away_rating,
    2e0 + match_id % 3 AS rest_days_home, 1e0 AS rest_days_away, CAST(match_id % 4 AS INT) AS schedule_load_home, 3 AS schedule_load_away,
    CASE WHEN age = 1 THEN '{{{{"recent_home": {{{{"points_per_game": 99}}}}}}}}' ELSE CASE match_id % 6 WHEN 1 THEN '' WHEN 2 THEN '{{{{"recent_home": {{{{"points_per' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{_GIVEN.replace("{", "{{").replace("}", "}}")}' ELSE '{_HOLLOW.replace("{", "{{").replace("}", "}}")}' END END AS feature_payload
    FROM {{wide}} CROSS JOIN (SELECT 0 AS age UNION ALL SELECT 1) ages WHERE match_id % 6 <> 0"""
_six = lambda given, other: f"CASE WHEN k % 6 = 4 THEN {given} ELSE {other} END"
_seen = lambda given, other: f"CASE WHEN k % 6 <> 0 THEN {given} ELSE {other} END"
_expected = lambda rank, teams: f"CASE WHEN {rank} > 0 AND {teams} > 1 THEN {clip(f'2.4::DOUBLE - ({rank} - 1) / ({teams} - 1)::DOUBLE * 1.7::DOUBLE', '0.6::DOUBLE', '2.5::DOUBLE')} ELSE 1.4::DOUBLE END"
_goals = lambda rank, teams: f"CASE WHEN {rank} > 0 AND {teams} > 1 THEN {clip(f'1.5::DOUBLE - ({rank} - 1) / ({teams} - 1)::DOUBLE * 2.7::DOUBLE', '-1.4::DOUBLE', '1.6::DOUBLE')} ELSE 0e0 END"
_FEATURES = f"""fe0 AS (SELECT * REPLACE ({_six('9', 'rh_n')} AS rh_n, {_six('2.5::DOUBLE', 'rh_ppg')} AS rh_ppg, {_six('1.25::DOUBLE', 'rh_gd')} AS rh_gd, {_six('4', 'hh_n')} AS hh_n, {_six('-0.5::DOUBLE', 'hh_edge')} AS hh_edge,
  {_six('2e0', 'o_home')} AS o_home, {_six('3.2::DOUBLE', 'o_draw')} AS o_draw, {_six('4e0', 'o_away')} AS o_away, {_six('2', 'rank_home')} AS rank_home, {_six('20', 'teams_home')} AS teams_home, {_six('1', 'mv_on')} AS mv_on, {_six('-0.8::DOUBLE', 'mv_gap')} AS mv_gap),
  {_seen('1480e0 + k % 50', 'rate_home')} AS r_home, {_seen('1470e0 + k % 70', 'rate_away')} AS r_away, {_six('6e0', _seen('2e0 + k % 3', '0e0'))} AS f_rest_home, {_six('3e0', _seen('1e0', '0e0'))} AS f_rest_away,
  {_six('2', _seen('k % 4', '0'))} AS f_load_home, {_six('4', _seen('3', '0'))} AS f_load_away, {_six('1.5::DOUBLE', 'CASE WHEN xg_coverage = 0 THEN 0e0 ELSE home_xg END')} AS f_home_xg FROM der),
fe1 AS (SELECT *, CASE WHEN mv_on = 1 THEN {clip('mv_gap * 85e0', '-190e0', '190e0')} ELSE 0e0 END AS vgap, {', '.join(f'greatest({_inv(o)}, 0.001::DOUBLE) AS v_{o}' for o in V.OUTCOMES)} FROM fe0),
fe AS (SELECT *, r_home + greatest(vgap, 0e0) * 0.45::DOUBLE + rh_ppg * 24e0 + sp_home * 18e0 + rh_gd * 22e0 AS s_home, r_away + greatest(-vgap, 0e0) * 0.45::DOUBLE + ra_ppg * 24e0 + sp_away * 18e0 + ra_gd * 22e0 AS s_away,
  CASE WHEN k % 6 = 5 THEN 0.5::DOUBLE ELSE {_prob('home')} END AS p_home, CASE WHEN k % 6 = 5 THEN 0.25::DOUBLE ELSE {_prob('away')} END AS p_away, lu_on = 1 OR k % 6 = 4 AS lineup_ok FROM fe1)"""


def loaded(spark, sf_dir):
    return features.match_features(analyses(spark, sf_dir), view(spark, sf_dir, SNAPSHOTS), stored_xg(load(spark, sf_dir, "wide")))


@query("match_features", sql(
    f"""SELECT match_id, CAST(rh_n AS INT) AS recent_matches, round(rh_ppg, 6) AS home_ppg, round(ra_ppg, 6) AS away_ppg, round(r_home - r_away, 6) AS rating_gap, round(vgap, 6) AS market_value_rating_gap, round(s_home - s_away, 6) AS strength_gap,
    round(hh_edge, 6) AS h2h_edge, f_rest_home - f_rest_away AS rest_advantage, CAST(f_load_away - f_load_home AS DOUBLE) AS schedule_gap, CASE WHEN k % 5 < 2 THEN 0.15::DOUBLE ELSE 0e0 END AS motivation_signal, round(p_home - p_away, 6) AS market_bias_anchor,
    CASE WHEN k % 6 <> 0 THEN k * 2 ELSE 0 END AS feature_snapshot_id, round(rh_ppg - {_expected('rank_home', 'teams_home')} - (ra_ppg - {_expected('rank_away', 'teams_away')}), 6) AS form_residual_gap,
    round(rh_gd - {_goals('rank_home', 'teams_home')} - (ra_gd - {_goals('rank_away', 'teams_away')}), 6) AS goal_diff_residual_gap, round(f_home_xg, 6) AS home_xg FROM fe""", "wide", extra=[_DERIVED, _FEATURES]))
def match_features(spark, sf_dir):
    df = loaded(spark, sf_dir)
    rounded = ("rating_gap", "market_value_rating_gap", "strength_gap", "market_bias_anchor", "form_residual_gap", "goal_diff_residual_gap")
    return df.select(
        "match_id", F.col("recent_home.matches").alias("recent_matches"), round_to("recent_home.points_per_game", 6).alias("home_ppg"), round_to("recent_away.points_per_game", 6).alias("away_ppg"), round_to("h2h.edge", 6).alias("h2h_edge"),
        "rest_advantage", "schedule_gap", "motivation_signal", "feature_snapshot_id", round_to("xg.home_xg", 6).alias("home_xg"), *[round_to(c, 6).alias(c) for c in rounded],
    )


_CHECKS = {
    "recent_home": "rh_n >= 6", "recent_away": "ra_n >= 6", "home_away": "sp_n >= 6", "ratings": "r_home > 0 AND r_away > 0", "market_value": "mv_on = 1", "lineup": "lineup_ok", "h2h": "hh_n > 0",
    "schedule": "f_rest_home > 0 OR f_rest_away > 0 OR f_load_home > 0 OR f_load_away > 0", "market": "o_home > 0 AND o_draw > 0 AND o_away > 0",
}


@query("data_quality_scores", sql(
    f"""SELECT match_id, round(score, 6) AS score, round(0.72::DOUBLE + score * 0.28::DOUBLE, 6) AS weight_adjustment, array_to_string(list_filter([CASE WHEN NOT (c_recent_home AND c_recent_away) THEN 'recent_form' END, CASE WHEN NOT c_home_away THEN 'home_away_form' END,
      CASE WHEN NOT c_ratings THEN 'ratings' END, CASE WHEN NOT c_lineup THEN 'lineup_text_only' END, CASE WHEN NOT c_market THEN 'market_odds' END, CASE WHEN NOT c_schedule THEN 'schedule' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM (SELECT *, {' + '.join(f'CASE WHEN c_{n} THEN {w}::DOUBLE ELSE 0e0 END' for n, w in models.QUALITY_WEIGHTS.items())} AS score FROM (SELECT *, {', '.join(f'({c}) AS c_{n}' for n, c in _CHECKS.items())} FROM fe))""",
    "wide", extra=[_DERIVED, _FEATURES]))
def data_quality_scores(spark, sf_dir):
    df = features.data_quality(loaded(spark, sf_dir))
    return df.select("match_id", round_to("quality", 6).alias("score"), round_to("weight_adjustment", 6).alias("weight_adjustment"), F.array_join("problems", ",").alias("problems"))
