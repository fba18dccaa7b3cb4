"""Learning queries: calibration, rule grids, bucket tables, walk-forward, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numeric import ratio as spark_ratio
from ..functions.numeric import round_to
from ..operators import learning, metrics
from . import adapters
from .oracle import SETTLED, argmax, big, by_outcome, margin_of, odds_of, ratio, with_wide
from .registry import query

#: Periods of the window that ``learning_split`` shows; all other learning queries read every period.
WINDOW_PERIODS = 60


def rows(spark, sf_dir, last=None):
    return learning.learning_window(metrics.with_settlement(adapters.wide(spark, sf_dir)), last)


_PERIODS = "SELECT DISTINCT period FROM settled WHERE period <> ''"
_ROWS = f"""ax AS (SELECT period, row_number() OVER (ORDER BY CAST(period AS BIGINT)) AS period_rank FROM ({_PERIODS})),
lr AS (SELECT s.*, period_rank, period_rank = (SELECT max(period_rank) FROM ax) AS val FROM settled s JOIN ax USING (period))"""

# --- calibration -----------------------------------------------------------------

_RAW = ", ".join(f"greatest(final_{o}_prob, 1e-6) AS r_{o}" for o in V.OUTCOMES)
_SCALES = ", ".join(f"({i}, {s}::DOUBLE, {t}::DOUBLE)" for i, (s, t) in enumerate((s, t) for s in V.BIAS_SCALES for t in V.TEMPERATURES))
_CAL = f"""raw0 AS (SELECT *, {_RAW} FROM lr),
raw AS (SELECT *, r_home / (r_home + r_draw + r_away) AS q_home, r_draw / (r_home + r_draw + r_away) AS q_draw, r_away / (r_home + r_draw + r_away) AS q_away FROM raw0),
bias0 AS (SELECT {', '.join(f"ln(greatest(avg(CASE WHEN actual_result = '{o}' THEN 1e0 ELSE 0e0 END), 1e-6) / greatest(avg(q_{o}), 1e-6)) AS b_{o}" for o in V.OUTCOMES)} FROM raw WHERE NOT val),
grid AS (SELECT g.*, {', '.join(f'(b_{o} - (b_home + b_draw + b_away) / 3e0) * bias_scale AS c_{o}' for o in V.OUTCOMES)} FROM (VALUES {_SCALES}) g(grid_id, bias_scale, temperature), bias0),
sm AS (SELECT grid_id, bias_scale, temperature, val, actual_result, {', '.join(f'exp((ln(greatest(q_{o}, 1e-6)) + c_{o}) / temperature) AS e_{o}' for o in V.OUTCOMES)} FROM raw, grid),
cp AS (SELECT *, e_home / (e_home + e_draw + e_away) AS p_home, e_draw / (e_home + e_draw + e_away) AS p_draw, e_away / (e_home + e_draw + e_away) AS p_away FROM sm),
cs AS (SELECT grid_id, bias_scale, temperature, val, -ln(greatest({by_outcome('actual_result', 'p_home', 'p_draw', 'p_away')}, 1e-6)) AS ll,
   ({' + '.join(f"pow(p_{o} - CASE WHEN actual_result = '{o}' THEN 1e0 ELSE 0e0 END, 2)" for o in V.OUTCOMES)}) / 3e0 AS br,
   CASE WHEN {argmax('p_home', 'p_draw', 'p_away')} = actual_result THEN 1 ELSE 0 END AS hit FROM cp),
cg AS (SELECT grid_id, bias_scale, temperature, count(*) FILTER (NOT val) AS train_samples, count(*) FILTER (val) AS validation_samples,
  {', '.join(f"round(avg({c}) FILTER ({f}), 6) AS {s}_{n}" for s, f in (('train', 'NOT val'), ('validation', 'val')) for c, n in (('ll', 'log_loss'), ('br', 'brier_score'), ('hit', 'hit_rate')))} FROM cs GROUP BY 1, 2, 3)"""


@query("calibration_grid", with_wide("SELECT * FROM cg", SETTLED, _ROWS, _CAL))
def calibration_grid(spark, sf_dir):
    return learning.calibration_grid(rows(spark, sf_dir))


@query("fit_calibrator", with_wide(
    """SELECT CASE WHEN (SELECT count(*) FROM lr WHERE NOT val) < 200 OR (SELECT min(n) FROM (SELECT count(*) AS n FROM lr WHERE NOT val GROUP BY actual_result)) < 25 THEN 'insufficient_samples'
      WHEN c.validation_log_loss + 1e-9 < b.validation_log_loss AND c.validation_brier_score <= b.validation_brier_score + 1e-9 THEN 'ready' ELSE 'no_gain' END AS status,
    c.bias_scale, c.temperature, c.train_log_loss, b.train_log_loss AS baseline_train_log_loss, c.validation_log_loss, b.validation_log_loss AS baseline_validation_log_loss
    FROM (SELECT * FROM cg ORDER BY train_log_loss, grid_id LIMIT 1) c, (SELECT * FROM cg WHERE grid_id = 2) b""", SETTLED, _ROWS, _CAL))
def fit_calibrator(spark, sf_dir):
    return learning.fit_calibrator(rows(spark, sf_dir))


# --- handicap grid -----------------------------------------------------------------

_OWN = lambda h, a: f"(CASE handicap_recommended_side WHEN 'home' THEN {h} ELSE {a} END)"
_DEC = lambda x: f"(CASE WHEN {x} > 0 AND {x} < 1.5 THEN {x} + 1e0 ELSE {x} END)"


def _list(vals):
    return "[" + ", ".join(f"{v}::DOUBLE" for v in vals) + "]"


def _idx(x, vals):
    return "(" + " + ".join(f"CASE WHEN {x} >= {v}::DOUBLE THEN 1 ELSE 0 END" for v in vals) + ")"


_HG = V.HANDICAP_GRID
_HCELL = f"""hs0 AS (SELECT *, {_OWN('handicap_home_cover_prob', 'handicap_away_cover_prob')} AS cov, {_OWN('handicap_away_cover_prob', 'handicap_home_cover_prob')} AS oth,
  {_DEC(_OWN('handicap_home_odds', 'handicap_away_odds'))} AS od FROM lr),
hs AS (SELECT *, CASE WHEN od > 0 THEN cov * od - 1e0 ELSE -1e0 END AS ev, CAST(handicap_recommended_side = handicap_actual_result AS INT) AS h,
  CASE WHEN handicap_actual_result = 'push' THEN 0e0 WHEN handicap_recommended_side = handicap_actual_result THEN CASE WHEN od > 1 THEN round(0.01::DOUBLE * (od - 1e0), 4) ELSE 0e0 END ELSE -0.01::DOUBLE END AS r FROM hs0),
hcell AS (SELECT {_idx('ev', _HG['ev_min'])} AS i1, {_idx('handicap_confidence', _HG['confidence_min'])} AS i2, {_idx('cov', _HG['cover_prob_min'])} AS i3,
  {_idx('(cov - oth)', _HG['cover_margin_min'])} AS i4, {_idx('quality_score', _HG['quality_min'])} AS i5,
  CASE WHEN od <= 0 THEN 9 WHEN od <= 1.8 THEN 0 WHEN od <= 2.2 THEN 1 WHEN od <= 10 THEN 2 ELSE 9 END AS i6,
  handicap_recommended_side AS sd, handicap_recommendation AS ac, {', '.join(f"{e} AS {s}_{n}" for s, f in (('train', 'NOT val'), ('validation', 'val')) for e, n in ((f'count(*) FILTER ({f})', 'actions'), (f'coalesce(sum(h) FILTER ({f}), 0)', 'hits'), (f'coalesce(sum(r) FILTER ({f}), 0)', 'roi')))}
  FROM hs GROUP BY ALL),
hrule AS (SELECT a, b, c, d, e, f, g, k, ((((((a * 4 + b) * 3 + c) * 3 + d) * 2 + e) * 3 + f) * 3 + g) * 3 + k AS rule_id
  FROM range(5) t1(a), range(4) t2(b), range(3) t3(c), range(3) t4(d), range(2) t5(e), range(3) t6(f), range(3) t7(g), range(3) t8(k)),
hsum AS (SELECT rule_id, {', '.join(f'sum({s}_{n}) AS {s}_{n}' for s in ('train', 'validation') for n in ('actions', 'hits', 'roi'))} FROM hrule JOIN hcell ON i1 > a AND i2 > b AND i3 > c AND i4 > d AND i5 > e AND i6 <= f
  AND (g = 0 OR (g = 1 AND sd = 'home') OR (g = 2 AND sd = 'away')) AND (k = 0 OR (k = 1 AND ac IN ('light', 'main')) OR (k = 2 AND ac = 'main')) GROUP BY 1)"""


def _metrics(prefix, samples):
    return (
        f"{samples} AS {prefix}_samples, {ratio(f'{prefix}_hits', f'{prefix}_actions', 12)} AS {prefix}_hit_rate,"
        f" {ratio(f'{prefix}_actions', samples, 12)} AS {prefix}_action_share, round({prefix}_roi, 4) AS {prefix}_total_roi"
    )


_HMET = f"""hmet AS (SELECT rule_id, {', '.join(f"{big(f'{s}_{n}')} AS {s}_{n}" for s in ('train', 'validation') for n in ('actions', 'hits'))}, train_roi, validation_roi,
  {_metrics('train', '(SELECT count(*) FROM lr WHERE NOT val)')}, {_metrics('validation', '(SELECT count(*) FROM lr WHERE val)')} FROM hsum)"""
_OUT_COLS = ["rule_id", "train_actions", "train_hits", "validation_actions", "validation_hits", "train_total_roi", "validation_total_roi"]


@query("handicap_rule_grid", with_wide(f"SELECT {', '.join(_OUT_COLS)} FROM hmet", SETTLED, _ROWS, _HCELL, _HMET))
def handicap_rule_grid(spark, sf_dir):
    return learning.handicap_rules(rows(spark, sf_dir)).select(*_OUT_COLS)


def _front(src, target):
    gap = "-(greatest(0.75 - validation_hit_rate, 0e0) * 2e0 + greatest(0.5 - validation_action_share, 0e0))"
    ready = f"validation_samples >= 10 AND validation_actions > 0 AND validation_hit_rate >= {target['hit_rate']} AND validation_action_share >= {target['action_share']}"
    h, s, r = "validation_hit_rate", "validation_action_share", "validation_total_roi"
    arm = lambda name, order, where="true": (
        f"SELECT * FROM (SELECT '{name}' AS pick, rule_id, train_actions, validation_actions, round({h}, 6) AS validation_hit_rate, round({s}, 6) AS validation_action_share, {r},"
        f" CASE WHEN {ready} THEN 'ready' WHEN validation_samples < 10 THEN 'insufficient_samples' ELSE 'target_unreachable' END AS status FROM {src}"
        f" WHERE train_actions >= 40 AND {where} ORDER BY {', '.join(o + ' DESC' for o in order)}, rule_id LIMIT 1)"
    )
    return " UNION ALL ".join([
        arm("best_ready", [gap, h, s, r], ready), arm("best_candidate", [gap, h, s, r]), arm("best_hit", [h, s, r]),
        arm("best_action", [s, h, r]), arm("best_covered", [h, s, r], f"{s} > {target['action_share']}"),
    ])


_FRONT = ["pick", "rule_id", "train_actions", "validation_actions", "validation_hit_rate", "validation_action_share", "validation_total_roi", "status"]


def _front_cols(df):
    return df.select(*[round_to(c, 6).alias(c) if c in ("validation_hit_rate", "validation_action_share") else F.col(c) for c in _FRONT])


@query("fit_handicap_rules", with_wide(_front("hmet", V.HANDICAP_TARGET), SETTLED, _ROWS, _HCELL, _HMET))
def fit_handicap_rules(spark, sf_dir):
    return _front_cols(learning.fit_handicap_rules(rows(spark, sf_dir)))


# --- handicap buckets -----------------------------------------------------------------

_FL = lambda x, w, o: f"CAST(CAST(floor(({x} + {o}) / {w}) AS BIGINT) AS VARCHAR)"
_EVS = lambda s: f"(CASE WHEN {_DEC(f'handicap_{s}_odds')} > 0 THEN handicap_{s}_cover_prob * {_DEC(f'handicap_{s}_odds')} - 1e0 ELSE -9e0 END)"
_B = {
    "line25": _FL("handicap_line", "0.25::DOUBLE", "5e0"), "line50": _FL("handicap_line", "0.5::DOUBLE", "5e0"),
    "coverdiff10": _FL("(handicap_home_cover_prob - handicap_away_cover_prob)", "0.1::DOUBLE", "2e0"),
    "evdiff10": _FL(f"({_EVS('home')} - {_EVS('away')})", "0.1::DOUBLE", "5e0"), "awayodds20": _FL(_DEC("handicap_away_odds"), "0.2::DOUBLE", "0e0"),
}
_BCELL = "bl AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature_set, concat_ws('|', {', '.join(_B[f] for f in fs)}) AS bucket, val, handicap_actual_result AS r FROM lr" for n, fs in V.BUCKET_FEATURE_SETS.items()
) + f""")), bt AS (SELECT feature_set, bucket, {', '.join(f"count(*) FILTER ({f} AND r = '{x}') AS {s}_{x}" for s, f in (('train', 'NOT val'), ('validation', 'val')) for x in ('home', 'away', 'push'))} FROM bl GROUP BY 1, 2),
bs AS (SELECT *, CASE WHEN train_home + train_away >= 3 AND greatest(train_home, train_away) / (train_home + train_away)::DOUBLE >= 0.55 THEN CASE WHEN train_home >= train_away THEN 'home' ELSE 'away' END ELSE '' END AS side FROM bt),
bm AS (SELECT feature_set, count(*) FILTER (side <> '') AS bucket_count, {', '.join(f"{big(e)} AS {s}_{n}" for s in ('train', 'validation') for e, n in (
    (f'sum({s}_home + {s}_away + {s}_push)', 'samples'), (f"coalesce(sum({s}_home + {s}_away + {s}_push) FILTER (side <> ''), 0)", 'actions'),
    (f"sum(CASE side WHEN 'home' THEN {s}_home WHEN 'away' THEN {s}_away ELSE 0 END)", 'hits')))} FROM bs GROUP BY 1)"""
_BOUT = ["feature_set", "bucket_count", "train_samples", "train_actions", "train_hits", "validation_samples", "validation_actions", "validation_hits"]


@query("handicap_bucket_table", with_wide("SELECT feature_set, bucket, side, train_home, train_away, train_push FROM bs WHERE side <> ''", SETTLED, _ROWS, _BCELL))
def handicap_bucket_table(spark, sf_dir):
    table = learning.bucket_table(learning.bucket_cells(rows(spark, sf_dir))).filter("side <> ''")
    return table.select("feature_set", "bucket", "side", "train_home", "train_away", "train_push")


@query("handicap_bucket_metrics", with_wide(f"SELECT {', '.join(_BOUT)} FROM bm", SETTLED, _ROWS, _BCELL))
def handicap_bucket_metrics(spark, sf_dir):
    return learning.bucket_metrics(learning.bucket_cells(rows(spark, sf_dir))).select(*_BOUT)


@query("fit_handicap_buckets", with_wide(
    f"""SELECT feature_set, bucket_count, validation_actions, validation_hits, CASE WHEN rdy THEN 'ready' WHEN validation_samples < 10 THEN 'insufficient_samples' ELSE 'target_unreachable' END AS status FROM (
    SELECT *, validation_hits / validation_actions::DOUBLE AS hr, validation_actions / validation_samples::DOUBLE AS sh,
      validation_samples >= 10 AND validation_actions > 0 AND validation_hits / validation_actions::DOUBLE >= 0.7 AND validation_actions / validation_samples::DOUBLE >= 0.6 AS rdy FROM bm)
    ORDER BY rdy DESC, -(greatest(0.75 - hr, 0e0) * 2e0 + greatest(0.5 - sh, 0e0)) DESC, hr DESC, sh DESC, list_position({list(V.BUCKET_FEATURE_SETS)}, feature_set) LIMIT 1""", SETTLED, _ROWS, _BCELL))
def fit_handicap_buckets(spark, sf_dir):
    return learning.fit_buckets(rows(spark, sf_dir)).select("feature_set", "bucket_count", "validation_actions", "validation_hits", "status")


_TBL = lambda n: f"(SELECT bucket, side FROM bs WHERE side <> '' AND feature_set = '{n}')"
_SETS = list(V.BUCKET_FEATURE_SETS)


@query("apply_handicap_buckets", with_wide(
    f"""SELECT match_id, coalesce(t0.side, t2.side, '') AS bucket_side, CASE WHEN t0.side IS NOT NULL THEN 'primary' WHEN t2.side IS NOT NULL THEN 'fallback' ELSE '' END AS bucket_source
    FROM lr LEFT JOIN {_TBL(_SETS[0])} t0 ON t0.bucket = concat_ws('|', {', '.join(_B[f] for f in V.BUCKET_FEATURE_SETS[_SETS[0]])})
    LEFT JOIN {_TBL(_SETS[2])} t2 ON t2.bucket = concat_ws('|', {', '.join(_B[f] for f in V.BUCKET_FEATURE_SETS[_SETS[2]])})""", SETTLED, _ROWS, _BCELL))
def apply_handicap_buckets(spark, sf_dir):
    r = rows(spark, sf_dir)
    return learning.apply_buckets(r, learning.bucket_cells(r), [_SETS[0], _SETS[2]]).select("match_id", "bucket_side", "bucket_source")


# --- outcome grid -----------------------------------------------------------------------

_OG = V.OUTCOME_GRID
_P, _M, _O, _E = (tuple(f"{x}_{o}" for o in V.OUTCOMES) for x in ("p", "market", "market_odds", "e"))
_MPS = tuple(f"market_{o}_prob" for o in V.OUTCOMES)
_PRICE = tuple(f"(CASE WHEN market_odds_{o} > 0 THEN -market_odds_{o} ELSE -99e0 END)" for o in V.OUTCOMES)
_DIRS = [argmax(*_MPS), argmax(*_P), "recommended_outcome", "algo_recommended_outcome", argmax(*_PRICE), argmax(*_E)]
_OCELL = f"""o0 AS (SELECT *, {', '.join(f'greatest(final_{o}_prob, 1e-6) / (greatest(final_home_prob, 1e-6) + greatest(final_draw_prob, 1e-6) + greatest(final_away_prob, 1e-6)) AS p_{o}' for o in V.OUTCOMES)} FROM lr),
o1 AS (SELECT *, {', '.join(f'CASE WHEN market_odds_{o} > 0 THEN p_{o} * market_odds_{o} - 1e0 ELSE -1e0 END AS e_{o}' for o in V.OUTCOMES)} FROM o0),
o2 AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT *, {i} AS dr, {e} AS oc FROM o1' for i, e in enumerate(_DIRS))})),
o3 AS (SELECT *, {odds_of('oc')} AS od, CAST(oc = actual_result AS INT) AS h FROM o2),
ocell AS (SELECT dr, period, period_rank, val, CASE WHEN od <= 0 THEN 9 {' '.join(f'WHEN od <= {c} THEN {i}' for i, c in enumerate(_OG['odds_max']))} ELSE 9 END AS i1,
  {_idx(by_outcome('oc', *_P), _OG['prob_min'])} AS i2, {_idx(by_outcome('oc', *_MPS), _OG['market_prob_min'])} AS i3, {_idx('quality_score', _OG['quality_min'])} AS i4,
  {_idx('confidence_score', _OG['confidence_min'])} AS i5, {_idx(by_outcome('oc', *_E), _OG['ev_min'])} AS i6, {_idx(margin_of('oc', *_P), _OG['prob_margin_min'])} AS i7, {_idx(margin_of('oc', *_E), _OG['ev_margin_min'])} AS i8,
  count(*) AS n, sum(h) AS h, sum(CASE WHEN h = 1 AND od > 0 THEN round(0.01::DOUBLE * (od - 1e0), 4) WHEN h = 1 THEN 0e0 ELSE -0.01::DOUBLE END) AS r FROM o3 GROUP BY ALL),
orule AS (SELECT d0, a, b, c, d, e, f, g, k, (((((((d0 * 5 + a) * 3 + b) * 3 + c) * 3 + d) * 2 + e) * 2 + f) * 2 + g) * 2 + k AS rule_id
  FROM range(6) t0(d0), range(5) t1(a), range(3) t2(b), range(3) t3(c), range(3) t4(d), range(2) t5(e), range(2) t6(f), range(2) t7(g), range(2) t8(k)),
osplit AS (SELECT dr, val, i1, i2, i3, i4, i5, i6, i7, i8, sum(n) AS n, sum(h) AS h, sum(r) AS r FROM ocell GROUP BY ALL),
osum AS (SELECT rule_id, {', '.join(f'coalesce(sum({c}) FILTER ({f}), 0) AS {s}_{n}' for s, f in (('train', 'NOT val'), ('validation', 'val')) for c, n in (('n', 'actions'), ('h', 'hits'), ('r', 'roi')))}
  FROM orule JOIN osplit ON dr = d0 AND i1 <= a AND i2 > b AND i3 > c AND i4 > d AND i5 > e AND i6 > f AND i7 > g AND i8 > k GROUP BY 1),
omet AS (SELECT rule_id, {', '.join(f"{big(f'{s}_{n}')} AS {s}_{n}" for s in ('train', 'validation') for n in ('actions', 'hits'))}, train_roi, validation_roi,
  {_metrics('train', '(SELECT count(*) FROM lr WHERE NOT val)')}, {_metrics('validation', '(SELECT count(*) FROM lr WHERE val)')} FROM osum)"""


@query("outcome_rule_grid", with_wide(f"SELECT {', '.join(_OUT_COLS)} FROM omet", SETTLED, _ROWS, _OCELL))
def outcome_rule_grid(spark, sf_dir):
    return learning.outcome_rules(rows(spark, sf_dir)).select(*_OUT_COLS)


@query("fit_outcome_rules", with_wide(_front("omet", V.OUTCOME_TARGET), SETTLED, _ROWS, _OCELL))
def fit_outcome_rules(spark, sf_dir):
    return _front_cols(learning.fit_outcome_rules(rows(spark, sf_dir)))


def _steps() -> str:
    """One threshold after the other replaced by the positions it reaches, each step a sum over the cells before."""
    dims = ("a", "b", "c", "d", "e", "f", "g", "k")
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("tn", "th", "tr", "vn", "vh", "vr"))
    out, before = [], "xcat"
    for i, (dim, values) in enumerate(zip(dims, _OG.values()), 1):
        test = "i1 <= p" if i == 1 else f"i{i} > p"
        keys = ", ".join([*dims[: i - 1], *(f"i{j}" for j in range(i + 1, 9))])
        out.append(f"x{i} AS MATERIALIZED (SELECT dr, cat, st, {keys}, p AS {dim}, {sums} FROM {before}, range({len(values)}) t(p) WHERE {test} GROUP BY ALL)")
        before = f"x{i}"
    return ",\n".join(out)


def _gap(name: str) -> str:
    g = {
        "rating_gap": "home_rating - away_rating", "ppg_gap": "recent_home_ppg - recent_away_ppg", "split_ppg_gap": "home_split_ppg - away_split_ppg",
        "lineup_gap": "lineup_home_availability - lineup_away_availability", "absence_gap": "away_absence_impact - home_absence_impact", "h2h_gap": "h2h_edge",
    }[name]
    return f"(CASE oc WHEN 'home' THEN {g} WHEN 'away' THEN -({g}) ELSE -abs({g}) END)"


_CAT_COLUMN = {"outcomes": "oc", "review_decisions": "review_decision", "arbiter_decisions": "arbiter_decision", "effective_sources": "effective_action_source", "algo_actions": "algo_recommendation"}
_CATS = [f"{_CAT_COLUMN[k]} IN ({', '.join(repr(x) for x in v)})" for f in V.CATEGORY_FILTERS for k, v in f.items()]
_STRUCTS = [" AND ".join(f"{_gap(k)} >= {v}::DOUBLE" for k, v in f.items()) for f in V.STRUCTURAL_FILTERS]
_passed = lambda tests: f"unnest(list_filter([0, {', '.join(f'CASE WHEN {t} THEN {i} END' for i, t in enumerate(tests, 1))}], lambda x: x IS NOT NULL))"
_XCELL = f"""xrow AS (SELECT *, CASE WHEN h = 1 AND od > 0 THEN round(0.01::DOUBLE * (od - 1e0), 4) WHEN h = 1 THEN 0e0 ELSE -0.01::DOUBLE END AS r,
  CASE WHEN od <= 0 THEN 9 {' '.join(f'WHEN od <= {c} THEN {i}' for i, c in enumerate(_OG['odds_max']))} ELSE 9 END AS i1,
  {_idx(by_outcome('oc', *_P), _OG['prob_min'])} AS i2, {_idx(by_outcome('oc', *_MPS), _OG['market_prob_min'])} AS i3, {_idx('quality_score', _OG['quality_min'])} AS i4,
  {_idx('confidence_score', _OG['confidence_min'])} AS i5, {_idx(by_outcome('oc', *_E), _OG['ev_min'])} AS i6, {_idx(margin_of('oc', *_P), _OG['prob_margin_min'])} AS i7, {_idx(margin_of('oc', *_E), _OG['ev_margin_min'])} AS i8 FROM o3),
xst AS (SELECT *, {_passed(_STRUCTS)} AS st FROM xrow),
xcat AS MATERIALIZED (SELECT dr, cat, st, i1, i2, i3, i4, i5, i6, i7, i8, {', '.join(f'sum(CASE WHEN {f} THEN {c} ELSE 0 END) AS {s}{n}' for s, f in (('t', 'NOT val'), ('v', 'val')) for n, c in (('n', '1'), ('h', 'h'), ('r', 'r')))}
  FROM (SELECT dr, st, i1, i2, i3, i4, i5, i6, i7, i8, val, h, r, {_passed(_CATS)} AS cat FROM xst) GROUP BY ALL),
{_steps()},
xmet AS (SELECT rule_id, {', '.join(f"{big(f'{s}_{n}')} AS {s}_{n}" for s in ('train', 'validation') for n in ('actions', 'hits'))}, train_roi, validation_roi,
  {_metrics('train', '(SELECT count(*) FROM lr WHERE NOT val)')}, {_metrics('validation', '(SELECT count(*) FROM lr WHERE val)')}
  FROM (SELECT CAST((((((((dr * 5 + a) * 3 + b) * 3 + c) * 3 + d) * 2 + e) * 2 + f) * 2 + g) * 2 + k AS BIGINT) * {learning.VARIANTS_PER_RULE}
    + CASE WHEN st = 0 THEN cat WHEN cat = 0 THEN {learning.CATEGORY_COUNT} + st ELSE 1 + {learning.CATEGORY_COUNT + learning.STRUCTURAL_COUNT} + (cat - 1) * {learning.STRUCTURAL_COUNT} + st - 1 END AS rule_id,
    tn AS train_actions, th AS train_hits, tr AS train_roi, vn AS validation_actions, vh AS validation_hits, vr AS validation_roi FROM x8))"""


@query("fit_expanded_outcome_rules", with_wide(_front("xmet", V.OUTCOME_TARGET), SETTLED, _ROWS, _OCELL, _XCELL))
def fit_expanded_outcome_rules(spark, sf_dir):
    return _front_cols(learning.fit_expanded_rules(rows(spark, sf_dir)))


@query("expanded_filter_totals", with_wide(
    f"""SELECT cat AS category_filter, st AS structural_filter, count(*) AS rules_met, {big('sum(tn)')} AS train_actions, {big('sum(vn)')} AS validation_actions, {big('sum(th)')} AS train_hits,
    {big('sum(vh)')} AS validation_hits, {big('max(tn)')} AS widest_train_actions FROM x8 GROUP BY 1, 2""", SETTLED, _ROWS, _OCELL, _XCELL))
def expanded_filter_totals(spark, sf_dir):
    """What each of the 198 filter combinations lets through, over all base rules."""
    total = lambda c: F.sum(c).alias(c)
    return learning.expanded_rules(rows(spark, sf_dir)).groupBy(F.col("cat").alias("category_filter"), F.col("struct").alias("structural_filter")).agg(
        F.count("*").alias("rules_met"), *[total(f"{s}_{n}") for n in ("actions", "hits") for s in ("train", "validation")], F.max("train_actions").alias("widest_train_actions"),
    )


_WF = f"""wf AS (SELECT rule_id, period_rank, sum(n) AS a, sum(h) AS h, sum(r) AS r
  FROM orule JOIN ocell ON dr = d0 AND i1 <= orule.a AND i2 > b AND i3 > c AND i4 > d AND i5 > e AND i6 > f AND i7 > g AND i8 > k GROUP BY 1, 2),
wt AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY rule_id ORDER BY period_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ta FROM wf),
axn AS (SELECT period, period_rank, n, sum(n) OVER (ORDER BY period_rank) - n AS ts FROM (SELECT period, period_rank, count(*) AS n FROM lr GROUP BY 1, 2)),
fold AS (SELECT period, axn.period_rank, rule_id, ta, a, h, n, ts, round(r, 4) AS roi, h / a::DOUBLE AS hr, a / n::DOUBLE AS sh,
   h / a::DOUBLE >= {V.OUTCOME_TARGET['hit_rate']} AND a / n::DOUBLE >= {V.OUTCOME_TARGET['action_share']} AS rdy
   FROM wt JOIN axn ON axn.period_rank = wt.period_rank WHERE ta >= 40 AND ts >= 40 AND n >= 10),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_rank ORDER BY rdy DESC, -(greatest(0.75 - hr, 0e0) * 2e0 + greatest(0.5 - sh, 0e0)) DESC, hr DESC, sh DESC, roi DESC, rule_id) AS rn FROM fold) WHERE rn = 1)"""


@query("walk_forward_folds", with_wide(
    f"""SELECT period, period_rank, rule_id, CASE WHEN rdy THEN 'ready' ELSE 'target_unreachable' END AS status, {big('ts')} AS train_samples, n AS validation_samples,
    {big('ta')} AS train_actions, {big('a')} AS validation_actions, {big('h')} AS validation_hits, round(hr, 6) AS validation_hit_rate, round(sh, 6) AS validation_action_share,
    roi AS validation_total_roi FROM best""", SETTLED, _ROWS, _OCELL, _WF))
def walk_forward_folds(spark, sf_dir):
    return learning.walk_forward(rows(spark, sf_dir))


@query("walk_forward_combined", with_wide(
    f"""SELECT *, CASE WHEN validation_samples < 10 THEN 'insufficient_samples' WHEN validation_actions > 0 AND validation_hit_rate >= 0.75 AND validation_action_share >= 0.5 THEN 'ready'
      ELSE 'target_unreachable' END AS status FROM (SELECT count(*) AS fold_count, {big('sum(n)')} AS validation_samples, {big('sum(a)')} AS validation_actions, {big('sum(h)')} AS validation_hits,
      round(sum(roi), 4) AS validation_total_roi, {ratio('sum(h)', 'sum(a)')} AS validation_hit_rate, {ratio('sum(a)', 'sum(n)')} AS validation_action_share FROM best)""",
    SETTLED, _ROWS, _OCELL, _WF))
def walk_forward_combined(spark, sf_dir):
    return learning.combine_folds(learning.walk_forward(rows(spark, sf_dir)))


@query("direction_source_hits", with_wide(
    f"SELECT dr AS direction, oc AS outcome, count(*) AS row_count, {big('sum(h)')} AS hits, {ratio('sum(h)', 'count(*)')} AS hit_rate FROM o3 GROUP BY 1, 2", SETTLED, _ROWS, _OCELL))
def direction_source_hits(spark, sf_dir):
    long = learning.direction_rows(rows(spark, sf_dir), ["match_id"])
    return long.groupBy("direction", "outcome").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("hit").alias("hits"),
        round_to(spark_ratio(F.sum("hit"), F.count(F.lit(1))), 6).alias("hit_rate"),
    )


@query("learning_split", with_wide("SELECT period, period_rank, val AS is_validation, count(*) AS row_count FROM lr GROUP BY 1, 2, 3", SETTLED, _ROWS.replace(_PERIODS, f"{_PERIODS} ORDER BY CAST(period AS BIGINT) DESC LIMIT {WINDOW_PERIODS}")))
def learning_split(spark, sf_dir):
    return rows(spark, sf_dir, WINDOW_PERIODS).groupBy("period", "period_rank", "is_validation").agg(F.count(F.lit(1)).alias("row_count"))


@query("trained_profile", None)
def trained_profile(spark, sf_dir):
    return learning.train_profile(rows(spark, sf_dir))
