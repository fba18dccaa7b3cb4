"""Queries of the shrinkage what-if: model share against market prior."""

from __future__ import annotations

from .. import fixed_values as V
from ..operators import metrics, what_if
from . import adapters
from .oracle import SETTLED, argmax, by_outcome, clip, with_wide
from .registry import query

_F, _M = (tuple(f"{k}_{o}_prob" for o in V.OUTCOMES) for k in ("final", "market"))
_score = lambda p: f"""({' + '.join(f"pow({x} - CASE WHEN actual_result = '{o}' THEN 1e0 ELSE 0e0 END, 2)" for o, x in zip(V.OUTCOMES, p))}) / 3e0"""
_figures = lambda p: f"count(*) AS samples, avg({_score(p)}) AS b, avg(-ln(greatest({by_outcome('actual_result', *p)}, 1e-6))) AS l, avg(CASE WHEN {argmax(*p)} = actual_result THEN 1e0 ELSE 0e0 END) AS h"
_mix = lambda a, o: f"({a} * final_{o}_prob + (1e0 - {a}) * market_{o}_prob)"
_ALL = tuple(f"x_{o}" for o in V.OUTCOMES)
_WHAT = [
    f"""usable AS (SELECT *, {clip('0.35 * ' + clip('(quality_score - 0.55) / 0.30', 0.3, 1.1) + ' * ' + clip('(model_agreement - 0.55) / 0.30', 0.4, 1.0), 0.10, 0.55)} AS own FROM settled WHERE market_home_prob > 0 AND market_draw_prob > 0 AND market_away_prob > 0)""",
    f"""mixed AS (SELECT *, {', '.join(f"{_mix('own', o)} / ({' + '.join(_mix('own', x) for x in V.OUTCOMES)}) AS x_{o}" for o in V.OUTCOMES)} FROM usable)""",
    f"""tried AS (SELECT a, actual_result, {', '.join(f"{_mix('a', o)} AS x_{o}" for o in V.OUTCOMES)} FROM usable, (VALUES {', '.join(f'({a}::DOUBLE)' for a in what_if.ALPHAS)}) t(a))""",
    f"""whatif AS (SELECT variant, round(alpha, 6) AS alpha, samples, round(b, 6) AS brier_score, round(l, 6) AS log_loss, round(h, 6) AS hit_rate FROM (
      SELECT 'final' AS variant, 1e0 AS alpha, {_figures(_F)} FROM usable UNION ALL SELECT 'market', 0e0, {_figures(_M)} FROM usable UNION ALL SELECT 'blended', avg(own), {_figures(_ALL)} FROM mixed
      UNION ALL SELECT 'constant', a, {_figures(_ALL)} FROM tried GROUP BY a))""",
]


def rows(spark, sf_dir):
    return metrics.with_settlement(adapters.wide(spark, sf_dir))


@query("shrinkage_what_if", with_wide("SELECT * FROM whatif", SETTLED, *_WHAT))
def shrinkage_what_if(spark, sf_dir):
    return what_if.shrinkage_what_if(rows(spark, sf_dir))


@query("best_shrinkage", with_wide(
    """SELECT c.alpha, c.brier_score, c.log_loss, c.hit_rate, f.brier_score AS stored_brier_score, round((f.brier_score - c.brier_score) / f.brier_score, 4) AS gain
    FROM (SELECT * FROM whatif WHERE variant = 'constant' ORDER BY brier_score, alpha LIMIT 1) c, (SELECT * FROM whatif WHERE variant = 'final') f""", SETTLED, *_WHAT))
def best_shrinkage(spark, sf_dir):
    return what_if.best_constant(what_if.shrinkage_what_if(rows(spark, sf_dir)))
