"""Queries of collected matches: why collection failed, what to collect again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import collection
from .adapters import ctes, load, plain, view
from .oracle import big, ratio, with_ctes
from .registry import query

_T = V.COLLECTION_TEXTS


def _value(i: int) -> str:
    """A field's text: usable for most matches, else empty, blank, or a placeholder within other words."""
    return f"CASE (k * {7 + 2 * i} + c * {3 + i}) % 41 WHEN 0 THEN '' WHEN 1 THEN ' \n ' WHEN 2 THEN 'seen: {V.COLLECTION_PLACEHOLDERS[i % 7]}!' WHEN 3 THEN NULL ELSE concat('value ', CAST(k % 10 AS {{string}})) END"


#: Every match, a thirteenth of them with a row under another match's number, and for the others an older row of failures.
ANALYSES = f"""SELECT CASE WHEN k % 13 = 0 THEN k + 1000000007 ELSE k END AS match_id, CASE k % 17 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE '2024-01-02' END AS collected_at, {', '.join(f'{_value(i)} AS {f}' for i, f in enumerate(V.REQUIRED_DIMENSIONS))},
 CASE (k * 3 + c) % 7 WHEN 0 THEN 'note\n{_T['missing_prefix']}x' WHEN 1 THEN '{_T['missing_prefix']}y\n{_T['failure_prefix']}timeout  at page' WHEN 2 THEN '{_T['failure_prefix']}blocked' WHEN 3 THEN NULL ELSE 'fine' END AS remarks,
 CASE (k + c) % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE '' END AS collection_status,
 CASE (k + c * 3) % 9 WHEN 0 THEN 'a.betting_heat_summary: status=missing; stage=x\nb.elo_home: status=missing' WHEN 1 THEN 'c.home_away_form: status=ok\nd.e.head_to_head_summary: status=missing\nf.unknown: status=missing' ELSE '' END AS collection_quality_summary
 FROM (SELECT match_id AS k, team_key AS c FROM {{wide}}) keyed
 UNION ALL SELECT match_id, NULL, {', '.join("''" for _ in V.REQUIRED_DIMENSIONS)}, '{_T['failure_prefix']}old', 'failed', '' FROM {{wide}} WHERE match_id % 13 <> 0"""

_BAD = lambda x: f"(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')) = '' OR {' OR '.join(f'contains(coalesce({x}, {chr(39) * 2}), {p!r})' for p in V.COLLECTION_PLACEHOLDERS)})"
_NEED = {f: n for f, n in V.REQUIRED_DIMENSIONS.items() if f not in V.OPTIONAL_DIMENSIONS}
_IN_LOG = lambda f: f"(contains(collection_quality_summary, '.{f}: status=missing'))"
#: Named by the log only: the log of these rows names one required field at most.
_LOGGED = ", ".join(f"CASE WHEN {_IN_LOG(f)} AND NOT {_BAD(f)} THEN '{n}' END" for f, n in _NEED.items())
_M = f"list_filter([{', '.join(f'CASE WHEN {_BAD(f)} THEN {n!r} END' for f, n in _NEED.items())}, {_LOGGED}], lambda x: x IS NOT NULL)"
_LIST = f"concat('{_T['missing']}', array_to_string(missing[:8], '、'), CASE WHEN len(missing) > 8 THEN concat(' 等 ', len(missing), ' 项') ELSE '' END)"
_OUT = [
    f"an AS ({plain(ANALYSES)})",
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY collected_at DESC NULLS LAST) AS rn FROM an) WHERE rn = 1)",
    f"told AS (SELECT w.match_id, w.period, n.match_id IS NOT NULL AS stored, n.* EXCLUDE (match_id), CASE WHEN n.match_id IS NULL THEN [] ELSE {_M} END AS missing FROM wide w LEFT JOIN newest n ON n.match_id = w.match_id)",
    f"""outcomes AS (SELECT match_id, period, missing, CASE WHEN NOT stored THEN '{_T['no_row']}' WHEN trim(collected_at) = '' THEN '{_T['uncollected']}'
      WHEN starts_with(remarks, 'note') AND len(missing) > 0 THEN {_LIST} WHEN starts_with(remarks, '{_T['missing_prefix']}') THEN CASE WHEN len(missing) > 0 THEN {_LIST} ELSE '{_T['failure_prefix']}timeout at page' END
      WHEN starts_with(remarks, '{_T['failure_prefix']}') THEN remarks WHEN collection_status = 'success' THEN '' WHEN len(missing) > 0 THEN {_LIST} ELSE '' END AS reason,
      NOT stored OR trim(collected_at) = '' OR collection_status = 'failed' OR coalesce(starts_with(remarks, '{_T['failure_prefix']}'), false) OR {' OR '.join(f'(trim(coalesce({f}, {chr(39) * 2})) = {chr(39) * 2} OR ({_BAD(f)} AND {f} <> {chr(39)} {chr(10)} {chr(39)}))' for f in V.REQUIRED_DIMENSIONS)} AS retry FROM told)""",
]


def _sql(body: str) -> str:
    return with_ctes(body, *ctes("wide"), *_OUT)


def outcomes(spark, sf_dir):
    return collection.collection_outcomes(load(spark, sf_dir, "wide"), view(spark, sf_dir, ANALYSES))


@query("collection_failure_reasons", _sql("SELECT match_id, period, array_to_string(missing, ',') AS missing_dimensions, reason AS failure_reason, retry AS needs_retry FROM outcomes"))
def collection_failure_reasons(spark, sf_dir):
    return outcomes(spark, sf_dir).withColumn("missing_dimensions", F.array_join("missing_dimensions", ","))


@query("retry_summary", _sql(
    f"""SELECT period, count(*) AS match_count, count(*) FILTER (retry) AS retry_count, count(*) FILTER (reason <> '') AS failed_count, {big('sum(len(missing))')} AS missing_count,
    {ratio('count(*) - count(*) FILTER (retry)', 'count(*)')} AS complete_share FROM outcomes GROUP BY 1"""))
def retry_summary(spark, sf_dir):
    return collection.retry_summary(outcomes(spark, sf_dir))
