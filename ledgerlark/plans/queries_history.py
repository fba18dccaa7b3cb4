"""Queries of the import of settled history with everything that hangs on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from .adapters import view
from .oracle import with_ctes
from .registry import query

_S = "concat('copy-', CAST(l_linenumber % 3 AS {string}))"
_RUN = "l_orderkey * 4 + CAST(floor(l_linenumber / 3e0) AS BIGINT)"
_MATCH = "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_orderkey AS {string}) END"
#: Line items by number, which may repeat in the driver's table.
_ITEMS = """(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_discount) AS l_discount,
  max(l_extendedprice) AS l_extendedprice FROM {lineitem} GROUP BY l_orderkey, l_linenumber) items"""
#: Three copies of the ledger over all line items, whose run and settlement ids clash; some lack match, period or snapshot.
SOURCES = {
    "feedback": f"SELECT {_S} AS source, {_RUN} + 5 AS feedback_id, {_RUN} AS prediction_run_id, {_MATCH} AS match_id, l_quantity AS amount, l_tax AS only_here FROM {_ITEMS}",
    "runs": f"""SELECT {_S} AS source, {_RUN} AS run_id, {_MATCH} AS match_id, CASE WHEN l_partkey % 19 = 0 THEN ' ' ELSE CAST(l_suppkey % 90 + 100 AS {{string}}) END AS period,
      CASE WHEN l_linenumber < 3 THEN 0 ELSE {_RUN} + 9 END AS feature_snapshot_id, l_discount AS rate FROM {_ITEMS}""",
    "snapshots": f"SELECT concat('copy-', CAST(CASE WHEN l_suppkey % 5 = 0 THEN 9 ELSE l_linenumber % 3 END AS {{string}})) AS source, {_RUN} + 9 AS snapshot_id, CAST(l_orderkey AS {{string}}) AS match_id, l_extendedprice AS rating FROM {_ITEMS}",
    "matches": "SELECT concat('copy-', CAST(n.c AS {string})) AS source, CAST(o_orderkey AS {string}) AS match_id, o_totalprice + n.c AS price FROM {orders} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) n",
}
#: Stored: a settlement of every order, under the order's key if it is finished, and match rows likewise.
_KEY = "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS {string}) ELSE concat('old-', CAST(o_orderkey AS {string})) END"
STORED = {
    "feedback": f"SELECT o_orderkey + 100 AS feedback_id, o_orderkey AS prediction_run_id, {_KEY} AS match_id, 0e0 AS amount, 'x' AS note FROM {{orders}}",
    "runs": f"SELECT o_orderkey + 200 AS run_id, {_KEY} AS match_id, '99' AS period, o_orderkey AS feature_snapshot_id, 0e0 AS rate FROM {{orders}}",
    "snapshots": f"SELECT o_orderkey + 300 AS snapshot_id, {_KEY} AS match_id, 0e0 AS rating FROM {{orders}}",
    "matches": "SELECT CASE WHEN o_orderstatus = 'O' THEN concat('old-', CAST(o_orderkey AS {string})) ELSE CAST(o_orderkey AS {string}) END AS match_id, o_totalprice AS price FROM {orders}",
}


def _plain(text: str) -> str:
    for name in ("lineitem", "orders"):
        text = text.replace("{" + name + "}", name)
    return text.replace("{string}", "VARCHAR")


_CTES = [
    *[f"s_{n} AS ({_plain(t)})" for n, t in SOURCES.items()], *[f"t_{n} AS ({_plain(t)})" for n, t in STORED.items()],
    "cand AS MATERIALIZED (SELECT f.*, r.period, r.feature_snapshot_id FROM s_feedback f JOIN s_runs r ON r.source = f.source AND r.run_id = f.prediction_run_id WHERE trim(r.period) <> '')",
    """turn AS (SELECT *, CASE WHEN match_id IS NULL THEN 'invalid' WHEN match_id IN (SELECT match_id FROM t_feedback) THEN 'existing'
      WHEN row_number() OVER (PARTITION BY match_id ORDER BY source, CAST(period AS BIGINT), feedback_id) = 1 THEN 'imported' ELSE 'existing' END AS status FROM cand)""",
    """fresh AS (SELECT *, row_number() OVER (ORDER BY source, CAST(period AS BIGINT), feedback_id) AS n FROM turn WHERE status = 'imported')""",
    """shot AS (SELECT f.source, f.feedback_id, s.snapshot_id, s.match_id, s.rating, row_number() OVER (ORDER BY f.n) + (SELECT max(snapshot_id) FROM t_snapshots) AS new_id
      FROM fresh f JOIN s_snapshots s ON s.source = f.source AND s.snapshot_id = f.feature_snapshot_id WHERE f.feature_snapshot_id > 0)""",
]


def sql(body: str) -> str:
    return with_ctes(body, *_CTES)


def tables(spark, sf_dir, views):
    return {name: view(spark, sf_dir, text) for name, text in views.items()}


def run(spark, sf_dir):
    return history.import_history(tables(spark, sf_dir, STORED), tables(spark, sf_dir, SOURCES))


@query("history_counters", sql(
    """SELECT source, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'existing') AS existing, count(*) FILTER (status = 'invalid') AS invalid,
    count(DISTINCT period) FILTER (status = 'imported') AS periods FROM turn GROUP BY 1"""))
def history_counters(spark, sf_dir):
    return run(spark, sf_dir)[1]


@query("imported_settlements", sql(
    """SELECT n + (SELECT max(feedback_id) FROM t_feedback) AS feedback_id, n + (SELECT max(run_id) FROM t_runs) AS prediction_run_id, match_id, CAST(amount AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS note FROM fresh"""))
def imported_settlements(spark, sf_dir):
    return run(spark, sf_dir)[0]["feedback"]


@query("imported_runs", sql(
    """SELECT n + (SELECT max(run_id) FROM t_runs) AS run_id, f.match_id, f.period, coalesce(new_id, 0) AS feature_snapshot_id, CAST(r.rate AS DOUBLE) AS rate
    FROM fresh f JOIN s_runs r ON r.source = f.source AND r.run_id = f.prediction_run_id LEFT JOIN shot s ON s.source = f.source AND s.feedback_id = f.feedback_id"""))
def imported_runs(spark, sf_dir):
    return run(spark, sf_dir)[0]["runs"]


@query("imported_snapshots", sql("SELECT new_id AS snapshot_id, match_id, CAST(rating AS DOUBLE) AS rating FROM shot"))
def imported_snapshots(spark, sf_dir):
    return run(spark, sf_dir)[0]["snapshots"]


@query("imported_matches", sql(
    """SELECT m.match_id, CAST(m.price AS DOUBLE) AS price FROM fresh f JOIN s_matches m ON m.source = f.source AND m.match_id = f.match_id WHERE m.match_id NOT IN (SELECT match_id FROM t_matches)"""))
def imported_matches(spark, sf_dir):
    return run(spark, sf_dir)[0]["matches"].withColumn("price", F.col("price").cast("double"))
