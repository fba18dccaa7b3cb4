"""Keyed writes, lookups, joins, top picks, settlement and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import num, round_to, text
from ..operators import audit, joins, ledger, metrics, settle, topk
from ..sources import tables
from ..schemas import MATCHES
from .adapters import ctes, load, plain, view
from .oracle import EFFECTIVE_ACTION, EFFECTIVE_STAKE, PICKS, big, odds_of, ratio, roi, with_ctes
from .registry import query


def sql(body: str, *views: str, extra=()) -> str:
    return with_ctes(plain(body), *ctes(*views), *[plain(e) for e in extra]) if views or extra else plain(body)


# --- keyed writes ------------------------------------------------------------

#: All matches, and a feed of all line items, of which the odd ones tell of matches that are not stored yet.
TARGET = "SELECT match_id, league, match_time AS sync_time, actual_result FROM {wide}"
FEED = """SELECT l_orderkey + l_partkey % 2 * 1000000007 AS match_id, CAST(l_linenumber AS {string}) AS league, l_shipdate AS sync_time,
 l_partkey AS seq FROM {lineitem}"""
FEED1 = "f1 AS (SELECT match_id, max(sync_time) AS sync_time FROM (" + FEED + ") GROUP BY 1)"


@query("upsert_match_feed", sql(
    f"""SELECT coalesce(t.match_id, f.match_id) AS match_id, CASE WHEN f.match_id IS NULL THEN t.sync_time ELSE f.sync_time END AS sync_time, t.actual_result,
    f.match_id IS NOT NULL AS fed FROM ({TARGET}) t FULL JOIN f1 f ON t.match_id = f.match_id""", "wide", extra=[FEED1]))
def upsert_match_feed(spark, sf_dir):
    feed = view(spark, sf_dir, FEED)
    merged = ledger.upsert_feed(view(spark, sf_dir, TARGET), feed.drop("seq"), protected=("actual_result",))
    fed = F.length("league") == 1
    return merged.select("match_id", "sync_time", "actual_result", fed.alias("fed"))


@query("update_match_results", sql(
    """SELECT m.match_id, coalesce(f.actual_result, m.actual_result) AS actual_result, coalesce(f.actual_score, m.actual_score) AS actual_score,
    m.result_status FROM matches m LEFT JOIN fetched f USING (match_id)""", "matches", "fetched"))
def update_match_results(spark, sf_dir):
    updated = ledger.update_results(load(spark, sf_dir, "matches"), load(spark, sf_dir, "fetched"))
    return updated.select("match_id", "actual_result", "actual_score", "result_status")


ANALYSES = "SELECT l_orderkey AS match_id, l_shipdate AS collected_at, l_partkey AS seq, l_quantity AS value FROM {lineitem} WHERE l_linenumber {op}"


@query("upsert_analyses", sql(
    f"""SELECT match_id, collected_at, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY inc DESC, collected_at DESC, seq DESC, value DESC) AS rn
    FROM (SELECT *, 0 AS inc FROM ({ANALYSES.format(lineitem='lineitem', op='<= 4')}) UNION ALL SELECT *, 1 FROM ({ANALYSES.format(lineitem='lineitem', op='> 4')}))) WHERE rn = 1"""))
def upsert_analyses(spark, sf_dir):
    stored = view(spark, sf_dir, ANALYSES.replace("{op}", "<= 4"))
    rows = view(spark, sf_dir, ANALYSES.replace("{op}", "> 4"))
    return ledger.upsert_rows(stored, rows, ["match_id"], [F.col(c).desc() for c in ("collected_at", "seq", "value")])


@query("mark_failed_analyses", sql(
    """SELECT coalesce(a.match_id, w.match_id) AS match_id, coalesce(w.remarks, a.remarks) AS remarks, a.value FROM
    (SELECT match_id, '' AS remarks, quality_score AS value FROM wide) a
    FULL JOIN (SELECT match_id + match_id % 3 * 1000000007 AS match_id, 'collection failed' AS remarks FROM wide) w ON a.match_id = w.match_id""", "wide"))
def mark_failed_analyses(spark, sf_dir):
    stored = view(spark, sf_dir, "SELECT match_id, '' AS remarks, quality_score AS value FROM {wide}")
    failed = view(spark, sf_dir, "SELECT match_id + match_id % 3 * 1000000007 AS match_id, 'collection failed' AS remarks FROM {wide}")
    return ledger.upsert_masked(stored, failed, ["match_id"], ["remarks"])


@query("latest_snapshots", sql(
    """SELECT match_id, snapshot_id, snapshot_at, home_rating FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY snapshot_at DESC, snapshot_id DESC, home_rating DESC) AS rn
    FROM snapshots) WHERE rn = 1""", "snapshots"))
def latest_snapshots(spark, sf_dir):
    rows = ledger.latest(load(spark, sf_dir, "snapshots"), ["match_id"], [F.col(c).desc() for c in ("snapshot_at", "snapshot_id", "home_rating")])
    return rows.select("match_id", "snapshot_id", "snapshot_at", "home_rating")


NEW_RUNS = """SELECT * FROM {wide} WHERE match_id % 8 IN (0, 4) AND match_id % 5 = 0"""
_STAKE = "(CASE WHEN effective_stake_pct <> 0 THEN effective_stake_pct ELSE suggested_stake_pct END)"
_ACT = "(CASE WHEN effective_recommendation <> '' THEN effective_recommendation ELSE recommendation END)"
_HO = "(CASE WHEN handicap_recommended_side = 'home' THEN handicap_home_odds ELSE handicap_away_odds END)"
_GD = "(CAST(split_part(f.actual_score, '-', 1) AS INT) - CAST(split_part(f.actual_score, '-', 2) AS INT) + handicap_line)"
_HR = f"(CASE WHEN {_GD} > 0 THEN 'home' WHEN {_GD} < 0 THEN 'away' ELSE 'push' END)"


@query("replace_forecast_runs", sql(
    f"""SELECT feedback_id, run_id, match_id, hit_recommendation, round(roi_delta, 4) AS roi_delta, handicap_actual_result, handicap_hit, round(handicap_roi_delta, 4) AS handicap_roi_delta
    FROM feedback WHERE match_id NOT IN (SELECT match_id FROM new_runs)
    UNION ALL SELECT f.feedback_id, n.run_id, f.match_id, CAST(n.recommended_outcome = f.actual_result AS INT),
      CASE WHEN f.roi_source = 'manual_override' THEN round(f.roi_delta, 4) WHEN {_ACT} = 'watch' OR {_STAKE} <= 0 THEN 0
           WHEN n.recommended_outcome = f.actual_result THEN round(({odds_of('n.recommended_outcome')} - 1e0) * {_STAKE} / 100e0, 4) ELSE round(-{_STAKE} / 100e0, 4) END,
      {_HR}, CAST(handicap_recommended_side = {_HR} AS INT),
      CASE WHEN f.roi_source = 'manual_override' THEN round(f.handicap_roi_delta, 4) WHEN {_HR} = 'push' OR {_HO} <= 0 THEN 0
           WHEN handicap_recommended_side = {_HR} THEN round(({_HO} - 1e0) * {_STAKE} / 100e0, 4) ELSE round(-{_STAKE} / 100e0, 4) END
    FROM feedback f JOIN new_runs n ON f.match_id = n.match_id""", "feedback", extra=[f"new_runs AS ({NEW_RUNS})"]))
def replace_forecast_runs(spark, sf_dir):
    runs, feedback = load(spark, sf_dir, "runs"), load(spark, sf_dir, "feedback")
    picks = topk.top_picks(load(spark, sf_dir, "wide")).select("period", "rank", "match_id", "run_id")
    out = ledger.replace_runs(runs, view(spark, sf_dir, NEW_RUNS), feedback.drop("period"), picks)
    return out["feedback"].select(
        "feedback_id", "run_id", "match_id", "hit_recommendation", round_to("roi_delta", 4).alias("roi_delta"),
        "handicap_actual_result", "handicap_hit", round_to("handicap_roi_delta", 4).alias("handicap_roi_delta"),
    )


@query("one_settlement_per_match", sql(
    "SELECT match_id, max(feedback_id) AS feedback_id FROM feedback GROUP BY 1", "feedback"))
def one_settlement_per_match(spark, sf_dir):
    return ledger.latest(load(spark, sf_dir, "feedback"), ["match_id"], [F.col("feedback_id").desc()]).select("match_id", "feedback_id")


UPDATES = "SELECT run_id, CASE WHEN match_id % 2 = 0 THEN 'light' END AS recommendation, 9e0 AS quality_score, 2.5e0 AS suggested_stake_pct FROM {runs} WHERE match_id % 6 < 2"


@query("update_run_fields", sql(
    f"""SELECT r.run_id, coalesce(u.recommendation, r.recommendation) AS recommendation, r.quality_score, coalesce(u.suggested_stake_pct, r.suggested_stake_pct) AS suggested_stake_pct
    FROM runs r LEFT JOIN ({UPDATES}) u ON r.run_id = u.run_id""", "runs"))
def update_run_fields(spark, sf_dir):
    updated = ledger.update_runs(load(spark, sf_dir, "runs"), view(spark, sf_dir, UPDATES))
    return updated.select("run_id", "recommendation", "quality_score", "suggested_stake_pct")


LOG = """SELECT user_id AS profile_id, event_id, ts AS event_at,
 CASE event_type WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'draft' WHEN 'click' THEN 'ready' WHEN 'signup' THEN 'inactive' ELSE 'failed' END AS status FROM {events}"""


@query("profile_states", sql(
    f"""SELECT profile_id, CASE WHEN last_status <> 'active' THEN last_status WHEN act = max(act) OVER () THEN 'active' ELSE 'archived' END AS status, updated_at
    FROM (SELECT profile_id, arg_max(status, (event_at, event_id)) AS last_status, max(event_at) AS updated_at,
          max((event_at, event_id)) FILTER (status = 'active') AS act FROM ({LOG}) GROUP BY 1)"""))
def profile_states(spark, sf_dir):
    return ledger.profile_state(view(spark, sf_dir, LOG))


_DOOMED = "SELECT match_id FROM {wide} WHERE match_id % 7 = 3"
_GONE = "run_id IN (SELECT run_id FROM runs WHERE match_id % 7 = 3)"


@query("cascade_delete_counts", sql(
    f"""SELECT 'matches' AS "table", count(*) AS rows_before, count(*) FILTER (match_id % 7 <> 3) AS rows_kept, count(*) FILTER (match_id % 7 = 3) AS rows_deleted FROM matches
    UNION ALL SELECT 'runs', count(*), count(*) FILTER (match_id % 7 <> 3), count(*) FILTER (match_id % 7 = 3) FROM runs
    UNION ALL SELECT 'snapshots', count(*), count(*) FILTER (match_id % 7 <> 3), count(*) FILTER (match_id % 7 = 3) FROM snapshots
    UNION ALL SELECT 'feedback', count(*), count(*) FILTER (match_id NOT IN (FROM doomed) AND NOT {_GONE}), count(*) FILTER (match_id IN (FROM doomed) OR {_GONE}) FROM feedback""",
    "matches", "feedback", "snapshots", extra=[f"doomed AS ({_DOOMED})"]))
def cascade_delete_counts(spark, sf_dir):
    before = {n: load(spark, sf_dir, n) for n in ("matches", "runs", "snapshots", "feedback")}
    return ledger.deleted_counts(before, ledger.cascade_delete(before, view(spark, sf_dir, _DOOMED)))


@query("prune_to_recent_periods", sql(
    """SELECT 'matches' AS "table", count(*) AS rows_before, count(*) FILTER (period IN (FROM keep)) AS rows_kept, count(*) FILTER (period NOT IN (FROM keep)) AS rows_deleted FROM matches
    UNION ALL SELECT 'runs', count(*), count(*) FILTER (period IN (FROM keep)), count(*) FILTER (period NOT IN (FROM keep)) FROM runs
    UNION ALL SELECT 'feedback', count(*), count(*) FILTER (match_id NOT IN (FROM old)), count(*) FILTER (match_id IN (FROM old)) FROM feedback""",
    "matches", "feedback", extra=["keep AS (SELECT DISTINCT period FROM matches ORDER BY 1 DESC LIMIT 30)", "old AS (SELECT match_id FROM matches WHERE period NOT IN (FROM keep))"]))
def prune_to_recent_periods(spark, sf_dir):
    before = {n: load(spark, sf_dir, n) for n in ("matches", "runs", "feedback")}
    return ledger.deleted_counts(before, ledger.prune(before, 30))


INCOMING = """SELECT run_id AS feedback_id, match_id, period, CASE WHEN run_id % 13 = 0 THEN '' ELSE actual_result END AS actual_result,
 concat('source-', CAST(run_id % 3 AS {string})) AS source FROM {runs}"""


#: Settlements arrive in the order of source, period and id; the first valid one of a match that is not stored counts.
_TURNS = """SELECT *, CASE WHEN actual_result = '' THEN 'invalid' WHEN match_id IN (SELECT match_id FROM feedback) THEN 'existing'
 WHEN row_number() OVER (PARTITION BY match_id, actual_result = '' ORDER BY source, CAST(period AS BIGINT), feedback_id) = 1 THEN 'imported' ELSE 'existing' END AS status FROM incoming"""


@query("import_settlements", sql(
    f"SELECT match_id, source, feedback_id FROM ({_TURNS}) WHERE status = 'imported'", "feedback", extra=[f"incoming AS ({INCOMING})"]))
def import_settlements(spark, sf_dir):
    fresh, _ = ledger.import_settlements(load(spark, sf_dir, "feedback"), view(spark, sf_dir, INCOMING), F.col("actual_result") != "")
    return fresh.select("match_id", "source", "feedback_id")


@query("import_counters", sql(
    f"""SELECT source, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'existing') AS existing,
    count(*) FILTER (status = 'invalid') AS invalid FROM ({_TURNS}) GROUP BY 1""",
    "feedback", extra=[f"incoming AS ({INCOMING})"]))
def import_counters(spark, sf_dir):
    return ledger.import_settlements(load(spark, sf_dir, "feedback"), view(spark, sf_dir, INCOMING), F.col("actual_result") != "")[1]


@query("import_source_summary", sql(
    "SELECT source, count(*) AS row_count, count(DISTINCT period) AS period_count, min(period) AS first_period, max(period) AS last_period FROM incoming GROUP BY 1",
    "runs", extra=[f"incoming AS ({INCOMING})"]))
def import_source_summary(spark, sf_dir):
    return ledger.source_summary(view(spark, sf_dir, INCOMING))


@query("renumbered_settlements", sql(
    "SELECT count(*) AS row_count, min(n) AS first_no, max(n) AS last_no, count(DISTINCT n) AS distinct_no FROM (SELECT 1000 + row_number() OVER (ORDER BY match_id) AS n FROM feedback)", "feedback"))
def renumbered_settlements(spark, sf_dir):
    numbered = ledger.renumber(load(spark, sf_dir, "feedback"), "feedback_id", "n", 1000)
    return numbered.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("n").alias("first_no"), F.max("n").alias("last_no"),
        F.countDistinct("n").alias("distinct_no"),
    )


_ASOF = "TIMESTAMP '2024-01-20 12:00:00'"


@query("fresh_dimension_rows", sql(
    f"""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events
    WHERE ts <= {_ASOF} AND ts >= {_ASOF} - INTERVAL 12 HOURS) WHERE rn = 1"""))
def fresh_dimension_rows(spark, sf_dir):
    return tables.fresh(load(spark, sf_dir, "events"), ["user_id"], "ts", F.expr(_ASOF)).select("user_id", "event_id", "ts")


@query("lookups_without_recent_failure", sql(
    f"SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 6 HOURS > {_ASOF})"))
def lookups_without_recent_failure(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    failures = events.filter("event_type = 'error'").select("user_id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"))
    return tables.skip_recent_failures(events.select("user_id").distinct(), failures, ["user_id"], F.expr(_ASOF))


@query("review_export_long", sql(
    " UNION ALL ".join(
        f"SELECT match_id, '{s}' AS section, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM wide"
        for s, fs in {"match": ["league", "home_team", "away_team"], "forecast": ["recommendation", "recommended_outcome", "predicted_score"]}.items() for f in fs), "wide"))
def review_export_long(spark, sf_dir):
    return ledger.export_long(
        load(spark, sf_dir, "wide"), "match_id",
        {"match": ["league", "home_team", "away_team"], "forecast": ["recommendation", "recommended_outcome", "predicted_score"]},
    )


_REPLAY = "SELECT DISTINCT period FROM {wide} WHERE period LIKE '1997%'"


@query("mark_replayed_settlements", sql(
    """SELECT feedback_id, CASE WHEN period LIKE '1997%' THEN 'historical_replay' ELSE roi_source END AS roi_source,
    CASE WHEN period NOT LIKE '1997%' OR starts_with(notes, 'replayed') THEN notes WHEN notes = '' THEN 'replayed' ELSE concat('replayed ', notes) END AS notes FROM feedback""", "feedback"))
def mark_replayed_settlements(spark, sf_dir):
    rows = ledger.mark_replayed(load(spark, sf_dir, "feedback"), view(spark, sf_dir, _REPLAY), "replayed")
    return rows.select("feedback_id", "roi_source", "notes")


_RES = "(CASE WHEN gd > 0 THEN 'home' WHEN gd < 0 THEN 'away' ELSE 'push' END)"


@query("resettle_backfilled_handicap", sql(
    f"""SELECT res AS handicap_actual_result, count(*) AS row_count, {big("sum(CASE WHEN handicap_recommendation <> 'watch' AND res = handicap_recommended_side THEN 1 ELSE 0 END)")} AS hits,
    round(sum(CASE WHEN handicap_recommendation = 'watch' OR res = 'push' THEN 0e0 WHEN res = handicap_recommended_side AND so > 0
      THEN round(suggested_stake_pct / 100e0 * (CASE WHEN so < 1.5 THEN so ELSE so - 1e0 END), 4) ELSE round(-suggested_stake_pct / 100e0, 4) END), 4) AS roi FROM (
    SELECT *, {_RES} AS res, CASE WHEN handicap_recommended_side = 'home' THEN handicap_home_odds ELSE handicap_away_odds END AS so FROM (
      SELECT *, CAST(split_part(actual_score, '-', 1) AS INT) - CAST(split_part(actual_score, '-', 2) AS INT) + handicap_initial_line AS gd FROM runs)) GROUP BY 1""", "runs"))
def resettle_backfilled_handicap(spark, sf_dir):
    rows = ledger.resettle_handicap(load(spark, sf_dir, "runs").withColumn("handicap_line", F.col("handicap_initial_line")))
    return rows.groupBy("handicap_actual_result").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("handicap_hit").alias("hits"), round_to(F.sum("handicap_roi_delta"), 4).alias("roi")
    )


_CONFORM = "SELECT match_id, period, league FROM {wide}"


@query("additive_schema_read", sql(
    "SELECT match_id, period, league, '' AS match_no, '' AS result_status, match_no_len FROM (SELECT *, 0 AS match_no_len FROM (" + _CONFORM + "))", "wide"))
def additive_schema_read(spark, sf_dir):
    rows = tables.conform(view(spark, sf_dir, _CONFORM), MATCHES)
    return rows.select("match_id", "period", "league", "match_no", "result_status", F.length("match_no").alias("match_no_len"))


# --- lookups -------------------------------------------------------------------


@query("period_list", sql("SELECT period, count(*) AS match_count, count(DISTINCT league) AS league_count FROM wide GROUP BY 1", "wide"))
def period_list(spark, sf_dir):
    return load(spark, sf_dir, "wide").groupBy("period").agg(
        F.count(F.lit(1)).alias("match_count"), F.countDistinct("league").alias("league_count")
    )


@query("period_matches_in_order", sql(
    """SELECT match_id, match_no, row_number() OVER (ORDER BY coalesce(TRY_CAST(match_no AS BIGINT), 0), match_id) AS place FROM matches WHERE period = '199707'""", "matches"))
def period_matches_in_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = joins.scoped(load(spark, sf_dir, "matches"), None, "199707")
    order = Window.orderBy(F.coalesce(F.col("match_no").try_cast("bigint"), F.lit(0)), "match_id")
    return rows.select("match_id", "match_no", F.row_number().over(order).cast("long").alias("place"))


@query("selected_matches", sql("SELECT match_id, period FROM matches WHERE match_id IN (SELECT match_id FROM feedback)", "feedback", "matches"))
def selected_matches(spark, sf_dir):
    return joins.scoped(load(spark, sf_dir, "matches"), load(spark, sf_dir, "feedback")).select("match_id", "period")


@query("pending_review_queue", sql(
    """SELECT run_id, match_id, manual_review_status, effective_action_source FROM runs WHERE manual_review_status = 'pending' OR effective_action_source IN ('expert_llm', 'expert_llm_failed')
    ORDER BY CASE WHEN manual_review_status = 'pending' THEN 0 ELSE 1 END, run_id DESC LIMIT 20""", "runs"))
def pending_review_queue(spark, sf_dir):
    runs = load(spark, sf_dir, "runs")
    queue = runs.filter((F.col("manual_review_status") == "pending") | F.col("effective_action_source").isin("expert_llm", "expert_llm_failed"))
    return queue.orderBy(F.when(F.col("manual_review_status") == "pending", 0).otherwise(1), F.col("run_id").desc()).limit(20).select(
        "run_id", "match_id", "manual_review_status", "effective_action_source"
    )


# --- joins ------------------------------------------------------------------------


@query("backtest_star_join", sql(
    """SELECT count(*) AS row_count, count(s.match_id) AS with_snapshot, round(sum(f.roi_delta), 6) AS roi, round(avg(s.home_rating), 6) AS avg_rating,
    count(DISTINCT m.league) AS leagues FROM feedback f JOIN runs r ON r.run_id = f.run_id JOIN matches m ON m.match_id = f.match_id
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY snapshot_at DESC, snapshot_id DESC, home_rating DESC) AS rn FROM snapshots) WHERE rn = 1) s ON s.match_id = f.match_id""",
    "feedback", "matches", "snapshots"))
def backtest_star_join(spark, sf_dir):
    snapshots = ledger.latest(load(spark, sf_dir, "snapshots"), ["match_id"], [F.col(c).desc() for c in ("snapshot_at", "snapshot_id", "home_rating")])
    runs = load(spark, sf_dir, "runs").select("run_id", "recommended_outcome")
    feedback = load(spark, sf_dir, "feedback").select("run_id", "match_id", "roi_delta")
    matches = load(spark, sf_dir, "matches").select("match_id", "league")
    analyses = view(spark, sf_dir, "SELECT match_id, quality_score AS analysis_quality FROM {wide}")
    rows = joins.star(feedback, runs, snapshots.withColumn("has_snapshot", F.lit(1)), analyses, matches)
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count("has_snapshot").alias("with_snapshot"),
        round_to(F.sum("roi_delta"), 6).alias("roi"), round_to(F.avg("home_rating"), 6).alias("avg_rating"),
        F.countDistinct("league").alias("leagues"),
    )


_CANON = """canon AS (SELECT m.match_id, CASE WHEN any_value(m.match_time) IS NOT NULL THEN coalesce(max(r.run_id) FILTER (r.created_at <= m.match_time), max(r.run_id) FILTER (r.created_at IS NOT NULL)) END AS run_id,
 CASE WHEN any_value(m.match_time) IS NULL THEN 'kickoff_unreadable' WHEN count(r.run_id) = 0 THEN 'no_run' WHEN count(r.created_at) = 0 THEN 'run_time_unreadable' ELSE '' END AS reason
 FROM matches m LEFT JOIN runs r ON r.match_id = m.match_id GROUP BY 1)"""


@query("canonical_runs", sql("SELECT * FROM canon", "matches", "runs", extra=[_CANON]))
def canonical_runs(spark, sf_dir):
    return joins.canonical_run(load(spark, sf_dir, "runs"), load(spark, sf_dir, "matches"))


@query("asof_latest_run", sql(
    """SELECT k.event_id, k.user_id, k.ts, max(r.event_id) AS run_id FROM events k LEFT JOIN events r ON r.user_id = k.user_id AND r.event_type = 'view' AND r.ts <= k.ts
    WHERE k.event_type = 'purchase' GROUP BY 1, 2, 3"""))
def asof_latest_run(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    runs = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("run_id"))
    kickoffs = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof_running(kickoffs, runs, "user_id", "ts", "run_id", "event_id", width_seconds=6 * 3600)


_NAMES = """SELECT c_custkey, concat('nation_', CAST(c_nationkey AS {string}), CASE c_custkey % 4 WHEN 0 THEN ' (W)' WHEN 1 THEN '' WHEN 2 THEN ' united' ELSE '' END) AS raw FROM {customer}"""


@query("resolve_team_names", sql(
    """SELECT c_custkey, n_name, kind = 0 AS exact FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos, kind, n_nationkey) AS rn FROM (
      SELECT c_custkey, pos, n_name, n_nationkey, CASE WHEN a = lower(n_name) THEN 0 ELSE 1 END AS kind FROM (
        SELECT c_custkey, 0 AS pos, lower(trim(regexp_replace(raw, '\\(.*?\\)', ''))) AS a FROM names UNION ALL SELECT c_custkey, 1, lower(raw) FROM names) x
      JOIN nation ON starts_with(a, lower(n_name)) OR starts_with(lower(n_name), a))) WHERE rn = 1""", extra=[f"names AS ({_NAMES})"]))
def resolve_team_names(spark, sf_dir):
    rows = view(spark, sf_dir, _NAMES).withColumn("aliases", joins.alias_list(F.col("raw")))
    return joins.resolve_names(rows, "c_custkey", "aliases", load(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query("league_codes", sql(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, 'red') THEN 'R' END, CASE WHEN contains(p_name, 'small') THEN 'S' END,
    CASE WHEN contains(p_name, 'ring') THEN 'N' END], lambda x: x IS NOT NULL), ',') AS codes FROM part"""))
def league_codes(spark, sf_dir):
    codes = joins.codes_of_label(F.col("p_name"), {"red": "R", "small": "S", "ring": "N"})
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"))


@query("preferred_standing", sql(
    """SELECT l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1"""))
def preferred_standing(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return joins.prefer(load(spark, sf_dir, "lineitem"), ["l_orderkey"], rank, ["l_suppkey", "l_quantity"])


# --- top picks ---------------------------------------------------------------------

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY wgt > 0 DESC, wgt DESC, evr DESC, cr DESC, qr DESC, comp DESC, match_id) AS rank FROM (
 SELECT *, round(greatest(handicap_expected_value, 0e0), 4) AS evr, round(handicap_confidence, 4) AS cr, round(quality_score, 4) AS qr,
   round(wgt * 1.00::DOUBLE + greatest(handicap_expected_value, 0e0) * 0.45 + handicap_confidence * 0.35 + quality_score * 0.10 + model_agreement * 0.05, 4) AS comp
 FROM (SELECT *, CASE handicap_recommendation WHEN 'main' THEN 2 WHEN 'light' THEN 1 ELSE 0 END AS wgt FROM wide)))"""


@query("period_top_picks", sql("SELECT period, rank, match_id, run_id, comp AS composite_score, cr AS confidence_rank, evr AS ev_rank FROM ranked WHERE rank <= 3", "wide", extra=[_RANKED]))
def period_top_picks(spark, sf_dir):
    return topk.top_picks(load(spark, sf_dir, "wide")).select(
        "period", "rank", "match_id", "run_id", "composite_score", "confidence_rank", "ev_rank"
    )


_FB_WIDE = "SELECT run_id, CASE WHEN match_id % 2 = 0 THEN handicap_recommended_side ELSE '' END AS handicap_actual_result, CAST(match_id % 2 = 0 AS INT) AS handicap_hit, actual_score FROM {wide} WHERE match_id % 3 <> 0"
_PST = f"""pst AS (SELECT r.*, f.handicap_actual_result, f.handicap_hit, f.run_id IS NOT NULL AS has,
  CASE WHEN f.run_id IS NULL THEN '' WHEN f.handicap_actual_result <> '' THEN f.handicap_actual_result WHEN wgt = 0 THEN ''
   WHEN CAST(split_part(r.actual_score, '-', 1) AS INT) - CAST(split_part(r.actual_score, '-', 2) AS INT) + handicap_line > 0 THEN 'home'
   WHEN CAST(split_part(r.actual_score, '-', 1) AS INT) - CAST(split_part(r.actual_score, '-', 2) AS INT) + handicap_line < 0 THEN 'away' ELSE 'push' END AS res
  FROM ranked r LEFT JOIN ({_FB_WIDE}) f ON f.run_id = r.run_id WHERE rank <= 3)"""
_PHIT = "CASE WHEN handicap_hit <> 0 OR handicap_recommended_side = res THEN 1 ELSE 0 END"


def _settled_top(spark, sf_dir):
    picks = topk.top_picks(load(spark, sf_dir, "wide")).drop("actual_score")
    return topk.settled_picks(picks, view(spark, sf_dir, _FB_WIDE))


@query("settled_top_picks", sql(
    f"""SELECT period, rank, match_id, wgt > 0 AND res <> '' AS is_settled, CASE WHEN wgt > 0 THEN res ELSE '' END AS pick_result,
    CASE WHEN wgt > 0 AND res <> '' THEN {_PHIT} ELSE 0 END AS pick_hit,
    CASE WHEN wgt = 0 OR res = '' THEN 'pending' WHEN {_PHIT} = 1 THEN 'hit' ELSE 'miss' END AS status FROM pst""", "wide", extra=[_RANKED, _PST]))
def settled_top_picks(spark, sf_dir):
    return _settled_top(spark, sf_dir).select("period", "rank", "match_id", "is_settled", "pick_result", "pick_hit", "status")


@query("top_pick_summary", sql(
    f"""SELECT *, {ratio('hit_count', 'settled_count')} AS hit_rate FROM (SELECT count(*) AS pick_count, count(*) FILTER (wgt > 0 AND res <> '') AS settled_count,
    {big(f"sum(CASE WHEN wgt > 0 AND res <> '' THEN {_PHIT} ELSE 0 END)")} AS hit_count FROM pst)""", "wide", extra=[_RANKED, _PST]))
def top_pick_summary(spark, sf_dir):
    return topk.pick_summary(_settled_top(spark, sf_dir))


# --- settlement ---------------------------------------------------------------------

_RESULTS = """res AS (SELECT m.match_id, m.period, m.match_time,
  CASE WHEN man THEN m.actual_result ELSE coalesce(f.actual_result, m.actual_result) END AS e_result,
  CASE WHEN man AND m.actual_score = '' AND f.actual_result = m.actual_result THEN f.actual_score WHEN man THEN m.actual_score ELSE coalesce(f.actual_score, m.actual_score) END AS e_score,
  CASE WHEN man AND f.actual_result = m.actual_result AND (m.actual_score IN ('', f.actual_score)) AND m.result_source_url IN ('', f.result_source_url) THEN 'settled'
       WHEN man THEN 'manual_override' ELSE 'settled' END AS e_status
  FROM (SELECT *, result_status = 'manual_override' AND actual_result <> '' AS man FROM matches) m LEFT JOIN fetched f ON f.match_id = m.match_id)"""
_BATCH = f"""batch AS (SELECT res.match_id, res.period, canon.run_id, e_result AS actual_result, e_score AS actual_score, e_status, reason,
  r.recommended_outcome, {EFFECTIVE_ACTION} AS ea, {EFFECTIVE_STAKE} AS es, f.roi_delta AS s_roi, f.roi_source AS s_source, f.notes AS s_notes,
  r.market_odds_home, r.market_odds_draw, r.market_odds_away, r.handicap_recommended_side AS side, r.handicap_recommendation AS ha, r.handicap_line
  FROM res LEFT JOIN canon ON canon.match_id = res.match_id LEFT JOIN runs r ON r.run_id = canon.run_id LEFT JOIN feedback f ON f.run_id = canon.run_id)"""


@query("settle_batch", sql(
    f"""SELECT match_id, run_id, CASE WHEN actual_result = '' THEN 'no_result' ELSE reason END AS skip_reason, actual_result, actual_score, e_status,
    CASE WHEN s_source = 'manual_override' THEN round(s_roi, 4) WHEN run_id IS NULL THEN NULL ELSE {roi('ea', 'recommended_outcome', 'es')} END AS roi_delta,
    CASE WHEN s_source = 'manual_override' THEN 'manual_override' ELSE 'auto' END AS roi_source, coalesce(s_notes, '') AS notes
    FROM batch WHERE run_id IS NOT NULL""", "matches", "fetched", "feedback", extra=[_CANON, _RESULTS, _BATCH]))
def settle_batch(spark, sf_dir):
    rows = settle.settle(*[load(spark, sf_dir, n) for n in ("matches", "fetched", "runs", "feedback")])
    return rows.filter("run_id is not null").select(
        "match_id", "run_id", "skip_reason", "actual_result", "actual_score", "e_status", round_to("roi_delta", 4).alias("roi_delta"),
        "roi_source", "notes",
    )


@query("settle_skips", sql(
    """SELECT skip_reason, count(*) AS match_count FROM (SELECT CASE WHEN actual_result = '' THEN 'no_result' ELSE reason END AS skip_reason FROM batch) GROUP BY 1""",
    "matches", "fetched", "feedback", extra=[_CANON, _RESULTS, _BATCH]))
def settle_skips(spark, sf_dir):
    rows = settle.settle(*[load(spark, sf_dir, n) for n in ("matches", "fetched", "runs", "feedback")])
    return rows.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("match_count"))


@query("rejected_manual_settlements", sql(
    """SELECT f.feedback_id, CASE WHEN c.run_id IS NULL THEN CASE WHEN c.reason <> '' THEN c.reason ELSE 'unknown_match' END WHEN c.run_id <> f.run_id THEN 'not_canonical' ELSE '' END AS reject_reason
    FROM feedback f LEFT JOIN canon c ON c.match_id = f.match_id""", "matches", "feedback", extra=[_CANON]))
def rejected_manual_settlements(spark, sf_dir):
    canonical = joins.canonical_run(load(spark, sf_dir, "runs"), load(spark, sf_dir, "matches"))
    return settle.rejected_feedback(load(spark, sf_dir, "feedback"), canonical).select("feedback_id", "reject_reason")


@query("apply_batch_strategy", with_ctes(
    """SELECT run_id, match_id, CASE WHEN coverage_draw_rescue.outcome = '' THEN 'watch' WHEN coverage_draw_rescue.tier = 'core' THEN 'main' ELSE 'light' END AS recommendation,
    CASE WHEN coverage_draw_rescue.outcome = '' THEN recommended_outcome ELSE coverage_draw_rescue.outcome END AS recommended_outcome, coverage_draw_rescue.stake AS suggested_stake_pct FROM picks""",
    ctes("wide")[0].replace("wide AS (", "wide0 AS (", 1), "wide AS (SELECT * FROM wide0 WHERE match_id % 3 = 0)", PICKS))
def apply_batch_strategy(spark, sf_dir):
    wide = load(spark, sf_dir, "wide")
    rows = settle.apply_batch_strategy(wide, view(spark, sf_dir, "SELECT run_id FROM {wide} WHERE match_id % 3 <> 0"))
    return rows.select("run_id", "match_id", "recommendation", "recommended_outcome", "suggested_stake_pct")


@query("settlement_progress", sql(
    f"""SELECT period, count(*) AS match_count, count(f.match_id) AS feedback_count,
    CASE WHEN count(f.match_id) = 0 THEN 'missing' WHEN count(f.match_id) < count(*) THEN 'partial' ELSE 'completed' END AS status, {ratio('count(f.match_id)', 'count(*)')} AS settled_share
    FROM matches m LEFT JOIN (SELECT DISTINCT match_id FROM feedback) f ON f.match_id = m.match_id GROUP BY 1""", "matches", "feedback"))
def settlement_progress(spark, sf_dir):
    return settle.period_progress(load(spark, sf_dir, "matches"), load(spark, sf_dir, "feedback"))


_SEQ = "SELECT period, CAST(period AS BIGINT) - CAST(floor(CAST(period AS BIGINT) / 100) AS BIGINT) * 88 AS seq FROM (SELECT DISTINCT period FROM {wide}) p"


@query("backfill_plan", sql(
    f"""SELECT period, seq, first_seq - seq AS distance FROM ({_SEQ}) s, (SELECT min(seq) AS first_seq, count(*) AS have FROM ({_SEQ}) s2 WHERE period IN (SELECT period FROM matches WHERE period >= '199901')) e
    WHERE seq < first_seq AND first_seq - seq <= 40 - have""", "wide", "matches"))
def backfill_plan(spark, sf_dir):
    settled = load(spark, sf_dir, "matches").filter("period >= '199901'")
    return settle.backfill_plan(settled, view(spark, sf_dir, _SEQ), 40)


# --- audits ---------------------------------------------------------------------------


@query("duplicate_keys", sql("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_keys(spark, sf_dir):
    return audit.duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


#: The customer of an urgent order; nobody for other orders.
_URGENT = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS c_custkey FROM {orders}"


@query("orphan_rows", sql(f"SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM ({_URGENT}) u WHERE u.c_custkey = c.c_custkey)"))
def orphan_rows(spark, sf_dir):
    return joins.orphans(load(spark, sf_dir, "customer"), view(spark, sf_dir, _URGENT), "c_custkey").select("c_custkey", "c_nationkey")


@query("dedup_repointed_settlements", sql(
    """SELECT match_id, feedback_id, coalesce(to_id, run_id) AS run_id FROM (SELECT f.*, s.run_id AS to_id, row_number() OVER (PARTITION BY f.match_id ORDER BY feedback_id DESC) AS rn FROM feedback f
    LEFT JOIN (SELECT * FROM (SELECT match_id, run_id, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC NULLS LAST, run_id DESC) AS k FROM runs) WHERE k = 1) s ON s.match_id = f.match_id) WHERE rn = 1""",
    "feedback"))
def dedup_repointed_settlements(spark, sf_dir):
    picks = load(spark, sf_dir, "runs").select("run_id")
    out = audit.dedup_runs(load(spark, sf_dir, "runs"), load(spark, sf_dir, "feedback"), picks)
    return out["feedback"].select("match_id", "feedback_id", "run_id")


def _chain(spark, sf_dir):
    feedback = load(spark, sf_dir, "feedback").drop("period", "actual_result", "actual_score")
    runs = load(spark, sf_dir, "runs").drop("match_id")
    canonical = joins.canonical_run(load(spark, sf_dir, "runs"), load(spark, sf_dir, "matches"))
    return audit.chain_findings(feedback.join(runs.drop("roi_source"), "run_id"), canonical)


_DER = """der AS (SELECT *, CAST(split_part(actual_score, '-', 1) AS INT) - CAST(split_part(actual_score, '-', 2) AS INT) + handicap_line AS adj FROM runs)"""
_CHK = """chk AS (SELECT r.period, f.handicap_hit, r.handicap_recommendation, list_filter([
  CASE WHEN c.run_id IS DISTINCT FROM f.run_id THEN 'not_canonical' END,
  CASE WHEN f.handicap_actual_result <> '' AND f.handicap_actual_result <> CASE WHEN adj > 0 THEN 'home' WHEN adj < 0 THEN 'away' ELSE 'push' END THEN 'handicap_result' END,
  CASE WHEN f.handicap_hit <> CAST(r.handicap_recommendation <> 'watch' AND CASE WHEN adj > 0 THEN 'home' WHEN adj < 0 THEN 'away' ELSE 'push' END = r.handicap_recommended_side AS INT) THEN 'handicap_hit' END,
  CASE WHEN abs(f.handicap_roi_delta - CASE WHEN r.handicap_recommendation = 'watch' OR adj = 0 THEN 0e0
     WHEN CASE WHEN adj > 0 THEN 'home' ELSE 'away' END = r.handicap_recommended_side AND so > 0
       THEN round(suggested_stake_pct / 100e0 * (CASE WHEN so < 1.5 THEN so ELSE so - 1e0 END), 4) ELSE round(-suggested_stake_pct / 100e0, 4) END) > 1e-6 THEN 'handicap_return' END
  ], lambda x: x IS NOT NULL) AS findings
  FROM feedback f JOIN (SELECT *, CASE WHEN handicap_recommended_side = 'home' THEN handicap_home_odds ELSE handicap_away_odds END AS so FROM der) r ON r.run_id = f.run_id
  LEFT JOIN canon c ON c.match_id = f.match_id)"""


@query("chain_audit_by_period", sql(
    """SELECT period, count(*) AS row_count, count(*) FILTER (len(findings) = 0) AS valid_count, count(*) FILTER (len(findings) > 0) AS finding_count,
    count(*) FILTER (len(findings) = 0 AND handicap_recommendation <> 'watch') AS action_count,
    count(*) FILTER (len(findings) = 0 AND handicap_recommendation <> 'watch' AND handicap_hit = 1) AS hit_count FROM chk GROUP BY 1""",
    "matches", "feedback", extra=[_CANON, _DER, _CHK]))
def chain_audit_by_period(spark, sf_dir):
    return audit.audit_periods(_chain(spark, sf_dir))


@query("chain_audit_findings", sql("SELECT unnest(findings) AS finding, count(*) AS rows FROM chk GROUP BY 1", "matches", "feedback", extra=[_CANON, _DER, _CHK]))
def chain_audit_findings(spark, sf_dir):
    return audit.finding_counts(_chain(spark, sf_dir))


@query("chain_audit_totals", sql(
    f"""SELECT *, {ratio('hit_count', 'action_count')} AS hit_rate, row_count >= 1 AND finding_count = 0 AS passed FROM (SELECT count(*) AS row_count,
    count(*) FILTER (len(findings) = 0) AS valid_count, count(*) FILTER (len(findings) > 0) AS finding_count,
    count(*) FILTER (len(findings) = 0 AND handicap_recommendation <> 'watch') AS action_count,
    count(*) FILTER (len(findings) = 0 AND handicap_recommendation <> 'watch' AND handicap_hit = 1) AS hit_count FROM chk)""",
    "matches", "feedback", extra=[_CANON, _DER, _CHK]))
def chain_audit_totals(spark, sf_dir):
    return audit.audit_totals(audit.audit_periods(_chain(spark, sf_dir)), {"row_count": 1})


_SPELL = "SELECT CASE match_id % 7 WHEN 0 THEN '观望' WHEN 1 THEN 'Hold now' WHEN 2 THEN '轻仓' WHEN 3 THEN 'LEAN' WHEN 4 THEN '主推' WHEN 5 THEN 'top' ELSE '' END AS spelling FROM {wide}"


@query("action_label_spellings", sql(
    f"""SELECT spelling, CASE spelling WHEN '观望' THEN 'watch' WHEN 'Hold now' THEN 'watch' WHEN '轻仓' THEN 'light' WHEN 'LEAN' THEN 'light' WHEN '主推' THEN 'main' WHEN 'top' THEN 'main' ELSE 'watch' END AS label,
    count(*) AS row_count FROM ({_SPELL}) GROUP BY 1, 2""", "wide"))
def action_label_spellings(spark, sf_dir):
    return audit.label_conflicts(view(spark, sf_dir, _SPELL), "spelling")
