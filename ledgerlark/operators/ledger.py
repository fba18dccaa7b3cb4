"""Keyed writes as set operations: each returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import num, text
from ..schemas import MUTABLE_RUN_COLUMNS, RESULT_COLUMNS
from . import metrics


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``.

    ``row_number() = 1`` plans as a group limit before the shuffle: each task
    sends one row per key, however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert_feed(target: DataFrame, feed: DataFrame, keys=("match_id",), protected=RESULT_COLUMNS, order="sync_time") -> DataFrame:
    """Feed columns win, protected (result) columns of known rows stay."""
    keys = list(keys)
    newest = latest(feed, keys, [F.col(order).desc_nulls_last()])
    known = F.col("t._known")
    present = F.col("f._present")
    joined = target.withColumn("_known", F.lit(True)).alias("t").join(
        newest.withColumn("_present", F.lit(True)).alias("f"), keys, "full_outer"
    )
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in protected:
            cols.append((F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"f.{c}")) if c in feed.columns else F.col(f"t.{c}")).alias(c))
        elif c in feed.columns:
            cols.append(F.when(present, F.col(f"f.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}"))
    return joined.select(*cols)


def update_columns(base: DataFrame, updates: DataFrame, keys: list[str], columns, order: list[Column] | None = None) -> DataFrame:
    """Update-only merge: the named columns change where the update has a value; unknown keys are ignored."""
    newest = updates if order is None else latest(updates, keys, order)
    allowed = [c for c in columns if c in updates.columns and c in base.columns]
    u = newest.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in allowed])
    joined = base.join(u, keys, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in allowed else F.col(c) for c in base.columns
    ])


def update_results(matches: DataFrame, results: DataFrame, order: list[Column] | None = None) -> DataFrame:
    return update_columns(matches, results, ["match_id"], RESULT_COLUMNS, order)


def update_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """White-listed partial update of runs."""
    return update_columns(runs, updates, ["run_id"], MUTABLE_RUN_COLUMNS)


def upsert_rows(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Full-row upsert: incoming rows replace stored ones, the newest incoming wins."""
    both = target.withColumn("_in", F.lit(0)).unionByName(rows.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_in").desc(), *order]).drop("_in")


def upsert_masked(target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert-or-update of a few columns; the others keep their stored value."""
    r = rows.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = target.join(r, keys, "full_outer")
    return joined.select(*[
        F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns
    ])


def replace_runs(runs: DataFrame, new_runs: DataFrame, feedback: DataFrame, top_picks: DataFrame) -> dict[str, DataFrame]:
    """Save new runs in replace mode.

    Old runs of the match go, every pick of the run's period goes, and a stored
    settlement moves to the new run re-scored (its returns are kept when a
    person had overridden them).
    """
    touched = new_runs.select("match_id").distinct()
    kept = runs.join(touched, "match_id", "left_anti")
    result = kept.unionByName(new_runs, allowMissingColumns=True)
    stale_runs = runs.join(touched, "match_id", "left_semi").select("run_id")
    picks = (
        top_picks.join(new_runs.filter("period <> ''").select("period").distinct(), "period", "left_anti")
        .join(touched, "match_id", "left_anti").join(stale_runs, "run_id", "left_anti")
    )
    carried = feedback.join(
        new_runs.select(
            "match_id", F.col("run_id").alias("new_run_id"), "recommended_outcome", "recommendation",
            "suggested_stake_pct", "effective_recommendation", "effective_stake_pct", "handicap_recommended_side",
            "handicap_line", "handicap_home_odds", "handicap_away_odds",
            *[f"market_odds_{o}" for o in ("home", "draw", "away")],
        ),
        "match_id",
    )
    manual = F.col("roi_source") == "manual_override"
    eff = text("effective_recommendation")
    action = F.when(eff != "", labels.action_label(eff)).otherwise(labels.action_label("recommendation"))
    stake = F.when(num("effective_stake_pct") != 0, num("effective_stake_pct")).otherwise(num("suggested_stake_pct"))
    side = text("handicap_recommended_side")
    result_side = labels.handicap_result("actual_score", num("handicap_line"))
    odds = F.when(side == "home", num("handicap_home_odds")).when(side == "away", num("handicap_away_odds")).otherwise(0.0)
    from ..functions.numeric import round_to

    # The carried re-score multiplies odds as stored (no net-odds correction) and, unlike a fresh
    # settlement, a winning pick without odds loses its stake.
    outcome = text("recommended_outcome")
    price = F.coalesce(
        *[F.when(outcome == o, num(f"market_odds_{o}")) for o in ("home", "draw", "away")], F.lit(0.0)
    )
    roi = (
        F.when((action == "watch") | (stake <= 0) | ~outcome.isin("home", "draw", "away"), 0.0)
        .when(outcome == F.col("actual_result"), round_to((price - 1.0) * stake / 100.0, 4))
        .otherwise(round_to(-stake / 100.0, 4))
    )
    h_roi = (
        F.when((side == "") | ~result_side.isin("home", "away") | (odds <= 0), 0.0)
        .when(side == result_side, round_to((odds - 1.0) * stake / 100.0, 4))
        .otherwise(round_to(-stake / 100.0, 4))
    )
    moved = carried.select(
        "feedback_id", F.col("new_run_id").alias("run_id"), "match_id", "actual_result", "actual_score", "settled_at",
        (outcome == F.col("actual_result")).cast("int").alias("hit_recommendation"),
        F.when(manual, F.col("roi_delta")).otherwise(roi).alias("roi_delta"),
        result_side.alias("handicap_actual_result"),
        ((side != "") & (side == result_side)).cast("int").alias("handicap_hit"),
        F.when(manual, F.col("handicap_roi_delta")).otherwise(h_roi).alias("handicap_roi_delta"),
        "roi_source", "notes",
    )
    untouched = feedback.join(touched, "match_id", "left_anti")
    return {"runs": result, "top_picks": picks, "feedback": untouched.unionByName(moved)}


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove matches and everything that hangs on them, directly or through a run."""
    ids = ids.select("match_id").distinct()
    out = {name: df.join(ids, "match_id", "left_anti") for name, df in tables.items()}
    if "runs" in tables:
        gone = tables["runs"].join(ids, "match_id", "left_semi").select("run_id")
        for name in ("feedback", "top_picks"):
            if name in out:
                out[name] = out[name].join(gone, "run_id", "left_anti")
    return out


def deleted_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows before, kept and deleted, from one aggregate over a union."""
    rows = None
    for name in before:
        part = before[name].select(F.lit(name).alias("table"), F.lit(1).alias("b"), F.lit(0).alias("k")).unionByName(
            after[name].select(F.lit(name).alias("table"), F.lit(0).alias("b"), F.lit(1).alias("k"))
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("table").agg(
        F.sum("b").alias("rows_before"), F.sum("k").alias("rows_kept"), (F.sum("b") - F.sum("k")).alias("rows_deleted")
    )


def recent_periods(matches: DataFrame, keep: int = 90) -> DataFrame:
    """The last ``keep`` distinct periods; the limit bounds the frame, so it may be broadcast."""
    distinct = matches.filter("period <> ''").select("period").distinct()
    return F.broadcast(distinct.orderBy(labels.period_key("period").desc()).limit(keep))


def prune(tables: dict[str, DataFrame], keep: int = 90) -> dict[str, DataFrame]:
    old = tables["matches"].join(recent_periods(tables["matches"], keep), "period", "left_anti")
    return cascade_delete(tables, old)


def import_settlements(stored: DataFrame, incoming: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Append settlements of matches not stored yet, the first by (source, period, id) of each; counters per source.

    A later settlement of the same match counts as existing, so imports add up to the rows that are appended.

    Surrogate keys continue after the stored maximum: dense per-match numbers
    come from a two-step rank (rows per partition, then offsets), never from a
    single-task window over all new rows.
    """
    own = Window.partitionBy("match_id", "_valid").orderBy("source", labels.period_key("period"), "feedback_id")
    turns = incoming.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_turn", F.row_number().over(own))
    have = stored.select("match_id").distinct().withColumn("_have", F.lit(True))
    status = F.when(~F.col("_valid"), "invalid").when(F.col("_have").isNull() & (F.col("_turn") == 1), "imported").otherwise("existing")
    marked = turns.join(have, "match_id", "left").withColumn("_status", status)
    counters = marked.groupBy("source").agg(*[F.count_if(F.col("_status") == s).alias(s) for s in ("imported", "existing", "invalid")])
    return marked.where("_status = 'imported'").drop("_valid", "_turn", "_have", "_status"), counters


def renumber(df: DataFrame, key: str, out: str, start: Column | int = 0, buckets: int = 256) -> DataFrame:
    """Dense numbers 1..n without a global single-task window.

    Rows are split into hash buckets for parallelism, numbered by key inside
    each, and shifted by the running total of the (bounded) bucket counts.
    """
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off")
    )
    rn = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    start = F.lit(start) if isinstance(start, int) else start
    return (
        bucketed.withColumn("_rn", rn).join(F.broadcast(offsets), "_b")
        .withColumn(out, (F.col("_rn") + F.col("_off") + start).cast("long")).drop("_b", "_rn", "_off")
    )


def source_summary(df: DataFrame) -> DataFrame:
    key = labels.period_key("period")
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("period").alias("period_count"),
        F.min(key)["t"].alias("first_period"), F.max(key)["t"].alias("last_period"),
    )


def profile_state(events: DataFrame) -> DataFrame:
    """Current state per profile from its append-only event log; the last activation wins."""
    order = F.struct("event_at", "event_id")
    state = events.groupBy("profile_id").agg(
        F.max_by("status", order).alias("last_status"), F.max("event_at").alias("updated_at"),
        F.max(F.when(F.col("status") == "active", order)).alias("activated"),
    )
    newest = events.filter("status = 'active'").agg(F.max(order).alias("newest"))
    joined = state.join(F.broadcast(newest), F.lit(True), "left")
    status = (
        F.when((F.col("last_status") == "active") & (F.col("activated") == F.col("newest")), "active")
        .when(F.col("last_status") == "active", "archived")
        .otherwise(F.col("last_status"))
    )
    return joined.select("profile_id", status.alias("status"), "updated_at")


def export_long(df: DataFrame, key: str, sections: dict[str, list[str]]) -> DataFrame:
    """Wide review rows as (key, section, field, value)."""
    entries = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), text(f).alias("value"))
        for s, fields in sections.items() for f in fields
    ])
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.section", "e.field", "e.value")


def mark_replayed(feedback: DataFrame, periods: DataFrame, note: str) -> DataFrame:
    """Tag settlements of the given periods; running twice changes nothing."""
    marked = feedback.join(periods.select("period", F.lit(True).alias("_hit")).distinct(), "period", "left")
    notes = (
        F.when(F.col("notes").startswith(note), F.col("notes"))
        .when(F.col("notes") == "", F.lit(note)).otherwise(F.concat(F.lit(note + " "), F.col("notes")))
    )
    return marked.withColumns(
        {
            "roi_source": F.when(F.col("_hit"), "historical_replay").otherwise(F.col("roi_source")),
            "notes": F.when(F.col("_hit"), notes).otherwise(F.col("notes")),
        }
    ).drop("_hit")


def append_labels(current: Column, extra: list[str]) -> Column:
    """Add newline-separated labels that are not there yet, order preserved."""
    have = F.filter(F.split(text(current), "\n"), lambda x: x != "")
    return F.array_join(F.array_union(have, F.array(*[F.lit(e) for e in extra])), "\n")


def resettle_handicap(df: DataFrame) -> DataFrame:
    """Recompute handicap result, hit and return after a line was back-filled."""
    return df.withColumns(metrics.handicap_settlement())
