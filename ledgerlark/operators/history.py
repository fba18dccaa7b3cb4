"""Import of settled history from copies of the ledger: settlements with their runs, snapshots and match rows.

Sources are copies that grew apart, so ids clash between them; a row is (source, id).  Settlements are taken in the
order of source, period and id, the first of every match that is not stored yet.  What hangs on an imported settlement
comes along under new surrogate keys, which continue densely behind the stored ones in the order of import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .ledger import latest

#: Ids of one source and period that are numbered in one task.
ID_RANGE = 1 << 16
Tables = dict[str, DataFrame]


def number_in_order(df: DataFrame, groups: list[Column], key: str, out: str, start: int) -> DataFrame:
    """Dense numbers from ``start`` + 1 in the order of ``groups`` and then ``key`` (a whole number).

    Rows are counted per group and range of ``ID_RANGE`` keys; running totals of these few counts shift the numbers
    that each range gets by itself, so no task orders all rows.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    parts = df.withColumns(dict(zip(names, groups)) | {"_r": F.floor(F.col(key) / ID_RANGE)})
    names.append("_r")
    counts = parts.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*names, (F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(key))
    numbered = parts.withColumn("_turn", turn).join(before, names)
    return numbered.withColumn(out, (F.col("_turn") + F.col("_before") + start).cast("long")).drop(*names, "_turn", "_before")


def _like(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` in the columns of ``table``: those that a source lacks are null, those that only it has go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def _top(table: DataFrame, key: str) -> int:
    return int(table.agg(F.max(key)).first()[0] or 0)


def candidates(sources: Tables) -> DataFrame:
    """Settlements of all sources with their run and its period; those without a run or a period are none."""
    runs = sources["runs"].select("source", F.col("run_id").alias("prediction_run_id"), "feature_snapshot_id", F.trim("period").alias("_period")).where("_period <> ''")
    return sources["feedback"].drop("period").join(runs, ["source", "prediction_run_id"]).withColumnRenamed("_period", "period")


def import_history(stored: Tables, sources: Tables) -> tuple[Tables, DataFrame]:
    """(new rows per table in the stored columns, counters per source).

    Tables: feedback (feedback_id, match_id, prediction_run_id), runs (run_id, match_id, period, feature_snapshot_id),
    snapshots (snapshot_id) and any others, which hang on match_id and are copied unless the match has a row there.
    ``sources`` have the column ``source`` besides.  A settlement without match_id is invalid; one of a match that is
    stored or was imported before it exists already.  A run whose snapshot is missing in its source gets snapshot 0.
    """
    rows = candidates(sources)
    named = F.trim(F.coalesce(F.col("match_id").cast("string"), F.lit(""))) != ""
    order = [F.col("source"), labels.period_key("period")]
    have = stored["feedback"].select("match_id").distinct()
    fresh = latest(rows.where(named).join(have, "match_id", "left_anti"), ["match_id"], [*order, F.col("feedback_id")])
    taken = fresh.select("source", "feedback_id", F.lit(True).alias("_taken"))
    marked = rows.join(taken, ["source", "feedback_id"], "left")
    counters = marked.groupBy("source").agg(
        F.count_if("_taken").alias("imported"), F.count_if(named & F.col("_taken").isNull()).alias("existing"), F.count_if(~named).alias("invalid"),
        F.countDistinct(F.when(F.col("_taken"), F.col("period"))).alias("periods"),
    )
    fresh = number_in_order(fresh, order, "feedback_id", "new_feedback_id", _top(stored["feedback"], "feedback_id"))
    fresh = number_in_order(fresh, order, "feedback_id", "new_run_id", _top(stored["runs"], "run_id"))
    keys = fresh.select("source", "match_id", "feedback_id", "prediction_run_id", "feature_snapshot_id", "period", "new_feedback_id", "new_run_id")
    shots = keys.where("feature_snapshot_id > 0").join(sources["snapshots"].select("source", F.col("snapshot_id").alias("feature_snapshot_id")), ["source", "feature_snapshot_id"], "left_semi")
    shots = number_in_order(shots, order, "feedback_id", "new_snapshot_id", _top(stored["snapshots"], "snapshot_id")).select("source", "feedback_id", "feature_snapshot_id", "new_snapshot_id")
    keys = keys.join(shots.drop("feature_snapshot_id"), ["source", "feedback_id"], "left").withColumn("new_snapshot_id", F.coalesce("new_snapshot_id", F.lit(0)))

    out = {}
    moved = sources["snapshots"].withColumnRenamed("snapshot_id", "feature_snapshot_id").join(shots, ["source", "feature_snapshot_id"])
    out["snapshots"] = _like(moved.withColumn("snapshot_id", F.col("new_snapshot_id")), stored["snapshots"])
    runs = sources["runs"].withColumnRenamed("run_id", "prediction_run_id").drop("feature_snapshot_id")
    runs = runs.join(keys.select("source", "prediction_run_id", "new_run_id", "new_snapshot_id"), ["source", "prediction_run_id"])
    out["runs"] = _like(runs.withColumns({"run_id": F.col("new_run_id"), "feature_snapshot_id": F.col("new_snapshot_id")}), stored["runs"])
    feedback = sources["feedback"].drop("prediction_run_id").join(keys.select("source", "feedback_id", "new_feedback_id", "new_run_id"), ["source", "feedback_id"])
    out["feedback"] = _like(feedback.withColumns({"feedback_id": F.col("new_feedback_id"), "prediction_run_id": F.col("new_run_id")}), stored["feedback"])
    for name in sources.keys() - {"feedback", "runs", "snapshots"}:
        own = sources[name].join(keys.select("source", "match_id"), ["source", "match_id"], "left_semi")
        out[name] = _like(own.join(stored[name].select("match_id"), "match_id", "left_anti"), stored[name])
    return out, counters


def imported(stored: Tables, new: Tables) -> Tables:
    """The stored tables with what an import adds."""
    return {name: table.unionByName(new[name]) if name in new else table for name, table in stored.items()}
