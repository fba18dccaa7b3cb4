"""Ledger audits: duplicates, orphans, re-derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import num, ratio, round_to, text
from . import ledger, metrics


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dedup_runs(runs: DataFrame, feedback: DataFrame, picks: DataFrame) -> dict[str, DataFrame]:
    """Keep the newest run per match, point settlements at it, drop picks of removed runs."""
    survivors = ledger.latest(runs, ["match_id"], [F.col("created_at").desc_nulls_last(), F.col("run_id").desc()])
    pointer = survivors.select("match_id", F.col("run_id").alias("_to"))
    moved = feedback.join(pointer, "match_id", "left").withColumn("run_id", F.coalesce("_to", "run_id")).drop("_to")
    return {
        "runs": survivors,
        "feedback": ledger.latest(moved, ["match_id"], [F.col("feedback_id").desc()]),
        "top_picks": picks.join(survivors.select("run_id"), "run_id", "left_semi"),
    }


def chain_findings(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per settlement: everything that does not re-derive from its inputs."""
    j = rows.join(canonical.select("match_id", F.col("run_id").alias("canonical_id")), "match_id", "left")
    derived = metrics.handicap_settlement()
    findings = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("canonical_id") == F.col("run_id"), F.lit(False)), "not_canonical"),
        F.when((text("handicap_actual_result") != "") & (text("handicap_actual_result") != derived["handicap_actual_result"]), "handicap_result"),
        F.when(num("handicap_hit") != derived["handicap_hit"], "handicap_hit"),
        F.when(F.abs(num("handicap_roi_delta") - derived["handicap_roi_delta"]) > 1e-6, "handicap_return"),
        F.when(text("period") == "", "blank_period"),
    ))
    return j.withColumn("findings", findings)


def audit_periods(findings: DataFrame) -> DataFrame:
    """Counts per period; a row is valid when nothing was found."""
    valid = F.size("findings") == 0
    acted = (text("handicap_recommendation") != "watch") & text("handicap_recommended_side").isin("home", "away")
    return findings.groupBy("period").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(valid).alias("valid_count"),
        F.count_if(~valid).alias("finding_count"), F.count_if(valid & acted).alias("action_count"),
        F.count_if(valid & acted & (F.col("handicap_hit") == 1)).alias("hit_count"),
    )


def audit_totals(periods: DataFrame, baseline: dict[str, int]) -> DataFrame:
    """Whole-ledger totals next to a stored baseline."""
    total = periods.agg(*[F.sum(c).alias(c) for c in ("row_count", "valid_count", "finding_count", "action_count", "hit_count")])
    passed: Column = F.lit(True)
    for name, floor in baseline.items():
        passed = passed & (F.col(name) >= floor)
    return total.withColumns(
        {"hit_rate": round_to(ratio("hit_count", "action_count"), 6), "passed": passed & (F.col("finding_count") == 0)}
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("findings").alias("finding")).groupBy("finding").count().withColumnRenamed("count", "rows")


def label_conflicts(df: DataFrame, column: str) -> DataFrame:
    """Spellings of an action next to the label they stand for."""
    return df.groupBy(F.col(column).alias("spelling"), labels.action_label(column).alias("label")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
