"""Batch settlement of forecasts against results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import OUTCOMES
from ..functions import labels
from ..functions.numeric import num, ratio, round_to, text
from . import joins, metrics, strategies


def effective_results(matches: DataFrame, fetched: DataFrame) -> DataFrame:
    """Which result counts per match.

    A manual result wins; an automatic one that agrees fills its gaps and, when
    it confirms everything, turns the status into settled.  Otherwise the
    fetched result, else the one already on the match.
    """
    f = fetched.select(
        "match_id", F.col("actual_result").alias("f_result"), F.col("actual_score").alias("f_score"),
        F.col("result_source_url").alias("f_url"),
    )
    j = matches.join(f, "match_id", "left")
    stored, score, url = text("actual_result"), text("actual_score"), text("result_source_url")
    manual = (text("result_status") == "manual_override") & stored.isin(*OUTCOMES)
    agrees = manual & (text("f_result") == stored)
    filled_score = F.when(agrees & (score == ""), text("f_score")).otherwise(score)
    filled_url = F.when(agrees & (url == ""), text("f_url")).otherwise(url)
    # The automatic result only completes a manual one that has gaps or agrees in full.
    confirmed = (
        agrees & (text("f_score") != "") & (text("f_url") != "")
        & (filled_score == text("f_score")) & (filled_url == text("f_url"))
    )
    automatic = F.when(F.col("f_result").isNotNull(), text("f_result")).otherwise(stored)
    return j.withColumns(
        {
            "e_result": F.when(manual, stored).otherwise(automatic),
            "e_score": F.when(manual, filled_score).when(F.col("f_result").isNotNull(), text("f_score")).otherwise(score),
            "e_url": F.when(manual, filled_url).when(F.col("f_result").isNotNull(), text("f_url")).otherwise(url),
            "e_status": F.when(confirmed, "settled").when(manual, "manual_override").otherwise("settled"),
        }
    ).drop("f_result", "f_score", "f_url")


def settle(matches: DataFrame, fetched: DataFrame, runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Settlement rows and skips (``skip_reason`` <> '') for any set of periods.

    Idempotent: a manual return and the notes of an existing settlement stay.
    """
    results = effective_results(matches, fetched)
    canonical = joins.canonical_run(runs, results)
    stored = feedback.select(
        "run_id", F.col("roi_delta").alias("s_roi"), F.col("roi_source").alias("s_source"), F.col("notes").alias("s_notes")
    )
    rows = (
        results.select("match_id", "period", F.col("e_result").alias("actual_result"), F.col("e_score").alias("actual_score"), "e_status")
        .join(canonical, "match_id", "left")
        .join(runs.drop("match_id", "period", "created_at", "actual_result", "actual_score"), "run_id", "left")
        .join(stored, "run_id", "left")
    )
    rows = metrics.with_settlement(rows)
    manual = F.coalesce(F.col("s_source") == "manual_override", F.lit(False))
    skip = F.when(~F.col("actual_result").isin(*OUTCOMES), "no_result").otherwise(F.coalesce("reason", F.lit("no_run")))
    return rows.withColumns(
        {
            "skip_reason": skip,
            "roi_delta": F.when(manual, F.col("s_roi")).otherwise(F.col("roi_delta")),
            "roi_source": F.when(manual, "manual_override").otherwise("auto"),
            "notes": F.coalesce("s_notes", F.lit("")),
        }
    )


def rejected_feedback(claims: DataFrame, canonical: DataFrame) -> DataFrame:
    """Manual settlements with the reason they cannot be taken ('' = accepted)."""
    j = claims.join(canonical.select("match_id", F.col("run_id").alias("canonical_id"), "reason"), "match_id", "left")
    reason = (
        F.when(F.col("canonical_id").isNull(), F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown_match")))
        .when(F.col("canonical_id") != F.col("run_id"), "not_canonical")
        .when(~labels.text("actual_result").isin(*OUTCOMES), "bad_result")
        .otherwise("")
    )
    return j.withColumn("reject_reason", reason)


def apply_batch_strategy(latest_runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Write the batch strategy's action onto unsettled runs; watch keeps the old outcome."""
    open_runs = latest_runs.join(feedback.select("run_id"), "run_id", "left_anti")
    picked = strategies.all_picks(open_runs)
    pick = strategies.picked("coverage_draw_rescue")
    acted = pick["outcome"] != ""
    old = F.when(text("recommended_outcome").isin(*OUTCOMES), text("recommended_outcome")).when(
        text("algo_recommended_outcome").isin(*OUTCOMES), text("algo_recommended_outcome")
    ).otherwise("")
    action = F.when(~acted, "watch").when(pick["tier"] == "core", "main").otherwise("light")
    return picked.select(
        "run_id", "match_id", "period", action.alias("recommendation"),
        F.when(acted, pick["outcome"]).otherwise(old).alias("recommended_outcome"),
        pick["stake"].alias("suggested_stake_pct"), F.lit("target_batch_strategy").alias("effective_action_source"),
    )


def period_progress(matches: DataFrame, feedback: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Completed, partial or missing settlement per period."""
    done = feedback.select("match_id", F.lit(1).alias("_d")).distinct()
    agg = matches.join(done, "match_id", "left").groupBy("period").agg(
        F.count(F.lit(1)).alias("match_count"), F.coalesce(F.sum("_d"), F.lit(0)).alias("feedback_count")
    )
    status = (
        F.when(F.col("feedback_count") == 0, "missing").when(F.col("feedback_count") < F.col("match_count"), "partial")
        .otherwise("completed")
    )
    return agg.select(
        "period", "match_count", "feedback_count", status.alias("status"),
        round_to(ratio("feedback_count", "match_count"), 6).alias("settled_share"),
    )


def backfill_plan(settled: DataFrame, sequence: DataFrame, target: int) -> DataFrame:
    """Periods to replay: those right before the earliest settled one, nearest first.

    ``sequence`` holds the known periods in order (period, seq); only as many
    are taken as are missing to reach ``target`` settled periods.
    """
    have = settled.select("period").distinct().join(sequence, "period")
    edge = have.agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("have"))
    before = sequence.join(F.broadcast(edge), sequence["seq"] < F.col("first_seq"))
    distance = F.col("first_seq") - F.col("seq")
    return before.filter(distance <= F.greatest(F.lit(target) - F.col("have"), F.lit(0))).select(
        "period", "seq", distance.alias("distance")
    )
