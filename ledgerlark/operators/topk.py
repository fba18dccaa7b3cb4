"""Per-period ranked picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import num, round_to, text


def scored(runs: DataFrame) -> DataFrame:
    action = labels.action_label("handicap_recommendation")
    side = text("handicap_recommended_side")
    weight = labels.action_level(action)
    ev, conf, quality = num("handicap_expected_value"), num("handicap_confidence"), num("quality_score")
    positive = F.greatest(ev, F.lit(0.0))
    composite = weight * 1.00 + positive * 0.45 + conf * 0.35 + quality * 0.10 + num("model_agreement") * 0.05
    return runs.withColumns(
        {
            "action_weight": weight,
            "actionable": (weight > 0) & side.isin("home", "away"),
            "ev_rank": round_to(positive, 4),
            "confidence_rank": round_to(conf, 4),
            "quality_rank": round_to(quality, 4),
            "composite_score": round_to(composite, 4),
        }
    )


def top_picks(runs: DataFrame, k: int = 3, order: str = "match_id") -> DataFrame:
    """The best ``k`` runs of every period by the rounded rank keys.

    ``row_number() <= k`` becomes a group limit in front of the shuffle, so a
    period with a third of all rows still sends k rows per task.
    """
    keys = ["actionable", "action_weight", "ev_rank", "confidence_rank", "quality_rank", "composite_score"]
    w = Window.partitionBy("period").orderBy(*[F.col(c).desc() for c in keys], F.col(order))
    ranked = scored(runs).withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    side = F.when(F.col("handicap_recommended_side") == "home", "home").otherwise("away")
    reason = F.array_join(
        F.array_compact(F.array(
            F.when(F.col("actionable"), F.concat(F.lit("handicap "), F.col("handicap_recommendation"), F.lit(" "), side))
            .otherwise("fallback by value and confidence"),
            F.when(F.col("ev_rank") >= 0.02, F.format_string("ev %+.3f", num("handicap_expected_value"))),
            F.when(F.col("confidence_rank") >= 0.52, F.format_string("confidence %.0f%%", F.col("confidence_rank") * 100)),
            F.when(F.col("quality_rank") >= 0.80, F.lit("good data quality")),
        )),
        "; ",
    )
    return ranked.withColumn("reason", reason)


def settled_picks(picks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Picks with their settlement state: hit, miss or pending."""
    joined = picks.join(feedback.select("run_id", "handicap_actual_result", "handicap_hit", "actual_score"), "run_id", "left")
    actionable = (labels.action_label("handicap_recommendation") != "watch") & text("handicap_recommended_side").isin("home", "away")
    stored = text("handicap_actual_result")
    result = F.when((stored == "") & actionable, labels.handicap_result("actual_score", num("handicap_line"))).otherwise(stored)
    settled = actionable & result.isin("home", "away", "push")
    hit = F.coalesce(F.when(F.col("handicap_hit") != 0, 1), F.when(text("handicap_recommended_side") == result, 1).otherwise(0))
    return joined.withColumns(
        {
            "is_settled": settled,
            "pick_result": F.when(settled, result).otherwise(""),
            "pick_hit": F.when(settled, hit).otherwise(0),
            "status": F.when(settled & (hit == 1), "hit").when(settled, "miss").otherwise("pending"),
        }
    )


def pick_summary(picks: DataFrame) -> DataFrame:
    from ..functions.numeric import ratio

    return picks.agg(
        F.count(F.lit(1)).alias("pick_count"), F.count_if("is_settled").alias("settled_count"),
        F.sum("pick_hit").alias("hit_count"),
    ).withColumn("hit_rate", round_to(ratio("hit_count", "settled_count"), 6))
