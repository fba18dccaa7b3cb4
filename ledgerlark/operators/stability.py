"""Strategy comparison and stability over periods.

Everything here is computed from one additive frame with a row per
(variant, period): counts and sums stay additive to the end and ratios are
taken last.  Windows run on that frame, never on fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import HANDICAP_TARGET, VARIANT_ROLES
from ..functions import labels
from ..functions.numeric import ratio, round_to
from . import strategies

ADDITIVE = ("samples", "actions", "hits", "roi", "stake")


def variant_periods(picks: DataFrame, variants=None) -> DataFrame:
    """Additive facts per (variant, period), periods without actions included."""
    cells = strategies.variant_cells(picks, ["period"], variants)
    return cells.groupBy("variant", "period").agg(
        F.sum("n").alias("samples"),
        F.sum("acted").alias("actions"),
        F.sum("hit").alias("hits"),
        F.sum("roi").alias("roi"),
        F.sum("stake_units").alias("stake"),
    )


def ratios(prefix: str = "") -> list[Column]:
    n = lambda c: F.col(prefix + c)
    return [
        round_to(ratio(n("actions"), n("samples")), 6).alias(prefix + "action_share"),
        round_to(ratio(n("hits"), n("actions")), 6).alias(prefix + "hit_rate"),
        round_to(n("roi"), 6).alias(prefix + "total_roi"),
        round_to(ratio(n("roi"), n("stake")), 6).alias(prefix + "roi_on_stake"),
    ]


def _sums(condition: Column | None = None, prefix: str = "") -> list[Column]:
    pick = (lambda c: F.col(c)) if condition is None else (lambda c: F.when(condition, F.col(c)).otherwise(0))
    return [F.sum(pick(c)).alias(prefix + c) for c in ADDITIVE]


def ranked(frame: DataFrame) -> DataFrame:
    """Rank periods within each variant, oldest first; every variant sees the same periods."""
    by_variant = Window.partitionBy("variant")
    return frame.withColumn(
        "rank", F.row_number().over(by_variant.orderBy(labels.period_key("period")))
    ).withColumn("periods", F.count(F.lit(1)).over(by_variant))


def summary(frame: DataFrame) -> DataFrame:
    """Per variant: totals and the latest 6 and 10 periods."""
    r = ranked(frame)
    latest = lambda n: F.col("rank") > F.col("periods") - n
    agg = r.groupBy("variant").agg(
        F.max("periods").alias("periods"), *_sums(), *_sums(latest(6), "latest6_"), *_sums(latest(10), "latest10_")
    )
    return agg


def rolling(frame: DataFrame, width: int = 10) -> DataFrame:
    """All complete windows of ``width`` consecutive periods per variant."""
    r = ranked(frame)
    order = Window.partitionBy("variant").orderBy("rank")
    span = order.rowsBetween(-(width - 1), 0)
    summed = r.select(
        "variant", "rank", F.col("period").alias("end_period"), F.first("period").over(span).alias("start_period"),
        *[F.sum(c).over(span).alias(c) for c in ADDITIVE],
    ).filter(F.col("rank") >= width)
    return summed.withColumns(
        {"hit_rate": round_to(ratio("hits", "actions"), 6), "roi_on_stake": round_to(ratio("roi", "stake"), 6)}
    )


def rolling_report(frame: DataFrame, width: int = 10) -> DataFrame:
    """Min and average over windows, plus the worst windows (earliest on ties)."""
    w = rolling(frame, width)
    agg = w.groupBy("variant").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.min("hit_rate").alias("min_hit_rate"),
        F.min("roi_on_stake").alias("min_roi_on_stake"),
        round_to(F.avg("hit_rate"), 6).alias("avg_hit_rate"),
        round_to(F.avg("roi_on_stake"), 6).alias("avg_roi_on_stake"),
        F.min_by(F.struct("start_period", "end_period", "actions"), F.struct("hit_rate", "rank")).alias("h"),
        F.min_by(F.struct("start_period", "end_period", "actions"), F.struct("roi_on_stake", "rank")).alias("r"),
    )
    return agg.select(
        "variant", "window_count", "min_hit_rate", "min_roi_on_stake", "avg_hit_rate", "avg_roi_on_stake",
        F.col("h.start_period").alias("worst_hit_start"), F.col("h.end_period").alias("worst_hit_end"),
        F.col("h.actions").alias("worst_hit_actions"),
        F.col("r.start_period").alias("worst_roi_start"), F.col("r.end_period").alias("worst_roi_end"),
        F.col("r.actions").alias("worst_roi_actions"),
    )


def comparison(frame: DataFrame, width: int = 10) -> DataFrame:
    """The strategy table: role, totals, latest 10, rolling minimum.

    Totals and windows come from one ranked frame, so the fixtures behind it
    are scanned once.
    """
    r = ranked(frame)
    span = Window.partitionBy("variant").orderBy("rank").rowsBetween(-(width - 1), 0)
    r = r.withColumns({f"w_{c}": F.sum(c).over(span) for c in ("actions", "hits", "roi", "stake")})
    whole = F.col("rank") >= width
    latest = F.col("rank") > F.col("periods") - 10
    s = r.groupBy("variant").agg(
        *_sums(), *_sums(latest, "latest10_"),
        F.min(F.when(whole, round_to(ratio("w_hits", "w_actions"), 6))).alias("min_hit_rate"),
        F.min(F.when(whole, round_to(ratio("w_roi", "w_stake"), 6))).alias("min_roi_on_stake"),
    )
    role = F.create_map(*[F.lit(x) for kv in VARIANT_ROLES.items() for x in kv])
    return s.select(
        "variant",
        F.coalesce(F.try_element_at(role, F.col("variant")), F.lit("candidate")).alias("role"),
        F.col("samples").alias("sample_count"), F.col("actions").alias("action_count"), *ratios(),
        F.col("latest10_actions").alias("latest_10_action_count"),
        round_to(ratio("latest10_hits", "latest10_actions"), 6).alias("latest_10_hit_rate"),
        round_to(ratio("latest10_roi", "latest10_stake"), 6).alias("latest_10_roi_on_stake"),
        F.coalesce("min_hit_rate", F.lit(0.0)).alias("rolling_10_min_hit_rate"),
        F.coalesce("min_roi_on_stake", F.lit(0.0)).alias("rolling_10_min_roi_on_stake"),
    )


def recommended(table: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Best variant by ROI on stake, hit rate, count; stable ones are preferred when any exist."""
    order = F.create_map(*[F.lit(x) for kv in {v: -i for i, v in enumerate(VARIANT_ROLES)}.items() for x in kv])
    usable = table.filter((F.col("action_count") > 0) & ~F.col("variant").isin(*exclude))
    stable = (F.col("rolling_10_min_hit_rate") >= 0.70) & (F.col("rolling_10_min_roi_on_stake") >= 0.0)
    rank = F.struct(
        stable.cast("int"), F.col("roi_on_stake"), F.col("hit_rate"), F.col("action_count"),
        F.coalesce(F.try_element_at(order, F.col("variant")), F.lit(-999)),
    )
    return usable.agg(F.max_by(F.struct(*table.columns), rank).alias("best")).filter("best is not null").select("best.*")


def thirds(frame: DataFrame) -> DataFrame:
    """Early, middle and recent chunks of the period axis; chunk = ceil(n / 3)."""
    r = ranked(frame)
    chunk = F.greatest(F.ceil(F.col("periods") / 3.0), F.lit(1))
    index = F.floor((F.col("rank") - 1) / chunk)
    return r.withColumn("third", F.when(index == 0, "early").when(index == 1, "middle").otherwise("recent"))


def batch_target(frame: DataFrame, variant: str = "coverage_draw_rescue") -> DataFrame:
    """Does the batch strategy reach its share, hit-rate and rolling targets?"""
    s = comparison(frame.filter(F.col("variant") == variant))
    hit, share = HANDICAP_TARGET["hit_rate"], HANDICAP_TARGET["action_share"]
    required = F.ceil(F.col("sample_count") * share)
    met = (
        (F.col("action_count") >= required) & (F.col("hit_rate") >= hit)
        & (F.col("rolling_10_min_hit_rate") >= hit)
    )
    return s.withColumns({"required_actions": required, "target_met": met}).withColumn(
        "status", F.when(F.col("target_met"), "met").otherwise("gap")
    )
