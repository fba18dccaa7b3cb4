"""Reports that compare the production strategy with observation layers.

All take the frame of :func:`strategies.row_picks` (or ``all_picks``) and run
one aggregate over it; ratios come from additive columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import HANDICAP_TARGET, OUTCOMES
from ..functions import labels
from ..functions.numeric import between, num, ratio, round_to
from . import stability, strategies
from .strategies import part, picked

PRODUCTION = "steady"
DELTA_LAYERS = (
    "clean", "precise", "rescue", "broad", "cautious", "ultra",
    "coverage_push", "coverage_stable", "coverage_refined", "coverage_value_guarded", "coverage_xg_guarded",
)


def pick_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("action_count"),
        F.sum("hit").alias("hit_count"),
        F.sum("roi").alias("roi"),
        F.sum("stake_units").alias("stake"),
    ]


def pick_ratios(prefix: str = "") -> list[Column]:
    n = lambda c: F.col(prefix + c)
    return [
        n("action_count"),
        n("hit_count"),
        F.greatest(n("action_count") - n("hit_count"), F.lit(0)).alias(prefix + "miss_count"),
        round_to(ratio(n("hit_count"), n("action_count")), 6).alias(prefix + "hit_rate"),
        round_to(n("roi"), 6).alias(prefix + "total_roi"),
        round_to(ratio(n("roi"), n("stake")), 6).alias(prefix + "roi_on_stake"),
    ]


def pick_summary(picks: DataFrame, strategy: str) -> DataFrame:
    """Metrics of one strategy by grouping set: total, tier, bucket, league, period.

    Watch rows take part so sample counts and shares are right.  One scan, one
    shuffle: the five groupings are GROUPING SETS over a partial aggregate.
    """
    facts = strategies.settle_pick(picked(strategy))
    rows = picks.select(
        F.col("league"), F.col("period"), part(strategy, "tier").alias("tier"), part(strategy, "reason").alias("reason"),
        F.when(part(strategy, "outcome") == "", "watch").otherwise(part(strategy, "outcome")).alias("outcome"),
        *[facts[c].alias(c) for c in ("acted", "hit", "roi", "stake_units")],
    )
    keys = ["tier", "reason", "outcome", "league", "period"]
    sets = [[], ["tier"], ["tier", "reason", "outcome"], ["league"], ["period"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(
        F.grouping_id(*keys).alias("gid"),
        F.count(F.lit(1)).alias("samples"), F.sum("acted").alias("actions"), F.sum("hit").alias("hits"),
        F.sum("roi").alias("roi"), F.sum("stake_units").alias("stake"),
    )
    names = {31: "total", 15: "tier", 3: "bucket", 29: "league", 30: "period"}
    scope = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    key = F.concat_ws(":", *keys)
    return grouped.select(
        F.try_element_at(scope, F.col("gid").cast("int")).alias("scope"),
        F.when(F.col("gid") == 31, "all").otherwise(key).alias("key"),
        F.col("samples").alias("sample_count"), F.col("actions").alias("action_count"), *stability.ratios(),
        round_to(ratio(F.col("stake") * 100.0, F.col("actions")), 6).alias("avg_stake_pct"),
    )


def diagnostics(picks: DataFrame, strategy: str) -> DataFrame:
    """Acted rows grouped by outcome, reason, odds band, confidence band and score alignment."""
    keys = ["outcome", "reason", "odds_band", "confidence_band", "score_alignment"]
    rows = strategies.actions_of(picks, strategy).select(*keys, "hit", "roi", "stake_units")
    grouped = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        *pick_sums(), *[F.grouping(k).alias(f"g_{k}") for k in keys]
    )
    dimension = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys])
    return grouped.select(dimension.alias("dimension"), F.coalesce(*keys).alias("key"), *pick_ratios())


def breakdown(rows: DataFrame, field: str, limit: int = 6, by: list[str] | None = None) -> DataFrame:
    """Groups ordered by misses, actions, key; the top ``limit`` with up to three example misses.

    Examples are kept per group by a bounded ``max_by`` style aggregate: the
    three newest misses come from a top-k array per task, never a full list.
    """
    by = by or []
    key = F.when(F.col(field) == "", "unknown").otherwise(F.col(field))
    grouped = rows.withColumn("key", key).groupBy(*by, "key").agg(*pick_sums())
    order = Window.partitionBy(*by).orderBy(
        (F.col("action_count") - F.col("hit_count")).desc(), F.col("action_count").desc(), F.col("key")
    )
    return (
        grouped.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)
        .select(*by, "key", "place", *pick_ratios())
    )


def newest_examples(rows: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Newest actions by period (then newest settlement), per group when asked.

    ``row_number() <= k`` plans as a partial group limit before the shuffle, so
    only k rows per task and group move.
    """
    key = labels.period_key("period")
    order = [key.desc(), F.col("feedback_id").desc()]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)
    return rows.orderBy(*order).limit(limit)


def flags_of(picks: DataFrame) -> DataFrame:
    """Production actions with their raised observation flags."""
    return strategies.actions_of(picks, PRODUCTION, extra={"flags": strategies.raised_flags()})


def risk_buckets(picks: DataFrame) -> DataFrame:
    """Production actions by number of raised flags; empty buckets are listed too."""
    n = F.size("flags")
    bucket = F.when(n >= 3, "resonance").when(n == 2, "stacked").when(n == 1, "single").otherwise("clean")
    rows = flags_of(picks).withColumn("bucket", bucket).select("bucket", "hit", "roi", "stake_units")
    names = picks.sparkSession.createDataFrame([(b,) for b in ("clean", "single", "stacked", "resonance")], "bucket string")
    counted = rows.groupBy("bucket").agg(*pick_sums())
    full = F.broadcast(names).join(counted, "bucket", "left").fillna(0)
    return full.select("bucket", *pick_ratios())


def combo_buckets(picks: DataFrame) -> DataFrame:
    """Production actions by the exact combination of raised flags."""
    rows = flags_of(picks).select(
        F.when(F.size("flags") == 0, "clean").otherwise(F.array_join("flags", "+")).alias("combo"),
        F.size("flags").cast("long").alias("flag_count"), "hit", "roi", "stake_units",
    )
    return rows.groupBy("combo", "flag_count").agg(*pick_sums()).select("combo", "flag_count", *pick_ratios())


def _resonant() -> Column:
    return F.array_contains("flags", "rescue") & (F.size("flags") >= 3)


def scenarios(picks: DataFrame) -> DataFrame:
    """What if a filter had removed some production actions: kept and removed side by side."""
    rows = flags_of(picks)
    tests = {
        "rescue_high_resonance": _resonant(),
        "rescue_high_resonance_r4_draw": _resonant() & (F.col("reason") == "R4_score_draw") & (F.col("outcome") == "draw"),
        "rescue_high_resonance_existing_home": _resonant() & (F.col("reason") == "existing") & (F.col("outcome") == "home"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("scenario"), t.alias("removed")) for k, t in tests.items()])
    per_period = (
        rows.select("period", "hit", "roi", "stake_units", F.explode(entries).alias("e"))
        .groupBy("e.scenario", "period")
        .agg(
            *pick_sums(),
            F.sum(F.when(F.col("e.removed"), 1).otherwise(0)).alias("removed_count"),
            F.sum(F.when(F.col("e.removed"), F.col("hit")).otherwise(0)).alias("removed_hits"),
            F.sum(F.when(F.col("e.removed"), F.col("roi")).otherwise(0.0)).alias("removed_roi"),
            F.sum(F.when(F.col("e.removed"), F.col("stake_units")).otherwise(0.0)).alias("removed_stake"),
        )
    )
    hit_period = F.col("removed_count") > 0
    total = per_period.groupBy("scenario").agg(
        *[F.sum(c).alias(c) for c in ("action_count", "hit_count", "roi", "stake", "removed_count", "removed_hits", "removed_roi", "removed_stake")],
        F.sum(hit_period.cast("int")).alias("removed_periods"),
        F.max("removed_count").alias("max_removed"),
        F.max(F.when(hit_period, labels.period_key("period"))).alias("latest"),
    )
    kept = F.col("action_count") - F.col("removed_count")
    kept_hits = F.col("hit_count") - F.col("removed_hits")
    return total.select(
        "scenario",
        F.col("action_count").alias("production_action_count"),
        F.col("hit_count").alias("production_hit_count"),
        round_to(ratio("hit_count", "action_count"), 6).alias("production_hit_rate"),
        kept.alias("kept_action_count"), kept_hits.alias("kept_hit_count"),
        round_to(ratio(kept_hits, kept), 6).alias("kept_hit_rate"),
        round_to(F.col("roi") - F.col("removed_roi"), 6).alias("kept_roi"),
        round_to(ratio(F.col("roi") - F.col("removed_roi"), F.col("stake") - F.col("removed_stake")), 6).alias("kept_roi_on_stake"),
        F.col("removed_count").alias("filtered_count"), F.col("removed_hits").alias("filtered_hit_count"),
        F.col("removed_periods").alias("filtered_period_count"),
        F.coalesce(F.col("latest.t"), F.lit("")).alias("filtered_latest_period"),
        round_to(ratio("max_removed", "removed_count"), 6).alias("max_period_filtered_share"),
    )


def _delta_rows(picks: DataFrame, layers) -> DataFrame:
    """Production actions x layers with the layer's verdict; one row per pair."""
    entries = F.array(*[
        F.struct(F.lit(v).alias("layer"), (part(v, "outcome") == "").alias("dropped"), part(v, "reason").alias("why"))
        for v in layers
    ])
    acted = strategies.actions_of(picks, PRODUCTION, extra={"layers": entries})
    return acted.select("period", "hit", "roi", "stake_units", F.explode("layers").alias("e")).select(
        "period", "hit", "roi", "stake_units", "e.layer", "e.dropped", "e.why"
    )


def _delta_cells(picks: DataFrame, layers) -> DataFrame:
    """Production actions x layers with the layer's verdict; one row per pair of a cell of like fixtures and a layer.

    The cells are those of ``stability.variant_periods`` over the row-local
    strategies, so a query that asks for both scores its fixtures once.
    """
    variants = strategies.ROW_LOCAL + tuple(v for v in layers if v not in strategies.ROW_LOCAL)
    place = {v: i + 1 for i, v in enumerate(variants)}
    drops = lambda at: f"substring(verdicts, {at}, 1) = '{strategies.NO_ACTION}'"
    # Whether production acted leaves through the generator: a filter on a cell's key would be pushed into the layers.
    entries = ", ".join(f"struct('{v}' AS layer, {place[v]} AS place, NOT {drops(place[PRODUCTION])} AS keep)" for v in layers)
    cells = strategies.verdict_cells(picks, ["period"], variants).selectExpr("*", f"explode(array({entries})) AS e")
    return cells.filter("e.keep").selectExpr(
        "period", "n", *strategies.cell_facts(str(place[PRODUCTION]), {PRODUCTION: "true"}),
        "e.layer AS layer", f"{drops('e.place')} AS dropped",
    )


def deltas(picks: DataFrame, layers=DELTA_LAYERS) -> DataFrame:
    """What each observation layer would filter out of production."""
    d = F.col("dropped")
    per_period = _delta_cells(picks, layers).groupBy("layer", "period").agg(
        F.sum("n").alias("n"), F.sum("hit").alias("hits"),
        F.sum(F.when(d, F.col("n")).otherwise(0)).alias("f"), F.sum(F.when(d, F.col("hit")).otherwise(0)).alias("fh"),
        F.sum(F.when(d, F.col("roi")).otherwise(0.0)).alias("f_roi"),
        F.sum(F.when(d, F.col("stake_units")).otherwise(0.0)).alias("f_stake"),
    )
    total = per_period.groupBy("layer").agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "f", "fh", "f_roi", "f_stake")],
        F.sum((F.col("f") > 0).cast("int")).alias("periods"),
        F.max("f").alias("max_f"), F.max(F.col("f") - F.col("fh")).alias("max_miss"),
        F.max(F.when(F.col("f") > 0, labels.period_key("period"))).alias("latest"),
    )
    misses, fmiss = F.col("n") - F.col("hits"), F.col("f") - F.col("fh")
    return total.select(
        "layer", F.col("f").alias("filtered_count"), F.col("fh").alias("filtered_hit_count"),
        fmiss.alias("filtered_miss_count"), round_to(ratio("fh", "f"), 6).alias("filtered_hit_rate"),
        F.col("hits").alias("production_hit_count"), misses.alias("production_miss_count"),
        round_to(ratio(fmiss, misses), 6).alias("miss_capture_rate"),
        round_to(ratio("fh", "hits"), 6).alias("hit_filter_rate"),
        round_to(F.col("f_roi"), 6).alias("filtered_roi"),
        round_to(ratio("f_roi", "f_stake"), 6).alias("filtered_roi_on_stake"),
        F.col("periods").alias("filtered_period_count"),
        F.coalesce(F.col("latest.t"), F.lit("")).alias("filtered_latest_period"),
        round_to(ratio("max_f", "f"), 6).alias("max_period_filtered_share"),
        round_to(ratio("max_miss", fmiss), 6).alias("max_period_miss_share"),
    )


def delta_reasons(picks: DataFrame, layers=DELTA_LAYERS) -> DataFrame:
    """Filtered production actions per layer and guard reason."""
    rows = _delta_rows(picks, layers).filter("dropped").withColumn(
        "reason", F.when(F.col("why") == "", "unknown").otherwise(F.col("why"))
    )
    per_period = rows.groupBy("layer", "reason", "period").agg(*pick_sums())
    return (
        per_period.groupBy("layer", "reason")
        .agg(
            *[F.sum(c).alias(c) for c in ("action_count", "hit_count", "roi", "stake")],
            F.count(F.lit(1)).alias("period_count"),
            F.max(labels.period_key("period")).alias("latest"),
        )
        .select("layer", "reason", *pick_ratios(), "period_count", F.col("latest.t").alias("latest_period"))
    )


def transition(picks: DataFrame, source: str, target: str) -> DataFrame:
    """Actions the target strategy restores among the source's watch rows."""
    rows = strategies.actions_of(picks, target, where=part(source, "outcome") == "")
    per_period = rows.groupBy("period").agg(*pick_sums())
    return per_period.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("action_count", "hit_count", "roi", "stake")],
        F.count(F.lit(1)).alias("period_count"),
        F.max(labels.period_key("period")).alias("latest"),
    ).select(
        F.lit(f"{source}_to_{target}").alias("transition"), *pick_ratios(), "period_count",
        F.coalesce(F.col("latest.t"), F.lit("")).alias("latest_period"),
    )


def period_thirds(picks: DataFrame, layers=("rescue", "broad")) -> DataFrame:
    """Early, middle and recent thirds: production next to each observation layer."""
    d = F.col("dropped")
    per_period = _delta_cells(picks, layers).groupBy("layer", "period").agg(
        F.sum("n").alias("n"), F.sum("hit").alias("hits"),
        F.sum(F.when(d, F.col("n")).otherwise(0)).alias("f"), F.sum(F.when(d, F.col("hit")).otherwise(0)).alias("fh"),
    )
    axis = picks.select("period").distinct()
    empty = axis.select(F.explode(F.array(*[F.lit(v) for v in layers])).alias("variant"), "period")
    ranked = stability.thirds(empty)
    joined = ranked.join(per_period.withColumnRenamed("layer", "variant"), ["variant", "period"], "left").fillna(0)
    key = labels.period_key("period")
    return (
        joined.groupBy("third", "variant")
        .agg(
            F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("period_count"),
            *[F.sum(c).alias(c) for c in ("n", "hits", "f", "fh")],
        )
        .select(
            "third", F.col("variant").alias("layer"), F.col("first.t").alias("period_from"),
            F.col("last.t").alias("period_to"), "period_count",
            F.col("n").alias("production_action_count"), round_to(ratio("hits", "n"), 6).alias("production_hit_rate"),
            (F.col("n") - F.col("f")).alias("action_count"),
            round_to(ratio(F.col("hits") - F.col("fh"), F.col("n") - F.col("f")), 6).alias("hit_rate"),
            F.col("f").alias("filtered_count"), F.col("fh").alias("filtered_hit_count"),
        )
    )


PROFILE_FIELDS = {
    "market_odds": "pick_odds", "market_home_prob": "market_home_prob", "market_draw_prob": "market_draw_prob",
    "market_away_prob": "market_away_prob", "confidence_score": "confidence_score", "quality_score": "quality_score",
}


def feature_profiles(picks: DataFrame) -> DataFrame:
    """Numeric profiles (positive values only) of three segments of production actions."""
    segment = (
        F.when(_resonant(), "rescue_high_resonance").when(F.size("flags") > 0, "other_flagged").otherwise("clean")
    )
    entries = F.array(*[
        F.struct(F.lit(n).alias("field"), num(c).alias("value")) for n, c in PROFILE_FIELDS.items()
    ])
    rows = flags_of(picks).select(segment.alias("segment"), "hit", F.explode(entries).alias("e")).select(
        "segment", "hit", "e.field", "e.value"
    )
    v = F.when(F.col("value") > 0, F.col("value"))
    return rows.groupBy("segment", "field").agg(
        F.count(F.lit(1)).alias("action_count"), F.sum("hit").alias("hit_count"), F.count(v).alias("value_count"),
        F.coalesce(round_to(F.avg(v), 6), F.lit(0.0)).alias("avg_value"),
        F.coalesce(round_to(F.min(v), 6), F.lit(0.0)).alias("min_value"),
        F.coalesce(round_to(F.max(v), 6), F.lit(0.0)).alias("max_value"),
    )


def readiness(comparison: DataFrame, delta: DataFrame) -> DataFrame:
    """Is an observation layer ready to be considered for production?"""
    joined = comparison.filter(F.col("role") == "observation").join(
        delta.withColumnRenamed("layer", "variant"), "variant", "left"
    )
    periods, share = F.coalesce("filtered_period_count", F.lit(0)), num("max_period_filtered_share")
    status = (
        F.when((F.col("action_count") < 80) | (periods < 5), "needs_more_samples")
        .when(share >= 0.40, "needs_more_samples")
        .when(
            (num("miss_capture_rate") >= 0.80) & (num("hit_filter_rate") <= 0.05) & (F.col("hit_rate") >= 0.95),
            "candidate",
        )
        .otherwise("watch")
    )
    return joined.select(
        "variant", status.alias("status"), "action_count", "action_share", "hit_rate",
        periods.alias("filtered_period_count"), share.alias("max_period_filtered_share"),
        num("miss_capture_rate").alias("miss_capture_rate"), num("hit_filter_rate").alias("hit_filter_rate"),
    )


TARGET_LAYERS = (
    "base", "steady", "coverage_push", "coverage_stable", "coverage_refined", "coverage_value_guarded",
    "coverage_xg_guarded", "coverage_draw_rescue",
)


def coverage_targets(frame: DataFrame) -> DataFrame:
    """How far each layer is from the action-share and hit-rate targets."""
    hit, share = HANDICAP_TARGET["hit_rate"], HANDICAP_TARGET["action_share"]
    total = frame.filter(F.col("variant").isin(*TARGET_LAYERS)).groupBy("variant").agg(*stability._sums())
    required = F.ceil(F.col("samples") * share)
    return total.select(
        "variant", F.col("samples").alias("sample_count"), required.alias("required_actions"),
        F.col("actions").alias("action_count"), *stability.ratios(),
        F.greatest(required - F.col("actions"), F.lit(0)).alias("additional_needed"),
        ((F.col("actions") >= required) & (ratio("hits", "actions") >= hit)).alias("target_met"),
    )


def fill_candidates(picks: DataFrame) -> DataFrame:
    """Four ways to act on the base strategy's watch rows, best first.

    A row can fall into several candidates, so conditions are exploded; sample
    counts come from the same pass through an always-true entry.
    """
    watch = part("base", "outcome") == ""
    direction = F.col("s_direction")
    tests = {
        "legacy_home_margin_05_10": (
            (F.col("s_legacy_top") == "home") & between(F.col("s_legacy_margin"), 0.05, 0.10), F.lit("home")),
        "score_low_confidence": (direction.isin(*OUTCOMES) & (num("confidence_score") <= 0.82), direction),
        "market_home_prob_50": ((F.col("s_market_top") == "home") & (num("market_home_prob") >= 0.50), F.lit("home")),
        "market_home_odds_180_220": (
            (F.col("s_market_top") == "home") & between(num("market_odds_home"), 1.80, 2.20), F.lit("home")),
    }
    structs = []
    for key, (test, outcome) in tests.items():
        facts = strategies.settle_pick(strategies.make_pick(F.when(watch & test, outcome).otherwise(""), "standard", key))
        structs.append(F.struct(
            F.lit(key).alias("key"), facts["acted"].alias("acted"), facts["hit"].alias("hit"),
            facts["roi"].alias("roi"), facts["stake_units"].alias("stake_units"),
        ))
    rows = picks.select(F.explode(F.array(*structs)).alias("e")).select("e.*")
    total = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("acted").alias("actions"), F.sum("hit").alias("hits"),
        F.sum("roi").alias("roi"), F.sum("stake_units").alias("stake"),
    )
    hit = ratio("hits", "actions")
    place = F.row_number().over(
        Window.orderBy((hit >= HANDICAP_TARGET["hit_rate"]).desc(), F.col("actions").desc(), hit.desc(), "key")
    )
    return total.select(
        "key", place.cast("long").alias("place"), F.col("samples").alias("sample_count"),
        F.col("actions").alias("action_count"), *stability.ratios(),
        (hit >= HANDICAP_TARGET["hit_rate"]).alias("reaches_target"),
    )


def low_window(picks: DataFrame, strategy: str = "coverage_stable", width: int = 10) -> DataFrame:
    """Worst window by hit rate among windows that acted at all (earliest on ties)."""
    frame = stability.variant_periods(picks, [strategy])
    windows = stability.rolling(frame, width).filter(F.col("actions") > 0)
    return windows.agg(
        F.min_by(F.struct("start_period", "end_period", "actions", "hits", "hit_rate"), F.struct("hit_rate", "rank")).alias("w")
    ).filter("w is not null").select("w.*")


def low_window_breakdown(picks: DataFrame, field: str, limit: int = 8, strategy: str = "coverage_stable") -> DataFrame:
    """Breakdown of the actions inside the worst window; the window is one broadcast row."""
    bounds = low_window(picks, strategy).select(
        labels.period_key("start_period").alias("lo"), labels.period_key("end_period").alias("hi")
    )
    acted = strategies.actions_of(picks, strategy)
    key = labels.period_key("period")
    inside = acted.join(F.broadcast(bounds), (key >= F.col("lo")) & (key <= F.col("hi")))
    return breakdown(inside, field, limit)
