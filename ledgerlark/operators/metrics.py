"""Back-test metrics over the wide frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import OUTCOMES
from ..functions import labels, policy, probs
from ..functions.numeric import num, ratio, round_to, text

FAMILIES = {"market": "market", "legacy": "legacy", "independent": "final"}


def recommended(triple: probs.Triple, outcome="recommended_outcome") -> Column:
    return probs.pick(triple, text(outcome))


def backtest_filter(
    df: DataFrame, *, league="", month="", odds_min=None, odds_max=None, confidence_min=None, ev_min=None, limit=None
) -> DataFrame:
    """The back-test filter set; every test is a plain predicate the scan can take."""
    odds = recommended(probs.market_odds())
    ev = recommended({o: num(f"ev_{o}") for o in OUTCOMES})
    tests = []
    if league:
        tests.append(F.col("league") == league)
    if month:
        tests.append(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").startswith(month))
    if odds_min is not None:
        tests.append(odds >= odds_min)
    if odds_max is not None:
        tests.append(odds <= odds_max)
    if confidence_min is not None:
        tests.append(num("confidence_score") >= confidence_min)
    if ev_min is not None:
        tests.append(ev >= ev_min)
    for test in tests:
        df = df.filter(test)
    return df if limit is None else df.orderBy(F.col("feedback_id").desc()).limit(limit)


def roi(action: Column, outcome: Column, stake: Column) -> Column:
    """Return of one action: stake x (odds - 1), minus the stake, or 0."""
    odds = probs.pick(probs.market_odds(), outcome)
    units = stake / 100.0
    hit = outcome == F.col("actual_result")
    return (
        F.when((action == "watch") | (stake <= 0), 0.0)
        .when(hit & (odds > 0), round_to(units * (odds - 1.0), 4))
        .when(hit, 0.0)
        .otherwise(round_to(-units, 4))
    )


def handicap_settlement(score: str = "actual_score") -> dict[str, Column]:
    """Handicap result, hit and return of a run against a score."""
    action, side, line = text("handicap_recommendation"), text("handicap_recommended_side"), num("handicap_line")
    result = labels.handicap_result(score, line)
    suggested = num("suggested_stake_pct")
    eff_action, eff_stake = labels.effective_action()
    stake = F.when(suggested > 0, suggested).when(eff_action == "watch", 0.0).otherwise(eff_stake)
    units = stake / 100.0
    playable = (action != "watch") & side.isin("home", "away") & result.isin("home", "away")
    hit = playable & (side == result)
    odds = labels.decimal_odds(F.when(side == "home", num("handicap_home_odds")).otherwise(num("handicap_away_odds")))
    value = (
        F.when(~playable, 0.0).when(hit & (odds > 0), round_to(units * (odds - 1.0), 4))
        .otherwise(round_to(-units, 4))
    )
    return {
        "handicap_actual_result": result,
        "handicap_hit": hit.cast("int"),
        "handicap_roi_delta": value,
    }


def with_settlement(df: DataFrame) -> DataFrame:
    """Adds the settlement columns a feedback row stores."""
    action, stake = labels.effective_action()
    outcome = text("recommended_outcome")
    return df.withColumns(
        {
            "effective_action": action,
            "effective_stake": stake,
            "hit_recommendation": (outcome == F.col("actual_result")).cast("int"),
            "roi_delta": roi(action, outcome, stake),
            **handicap_settlement(),
        }
    )


def feedback_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, hits and returns, and the same on rows with a handicap action."""
    acted = (
        (text("handicap_recommendation") != "watch")
        & text("handicap_recommended_side").isin("home", "away")
        & text("handicap_actual_result").isin("home", "away", "push")
    )
    agg = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(F.sum("hit_recommendation"), F.lit(0)).alias("hit_predictions"),
        F.coalesce(F.sum("roi_delta"), F.lit(0.0)).alias("roi"),
        F.count_if(acted).alias("handicap_total_predictions"),
        F.count_if(acted & (F.col("handicap_hit") == 1)).alias("handicap_hit_predictions"),
        F.coalesce(F.sum(F.when(acted, F.col("handicap_roi_delta"))), F.lit(0.0)).alias("h_roi"),
    )
    n, h = F.col("total_predictions"), F.col("handicap_total_predictions")
    return agg.select(
        *(by or []), n, "hit_predictions", (n - F.col("hit_predictions")).alias("miss_predictions"),
        round_to(ratio("hit_predictions", n), 6).alias("hit_rate"),
        round_to(F.col("roi"), 6).alias("total_roi"), round_to(ratio("roi", n), 6).alias("avg_roi"),
        h, "handicap_hit_predictions", (h - F.col("handicap_hit_predictions")).alias("handicap_miss_predictions"),
        round_to(ratio("handicap_hit_predictions", h), 6).alias("handicap_hit_rate"),
        round_to(F.col("h_roi"), 6).alias("handicap_total_roi"),
        round_to(ratio("h_roi", h), 6).alias("handicap_avg_roi"),
    )


def model_scores(df: DataFrame, by: list[str] | None = None, families=None) -> DataFrame:
    """Brier, log loss and hit rate of every model family in one pass."""
    by = by or []
    actual = F.col("actual_result")
    entries = []
    for name, prefix in (families or FAMILIES).items():
        p = probs.triple(prefix)
        entries.append(F.struct(
            F.lit(name).alias("model"), probs.brier(p, actual).alias("brier"), probs.log_loss(p, actual).alias("log_loss"),
            (probs.argmax(p) == actual).cast("int").alias("hit"),
        ))
    rows = df.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")
    return rows.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("sample_count"),
        round_to(F.avg("brier"), 6).alias("brier_score"),
        round_to(F.avg("log_loss"), 6).alias("log_loss"),
        round_to(F.avg("hit"), 6).alias("hit_rate"),
    )


def action_metrics(
    df: DataFrame, action: Column, outcome: Column, stake: Column, *, value: Column | None = None,
    acted: Column | None = None, by: list[str] | None = None
) -> DataFrame:
    """Count, hit rate, return and stake of one family of actions, optionally per group."""
    by = by or []
    acted = (action != "watch") if acted is None else acted
    value = roi(action, outcome, stake) if value is None else value
    agg = df.select(
        *by, acted.alias("a"), (acted & (outcome == F.col("actual_result"))).alias("h"),
        F.when(acted, value).otherwise(0.0).alias("r"), F.when(acted, stake).otherwise(0.0).alias("s"),
    ).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("a").alias("action_count"), F.count_if("h").alias("hits"),
        F.coalesce(F.sum("r"), F.lit(0.0)).alias("r"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"),
    )
    return agg.select(
        *by, "sample_count", "action_count", round_to(ratio("hits", "action_count"), 6).alias("hit_rate"),
        round_to(F.col("r"), 6).alias("total_roi"), round_to(ratio("r", "action_count"), 6).alias("avg_roi"),
        round_to(ratio("s", "action_count"), 6).alias("avg_stake_pct"),
    )


def algorithm_metrics(df: DataFrame, by=None) -> DataFrame:
    return action_metrics(
        df, labels.action_label("algo_recommendation"), text("algo_recommended_outcome"), num("algo_suggested_stake_pct"), by=by
    )


def executed_metrics(df: DataFrame, by=None) -> DataFrame:
    """Only what could really be executed: effective action with a positive stake."""
    action, stake = labels.effective_action()
    return action_metrics(
        df, action, text("recommended_outcome"), stake, value=F.col("roi_delta"),
        acted=(action != "watch") & (stake > 0), by=by,
    )


def review_metrics(df: DataFrame) -> DataFrame:
    """Final actions per stored-review bucket, with their stored return."""
    bucketed = df.withColumn("review_bucket", labels.review_bucket())
    return action_metrics(
        bucketed, labels.action_label("recommendation"), text("recommended_outcome"), num("suggested_stake_pct"),
        value=F.col("roi_delta"), by=["review_bucket"],
    )


def current_policy_rows(df: DataFrame, gates: policy.Gates | None = None) -> DataFrame:
    """Replay the current policy on stored probabilities, lowered by stored reviews."""
    market = probs.effective_market(probs.triple("market"), probs.market_odds())
    staged = policy.action_policy(df, policy.stored_probabilities(), gates, selected=probs.argmax(market))
    staged = policy.review_targets(staged)
    action = policy.review_gate(F.col("policy_action"), F.col("favourite_guard"))
    staged = staged.withColumn("replay_action", action)
    stake = F.when(F.col("replay_action") == "watch", 0.0).otherwise(F.col("policy_stake"))
    return policy.drop_working(staged.withColumn("replay_stake", stake))


def current_policy_metrics(df: DataFrame) -> DataFrame:
    """Replay totals and buckets per (action, outcome): one rollup."""
    a, o, s = F.col("replay_action"), F.col("policy_outcome"), F.col("replay_stake")
    acted = (a != "watch") & (s > 0)
    units = s / 100.0
    odds = probs.pick(probs.market_odds(), o)
    hit = o == F.col("actual_result")
    value = F.when(hit & (odds > 0), round_to(units * (odds - 1.0), 4)).otherwise(round_to(-units, 4))
    rows = current_policy_rows(df).select(
        a.alias("action"), o.alias("outcome"), acted.cast("int").alias("acted"), (acted & hit).cast("int").alias("hit"),
        F.when(acted, value).otherwise(0.0).alias("roi"), F.when(acted, s).otherwise(0.0).alias("stake"),
    )
    agg = rows.groupingSets([[], [F.col("action"), F.col("outcome")]], F.col("action"), F.col("outcome")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("acted").alias("action_count"), F.sum("hit").alias("hits"),
        F.sum("roi").alias("r"), F.sum("stake").alias("s"),
    )
    return agg.select(
        F.coalesce("action", F.lit("all")).alias("action"), F.coalesce("outcome", F.lit("all")).alias("outcome"),
        "sample_count", "action_count", round_to(ratio("hits", "action_count"), 6).alias("hit_rate"),
        round_to(F.col("r"), 4).alias("total_roi"), round_to(ratio("r", "action_count"), 6).alias("avg_roi"),
        round_to(ratio("s", "action_count"), 6).alias("avg_stake_pct"),
    )


def positive_ev_share(df: DataFrame) -> DataFrame:
    ev = recommended({o: num(f"ev_{o}") for o in OUTCOMES})
    return df.agg(
        F.count(F.lit(1)).alias("total_settled"), round_to(F.avg((ev > 0).cast("int")), 6).alias("positive_ev_share")
    )


def report(df: DataFrame) -> DataFrame:
    """The root back-test report as long rows (section, name, metric, value).

    Sections with the same shape are aggregated together; each is one scan of
    the filtered wide frame.
    """
    def long(frame: DataFrame, section: str, name: Column, metrics: list[str]) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
        ])
        return frame.select(F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("p")).select(
            "section", "name", "p.metric", "p.value"
        )

    action = ["action_count", "hit_rate", "total_roi", "avg_roi", "avg_stake_pct"]
    parts = [
        long(model_scores(df), "model", F.col("model"), ["brier_score", "log_loss", "hit_rate"]),
        long(algorithm_metrics(df), "actions", F.lit("algorithm"), action),
        long(executed_metrics(df), "actions", F.lit("final"), action),
        long(current_policy_metrics(df).filter("action = 'all'"), "actions", F.lit("current_policy"), action),
        long(review_metrics(df), "review", F.col("review_bucket"), ["sample_count", *action]),
        long(positive_ev_share(df), "share", F.lit("positive_ev"), ["total_settled", "positive_ev_share"]),
    ]
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result


def sample_summary(df: DataFrame) -> DataFrame:
    """Ranges, class counts and actionable count of a learning window, per split."""
    action, stake = labels.effective_action()
    order = F.struct("created_at", "run_id")
    return df.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min_by("period", order).alias("first_period"), F.max_by("period", order).alias("last_period"),
        F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("first_created_at"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_created_at"),
        *[F.count_if(F.col("actual_result") == o).alias(f"{o}_count") for o in OUTCOMES],
        F.count_if((action != "watch") & (stake > 0)).alias("actionable_samples"),
    )


def review_signals(df: DataFrame) -> DataFrame:
    """Counts and shares of stored review states."""
    s, d, a, ad, src = (
        text("review_status"), text("review_decision"), text("arbiter_status"), text("arbiter_decision"),
        text("effective_action_source"),
    )
    counts = {
        "review_completed": s == "completed", "review_keep": d == "keep", "review_downgrade": d == "downgrade",
        "review_abstain": d == "abstain", "arbiter_completed": a == "completed",
        "arbiter_actioned": ad.isin("allow", "downgrade", "skip", "manual_review"),
        "expert_source": src == "expert_llm", "arbiter_source": src == "arbiter",
    }
    agg = df.agg(F.count(F.lit(1)).alias("sample_count"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    shares = ("review_completed", "arbiter_completed", "expert_source", "arbiter_source")
    return agg.select(
        "*", *[round_to(ratio(c, "sample_count"), 6).alias(f"{c}_share") for c in shares]
    )


def period_actions(df: DataFrame) -> DataFrame:
    """Actionable and watch counts per period for main and handicap actions."""
    action, stake = labels.effective_action()
    raw = F.when(F.trim(text("effective_recommendation")) != "", action).otherwise(labels.action_label("recommendation"))
    pct = F.when(F.trim(text("effective_recommendation")) != "", stake).otherwise(num("suggested_stake_pct"))
    main = (raw != "watch") & (pct > 0) & text("recommended_outcome").isin(*OUTCOMES)
    handicap = (labels.action_label("handicap_recommendation") != "watch") & text("handicap_recommended_side").isin(
        "home", "away"
    )
    n = F.count(F.lit(1))
    return df.groupBy("period").agg(
        n.alias("sample_count"), F.count_if(main).alias("main_action_count"),
        (n - F.count_if(main)).alias("main_watch_count"), F.count_if(handicap).alias("handicap_action_count"),
        (n - F.count_if(handicap)).alias("handicap_watch_count"),
    )
