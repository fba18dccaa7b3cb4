"""Labels, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ACTION_ALIASES, ACTIONS
from .numeric import col, num, text


def action_label(value: Column | str) -> Column:
    """Canonical action: first word, case-insensitive, aliases resolved, blank = watch.

    Set membership instead of a map or regex: this sits in the hottest
    projections and is referenced several times per row.
    """
    word = F.lower(F.substring_index(F.trim(text(value)), " ", 1))
    spelled = {a: [w for w, canon in ACTION_ALIASES.items() if canon == a] for a in ACTIONS}
    return (
        F.when(word.isin("", *spelled["watch"]), "watch")
        .when(word.isin(*spelled["light"]), "light")
        .when(word.isin(*spelled["main"]), "main")
        .otherwise(word)
    )


def action_level(action: Column) -> Column:
    return F.when(action == "main", 2).when(action == "light", 1).otherwise(0)


def step_up(current: Column, target: Column) -> Column:
    """One step towards a higher target, never past it."""
    return (
        F.when((current == "watch") & target.isin("light", "main"), "light")
        .when((current == "light") & (target == "main"), "main")
        .otherwise(current)
    )


def step_down(current: Column, target: Column) -> Column:
    """One step towards a lower target, never past it."""
    return (
        F.when((current == "main") & target.isin("watch", "light"), "light")
        .when((current == "light") & (target == "watch"), "watch")
        .otherwise(current)
    )


def effective_action(action="recommendation", stake="suggested_stake_pct") -> tuple[Column, Column]:
    """Action and stake that were really executable for a run."""
    stored = F.trim(text("effective_recommendation"))
    blocked = text("manual_review_status").isin("pending", "expired", "superseded")
    chosen = (
        F.when(stored != "", action_label(stored)).when(blocked, "watch").otherwise(action_label(action))
    )
    pct = F.when(stored != "", num("effective_stake_pct")).when(blocked, 0.0).otherwise(num(stake))
    return chosen, pct


def score_goals(score: Column | str) -> tuple[Column, Column]:
    """First two integers of a score text; null when fewer than two."""
    numbers = F.regexp_extract_all(text(score), F.lit(r"(\d+)"), F.lit(1))
    return F.try_element_at(numbers, F.lit(1)).try_cast("int"), F.try_element_at(numbers, F.lit(2)).try_cast("int")


def score_direction(score: Column | str) -> Column:
    home, away = score_goals(score)
    return (
        F.when(home.isNull() | away.isNull(), "")
        .when(home > away, "home")
        .when(home == away, "draw")
        .otherwise("away")
    )


def handicap_result(score: Column | str, line: Column) -> Column:
    home, away = score_goals(score)
    adjusted = (home - away).cast("double") + line
    return (
        F.when(home.isNull() | away.isNull(), "")
        .when(adjusted > 0, "home")
        .when(adjusted < 0, "away")
        .otherwise("push")
    )


def odds_band(odds: Column) -> Column:
    return (
        F.when(odds <= 0, "unknown").when(odds < 1.60, "<1.60").when(odds < 2.00, "1.60-1.99")
        .when(odds < 2.50, "2.00-2.49").when(odds < 3.00, "2.50-2.99").otherwise(">=3.00")
    )


def confidence_band(value: Column) -> Column:
    return (
        F.when(value < 0.70, "<0.70").when(value < 0.80, "0.70-0.79").when(value < 0.90, "0.80-0.89")
        .otherwise(">=0.90")
    )


def score_alignment(outcome: Column, direction: Column) -> Column:
    return (
        F.when(direction == "", "score_missing").when(outcome == direction, "score_aligned")
        .otherwise("score_conflict")
    )


def review_bucket(status="review_status", decision="review_decision") -> Column:
    s, d = text(status), text(decision)
    return (
        F.when(s == "failed", "failed").when((s == "skipped") | d.isin("abstain", ""), "skipped").otherwise(d)
    )


def risk_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.78, "low").when(confidence >= 0.62, "medium").when(confidence >= 0.48, "high")
        .otherwise("very_high")
    )


def period_key(period: Column | str) -> Column:
    """Periods sort by their number first (0 when not numeric), then by text."""
    p = text(period)
    return F.struct(F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("n"), p.alias("t"))


def decimal_odds(odds: Column) -> Column:
    """Quotes below 1.5 are net odds; add the stake back."""
    return F.when((odds > 0) & (odds < 1.5), odds + 1.0).otherwise(odds)
