"""Three-way probability expressions.

A triple is a dict of Columns keyed home/draw/away; it never becomes a map at
run time, so the optimiser sees plain doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import EPSILON, OUTCOMES
from .numeric import clamp, num

Triple = dict[str, Column]


def triple(prefix: str, suffix: str = "_prob") -> Triple:
    return {o: num(f"{prefix}_{o}{suffix}") for o in OUTCOMES}


def market_odds() -> Triple:
    return {o: num(f"market_odds_{o}") for o in OUTCOMES}


def total(values: Triple) -> Column:
    return values["home"] + values["draw"] + values["away"]


def normalise(values: Triple, floor: float = 0.001) -> Triple:
    floored = {o: F.greatest(v, F.lit(floor)) for o, v in values.items()}
    s = total(floored)
    return {o: v / s for o, v in floored.items()}


def argmax(values: Triple) -> Column:
    """Ties resolve home, then draw, then away."""
    h, d, a = (values[o] for o in OUTCOMES)
    return F.when((h >= d) & (h >= a), "home").when(d >= a, "draw").otherwise("away")


def margin(values: Triple) -> Column:
    """Distance between the best and the second best value."""
    h, d, a = (values[o] for o in OUTCOMES)
    return F.greatest(h, d, a) - F.greatest(F.least(h, d), F.least(F.greatest(h, d), a))


def pick(values: Triple, outcome: Column) -> Column:
    return (
        F.when(outcome == "home", values["home"])
        .when(outcome == "draw", values["draw"])
        .when(outcome == "away", values["away"])
        .otherwise(F.lit(0.0))
    )


def margin_of(values: Triple, outcome: Column) -> Column:
    """The chosen value minus the best of the other two."""
    h, d, a = (values[o] for o in OUTCOMES)
    return (
        F.when(outcome == "home", h - F.greatest(d, a))
        .when(outcome == "draw", d - F.greatest(h, a))
        .otherwise(a - F.greatest(h, d))
    )


def implied_by_odds(odds: Triple) -> Triple:
    inverse = {o: F.when(v > 0, 1.0 / F.when(v > 0, v)).otherwise(0.0) for o, v in odds.items()}
    s = total(inverse)
    return {o: F.when(s > 0, v / F.when(s > 0, s)).otherwise(1.0 / 3.0) for o, v in inverse.items()}


def effective_market(market: Triple, odds: Triple) -> Triple:
    """Stored market probabilities when present, else those implied by the odds."""
    floored = {o: F.greatest(v, F.lit(0.0)) for o, v in market.items()}
    s = total(floored)
    usable = (total(market) > 0) & (s > 0)
    implied = implied_by_odds(odds)
    return {o: F.when(usable, floored[o] / F.when(s > 0, s)).otherwise(implied[o]) for o in OUTCOMES}


def expected_values(probs: Triple, odds: Triple) -> Triple:
    return {o: F.when(odds[o] > 0, probs[o] * odds[o] - 1.0).otherwise(-1.0) for o in OUTCOMES}


def brier(probs: Triple, actual: Column) -> Column:
    terms = [(probs[o] - F.when(actual == o, 1.0).otherwise(0.0)) for o in OUTCOMES]
    return (terms[0] * terms[0] + terms[1] * terms[1] + terms[2] * terms[2]) / 3.0


def log_loss(probs: Triple, actual: Column) -> Column:
    chosen = F.when(actual == "draw", probs["draw"]).when(actual == "away", probs["away"]).otherwise(probs["home"])
    return -F.log(F.greatest(chosen, F.lit(EPSILON)))


def log_scores(probs: Triple) -> Triple:
    """Logarithms of the floored, normalised probabilities."""
    return {o: F.log(F.greatest(v, F.lit(EPSILON))) for o, v in normalise(probs, EPSILON).items()}


def soften(logs: Triple, temperature: Column, biases: Triple) -> Triple:
    """Temperature and bias softmax over ``log_scores``."""
    t = F.greatest(temperature, F.lit(0.35))
    scores = {o: (logs[o] + biases[o]) / t for o in OUTCOMES}
    top = F.greatest(*scores.values())
    exps = {o: F.exp(s - top) for o, s in scores.items()}
    s = total(exps)
    return {o: e / s for o, e in exps.items()}


def calibrate(probs: Triple, temperature: Column, biases: Triple) -> Triple:
    """Temperature and bias softmax over floored, normalised probabilities."""
    return soften(log_scores(probs), temperature, biases)


def poisson(rate: Column, goals: int) -> Column:
    factorial = 1
    for i in range(2, goals + 1):
        factorial *= i
    return F.exp(-rate) * F.pow(rate, F.lit(float(goals))) / float(factorial)


def prior_weight(quality: Column, agreement: Column) -> Column:
    """Share of the model blend against the market prior."""
    return clamp(
        F.lit(0.35) * clamp((quality - 0.55) / 0.30, 0.3, 1.1) * clamp((agreement - 0.55) / 0.30, 0.4, 1.0),
        0.10,
        0.55,
    )
