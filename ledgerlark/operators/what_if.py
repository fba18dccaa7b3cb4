"""What a different weight of the market prior would have scored on stored forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import probs
from ..functions.numeric import num, ratio, round_to

#: Shares of the model that are tried for all rows alike.
ALPHAS = tuple(round(i / 20, 2) for i in range(21))


def _hit(p: probs.Triple) -> Column:
    return (probs.argmax(p) == F.col("actual_result")).cast("int")


def shrinkage_what_if(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(variant, alpha, samples, brier_score, log_loss, hit_rate) from one aggregate over the settled rows.

    Variants: ``final`` and ``market`` as stored, ``blended`` with each row's own prior weight (alpha is their mean),
    and ``constant`` for every alpha.  With a constant alpha the squared error of a row is a quadratic in alpha, so
    three sums give the Brier score of all alphas; log loss and hits are summed per alpha.  Rows without market
    probabilities are left out; results other than the three outcomes count as home.
    """
    stored, quoted = probs.triple("final"), probs.triple("market")
    rows = rows.where(" and ".join(f"market_{o}_prob > 0" for o in V.OUTCOMES)).withColumn(
        "actual_result", F.when(F.col("actual_result").isin(*V.OUTCOMES), F.col("actual_result")).otherwise("home")
    )
    share = lambda t: {o: v / F.when(probs.total(t) > 0, probs.total(t)).otherwise(1.0) for o, v in t.items()}
    rows = rows.withColumns({"_alpha": probs.prior_weight(num("quality_score"), num("model_agreement"))} | {f"_f_{o}": v for o, v in share(stored).items()} | {f"_m_{o}": v for o, v in share(quoted).items()})
    final, market = ({o: F.col(f"_{k}_{o}") for o in V.OUTCOMES} for k in "fm")
    mixed = {o: F.col("_alpha") * stored[o] + (1.0 - F.col("_alpha")) * quoted[o] for o in V.OUTCOMES}
    total = probs.total(mixed)
    rows = rows.withColumns({f"_b_{o}": F.when(total > 0, mixed[o] / F.when(total > 0, total)).otherwise(quoted[o]) for o in V.OUTCOMES})
    blended = {o: F.col(f"_b_{o}") for o in V.OUTCOMES}
    truth = {o: F.when(F.col("actual_result") == o, 1.0).otherwise(0.0) for o in V.OUTCOMES}
    gap = {o: final[o] - market[o] for o in V.OUTCOMES}
    miss = {o: market[o] - truth[o] for o in V.OUTCOMES}
    dot = lambda a, b: probs.total({o: a[o] * b[o] for o in V.OUTCOMES}) / 3.0
    sums = {"n": F.count(F.lit(1)), "alpha": F.sum("_alpha"), "s0": F.sum(dot(miss, miss)), "s1": F.sum(dot(miss, gap)), "s2": F.sum(dot(gap, gap))}
    for name, p in (("final", stored), ("market", quoted), ("blended", blended)):
        sums |= {f"{name}_b": F.sum(probs.brier(p, F.col("actual_result"))), f"{name}_l": F.sum(probs.log_loss(p, F.col("actual_result"))), f"{name}_h": F.sum(_hit(p))}
    for i, a in enumerate(alphas):
        p = {o: a * final[o] + (1.0 - a) * market[o] for o in V.OUTCOMES}
        sums |= {f"l{i}": F.sum(probs.log_loss(p, F.col("actual_result"))), f"h{i}": F.sum(_hit(p))}
    one = rows.agg(*[c.alias(n) for n, c in sums.items()])
    c = F.col
    entry = lambda variant, alpha, b, ll, h: F.struct(F.lit(variant).alias("variant"), alpha.cast("double").alias("alpha"), b.alias("b"), ll.alias("l"), h.alias("h"))
    entries = [entry("final", F.lit(1.0), c("final_b"), c("final_l"), c("final_h")), entry("market", F.lit(0.0), c("market_b"), c("market_l"), c("market_h")),
               entry("blended", ratio("alpha", "n"), c("blended_b"), c("blended_l"), c("blended_h"))]
    entries += [entry("constant", F.lit(a), c("s0") + 2.0 * a * c("s1") + a * a * c("s2"), c(f"l{i}"), c(f"h{i}")) for i, a in enumerate(alphas)]
    rate = lambda name: round_to(ratio(f"e.{name}", "n"), 6)
    return one.select("n", F.explode(F.array(*entries)).alias("e")).where("n > 0").select(
        "e.variant", round_to("e.alpha", 6).alias("alpha"), c("n").alias("samples"), rate("b").alias("brier_score"), rate("l").alias("log_loss"), rate("h").alias("hit_rate"),
    )


def best_constant(what_if: DataFrame) -> DataFrame:
    """The constant alpha of least Brier score, the smaller of equals, and what it gains over the stored forecasts."""
    row = F.struct("brier_score", "alpha", "log_loss", "hit_rate")
    both = what_if.agg(F.min(F.when(F.col("variant") == "constant", row)).alias("b"), F.max(F.when(F.col("variant") == "final", F.col("brier_score"))).alias("stored"))
    return both.where("b is not null").select(
        "b.alpha", "b.brier_score", "b.log_loss", "b.hit_rate", F.col("stored").alias("stored_brier_score"), round_to(ratio(F.col("stored") - F.col("b.brier_score"), "stored"), 4).alias("gain"),
    )
