"""Policy learning: calibration, gate search, rule grids, bucket tables, walk-forward.

Rule grids never meet rows.  Every threshold comes from a short list, so rows
collapse to cells (one per combination of threshold indices); a grid over
ordered thresholds is then a cumulative sum over the cells, taken one group of
dimensions at a time.  The cost after the first aggregate depends on the grid,
not on the data.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels, policy, probs
from ..functions.numeric import clamp, floor_bin, num, ratio, round_to, text, text_num, threshold_index

# --- windows and splits -------------------------------------------------------


def period_axis(df: DataFrame, last: int | None = None) -> DataFrame:
    """Distinct periods with their rank, oldest first; optionally only the last few."""
    axis = df.filter("period <> ''").select("period").distinct()
    if last is not None:
        axis = axis.orderBy(labels.period_key("period").desc()).limit(last)
    return axis.withColumn("period_rank", F.row_number().over(Window.orderBy(labels.period_key("period"))))


def learning_window(df: DataFrame, last: int | None = None) -> DataFrame:
    """Rows of all periods, or of the last ``last`` ones, with period_rank and the latest-period hold-out flag.

    The axis has one row per period and is broadcast: a plain join shuffles all rows by period before its size is known.
    """
    axis = period_axis(df, last)
    top = Window.partitionBy()
    axis = axis.withColumn("is_validation", (F.col("period_rank") == F.max("period_rank").over(top)) & (F.max("period_rank").over(top) > 1))
    return df.join(F.broadcast(axis), "period")


# --- calibration ---------------------------------------------------------------


def class_stats(rows: DataFrame):
    """Train rows in all and per result, and the mean probabilities of the classes: one row, one pass."""
    raw = probs.normalise(probs.triple("final"), V.EPSILON)
    actual = F.col("actual_result")
    return rows.filter(~F.col("is_validation")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(raw[o]).alias(f"p_{o}") for o in V.OUTCOMES],
        *[F.avg((actual == o).cast("int")).alias(f"e_{o}") for o in V.OUTCOMES],
        *[F.count_if(actual == o).alias(o) for o in V.OUTCOMES],
    ).first()


def calibration_grid(rows: DataFrame, stats=None) -> DataFrame:
    """Log loss, Brier and hit rate of every (bias scale, temperature) on both splits.

    The class means are one row (``stats``, as ``class_stats`` returns it); the grid is 30 constants exploded in front of
    a partial aggregate.  Logarithms are taken once per row, in front of the explode.
    """
    stats = stats or class_stats(rows)
    base = {
        o: math.log(max(stats[f"e_{o}"] or 0.0, V.EPSILON) / max(stats[f"p_{o}"] or 0.0, V.EPSILON)) for o in V.OUTCOMES
    }
    mean = sum(base.values()) / 3.0
    grid = F.array(*[
        F.struct(
            F.lit(i).alias("grid_id"), F.lit(scale).alias("bias_scale"), F.lit(temperature).alias("temperature"),
            *[F.lit((base[o] - mean) * scale).alias(f"b_{o}") for o in V.OUTCOMES],
        )
        for i, (scale, temperature) in enumerate(product(V.BIAS_SCALES, V.TEMPERATURES))
    ])
    logs = probs.log_scores(probs.triple("final"))
    exploded = rows.select("is_validation", "actual_result", *[c.alias(f"_l_{o}") for o, c in logs.items()]).select("*", F.explode(grid).alias("g"))
    p = probs.soften({o: F.col(f"_l_{o}") for o in V.OUTCOMES}, F.col("g.temperature"), {o: F.col(f"g.b_{o}") for o in V.OUTCOMES})
    scored = exploded.select("is_validation", "actual_result", "g.grid_id", "g.bias_scale", "g.temperature", *[p[o].alias(o) for o in V.OUTCOMES])
    q = {o: F.col(o) for o in V.OUTCOMES}
    actual = F.col("actual_result")
    facts = scored.select(
        "grid_id", "bias_scale", "temperature", "is_validation", probs.log_loss(q, actual).alias("ll"),
        probs.brier(q, actual).alias("br"), (probs.argmax(q) == actual).cast("int").alias("hit"),
    )
    on = lambda flag, c: F.avg(F.when(flag, F.col(c)))
    val = F.col("is_validation")
    return facts.groupBy("grid_id", "bias_scale", "temperature").agg(
        F.count_if(~val).alias("train_samples"), F.count_if(val).alias("validation_samples"),
        *[round_to(on(flag, c), 6).alias(f"{split}_{name}")
          for split, flag in (("train", ~val), ("validation", val))
          for c, name in (("ll", "log_loss"), ("br", "brier_score"), ("hit", "hit_rate"))],
    )


def fit_calibrator(rows: DataFrame) -> DataFrame:
    """Best grid point on train, accepted only if validation improves; one row with its status."""
    classes = class_stats(rows)
    grid = calibration_grid(rows, classes)
    enough = classes["n"] >= V.CALIBRATION_MIN_ROWS and min(classes[o] for o in V.OUTCOMES) >= V.CALIBRATION_MIN_CLASS_ROWS
    # Grid point 2 is (scale 0, temperature 1): the uncalibrated baseline.
    baseline = V.TEMPERATURES.index(1.0)
    picked = grid.agg(
        F.min_by(F.struct(*grid.columns), F.struct("train_log_loss", "grid_id")).alias("c"),
        F.min_by(F.struct(*grid.columns), F.when(F.col("grid_id") == baseline, 0).otherwise(1)).alias("b"),
    )
    gain = (F.col("c.validation_log_loss") + 1e-9 < F.col("b.validation_log_loss")) & (
        F.col("c.validation_brier_score") <= F.col("b.validation_brier_score") + 1e-9
    )
    status = (
        F.lit("insufficient_samples") if not enough
        else F.when(F.col("c.validation_samples") == 0, "insufficient_samples").when(gain, "ready").otherwise("no_gain")
    )
    return picked.select(
        status.alias("status"), F.col("c.bias_scale").alias("bias_scale"), F.col("c.temperature").alias("temperature"),
        F.col("c.train_log_loss").alias("train_log_loss"), F.col("b.train_log_loss").alias("baseline_train_log_loss"),
        F.col("c.validation_log_loss").alias("validation_log_loss"),
        F.col("b.validation_log_loss").alias("baseline_validation_log_loss"),
    )


# --- shared scoring --------------------------------------------------------------


def grid_metrics(df: DataFrame, prefix: str, samples: Column) -> dict[str, Column]:
    n = lambda c: F.col(f"{prefix}_{c}")
    return {
        f"{prefix}_samples": samples,
        f"{prefix}_hit_rate": ratio(n("hits"), n("actions")),
        f"{prefix}_action_share": ratio(n("actions"), samples),
        f"{prefix}_total_roi": round_to(n("roi"), 4),
    }


def rule_score(prefix: str = "validation") -> Column:
    """Closeness to the default targets first, then hit rate, share and return."""
    hit, share = F.col(f"{prefix}_hit_rate"), F.col(f"{prefix}_action_share")
    gap = (
        F.greatest(V.OUTCOME_TARGET["hit_rate"] - hit, F.lit(0.0)) * 2.0
        + F.greatest(V.OUTCOME_TARGET["action_share"] - share, F.lit(0.0))
    )
    return F.struct((-gap).alias("gap"), hit, share, F.col(f"{prefix}_total_roi"))


def target_status(target: dict, prefix: str = "validation") -> Column:
    n = lambda c: F.col(f"{prefix}_{c}")
    return (
        F.when(n("samples") < V.RULE_MIN_VALIDATION_ROWS, "insufficient_samples")
        .when(n("actions") <= 0, "target_unreachable")
        .when((n("hit_rate") >= target["hit_rate"]) & (n("action_share") >= target["action_share"]), "ready")
        .otherwise("target_unreachable")
    )


def frontier(rules: DataFrame, target: dict) -> DataFrame:
    """Best ready, best overall, best hit, best share and best covered rule; first rule wins ties.

    Rules need the train-action floor; the winner is chosen by validation, as
    the ledger's trainer does, so read it as optimistic.
    """
    usable = rules.filter(F.col("train_actions") >= V.RULE_MIN_TRAIN_ROWS).withColumn("status", target_status(target))
    first = -F.col("rule_id")
    hit, share, roi = (F.col(f"validation_{c}") for c in ("hit_rate", "action_share", "total_roi"))
    row = F.struct(*usable.columns)
    best = lambda cond, *order: F.max_by(row, F.when(cond, F.struct(*order, first)))
    always = F.lit(True)
    picks = {
        "best_ready": best(F.col("status") == "ready", rule_score()),
        "best_candidate": best(always, rule_score()),
        "best_hit": best(always, hit, share, roi),
        "best_action": best(always, share, hit, roi),
        "best_covered": best(share > target["action_share"], hit, share, roi),
    }
    one = usable.agg(*[c.alias(n) for n, c in picks.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("r")) for n in picks])
    return one.select(F.explode(entries).alias("e")).filter("e.r is not null").select("e.pick", "e.r.*")


def _expand(cells: DataFrame, keys: list[str], groups: list[dict[str, Column]], sums: list[str]) -> DataFrame:
    """Cumulative cube: replace each index by every threshold index it reaches, group by group."""
    done: list[str] = []
    for i, group in enumerate(groups):
        later = [c for g in groups[i + 1:] for c in g]
        for name, reached in group.items():
            cells = cells.withColumn(name, F.explode(reached))
        done += list(group)
        cells = cells.groupBy(*keys, *done, *later).agg(*[F.sum(s).alias(s) for s in sums])
    return cells


def _reach(name: str) -> Column:
    """Threshold positions 0..index-1 reached by an index; empty when none is."""
    return F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))


def _rule_id(names: list[str], sizes: list[int]) -> Column:
    value = F.lit(0)
    for name, size in zip(names, sizes):
        value = value * size + F.col(name)
    return value.cast("long")


def _cap_index(value: Column, caps) -> Column:
    """Position counted from the loosest cap: how many caps the value stays under."""
    total = F.lit(0)
    for cap in caps:
        total = total + F.when((value > 0) & (value <= float(cap)), 1).otherwise(0)
    return total


def _reach_caps(name: str, size: int) -> Column:
    """Ascending caps: a value under c caps passes the last c positions."""
    return F.when(F.col(name) > 0, F.sequence(F.lit(size) - F.col(name), F.lit(size - 1))).otherwise(
        F.array().cast("array<int>")
    )


# --- handicap rule grid -------------------------------------------------------------

H_ORDER = ("ev_min", "confidence_min", "cover_prob_min", "cover_margin_min", "quality_min", "odds_max", "sides", "base_actions")


def handicap_sides(rows: DataFrame) -> DataFrame:
    """Features of the recommended side and its return at one percent stake."""
    side = text("handicap_recommended_side")
    is_side = side.isin(*V.SIDES)
    own = lambda h, a: F.when(side == "home", num(h)).when(side == "away", num(a)).otherwise(0.0)
    cover = own("handicap_home_cover_prob", "handicap_away_cover_prob")
    other = own("handicap_away_cover_prob", "handicap_home_cover_prob")
    odds = labels.decimal_odds(own("handicap_home_odds", "handicap_away_odds"))
    actual = text("handicap_actual_result")
    df = rows.filter(actual.isin("home", "away", "push")).withColumns(
        {"_side": side, "_cover": cover, "_margin": cover - other, "_odds": odds, "_action": labels.action_label("handicap_recommendation")}
    )
    hit = F.col("_side") == actual
    roi = (
        F.when(~is_side | (actual == "push"), 0.0)
        .when(hit, F.when(F.col("_odds") > 1.0, round_to(0.01 * (F.col("_odds") - 1.0), 4)).otherwise(0.0))
        .otherwise(-0.01)
    )
    return df.withColumns(
        {
            "_ev": F.when(F.col("_odds") > 0, F.col("_cover") * F.col("_odds") - 1.0).otherwise(-1.0),
            "_hit": hit.cast("int"),
            "_roi": roi,
        }
    )


def handicap_rules(rows: DataFrame) -> DataFrame:
    """Train and validation metrics of all 9,720 handicap rules that act at least once.

    Rows without a side are cells of side 0, which no rule reads: the samples of a split are the sum over all cells.
    """
    g = V.HANDICAP_GRID
    val = F.col("is_validation")
    indexed = handicap_sides(rows).select(
        "is_validation", "_side", "_action", "_hit", "_roi",
        threshold_index(F.col("_ev"), g["ev_min"]).alias("ev_min"),
        threshold_index(num("handicap_confidence"), g["confidence_min"]).alias("confidence_min"),
        threshold_index(F.col("_cover"), g["cover_prob_min"]).alias("cover_prob_min"),
        threshold_index(F.col("_margin"), g["cover_margin_min"]).alias("cover_margin_min"),
        threshold_index(num("quality_score"), g["quality_min"]).alias("quality_min"),
        _cap_index(F.col("_odds"), g["odds_max"]).alias("odds_max"),
    )
    side = F.when(F.col("_side") == "home", 1).when(F.col("_side") == "away", 2).otherwise(0)
    base = F.when(F.col("_action") == "main", 2).when(F.col("_action") == "light", 1).otherwise(0)
    facts = lambda flag: [
        F.count_if(flag).alias("_n"), F.sum(F.when(flag, F.col("_hit")).otherwise(0)), F.sum(F.when(flag, F.col("_roi")).otherwise(0.0))
    ]
    sums = []
    for split, flag in (("train", ~val), ("validation", val)):
        n, h, r = facts(flag)
        sums += [n.alias(f"{split}_actions"), h.alias(f"{split}_hits"), r.alias(f"{split}_roi")]
    names = [f"{s}_{c}" for s in ("train", "validation") for c in ("actions", "hits", "roi")]
    cells = indexed.withColumns({"sides": side, "base_actions": base}).groupBy(*H_ORDER).agg(*sums)
    everything = Window.partitionBy()
    samples = {f"_{s}_samples": F.sum(f"{s}_actions").over(everything) for s in ("train", "validation")}
    cells = cells.withColumns(samples).filter(F.col("sides") > 0)
    cube = _expand(cells, list(samples), [
        {"ev_min": _reach("ev_min"), "confidence_min": _reach("confidence_min"), "odds_max": _reach_caps("odds_max", 3)},
        {"cover_prob_min": _reach("cover_prob_min"), "cover_margin_min": _reach("cover_margin_min"), "quality_min": _reach("quality_min")},
        {"sides": F.array(F.lit(0), F.col("sides")), "base_actions": F.sequence(F.lit(0), F.col("base_actions"))},
    ], names)
    sizes = [len(g[k]) for k in H_ORDER]
    return cube.withColumn("rule_id", _rule_id(list(H_ORDER), sizes)).withColumns(
        {**grid_metrics(cube, "train", F.col("_train_samples")), **grid_metrics(cube, "validation", F.col("_validation_samples"))}
    ).drop(*samples)


def fit_handicap_rules(rows: DataFrame) -> DataFrame:
    return frontier(handicap_rules(rows), V.HANDICAP_TARGET)


# --- handicap bucket tables -----------------------------------------------------------


def bucket_key(feature: str) -> Column:
    """Integer bin of one bucket feature (the edge is only for display)."""
    ev = lambda s: F.when(
        labels.decimal_odds(num(f"handicap_{s}_odds")) > 0,
        num(f"handicap_{s}_cover_prob") * labels.decimal_odds(num(f"handicap_{s}_odds")) - 1.0,
    ).otherwise(-9.0)
    bins = {
        "line25": lambda: floor_bin(num("handicap_line"), 0.25, 5.0),
        "line50": lambda: floor_bin(num("handicap_line"), 0.50, 5.0),
        "coverdiff10": lambda: floor_bin(num("handicap_home_cover_prob") - num("handicap_away_cover_prob"), 0.10, 2.0),
        "evdiff10": lambda: floor_bin(ev("home") - ev("away"), 0.10, 5.0),
        "homeodds20": lambda: floor_bin(labels.decimal_odds(num("handicap_home_odds")), 0.20),
        "awayodds20": lambda: floor_bin(labels.decimal_odds(num("handicap_away_odds")), 0.20),
        "conf10": lambda: floor_bin(num("handicap_confidence"), 0.10),
        "quality10": lambda: floor_bin(num("quality_score"), 0.10),
    }
    return bins[feature]()


def bucket_cells(rows: DataFrame, feature_sets=None) -> DataFrame:
    """Result counts per (feature set, bucket) and split: all later steps run on these cells."""
    feature_sets = feature_sets or V.BUCKET_FEATURE_SETS
    actual, val = text("handicap_actual_result"), F.col("is_validation")
    entries = F.array(*[
        F.struct(F.lit(name).alias("feature_set"), F.concat_ws("|", *[bucket_key(f).cast("string") for f in fs]).alias("bucket"))
        for name, fs in feature_sets.items()
    ])
    rows = rows.filter(actual.isin("home", "away", "push")).select("is_validation", actual.alias("r"), F.explode(entries).alias("e"))
    counts = [
        F.count_if(flag & (F.col("r") == r)).alias(f"{split}_{r}")
        for split, flag in (("train", ~val), ("validation", val)) for r in ("home", "away", "push")
    ]
    return rows.groupBy("e.feature_set", "e.bucket").agg(*counts)


def bucket_table(cells: DataFrame) -> DataFrame:
    """Majority side of every bucket with enough train rows and a high enough hit rate."""
    n = F.col("train_home") + F.col("train_away")
    side_hits = F.greatest("train_home", "train_away")
    return cells.withColumns(
        {
            "side": F.when(
                (n >= V.BUCKET_MIN_ROWS) & (ratio(side_hits, n) >= V.BUCKET_MIN_HIT),
                F.when(F.col("train_home") >= F.col("train_away"), "home").otherwise("away"),
            ).otherwise(""),
            "train_count": n,
            "train_hit_rate": round_to(ratio(side_hits, n), 6),
        }
    )


def bucket_metrics(cells: DataFrame) -> DataFrame:
    """Train and validation metrics per feature set; pushes are samples and, when acted on, actions without a hit."""
    table = bucket_table(cells)
    acted = F.col("side") != ""
    aggs = [F.count_if(acted).alias("bucket_count")]
    for split in ("train", "validation"):
        total = F.col(f"{split}_home") + F.col(f"{split}_away") + F.col(f"{split}_push")
        hits = F.when(F.col("side") == "home", F.col(f"{split}_home")).when(F.col("side") == "away", F.col(f"{split}_away")).otherwise(0)
        aggs += [
            F.sum(total).alias(f"{split}_samples"), F.sum(F.when(acted, total).otherwise(0)).alias(f"{split}_actions"),
            F.sum(hits).alias(f"{split}_hits"),
        ]
    m = table.groupBy("feature_set").agg(*aggs)
    extra = {}
    for split in ("train", "validation"):
        extra[f"{split}_hit_rate"] = ratio(f"{split}_hits", f"{split}_actions")
        extra[f"{split}_action_share"] = ratio(f"{split}_actions", f"{split}_samples")
        extra[f"{split}_total_roi"] = F.lit(0.0)
    return m.withColumns(extra).withColumn("status", target_status(V.HANDICAP_TARGET))


def fit_buckets(rows: DataFrame) -> DataFrame:
    """The best feature set: ready ones first, then closest to the targets, listed order on ties."""
    order = F.create_map(*[F.lit(x) for kv in {n: -i for i, n in enumerate(V.BUCKET_FEATURE_SETS)}.items() for x in kv])
    m = bucket_metrics(bucket_cells(rows))
    rank = F.struct((F.col("status") == "ready").cast("int"), rule_score(), order[F.col("feature_set")])
    return m.agg(F.max_by(F.struct(*m.columns), rank).alias("b")).select("b.*")


def apply_buckets(rows: DataFrame, cells: DataFrame, feature_sets: list[str]) -> DataFrame:
    """Side per row from the first table (primary, then fallbacks) that has one."""
    table = bucket_table(cells).filter("side <> ''")
    sides = []
    for i, name in enumerate(feature_sets):
        key = F.concat_ws("|", *[bucket_key(f).cast("string") for f in V.BUCKET_FEATURE_SETS[name]])
        side = table.filter(F.col("feature_set") == name).select(F.col("bucket").alias(f"_k{i}"), F.col("side").alias(f"_s{i}"))
        rows = rows.withColumn(f"_k{i}", key).join(side, f"_k{i}", "left")
        sides.append(F.col(f"_s{i}"))
    chosen = F.coalesce(*sides, F.lit(""))
    source = F.when(sides[0].isNotNull(), "primary").when(F.coalesce(*sides).isNotNull(), "fallback").otherwise("")
    return rows.withColumns({"bucket_side": chosen, "bucket_source": source}).drop(
        *[f"_k{i}" for i in range(len(feature_sets))], *[f"_s{i}" for i in range(len(feature_sets))]
    )


# --- outcome rule grid ------------------------------------------------------------------

O_ORDER = ("direction", "odds_max", "prob_min", "market_prob_min", "quality_min", "confidence_min", "ev_min", "prob_margin_min", "ev_margin_min")


GAPS = {
    "rating_gap": lambda: num("home_rating") - num("away_rating"),
    "ppg_gap": lambda: num("recent_home_ppg") - num("recent_away_ppg"),
    "split_ppg_gap": lambda: num("home_split_ppg") - num("away_split_ppg"),
    "lineup_gap": lambda: num("lineup_home_availability") - num("lineup_away_availability"),
    "absence_gap": lambda: num("away_absence_impact") - num("home_absence_impact"),
    "h2h_gap": lambda: num("h2h_edge"),
}


def filter_columns() -> dict[str, Column]:
    """Inputs of the category and structural filters, home side minus away side."""
    return {
        "review_decisions": text("review_decision"), "arbiter_decisions": text("arbiter_decision"),
        "effective_sources": text("effective_action_source"), "algo_actions": labels.action_label("algo_recommendation"),
        **{name: gap() for name, gap in GAPS.items()},
    }


def direction_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once per direction source, with the features of the chosen outcome."""
    p = probs.normalise(probs.triple("final"), V.EPSILON)
    odds, market = probs.market_odds(), probs.triple("market")
    base = rows.select(
        *keys, "actual_result", num("quality_score").alias("quality"), num("confidence_score").alias("confidence"),
        text("recommended_outcome").alias("cur"), text("algo_recommended_outcome").alias("alg"),
        *[p[o].alias(f"p_{o}") for o in V.OUTCOMES], *[odds[o].alias(f"o_{o}") for o in V.OUTCOMES],
        *[market[o].alias(f"m_{o}") for o in V.OUTCOMES],
    )
    cols = lambda prefix: {o: F.col(f"{prefix}_{o}") for o in V.OUTCOMES}
    ev = probs.expected_values(cols("p"), cols("o"))
    base = base.withColumns({f"e_{o}": ev[o] for o in V.OUTCOMES} | {"mtop": probs.argmax(cols("m"))})
    priced = {o: F.when(F.col(f"o_{o}") > 0, -F.col(f"o_{o}")).otherwise(-99.0) for o in V.OUTCOMES}
    known = lambda c: F.when(F.col(c).isin(*V.OUTCOMES), F.col(c)).otherwise(F.col("mtop"))
    sources = {
        "market": F.col("mtop"), "model": probs.argmax(cols("p")), "current": known("cur"), "algo": known("alg"),
        "low_odds": probs.argmax(priced), "ev": probs.argmax(cols("e")),
    }
    entries = F.array(*[
        F.struct(F.lit(i).alias("direction"), sources[s].alias("outcome")) for i, s in enumerate(V.DIRECTION_SOURCES)
    ])
    long = base.withColumn("d", F.explode(entries))
    o = F.col("d.outcome")
    long = long.select(
        *keys, "actual_result", "quality", "confidence", F.col("d.direction").alias("direction"), o.alias("outcome"),
        probs.pick(cols("p"), o).alias("prob"), probs.pick(cols("m"), o).alias("market_prob"),
        probs.pick(cols("o"), o).alias("odds"), probs.pick(cols("e"), o).alias("ev"),
        probs.margin_of(cols("p"), o).alias("prob_margin"), probs.margin_of(cols("e"), o).alias("ev_margin"),
    )
    hit = F.col("outcome") == F.col("actual_result")
    roi = F.when(hit & (F.col("odds") > 0), round_to(0.01 * (F.col("odds") - 1.0), 4)).when(hit, 0.0).otherwise(-0.01)
    return long.withColumns({"hit": hit.cast("int"), "roi": roi})


def outcome_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    g = V.OUTCOME_GRID
    long = direction_rows(rows, keys)
    return long.select(
        *keys, "direction", "hit", "roi",
        _cap_index(F.col("odds"), g["odds_max"]).alias("odds_max"),
        *[threshold_index(F.col(c), g[k]).alias(k) for k, c in (
            ("prob_min", "prob"), ("market_prob_min", "market_prob"), ("quality_min", "quality"),
            ("confidence_min", "confidence"), ("ev_min", "ev"), ("prob_margin_min", "prob_margin"), ("ev_margin_min", "ev_margin"))],
    ).groupBy(*keys, *O_ORDER).agg(
        F.count(F.lit(1)).alias("actions"), F.sum("hit").alias("hits"), F.sum("roi").alias("roi")
    )


def _outcome_cube(cells: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    cube = _expand(cells, [*keys, "direction"], [
        {"odds_max": _reach_caps("odds_max", 5), "prob_min": _reach("prob_min"), "market_prob_min": _reach("market_prob_min")},
        {"quality_min": _reach("quality_min"), "confidence_min": _reach("confidence_min"), "ev_min": _reach("ev_min")},
        {"prob_margin_min": _reach("prob_margin_min"), "ev_margin_min": _reach("ev_margin_min")},
    ], sums)
    sizes = [len(V.DIRECTION_SOURCES)] + [len(V.OUTCOME_GRID[k]) for k in O_ORDER[1:]]
    return cube.withColumn("rule_id", _rule_id(list(O_ORDER), sizes))


def outcome_rules(rows: DataFrame) -> DataFrame:
    """Metrics of all 12,960 outcome rules on both splits, from one scan of the rows."""
    val = F.col("is_validation")
    totals = rows.agg(F.count_if(~val).alias("t"), F.count_if(val).alias("v")).first()
    cells = outcome_cells(rows, ["is_validation"])
    wide = cells.groupBy(*O_ORDER).agg(*[
        F.sum(F.when(flag, F.col(c)).otherwise(0)).alias(f"{split}_{c}")
        for split, flag in (("train", ~val), ("validation", val)) for c in ("actions", "hits", "roi")
    ])
    names = [f"{s}_{c}" for s in ("train", "validation") for c in ("actions", "hits", "roi")]
    cube = _outcome_cube(wide, [], names)
    return cube.withColumns(
        {**grid_metrics(cube, "train", F.lit(totals["t"])), **grid_metrics(cube, "validation", F.lit(totals["v"]))}
    )


def fit_outcome_rules(rows: DataFrame) -> DataFrame:
    return frontier(outcome_rules(rows), V.OUTCOME_TARGET)


def _signed(gap: str) -> Column:
    """A gap seen from the chosen outcome; a draw wants both sides level."""
    d, o = F.col(gap), F.col("outcome")
    return F.when(o == "home", d).when(o == "away", -d).otherwise(-F.abs(d))


def _mask(tests: list[Column]) -> Column:
    """Bit i set when test i holds; bit 0 stands for "no filter"."""
    mask = F.lit(1)
    for i, test in enumerate(tests):
        mask = mask + F.when(test, 1 << (i + 1)).otherwise(0)
    return mask


def _bits(mask: str, count: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(count)), lambda b: F.getbit(F.col(mask), b) == 1)


CATEGORY_COUNT, STRUCTURAL_COUNT = len(V.CATEGORY_FILTERS), len(V.STRUCTURAL_FILTERS)
VARIANTS_PER_RULE = (1 + CATEGORY_COUNT) * (1 + STRUCTURAL_COUNT)


def expanded_cells(rows: DataFrame) -> DataFrame:
    """Actions, hits and return of both splits per combination of threshold indices, category and structural filter.

    Which filters a row passes is two bit masks; rows collapse to cells of (indices, masks) first, and a mask is then
    read off bit by bit, so the filters cost cells, not rows.
    """
    val = F.col("is_validation")
    g = V.OUTCOME_GRID
    extra = filter_columns()
    packed = rows.withColumn("_x", F.struct(*[c.alias(n) for n, c in extra.items()]))
    long = direction_rows(packed, ["is_validation", "_x"]).select("*", *[F.col(f"_x.{n}").alias(n) for n in extra])
    member = lambda k, vals: F.col("outcome" if k == "outcomes" else k).isin(*vals)
    category = [member(k, v) for f in V.CATEGORY_FILTERS for k, v in f.items()]
    structural = []
    for f in V.STRUCTURAL_FILTERS:
        test = F.lit(True)
        for gap, floor in f.items():
            test = test & (_signed(gap) >= floor)
        structural.append(test)
    cells = long.select(
        "is_validation", "direction", "hit", "roi", _mask(category).alias("cats"), _mask(structural).alias("structs"),
        _cap_index(F.col("odds"), g["odds_max"]).alias("odds_max"),
        *[threshold_index(F.col(c), g[k]).alias(k) for k, c in (
            ("prob_min", "prob"), ("market_prob_min", "market_prob"), ("quality_min", "quality"),
            ("confidence_min", "confidence"), ("ev_min", "ev"), ("prob_margin_min", "prob_margin"), ("ev_margin_min", "ev_margin"))],
    ).groupBy(*O_ORDER, "cats", "structs").agg(*[
        agg.alias(f"{split}_{n}") for split, flag in (("train", ~val), ("validation", val)) for n, agg in (
            ("actions", F.count_if(flag)), ("hits", F.sum(F.when(flag, F.col("hit")).otherwise(0))),
            ("roi", F.sum(F.when(flag, F.col("roi")).otherwise(0.0))))
    ])
    by_bit = cells.withColumn("struct", F.explode(_bits("structs", STRUCTURAL_COUNT))).groupBy(*O_ORDER, "cats", "struct").agg(*_sums())
    return by_bit.withColumn("cat", F.explode(_bits("cats", CATEGORY_COUNT))).groupBy(*O_ORDER, "cat", "struct").agg(*_sums())


def _sums() -> list[Column]:
    return [F.sum(n).alias(n) for n in SPLIT_SUMS]


SPLIT_SUMS = tuple(f"{s}_{n}" for s in ("train", "validation") for n in ("actions", "hits", "roi"))


def expanded_rules(rows: DataFrame) -> DataFrame:
    """All 12,960 base rules, each with all 198 combinations of a category and a structural filter, on both splits.

    Every rule is judged: the thresholds are cumulated over the cells of each filter combination, as those of the
    base grid are, so no rule is chosen beforehand and nothing is brought to the driver but two row counts.
    """
    val = F.col("is_validation")
    totals = rows.agg(F.count_if(~val).alias("t"), F.count_if(val).alias("v")).first()
    cube = _outcome_cube(expanded_cells(rows), ["cat", "struct"], list(SPLIT_SUMS))
    # Listed order within a rule: bare, categories, structures, then category x structure.
    c, t = F.col("cat"), F.col("struct")
    offset = (
        F.when(t == 0, c).when(c == 0, CATEGORY_COUNT + t)
        .otherwise(1 + CATEGORY_COUNT + STRUCTURAL_COUNT + (c - 1) * STRUCTURAL_COUNT + (t - 1))
    )
    out = cube.withColumn("rule_id", (F.col("rule_id") * VARIANTS_PER_RULE + offset).cast("long"))
    return out.withColumns(
        {**grid_metrics(out, "train", F.lit(totals["t"])), **grid_metrics(out, "validation", F.lit(totals["v"]))}
    )


def fit_expanded_rules(rows: DataFrame) -> DataFrame:
    return frontier(expanded_rules(rows), V.OUTCOME_TARGET)


def walk_forward(rows: DataFrame) -> DataFrame:
    """Expanding folds: per period the rule chosen by that fold, trained on earlier periods only.

    The grid is evaluated once per period; train metrics of a fold are a
    running sum over the rule's earlier periods, so no fold rescans rows.
    """
    cells = outcome_cells(rows, ["period_rank"])
    cube = _outcome_cube(cells, ["period_rank"], ["actions", "hits", "roi"])
    sizes = rows.groupBy("period", "period_rank").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("period_rank").rowsBetween(Window.unboundedPreceding, -1)
    axis = sizes.withColumn("train_samples", F.coalesce(F.sum("n").over(before), F.lit(0)))
    past = Window.partitionBy("rule_id").orderBy("period_rank").rowsBetween(Window.unboundedPreceding, -1)
    # A rule that does not act in a period still has train metrics there, but no validation actions;
    # such a rule scores lowest, so only acting rules (and their running sums) are needed to choose.
    folds = cube.select(
        "rule_id", "period_rank", F.col("actions").alias("validation_actions"), F.col("hits").alias("validation_hits"),
        F.col("roi").alias("validation_roi"),
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"train_{c}") for c in ("actions", "hits", "roi")],
    ).join(axis, "period_rank")
    folds = folds.filter(
        (F.col("train_actions") >= V.RULE_MIN_TRAIN_ROWS) & (F.col("train_samples") >= V.RULE_MIN_TRAIN_ROWS)
        & (F.col("n") >= V.RULE_MIN_VALIDATION_ROWS)
    )
    folds = folds.withColumns(
        {**grid_metrics(folds, "train", F.col("train_samples")), **grid_metrics(folds, "validation", F.col("n"))}
    ).withColumn("status", target_status(V.OUTCOME_TARGET))
    ready = (F.col("status") == "ready").cast("int")
    row = F.struct(*[c for c in folds.columns if c not in ("period", "period_rank")])
    best = folds.groupBy("period", "period_rank").agg(
        F.max_by(row, F.struct(ready, rule_score(), -F.col("rule_id"))).alias("b")
    )
    return best.select(
        "period", "period_rank", "b.rule_id", "b.status", "b.train_samples", "b.validation_samples", "b.train_actions",
        "b.validation_actions", "b.validation_hits", round_to("b.validation_hit_rate", 6).alias("validation_hit_rate"),
        round_to("b.validation_action_share", 6).alias("validation_action_share"),
        "b.validation_total_roi",
    )


def combine_folds(folds: DataFrame) -> DataFrame:
    """Merge fold metrics additively; ratios last."""
    total = folds.agg(
        F.count(F.lit(1)).alias("fold_count"), F.sum("validation_samples").alias("validation_samples"),
        F.sum("validation_actions").alias("validation_actions"), F.sum("validation_hits").alias("validation_hits"),
        round_to(F.sum("validation_total_roi"), 4).alias("validation_total_roi"),
    )
    return total.withColumns(
        {
            "validation_hit_rate": ratio("validation_hits", "validation_actions"),
            "validation_action_share": ratio("validation_actions", "validation_samples"),
        }
    ).withColumn("status", target_status(V.OUTCOME_TARGET)).withColumns(
        {c: round_to(c, 6) for c in ("validation_hit_rate", "validation_action_share")}
    )


# --- gate search ---------------------------------------------------------------------------


def _gate_positions(names: tuple[str, ...]) -> list[tuple[float, ...]]:
    return list(product(*[V.GATE_GRID[n] for n in names]))


GATE_NAMES = ("main_ev", "main_confidence", "main_market_bias", "light_ev", "light_confidence", "light_market_bias")
PROMOTE_NAMES = ("promote_ev", "promote_confidence", "promote_market_bias")


#: Gates that enter the evidence score or the main action: their 81 combinations meet rows; all others are thresholds.
SCORE_GATES = ("main_ev", "main_confidence", "main_market_bias", "light_confidence")
_EFFECTS = "confidence_delta string, stake_multiplier string, evidence_grade string"


def gate_candidates(rows: DataFrame, calibrator: dict | None = None) -> DataFrame:
    """Rows that could act, or be promoted to act, under the loosest gates; the others add nothing to any configuration.

    ``calibrator`` has a temperature and biases by outcome; without one the normalised probabilities stand.
    """
    p = probs.normalise(probs.triple("final"), V.EPSILON)
    if calibrator is not None:
        p = probs.calibrate(probs.triple("final"), F.lit(float(calibrator["temperature"])), {o: F.lit(float(calibrator["biases"][o])) for o in V.OUTCOMES})
    staged = policy.outcome_policy(policy.market_position(rows, p))
    staged = policy.selection(staged, F.col("market_outcome"))
    g = V.GATE_GRID
    loosest = {k: F.lit(min(g[f"light_{k}"])) for k in ("ev", "confidence", "market_bias")}
    done, decision = text("review_status") == "completed", text("review_decision")
    hopeful = done & (decision == "promote") & _promotable()
    for c, k in (("policy_ev", "ev"), ("policy_confidence", "confidence"), ("policy_bias", "market_bias")):
        hopeful = hopeful & (F.col(c) >= min(g[f"promote_{k}"]))
    reachable = policy.can_act(loosest | {"quality": F.lit(V.BASE_GATES["light"]["quality"])}) | hopeful
    raw = F.from_json(text("review_raw") if "review_raw" in rows.columns else F.lit(""), _EFFECTS)
    asked = F.trim(text("review_target_action"))
    keep = [
        "is_validation", "actual_result", "policy_outcome", "policy_ev", "policy_bias", "_prob", "_odds", "_ev_margin",
        "_p_margin", "_gap", "_quality", "_agreement", "policy_confidence", "_kelly", "favourite_guard",
        done.alias("done"), decision.alias("decision"), F.when(asked != "", labels.action_label(asked)).alias("target"),
        F.when(done, clamp(text_num(raw["confidence_delta"]), -0.12, 0.08)).otherwise(0.0).alias("delta"),
        F.when(done, clamp(text_num(raw["stake_multiplier"], 1.0), 0.0, 1.0)).otherwise(1.0).alias("share"),
        F.lower(F.trim(text(raw["evidence_grade"]))).alias("grade"),
    ]
    entry = F.array(F.struct(reachable.alias("reachable"), *keep))
    return staged.select(F.explode(entry).alias("e")).filter("e.reachable").select("e.*").drop("reachable")


def _promotable() -> Column:
    """What a promotion needs besides its three gates."""
    return (F.col("_quality") >= V.BASE_GATES["promote"]["quality"]) & (F.col("policy_confidence") >= 0.48)


def gate_cells(rows: DataFrame, calibrator: dict | None = None) -> DataFrame:
    """Facts of both splits per combination of the score gates and position under the threshold gates.

    Light's expected value and bias and the three promote gates only open or close: a row passes them up to a
    position.  A cell holds what its rows do when light stays closed or opens, and when a promotion is refused or
    granted, so 81 combinations meet the candidate rows and everything else is sums over at most 81 * 16 * 64 cells.
    """
    grid = F.array(*[
        F.struct(*[F.lit(i).alias(f"{n}_at") for n, i in zip(SCORE_GATES, at)], *[F.lit(float(V.GATE_GRID[n][i])).alias(n) for n, i in zip(SCORE_GATES, at)])
        for at in product(range(3), repeat=len(SCORE_GATES))
    ])
    df = gate_candidates(rows, calibrator).select("*", F.explode(grid).alias("g"))
    c = lambda n: F.col(f"g.{n}")
    never = F.lit(float("-inf"))
    gates = {
        "main": {"ev": c("main_ev"), "confidence": c("main_confidence"), "market_bias": c("main_market_bias"), "quality": F.lit(V.BASE_GATES["main"]["quality"])},
        "light": {"ev": never, "confidence": c("light_confidence"), "market_bias": never, "quality": F.lit(V.BASE_GATES["light"]["quality"])},
    }
    opened, closed, able = policy.gate_states(df, gates)
    df = opened.withColumns({"_open": able, "_opened": F.col("policy_action"), "_closed": closed})
    df = df.withColumn("_opened", F.when(F.col("_open"), F.col("_opened")).otherwise(F.col("_closed")))
    done, conf = F.col("done"), clamp(F.col("policy_confidence") + F.col("delta"), 0.18, 0.88)
    df = df.withColumn("_conf", conf)
    hit = F.col("policy_outcome") == F.col("actual_result")

    def roi(stake: Column) -> Column:
        units = stake / 100.0
        return F.when(units <= 0, 0.0).when(hit & (F.col("_odds") > 0), round_to(units * (F.col("_odds") - 1.0), 4)).when(hit, 0.0).otherwise(round_to(-units, 4))

    stakes = {}
    for level in ("main", "light"):
        stakes[f"_a_{level}"] = policy.stake(F.lit(level), F.col("policy_confidence"))
        full = policy.stake(F.lit(level), F.col("_conf"))
        stakes[f"_f_{level}"] = F.when(done, round_to(full * F.col("share"), 2)).otherwise(full)
    df = df.withColumns(stakes)
    df = df.withColumns({f"_r{k}": roi(F.col(k)) for k in stakes})

    def settled(level: Column) -> Column:
        """What the review's evidence and the confidence gates leave of an action."""
        level = F.when(done & ((F.col("grade") == "unsafe") | (F.col("share") <= 0)), "watch").when(done & (F.col("grade") == "weak") & (level == "main"), "light").otherwise(level)
        level = F.when(done & (level == "main") & (F.col("_conf") < c("main_confidence")), "light").otherwise(level)
        return F.when(done & (level == "light") & (F.col("_conf") < c("light_confidence")), "watch").otherwise(level)

    can = done & (F.col("decision") == "promote") & _promotable()
    actions = {}
    for state in ("_opened", "_closed"):
        now = F.col(state)
        target = F.coalesce("target", now)
        plain = F.when(done & (F.col("decision") == "downgrade"), labels.step_down(now, target)).when(done & (F.col("decision") == "abstain"), "watch").otherwise(now)
        granted = F.when(can & ~((now == "watch") & (target == "main")), labels.step_up(now, target)).otherwise(plain)
        actions |= {f"{state}_a": now, f"{state}_p": settled(plain), f"{state}_q": settled(granted)}
    df = df.withColumns(actions)
    index = lambda column, gate: threshold_index(F.col(column), V.GATE_GRID[gate])
    keys = {
        "light_ev_at": F.when(F.col("_open"), index("policy_ev", "light_ev")).otherwise(0), "light_market_bias_at": F.when(F.col("_open"), index("policy_bias", "light_market_bias")).otherwise(0),
        "promote_ev_at": F.when(can, index("policy_ev", "promote_ev")).otherwise(0), "promote_confidence_at": F.when(can, index("policy_confidence", "promote_confidence")).otherwise(0),
        "promote_market_bias_at": F.when(can, index("policy_bias", "promote_market_bias")).otherwise(0),
    }
    facts = {}
    for name in actions:
        kind = "_a" if name.endswith("_a") else "_f"
        of = lambda prefix, name=name, kind=kind: F.when(F.col(name) == "main", F.col(f"{prefix}{kind}_main")).when(F.col(name) == "light", F.col(f"{prefix}{kind}_light")).otherwise(0.0)
        facts |= {f"{name}_n": (of("") > 0).cast("int"), f"{name}_r": of("_r")}
    df = df.select("is_validation", *[c(f"{n}_at").alias(f"{n}_at") for n in SCORE_GATES], *[v.alias(k) for k, v in keys.items()], *[v.alias(k) for k, v in facts.items()])
    flags = (("train", ~F.col("is_validation")), ("validation", F.col("is_validation")))
    return df.groupBy(*[f"{n}_at" for n in SCORE_GATES], *keys).agg(*[F.sum(F.when(flag, F.col(k)).otherwise(0)).alias(f"{split}{k}") for split, flag in flags for k in facts])


def gate_search(rows: DataFrame, calibrator: dict | None = None) -> DataFrame:
    """Algorithm and final metrics of all 3^9 gate configurations, from the cells of ``gate_cells``.

    A configuration's total is what its rows do with light closed and no promotion, plus what opening light changes
    for the rows that reach its gates, what a promotion changes for those that reach the promote gates, and what both do.
    """
    cells = gate_cells(rows, calibrator)
    score = [f"{n}_at" for n in SCORE_GATES]
    light, promote = ["light_ev_at", "light_market_bias_at"], ["promote_ev_at", "promote_confidence_at", "promote_market_bias_at"]
    splits = ("train", "validation")
    named = (("algo", "actions", "a", "n"), ("algo", "roi", "a", "r"), ("final", "actions", "p", "n"), ("final", "roi", "p", "r"))

    x = lambda split, state, kind, what: F.col(f"{split}_{state}_{kind}_{what}")

    def change(split: str, kind: str, what: str) -> Column:
        """What part 0 to 3 adds: nothing opened, light opened, promotion granted, both."""
        opened, closed = (x(split, state, kind, what) for state in ("opened", "closed"))
        out = F.when(F.col("_part") == 0, closed).when(F.col("_part") == 1, opened - closed)
        if kind == "a":
            return out.otherwise(0)
        up = {state: x(split, state, "q", what) - x(split, state, "p", what) for state in ("opened", "closed")}
        return out.when(F.col("_part") == 2, up["closed"]).otherwise(up["opened"] - up["closed"])

    # One pass over the cells for all four parts; position -1 stands for every position.
    total = cells.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    for names, parts in ((light, (1, 3)), (promote, (2, 3))):
        for n in names:
            total = total.withColumn(n, F.explode(F.when(F.col("_part").isin(*parts), _reach(n)).otherwise(F.array(F.lit(-1)))))
    names = [f"{split}_{out}_{name}" for split in splits for out, name, _, _ in named]
    total = total.groupBy(*score, *light, *promote).agg(*[F.sum(change(split, kind, what)).alias(f"{split}_{out}_{name}") for split in splits for out, name, kind, what in named])
    every = F.array(*[F.lit(i) for i in range(3)])
    for n in (*light, *promote):
        total = total.withColumn(n, F.explode(F.when(F.col(n) < 0, every).otherwise(F.array(n))))
    total = total.groupBy(*score, *light, *promote).agg(*[F.sum(n).alias(n) for n in names])
    at = lambda wanted: _rule_id([f"{n}_at" for n in wanted], [3] * len(wanted)).cast("int")
    return total.select(
        at(GATE_NAMES).alias("gate_id"), at(PROMOTE_NAMES).alias("promote_id"), *[F.col(n).cast("long").alias(n) if n.endswith("actions") else round_to(n, 4).alias(n) for n in names],
    )


def _base_position(names: tuple[str, ...]) -> int:
    base = [V.BASE_GATES[n.split("_", 1)[0]][n.split("_", 1)[1]] for n in names]
    return [list(c) for c in _gate_positions(names)].index(base)


def fit_gates(search: DataFrame) -> DataFrame:
    """Best train return among configurations that act often enough, with its validation verdict.

    Ties on return go to the final-action count nearest the base configuration,
    then to grid order.  The winner is ready when validation return beats the
    base configuration's without falling under 35% of its actions.
    """
    is_base = (F.col("gate_id") == _base_position(GATE_NAMES)) & (F.col("promote_id") == _base_position(PROMOTE_NAMES))
    every = Window.partitionBy(F.lit(0))  # 3^9 rows at most
    names = [f"{split}_{kind}_{c}" for split in ("train", "validation") for kind in ("algo", "final") for c in ("actions", "roi")]
    df = search.withColumns({f"_b_{n}": F.max(F.when(is_base, F.col(n))).over(every) for n in names}).filter("_b_train_final_actions is not null")
    base = lambda n: F.col(f"_b_{n}")
    acts = F.greatest("train_final_actions", "train_algo_actions")
    order = F.struct(
        F.greatest("train_final_roi", "train_algo_roi"), F.col("train_final_roi"), F.col("train_algo_roi"),
        -F.abs(F.col("train_final_actions") - base("train_final_actions")), -F.col("gate_id"), -F.col("promote_id"),
    )
    best = df.filter(acts >= V.GATE_MIN_TRAIN_ACTIONS).agg(F.max_by(F.struct(*df.columns), order).alias("b")).filter("b is not null").select("b.*")

    def improved(kind: str) -> Column:
        floor = F.greatest(F.lit(1), F.ceil(base(f"validation_{kind}_actions") * 0.35))
        return (F.col(f"validation_{kind}_roi") > base(f"validation_{kind}_roi") + 1e-9) & (F.col(f"validation_{kind}_actions") >= floor)

    enough = (F.greatest(base("train_final_actions"), base("train_algo_actions")) >= V.GATE_MIN_TRAIN_ACTIONS) & (
        F.greatest(base("validation_final_actions"), base("validation_algo_actions")) >= V.GATE_MIN_VALIDATION_ACTIONS
    )
    status = F.when(~enough, "insufficient_samples").when(improved("algo") | improved("final"), "ready").otherwise("no_gain")
    return best.withColumn("status", status).drop(*[f"_b_{n}" for n in names])


def train_profile(rows: DataFrame) -> DataFrame:
    """One profile row: calibrator, handicap rule frontier and bucket table, as JSON."""
    parts = {
        "calibrator": fit_calibrator(rows), "handicap_rules": fit_handicap_rules(rows), "handicap_buckets": fit_buckets(rows),
    }
    packed = None
    for name, frame in parts.items():
        one = frame.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*frame.columns)))).alias("payload")).withColumn("part", F.lit(name))
        packed = one if packed is None else packed.unionByName(one)
    return packed.select("part", "payload")
