"""Stored strategies replayed: rule lists parsed from a profile's parameters and interpreted over all rows.

A rule names where its outcome comes from and what that outcome must satisfy; a strategy is one rule or an ordered list
of alternatives, of which the first that a row passes decides.  Rules are data (JSON in the profile row), so a row gets
its facts once per outcome and the list is interpreted by higher-order functions, without a plan per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels, probs
from ..functions.numeric import num, ratio, round_to, text
from .learning import GAPS

#: Least values by rule field: (fact, what holds where a rule has no such field).
FLOORS = {
    "prob_min": ("prob", 0.0), "market_prob_min": ("market_prob", 0.0), "quality_min": ("quality", 0.0), "agreement_min": ("agreement", 0.0), "confidence_min": ("confidence", 0.0),
    "ev_min": ("ev", -1.0), "prob_margin_min": ("prob_margin", -1.0), "ev_margin_min": ("ev_margin", -2.0), "score_confidence_min": ("score_confidence", 0.0),
}
#: Least gaps, seen from the outcome; a rule without the field does not look at the gap.
GAP_FLOORS = {
    "rating_gap_min": "rating_gap", "ppg_gap_min": "ppg_gap", "split_ppg_gap_min": "split_ppg_gap", "goal_for_gap_min": "goal_for_gap", "goal_against_gap_min": "goal_against_gap",
    "absence_gap_min": "absence_gap", "lineup_gap_min": "lineup_gap", "rest_gap_min": "rest_gap", "schedule_gap_min": "schedule_gap", "h2h_edge_min": "h2h_gap",
}
#: Lists by rule field: the fact that must be among them.
LISTS = {
    "outcomes": "outcome", "score_outcomes": "score_outcome", "llm_decisions": "llm_decision", "arbiter_decisions": "arbiter_decision", "effective_sources": "effective_source",
    "algo_actions": "algo_action", "final_actions": "final_action",
}
RULE = ", ".join(["direction_source string", "odds_max double", *(f"{n} double" for n in (*FLOORS, *GAP_FLOORS)), *(f"{n} array<string>" for n in LISTS)])
STRATEGY = f"{RULE}, stake_pct double, any_rules array<struct<{RULE.replace(' double', ':double').replace(' string', ':string').replace(' array', ':array')}>>, calibrator struct<temperature:double,biases:struct<home:double,draw:double,away:double>>"
MORE_GAPS = {
    "goal_for_gap": lambda: num("recent_home_gf_pg") - num("recent_away_gf_pg"), "goal_against_gap": lambda: num("recent_away_ga_pg") - num("recent_home_ga_pg"),
    "rest_gap": lambda: num("rest_days_home") - num("rest_days_away"), "schedule_gap": lambda: num("schedule_load_away") - num("schedule_load_home"),
}


def parse(params: Column | str) -> Column:
    """A strategy struct from its JSON text; null where that is unreadable."""
    return F.from_json(F.lit(params) if isinstance(params, str) else params, STRATEGY)


def row_facts(rows: DataFrame, strategy: str) -> DataFrame:
    """Adds ``_facts``, the facts of each outcome, and ``_named``, the outcome that each direction source names."""
    raw = probs.normalise(probs.triple("final"), V.EPSILON)
    s = F.col(strategy)
    temperature = F.coalesce(s["calibrator"]["temperature"], F.lit(1.0))
    fitted = probs.calibrate(probs.triple("final"), temperature, {o: F.coalesce(s["calibrator"]["biases"][o], F.lit(0.0)) for o in V.OUTCOMES})
    has = s["calibrator"].isNotNull()
    rows = rows.withColumns({f"_p_{o}": F.when(has, fitted[o]).otherwise(raw[o]) for o in V.OUTCOMES})
    p = {o: F.col(f"_p_{o}") for o in V.OUTCOMES}
    odds, market = probs.market_odds(), probs.triple("market")
    rows = rows.withColumns({f"_e_{o}": e for o, e in probs.expected_values(p, odds).items()})
    ev = {o: F.col(f"_e_{o}") for o in V.OUTCOMES}
    gaps = {n: g() for n, g in (GAPS | MORE_GAPS).items()}
    common = {
        "quality": num("quality_score"), "agreement": num("model_agreement"), "confidence": num("confidence_score"), "score_outcome": labels.score_direction("predicted_score"),
        "score_confidence": num("predicted_score_confidence"), "llm_decision": text("review_decision"), "arbiter_decision": text("arbiter_decision"), "effective_source": text("effective_action_source"),
        "algo_action": labels.action_label("algo_recommendation"), "final_action": labels.action_label("recommendation"),
    }

    def facts(o: str) -> Column:
        seen = {n: g if o == "home" else -g if o == "away" else -F.abs(g) for n, g in gaps.items()}
        own = {
            "outcome": F.lit(o), "odds": odds[o], "prob": p[o], "market_prob": market[o], "ev": ev[o],
            "prob_margin": probs.margin_of(p, F.lit(o)), "ev_margin": probs.margin_of(ev, F.lit(o)),
        }
        return F.struct(*[c.alias(n) for n, c in (own | common | seen).items()])

    top = probs.argmax(market)
    known = lambda c: F.when(text(c).isin(*V.OUTCOMES), text(c)).otherwise(top)
    priced = probs.argmax({o: F.when(odds[o] > 0, -odds[o]).otherwise(-99.0) for o in V.OUTCOMES})
    named = {"market": top, "model": probs.argmax(p), "current": known("recommended_outcome"), "algo": known("algo_recommended_outcome"), "low_odds": priced, "ev": probs.argmax(ev)}
    return rows.withColumns({"_facts": F.array(*[facts(o) for o in V.OUTCOMES]), "_named": F.struct(*[c.alias(n) for n, c in named.items()])})


def _passes(f: Column, rule: Column) -> Column:
    ok = (f["odds"] > 0) & (f["odds"] <= F.coalesce(rule["odds_max"], F.lit(10.0)))
    for field, (fact, least) in FLOORS.items():
        ok = ok & (f[fact] >= F.coalesce(rule[field], F.lit(least)))
    for field, fact in GAP_FLOORS.items():
        ok = ok & (rule[field].isNull() | (f[fact] >= rule[field]))
    for field, fact in LISTS.items():
        listed = F.transform(rule[field], lambda x: labels.action_label(x)) if field.endswith("actions") else rule[field]
        ok = ok & (F.coalesce(F.size(rule[field]), F.lit(0)).isin(0, -1) | F.coalesce(F.array_contains(listed, f[fact]), F.lit(False)))
    return ok


def _facts_of(rule: Column) -> Column:
    """The facts of the outcome that a rule's direction source names; unknown sources read the market."""
    source = F.coalesce(rule["direction_source"], F.lit("market"))
    outcome = F.col("_named.market")
    for name in ("model", "current", "algo", "low_odds", "ev"):
        outcome = F.when(source == name, F.col(f"_named.{name}")).otherwise(outcome)
    return F.get(F.col("_facts"), F.array_position(F.array(*[F.lit(o) for o in V.OUTCOMES]), outcome).cast("int") - 1)


def replay(rows: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Every row under every named strategy: action, outcome, hit, stake and return; one scan for all of them.

    The first alternative that passes gives outcome and action; without one the row is watched, with the outcome that
    the first alternative names.  ``strategies`` are parameter texts of profile rows; an unreadable one has no rows.
    """
    parsed = F.array(*[F.struct(F.lit(name).alias("strategy"), parse(text).alias("rule")) for name, text in strategies.items()])
    rows = rows.withColumn("_s", F.explode(parsed)).where("_s.rule is not null").withColumn("_rule", F.col("_s.rule"))
    rows = row_facts(rows, "_rule")
    listed = F.coalesce(F.size("_rule.any_rules"), F.lit(0)) > 0
    alone = F.array(F.struct(*[F.col(f"_rule.{c.split()[0]}").alias(c.split()[0]) for c in RULE.split(", ")]))
    rows = rows.withColumn("_rules", F.when(listed, F.col("_rule.any_rules")).otherwise(alone))

    def judged(rule: Column) -> Column:
        f = _facts_of(rule)
        return F.struct(f["outcome"].alias("outcome"), f["odds"].alias("odds"), _passes(f, rule).alias("passed"))

    rows = rows.withColumn("_judged", F.transform("_rules", judged))
    rows = rows.withColumn("_hit", F.get(F.filter("_judged", lambda j: j["passed"]), F.lit(0)))
    chosen = F.coalesce("_hit", F.get(F.col("_judged"), F.lit(0)))
    rows = rows.withColumns({
        "strategy": F.col("_s.strategy"), "strategy_action": F.when(F.col("_hit").isNotNull(), "light").otherwise("watch"), "strategy_outcome": chosen["outcome"], "_odds": chosen["odds"],
        "strategy_stake": F.when(F.col("_hit").isNotNull(), F.coalesce("_rule.stake_pct", F.lit(1.0))).otherwise(0.0),
    })
    units = F.col("strategy_stake") / 100.0
    hit = F.col("strategy_outcome") == text("actual_result")
    roi = F.when(units <= 0, 0.0).when(hit & (F.col("_odds") > 0), round_to(units * (F.col("_odds") - 1.0), 4)).when(hit, 0.0).otherwise(round_to(-units, 4))
    rows = rows.withColumns({"strategy_hit": hit.cast("int"), "strategy_roi": roi})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def replay_metrics(replayed: DataFrame) -> DataFrame:
    """Per strategy, in all and per action:outcome: samples, actions, hits, return and their rates; one aggregate."""
    acted = F.col("strategy_action") != "watch"
    keyed = replayed.withColumn("bucket", F.concat_ws(":", "strategy_action", "strategy_outcome"))
    sums = keyed.groupingSets([["strategy"], ["strategy", "bucket"]], "strategy", "bucket").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(acted).alias("action_count"), F.sum(F.when(acted, F.col("strategy_hit")).otherwise(0)).alias("hits"),
        F.sum(F.when(acted, F.col("strategy_roi")).otherwise(0.0)).alias("_roi"), F.sum(F.when(acted, F.col("strategy_stake")).otherwise(0.0)).alias("_stake"),
    )
    return sums.select(
        "strategy", F.coalesce("bucket", F.lit("all")).alias("bucket"), "sample_count", "action_count", (F.col("sample_count") - F.col("action_count")).alias("watch_count"), "hits",
        ratio("hits", "action_count").alias("hit_rate"), ratio("action_count", "sample_count").alias("action_share"), round_to("_roi", 4).alias("total_roi"), ratio("_roi", "action_count").alias("avg_roi"),
        ratio("_stake", "action_count").alias("avg_stake_pct"),
    )


def active_parameters(states: DataFrame, profiles: DataFrame) -> dict[str, str]:
    """Name and parameters of the active profile, of several the newest; empty where none is active (one row at most)."""
    active = states.where("status = 'active'").orderBy(F.col("updated_at").desc(), "profile_id").select("profile_id").limit(1)
    return {str(r["profile_id"]): r["params"] for r in active.join(profiles, "profile_id").select("profile_id", "params").collect()}
