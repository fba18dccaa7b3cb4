"""Pick strategies as layered Column expressions.

A pick is struct<outcome, tier, reason, stake>.  A strategy is its parent's
pick plus vetoes (turn a pick into watch) and fills (turn watch into a pick).
Every layer is its own projection that refers to the previous one by name, so
expressions stay small although the layers nest twelve deep.  The layers carry a
pick as one column per field, words as numbers: rows are copied from layer to
layer, and fields that neither a later layer nor the report reads are left out.
The structs are put together behind the last layer.

``register_strategy`` is the extension point: a function from the pick columns
to a pick struct, visible to Catalyst, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CAUTIOUS_LEAGUES,
    GUARDED_LEAGUES,
    LOW_ODDS_LEAGUES,
    OUTCOMES,
    STABLE_FILL_SKIP_LEAGUES,
    VARIANT_ROLES,
)
from ..functions import labels, probs
from ..functions.numeric import between, num, text

PREFIX = "pick_"
ROW_LOCAL = tuple(v for v in VARIANT_ROLES if v != "coverage_draw_rescue")
_EXTENSIONS: dict[str, Callable[[], Column]] = {}


def register_strategy(name: str, pick: Callable[[], Column]) -> None:
    """Add a strategy built from the signal columns and existing picks."""
    _EXTENSIONS[name] = pick


Pick = dict[str, Column]
FIELDS = ("outcome", "tier", "reason", "stake")
_WORDS: dict[str, int] = {w: i for i, w in enumerate(("", *OUTCOMES, "watch", "standard", "core"))}


def code(word: str | Column) -> Column:
    """Number of a word of the picks, or of an outcome held in a column (null stays null, any other text is -1)."""
    if isinstance(word, str):
        return F.lit(_WORDS.setdefault(word, len(_WORDS)))
    chain = F
    for outcome in OUTCOMES:
        chain = chain.when(word == outcome, _WORDS[outcome])
    return chain.when(word.isNotNull(), -1)


def pick_codes(outcome: str | Column, tier: str, reason: str | Column, stake=1.0) -> Pick:
    """A pick of the layers; a reason given as a column is a code."""
    stake = stake if isinstance(stake, Column) else F.lit(stake)
    reason = code(reason) if isinstance(reason, str) else reason
    return dict(zip(FIELDS, (code(outcome), code(tier), reason, stake.cast("double")), strict=True))


def make_pick(outcome, tier: str, reason, stake=1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(outcome).alias("outcome"),
        F.lit(tier).alias("tier"),
        as_col(reason).alias("reason"),
        as_col(stake).cast("double").alias("stake"),
    )


def watch(reason: str | Column) -> Pick:
    return pick_codes("", "watch", reason, 0.0)


def picked(name: str) -> Column:
    return F.col(PREFIX + name)


def part(name: str, field: str) -> Column:
    return picked(name)[field]


def held_name(name: str, field: str) -> str:
    return f"{PREFIX}{name}__{field}"


def held(name: str, field: str) -> Column:
    """A field of a strategy's pick as the layers carry it."""
    return F.col(held_name(name, field))


def _kept(name: str) -> Pick:
    return {f: held(name, f) for f in FIELDS}


def choose(branches: list[tuple[Column, Pick]], rest: Pick) -> Pick:
    """The pick of the first branch that holds, field by field."""
    chosen = {}
    for field in FIELDS:
        chain = F
        for condition, pick in branches:
            chain = chain.when(condition, pick[field])
        chosen[field] = chain.otherwise(rest[field])
    return chosen


def with_picks(df: DataFrame, picks: dict[str, Pick]) -> DataFrame:
    return df.withColumns({held_name(name, f): c for name, pick in picks.items() for f, c in pick.items()})


def with_structs(df: DataFrame, names) -> DataFrame:
    """Adds the struct ``pick_<strategy>`` to the columns the layers carry."""
    words = ", ".join(f"'{w}'" for w in _WORDS)
    text_of = lambda name, f: f"element_at(array({words}), {held_name(name, f)} + 1)"
    struct = lambda name: ", ".join(f"'{f}', {text_of(name, f)}" for f in FIELDS[:3])
    return df.withColumns({
        PREFIX + name: F.expr(f"named_struct({struct(name)}, 'stake', {held_name(name, 'stake')})") for name in names
    })


def odds_of(name: str) -> Column:
    odds = probs.market_odds()
    chain = F
    for outcome in OUTCOMES:
        chain = chain.when(held(name, "outcome") == code(outcome), odds[outcome])
    return chain.otherwise(0.0)


def signals(df: DataFrame) -> DataFrame:
    """Shared inputs of all strategies, one projection."""
    action, stake = labels.effective_action()
    batch = text("effective_action_source") == "target_batch_strategy"
    legacy, market = probs.triple("legacy"), probs.triple("market")
    return df.withColumns(
        {
            "s_action": F.when(batch, labels.action_label("algo_recommendation")).otherwise(action),
            "s_outcome": F.when(batch, text("algo_recommended_outcome")).otherwise(text("recommended_outcome")),
            "s_stake": F.when(batch, num("algo_suggested_stake_pct")).otherwise(stake),
            "s_legacy_top": probs.argmax(legacy),
            "s_legacy_margin": probs.margin(legacy),
            "s_market_top": probs.argmax(market),
            "s_market_margin": probs.margin(market),
            "s_direction": labels.score_direction("predicted_score"),
            "s_gf_gap": num("recent_home_gf_pg") - num("recent_away_gf_pg"),
            "s_split_gap": num("home_split_ppg") - num("away_split_ppg"),
            "s_xg_gap": (num("home_xg") - num("home_xga")) - (num("away_xg") - num("away_xga")),
            "s_xg": (num("xg_coverage") != 0)
            | (num("home_xg") != 0) | (num("home_xga") != 0) | (num("away_xg") != 0) | (num("away_xga") != 0),
        }
    )


def _base() -> Pick:
    conf, direction = num("confidence_score"), F.col("s_direction")
    away_unconfirmed = (F.col("s_outcome") == "away") & ((direction != "away") | (F.col("s_gf_gap") > -0.6))
    keep = (
        (F.col("s_action") != "watch") & (F.col("s_stake") > 0) & F.col("s_outcome").isin(*OUTCOMES) & ~away_unconfirmed
    )
    legacy_away = (
        (F.col("s_legacy_top") == "away") & (F.col("s_market_margin") >= 0.16) & (conf <= 0.86)
        & (num("legacy_away_prob") >= 0.40) & (F.col("s_gf_gap") >= -0.8)
    )
    market_home = (
        (F.col("s_market_top") == "home") & (F.col("s_market_margin") >= 0.16) & (F.col("s_market_margin") <= 0.34)
        & (conf <= 0.88) & (num("market_home_prob") >= 0.44) & (num("home_absent_count") <= num("away_absent_count"))
    )
    market_away = (
        (F.col("s_market_top") == "away") & (F.col("s_market_margin") >= 0.10) & (conf <= 0.88)
        & (num("market_away_prob") >= 0.52)
    )
    return choose(
        [
            (keep, pick_codes(F.col("s_outcome"), "core", "existing", F.col("s_stake"))),
            (legacy_away, pick_codes("away", "standard", "R1_legacy_away")),
            (market_home, pick_codes("home", "standard", "R2_market_home")),
            (market_away, pick_codes("away", "core", "R3_market_away")),
            ((direction == "draw") & (conf <= 0.82), pick_codes("draw", "core", "R4_score_draw")),
        ],
        watch("watch"),
    )


def _veto(parent: str, *guards: tuple[Column, str]) -> Pick:
    """First guard that fires turns the parent's pick into watch."""
    return choose([(condition, watch(reason)) for condition, reason in guards], _kept(parent))


def _is(parent: str, outcome: str | None = None, reason: str | None = None) -> Column:
    test = held(parent, "outcome") != code("")
    if outcome is not None:
        test = held(parent, "outcome") == code(outcome)
    if reason is not None:
        test = test & (held(parent, "reason") == code(reason))
    return test


def _league_in(leagues) -> Column:
    return text("league").isin(*leagues)


def _midlow_home(parent: str) -> Column:
    return (
        _is(parent, "home", "existing")
        & between(odds_of(parent), 1.30, 1.45)
        & (num("market_draw_prob") >= 0.18)
        & (num("market_away_prob") >= 0.13)
        & (num("h2h_edge") >= 0.0)
    )


def _fill(parent: str, dropped: Column | None, fills: list[tuple[Column, Pick]], rest: str) -> Pick:
    """Keep the parent's pick unless dropped; else the first fill that applies; else watch."""
    kept = _is(parent)
    if dropped is not None:
        kept = kept & ~dropped
    return choose([(kept, _kept(parent)), *fills], watch(rest))


def _home_in_odds() -> Column:
    return (F.col("s_market_top") == "home") & between(num("market_odds_home"), 1.80, 2.20)


def _legacy_thin_home() -> Column:
    return (F.col("s_legacy_top") == "home") & between(F.col("s_legacy_margin"), 0.05, 0.10)


#: Reasons of the fills that pick home; the stable score fill follows the score.
HOME_FILLS = (
    "fill_market_home_odds_180_220", "fill_legacy_home_margin_05_10", "fill_stable_market_home_odds_180_220",
    "fill_stable_legacy_home_margin_05_10", "fill_stable_market_home_draw_ge_30", "fill_stable_score_conf80",
    "fill_refined_market_home_prob50_low_draw", "fill_value_guarded_home_odds_180_220_score_home",
)
PRECISE_GUARDS = ("precise_league_guard", "precise_market_draw_pressure_guard", "precise_existing_home_midlow_draw_risk_guard")
for _word in HOME_FILLS:
    _WORDS.setdefault(_word, len(_WORDS))


def _filled_home(parent: str) -> Column:
    return _is(parent, "home") & held(parent, "reason").isin(*[_WORDS[r] for r in HOME_FILLS])


def _rescued() -> Column:
    """The reason of a rescue: only a precise guard can have fired."""
    chain = F
    for guard in PRECISE_GUARDS:
        chain = chain.when(held("precise", "reason") == code(guard), code(f"rescue_{guard}"))
    return chain


def _layers() -> list[tuple[str, Callable[[], Pick]]]:
    draw, away, home = num("market_draw_prob"), num("market_away_prob"), num("market_home_prob")
    conf, h2h, direction = num("confidence_score"), num("h2h_edge"), F.col("s_direction")
    absent_gap = num("home_absent_count") - num("away_absent_count")
    fill = lambda outcome, reason: pick_codes(outcome, "standard", reason)
    return [
        ("base", _base),
        ("league_guarded", lambda: _veto("base", (_is("base") & _league_in(GUARDED_LEAGUES), "league_guard"))),
        ("selective", lambda: _veto(
            "base",
            (_is("base", "home", "existing") & ((conf > 0.90) | (absent_gap > 2) | (h2h < 0)), "selective_existing_home_guard"),
        )),
        ("selective_league_guarded", lambda: _veto(
            "selective", (_is("selective") & _league_in(GUARDED_LEAGUES), "league_guard"))),
        ("strict", lambda: _veto(
            "selective_league_guarded",
            (
                _is("selective_league_guarded", "home", "R2_market_home")
                & ((~direction.isin("", "home")) | (conf > 0.84)),
                "strict_R2_home_guard",
            ),
        )),
        ("deep", lambda: _veto(
            "strict",
            (
                _is("strict", reason="existing") & (direction != "") & (code(direction) != held("strict", "outcome")),
                "deep_existing_score_conflict_guard",
            ),
        )),
        ("refined", lambda: _veto(
            "deep",
            (
                _is("deep", reason="existing") & _league_in(LOW_ODDS_LEAGUES) & (odds_of("deep") < 1.60),
                "refined_existing_low_odds_league_guard",
            ),
        )),
        ("hardened", lambda: _veto("refined", (_is("refined", "away") & (h2h <= -0.8), "hardened_away_h2h_guard"))),
        ("polished", lambda: _veto(
            "hardened",
            (
                _is("hardened", "away", "existing") & (odds_of("hardened") < 1.55) & (draw > 0.21),
                "polished_existing_away_draw_risk_guard",
            ),
        )),
        ("steady", lambda: _veto(
            "polished",
            (
                _is("polished", "home", "R2_market_home") & between(odds_of("polished"), 1.50, 1.80) & (draw >= 0.245),
                "steady_R2_home_draw_pressure_guard",
            ),
        )),
        ("precise", lambda: _veto(
            "steady",
            *zip(
                (_is("steady") & _league_in(CAUTIOUS_LEAGUES), _is("steady") & (draw >= 0.30), _midlow_home("steady")),
                PRECISE_GUARDS, strict=True,
            ),
        )),
        ("rescue", lambda: choose(
            [
                (_is("precise"), _kept("precise")),
                (~_is("steady"), _kept("steady")),
                (
                    (draw >= 0.19) & (h2h >= 0.0) & (odds_of("steady") < 3.20),
                    _kept("steady") | {"reason": _rescued()},
                ),
            ],
            watch(held("precise", "reason")),
        )),
        ("broad", lambda: _veto(
            "steady",
            (_midlow_home("steady"), "broad_existing_home_midlow_draw_risk_guard"),
            (_is("steady") & (draw >= 0.29), "broad_market_draw_pressure_guard"),
        )),
        ("cautious", lambda: _veto(
            "steady", (_is("steady") & _league_in(CAUTIOUS_LEAGUES), "cautious_league_guard"))),
        ("ultra", lambda: _veto(
            "steady",
            (
                (held("steady", "reason") == code("R4_score_draw"))
                & ((home < 0.39) | (away > home) | (num("legacy_away_prob") >= 0.40)),
                "ultra_draw_away_pressure_guard",
            ),
            (_midlow_home("steady"), "ultra_existing_home_midlow_draw_risk_guard"),
        )),
        ("clean", lambda: _veto(
            "steady", (reduce(or_, _raised().values()), "clean_observation_flag_guard"))),
        ("coverage_push", lambda: _fill(
            "base", None,
            [
                (_home_in_odds(), fill("home", "fill_market_home_odds_180_220")),
                (_legacy_thin_home(), fill("home", "fill_legacy_home_margin_05_10")),
            ],
            "coverage_push_watch",
        )),
        ("coverage_stable", lambda: _fill(
            "base", None,
            [
                (_home_in_odds() & ~_league_in(STABLE_FILL_SKIP_LEAGUES), fill("home", "fill_stable_market_home_odds_180_220")),
                (_legacy_thin_home(), fill("home", "fill_stable_legacy_home_margin_05_10")),
                ((F.col("s_market_top") == "home") & (draw >= 0.30), fill("home", "fill_stable_market_home_draw_ge_30")),
                (direction.isin(*OUTCOMES) & (conf <= 0.80), fill(direction, "fill_stable_score_conf80")),
            ],
            "coverage_stable_watch",
        )),
        ("coverage_refined", lambda: _fill(
            "coverage_stable", _is("coverage_stable", "home") & (draw >= 0.31),
            [
                (
                    (F.col("s_market_top") == "home") & (home >= 0.50) & (draw < 0.22),
                    fill("home", "fill_refined_market_home_prob50_low_draw"),
                )
            ],
            "coverage_refined_watch",
        )),
        ("coverage_value_guarded", lambda: _fill(
            "coverage_refined", _filled_home("coverage_refined") & (num("value_ratio") >= 3.0),
            [
                (
                    _home_in_odds() & (direction == "home")
                    & ((num("value_ratio") == 0.0) | (num("value_ratio") >= 0.90)),
                    fill("home", "fill_value_guarded_home_odds_180_220_score_home"),
                )
            ],
            "coverage_value_guarded_watch",
        )),
        ("coverage_xg_guarded", lambda: _veto(
            "coverage_value_guarded",
            (
                _filled_home("coverage_value_guarded") & F.col("s_xg") & (F.col("s_xg_gap") < -0.50),
                "xg_guarded_home_fill_net_gap_guard",
            ),
        )),
    ]


# Strategies by depth: a stage only reads picks of earlier stages.
STAGES = (
    ("base",),
    ("league_guarded", "selective", "coverage_push", "coverage_stable"),
    ("selective_league_guarded", "coverage_refined"),
    ("strict", "coverage_value_guarded"),
    ("deep", "coverage_xg_guarded"),
    ("refined",),
    ("hardened",),
    ("polished",),
    ("steady",),
    ("precise", "broad", "cautious", "ultra"),
    ("rescue",),
    ("clean",),
)
FLAG_LAYERS = ("rescue", "broad", "cautious", "ultra")


def _raised() -> dict[str, Column]:
    return {f: _is("steady") & ~_is(f) for f in FLAG_LAYERS}


def raised_flags() -> Column:
    """Observation layers that drop the production pick, in fixed order."""
    return F.array_compact(F.array(*[F.when(raised, F.lit(f)) for f, raised in _raised().items()]))


def row_picks(df: DataFrame, upto: str | None = None) -> DataFrame:
    """Adds ``pick_<strategy>`` for every row-local strategy (or the chain up to one)."""
    df = signals(df)
    layers = dict(_layers())
    built = []
    for stage in STAGES:
        df = with_picks(df, {name: layers[name]() for name in stage})
        built += stage
        if upto in stage:
            return with_structs(df, built)
    df = with_structs(df, built)
    for name, build in _EXTENSIONS.items():
        df = df.withColumn(PREFIX + name, build())
    return df


def ranked_candidate() -> Column:
    """Best of the scored home/draw/away candidates as struct<score, order, outcome, reason>."""
    draw, xg_gap, ratio_ = num("market_draw_prob"), F.col("s_xg_gap"), num("value_ratio")
    valued = num("value_available") != 0
    agrees = lambda o: (F.col("s_market_top") == o) & (F.col("s_direction") == o)
    home = (
        F.greatest(F.lit(0.0), num("market_home_prob") - 0.44) * 10.0
        + F.greatest(F.lit(0.0), 0.30 - draw) * 5.0
        + F.greatest(F.lit(0.0), F.col("s_split_gap")) * 0.5
        + F.when(F.col("s_xg"), F.greatest(F.lit(0.0), xg_gap) * 0.8).otherwise(0.0)
        + F.when(between(num("market_odds_home"), 1.50, 2.30), 0.8).otherwise(0.0)
        - F.when(valued & (ratio_ >= 8.0), 1.2).otherwise(0.0)
    )
    drawn = (
        (draw - 0.27) * 8.0
        + (0.5 - F.least(F.abs(xg_gap), F.lit(0.5))) * 0.5
        + F.when(between(num("market_odds_draw"), 2.80, 3.60), 0.5).otherwise(0.0)
    )
    away = (
        F.greatest(F.lit(0.0), num("market_away_prob") - 0.44) * 10.0
        + F.greatest(F.lit(0.0), 0.28 - draw) * 4.0
        - F.when(valued & (ratio_ > 1.2), 1.0).otherwise(0.0)
    )
    entry = lambda cond, score, order, o: F.when(
        cond,
        F.struct(score.alias("score"), F.lit(order).alias("order"), F.lit(o).alias("outcome"), F.lit(f"rank_{o}").alias("reason")),
    )
    # At most one direction can hold, so the candidates never compete.
    return F.coalesce(
        entry(agrees("home"), home, 2, "home"),
        entry((F.col("s_direction") == "draw") & (draw >= 0.27), drawn, 1, "draw"),
        entry(agrees("away"), away, 0, "away"),
    )


def with_draw_rescue(df: DataFrame) -> DataFrame:
    """Adds ``pick_coverage_draw_rescue``: row picks, then one scored pick per period, then draws.

    The per-period winner is a ``max(struct)`` aggregate, combined map-side, so
    a period holding most rows costs one row per task on the wire.  Ties on the
    score go to the newest settlement.  Only that axis-sized frame is joined
    back, by broadcast, so the picks are not shuffled.  Expects :func:`row_picks`.
    """
    parent = "coverage_value_guarded"
    guarded = _filled_home(parent) & F.col("s_xg") & (F.col("s_xg_gap") < 0.25)
    df = df.withColumn("_kept", _is(parent) & ~guarded).withColumn(
        "_cand", F.when(~F.col("_kept"), ranked_candidate())
    )
    df = df.withColumn("_cand", F.when(F.col("_cand.score") > 0, F.col("_cand")))
    # A filter here would be pushed below the layers and inline all of them, so the
    # bound leaves through a one-element generator.  A maximum of structs sorts its
    # input; only rows that can win reach it.
    entry = F.when(F.col("_cand.score") >= 2.0, F.struct("_cand.score", "feedback_id", "match_id"))
    winners = (
        df.select("period", F.explode(F.array(entry)).alias("_e")).filter("_e is not null")
        .groupBy("period").agg(F.max("_e").alias("_w")).select("period", F.col("_w.match_id").alias("_winner"))
    )
    # One row per period: a plain join would shuffle all picks by period before its size is known.
    df = df.join(F.broadcast(winners), "period", "left")
    cand = F.col("_cand")
    late_draw = (
        (cand["outcome"] == "draw") & (cand["score"] >= 0.5)
        & (~F.col("s_xg") | (F.col("s_xg_gap") >= 0.5)) & (F.col("s_split_gap") >= 0.0)
    )
    ranked = reduce(lambda c, o: c.when(cand["reason"] == f"rank_{o}", code(f"draw_rescue_rank_{o}")), OUTCOMES, F)
    result = choose(
        [
            (F.col("_kept"), _kept(parent)),
            (
                cand.isNotNull() & (F.col("match_id") == F.col("_winner")),
                pick_codes(cand["outcome"], "standard", ranked),
            ),
            (late_draw, pick_codes("draw", "standard", "draw_rescue_xg_split_draw")),
        ],
        watch("coverage_draw_rescue_watch"),
    )
    df = with_picks(df, {"coverage_draw_rescue": result}).drop("_kept", "_cand", "_winner")
    return with_structs(df, ["coverage_draw_rescue"])


def all_picks(df: DataFrame) -> DataFrame:
    return with_draw_rescue(row_picks(df))


def settle_pick(pick: Column) -> dict[str, Column]:
    """Additive facts of one pick against the stored result."""
    outcome, stake = pick["outcome"], pick["stake"]
    acted = outcome != ""
    hit = acted & (outcome == F.col("actual_result"))
    odds = probs.pick(probs.market_odds(), outcome)
    units = stake / 100.0
    return {
        "acted": acted.cast("int"),
        "hit": hit.cast("int"),
        "odds": odds,
        "stake_units": F.when(acted, units).otherwise(0.0),
        "roi": F.when(~acted, 0.0).when(hit & (odds > 0), units * (odds - 1.0)).otherwise(-units),
    }


NO_ACTION, MISS, HIT, UNJUDGED = "0", "1", "2", "3"


def verdict_cells(df: DataFrame, keys: list[str], variants=ROW_LOCAL) -> DataFrame:
    """Fixtures counted (``n``) by key and by what the picks of all ``variants`` came to, with each one's money sums.

    ``verdicts`` has a digit per strategy: no action, a miss, a hit, an action without
    a stored result.  The picks of a fixture follow from one another, so few combinations
    occur: one partial aggregate over the fixtures as they are serves every strategy, and
    a row per fixture and strategy is never made.  The sums are those of
    :func:`settle_pick`, as SQL text because a call per expression node takes long to plan.
    """
    odds = probs.pick(probs.market_odds(), F.col("actual_result"))
    gain = F.when(odds > 0, odds - 1.0).otherwise(-1.0)  # a hit has the odds of the result
    rows = df.withColumns({"_gain": gain, "_result": code(F.col("actual_result"))})
    verdicts, money = [], {}
    for name in variants:
        if name in _EXTENSIONS:
            outcome, none, result, stake = f"{PREFIX}{name}.outcome", "''", "actual_result", f"{PREFIX}{name}.stake"
        else:
            outcome, none, result, stake = held_name(name, "outcome"), "0", "_result", held_name(name, "stake")
        units, hit = f"{stake} / 100D", f"{outcome} = {result}"
        verdicts.append(
            f"CASE WHEN {outcome} <> {none} THEN CASE WHEN {hit} THEN '{HIT}' WHEN {result} IS NULL THEN '{UNJUDGED}'"
            f" ELSE '{MISS}' END ELSE '{NO_ACTION}' END"
        )
        money[f"roi_{name}"] = f"CASE WHEN {outcome} <> {none} THEN {units} * CASE WHEN {hit} THEN _gain ELSE -1D END ELSE 0D END"
        money[f"stake_units_{name}"] = f"CASE WHEN {outcome} <> {none} THEN {units} ELSE 0D END"
    return (
        rows.selectExpr(*keys, f"concat({', '.join(verdicts)}) AS verdicts", *[f"{m} AS {n}" for n, m in money.items()])
        .groupBy(*keys, "verdicts").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({n})").alias(n) for n in money])
    )


def cell_facts(place: str, variants: dict[str, str]) -> list[str]:
    """SQL of one strategy's additive facts in a cell: its place among the digits, and the strategies by a test for each."""
    verdict = f"substring(verdicts, {place}, 1)"
    of = lambda fact: "CASE " + " ".join(f"WHEN {t} THEN {fact}_{v}" for v, t in variants.items()) + " END"
    return [
        f"CASE WHEN {verdict} <> '{NO_ACTION}' THEN n ELSE 0L END AS acted",
        f"CASE {verdict} WHEN '{HIT}' THEN n WHEN '{UNJUDGED}' THEN NULL ELSE 0L END AS hit",
        f"{of('roi')} AS roi",
        f"{of('stake_units')} AS stake_units",
    ]


def variant_cells(df: DataFrame, keys: list[str], variants=None) -> DataFrame:
    """One row per cell and strategy, with keys, fixtures and additive facts."""
    variants = tuple(variants or VARIANT_ROLES)
    names = ", ".join(f"'{v}'" for v in variants)
    cells = verdict_cells(df, keys, variants).selectExpr("*", f"posexplode(array({names})) AS (place, variant)")
    # Facts are chosen behind the generator, so those a report does not ask for are not summed at all.
    return cells.selectExpr(*keys, "variant", "n", *cell_facts("place + 1", {v: f"variant = '{v}'" for v in variants}))


def actions_of(
    df: DataFrame, strategy: str, where: Column | None = None, extra: dict[str, Column] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The acted rows of one strategy with the fields its reports group by.

    The fields leave through a one-element generator: a filter on a generated
    column stays above it, while a filter on a layered pick would be pushed
    through a dozen projections and inline every layer into itself.
    """
    pick = picked(strategy)
    facts = settle_pick(pick)
    acted = pick["outcome"] != ""
    fields = {
        "keep": acted if where is None else acted & where,
        "outcome": pick["outcome"],
        "tier": pick["tier"],
        "reason": pick["reason"],
        "stake_pct": pick["stake"],
        "action": F.when(pick["tier"] == "core", "main").otherwise("light"),
        "hit": facts["hit"],
        "roi": facts["roi"],
        "stake_units": facts["stake_units"],
        "pick_odds": facts["odds"],
        "odds_band": labels.odds_band(facts["odds"]),
        "confidence_band": labels.confidence_band(num("confidence_score")),
        "score_alignment": labels.score_alignment(pick["outcome"], F.col("s_direction")),
        **(extra or {}),
    }
    kept = carry or REPORT_COLUMNS
    entry = F.struct(*[c.alias(n) for n, c in fields.items()])
    rows = df.select(*kept, F.explode(F.array(entry)).alias("e")).filter(F.col("e.keep"))
    return rows.select(*kept, *[F.col(f"e.{n}").alias(n) for n in fields if n != "keep"])


REPORT_COLUMNS = [
    "match_id", "feedback_id", "period", "league", "home_team", "away_team", "actual_result", "predicted_score",
    "market_home_prob", "market_draw_prob", "market_away_prob", "confidence_score", "quality_score",
]
