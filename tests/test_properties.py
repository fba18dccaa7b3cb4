"""Invariants and brute-force comparisons on small data."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlark import fixed_values as V
from ledgerlark.functions import policy, probs
from ledgerlark.operators import joins, learning, ledger, metrics, stability, strategies
from ledgerlark.plans import adapters


@pytest.fixture(scope="module")
def wide(spark):
    return adapters.wide(spark, SF).cache()


@pytest.fixture(scope="module")
def learn(wide):
    return learning.learning_window(metrics.with_settlement(wide), 90).cache()


def test_probabilities_are_normal(wide):
    p = probs.calibrate(probs.triple("final"), F.lit(1.3), {o: F.lit(0.1) for o in V.OUTCOMES})
    row = wide.select(probs.total(p).alias("s"), F.least(*p.values()).alias("lo")).agg(
        F.max(F.abs(F.col("s") - 1)).alias("e"), F.min("lo").alias("lo")).first()
    assert row.e < 1e-12 and row.lo > 0


def test_grouping_and_period_totals_agree(wide):
    frame = stability.variant_periods(strategies.row_picks(wide), ["base", "steady"])
    per = {r.variant: r.asDict() for r in frame.groupBy("variant").agg(F.sum("samples").alias("n"), F.sum("actions").alias("a")).collect()}
    assert per["base"]["n"] == wide.count()
    assert per["steady"]["a"] <= per["base"]["a"]


def test_rolling_equals_brute_force(wide):
    frame = stability.variant_periods(strategies.row_picks(wide, "base"), ["base"]).collect()
    rows = sorted(frame, key=lambda r: int(r.period))
    windows = [rows[i:i + 10] for i in range(len(rows) - 9)]
    worst = min(sum(r.hits for r in w) / (sum(r.actions for r in w) or 1) if sum(r.actions for r in w) else 0.0 for w in windows)
    report = stability.rolling_report(stability.variant_periods(strategies.row_picks(wide, "base"), ["base"])).first()
    assert report.window_count == len(windows)
    assert report.min_hit_rate == pytest.approx(worst, abs=1e-6)


def test_handicap_cube_equals_direct_rules(learn):
    rows = learning.handicap_sides(learn).select("is_validation", "_side", "_action", "_ev", "_cover", "_margin", "_odds", "_hit", "handicap_confidence", "quality_score").collect()
    cube = {r.rule_id: r for r in learning.handicap_rules(learn).collect()}
    g = V.HANDICAP_GRID
    sizes = [len(g[k]) for k in learning.H_ORDER]
    rng = random.Random(7)
    for _ in range(60):
        pos = [rng.randrange(s) for s in sizes]
        ev, conf, cov, mar, qual, cap, side, act = (g[k][i] for k, i in zip(learning.H_ORDER, pos))
        passing = [
            r for r in rows
            if not r.is_validation and r._odds > 0 and r._odds <= cap and r._ev >= ev and r.handicap_confidence >= conf and r._cover >= cov
            and r._margin >= mar and r.quality_score >= qual and side in ("any", r._side)
            and (act == "any" or (act == "active" and r._action in ("light", "main")) or act == r._action)
        ]
        rule = 0
        for p, s in zip(pos, sizes):
            rule = rule * s + p
        got = cube.get(rule)
        assert (got.train_actions if got else 0) == len(passing)
        assert (got.train_hits if got else 0) == sum(r._hit for r in passing)


def test_walk_forward_sees_only_the_past(learn):
    folds = learning.walk_forward(learn).collect()
    sizes = {r.period_rank: r["count"] for r in learn.groupBy("period_rank").count().collect()}
    assert folds
    for f in folds:
        assert f.train_samples == sum(n for k, n in sizes.items() if k < f.period_rank)
        assert f.validation_samples == sizes[f.period_rank]


def test_gate_search_equals_direct_replay(learn):
    search = {(r.gate_id, r.promote_id): r for r in learning.gate_search(learn).collect()}
    assert len(search) == 729 * 27 or not search
    combos = learning._gate_positions(learning.GATE_NAMES)
    for gate_id in (0, 364, 728):
        values = dict(zip(learning.GATE_NAMES, combos[gate_id]))
        gates = {lv: {k: F.lit(float(values[f"{lv}_{k}"])) for k in ("ev", "confidence", "market_bias")} | {
            "quality": F.lit(V.BASE_GATES[lv]["quality"])} for lv in ("main", "light")}
        p = probs.normalise(probs.triple("final"), V.EPSILON)
        market = probs.effective_market(probs.triple("market"), probs.market_odds())
        direct = policy.action_policy(learn.filter("not is_validation"), p, gates, selected=probs.argmax(market))
        acted = direct.agg(F.count_if(F.col("policy_stake") > 0)).first()[0]
        assert search[(gate_id, 0)].train_algo_actions == acted


def test_feed_upsert_is_idempotent_and_keeps_results(spark):
    target = spark.createDataFrame([(1, "a", 1, "home"), (2, "b", 1, "")], "match_id long, league string, sync_time int, actual_result string")
    feed = spark.createDataFrame([(1, "a2", 2), (1, "old", 0), (3, "c", 5)], "match_id long, league string, sync_time int")
    once = ledger.upsert_feed(target, feed, protected=("actual_result",))
    twice = ledger.upsert_feed(once, feed, protected=("actual_result",))
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect()))
    assert rows == [(1, "a2", 2, "home"), (2, "b", 1, ""), (3, "c", 5, None)]


def test_asof_handles_one_hot_key(spark):
    rng = random.Random(3)
    runs = [(1 if i % 3 else i, rng.randrange(100000), i) for i in range(600)]
    asks = [(1 if i % 2 else i, rng.randrange(100000), 1000 + i) for i in range(200)]
    to_df = lambda rows, name: spark.createDataFrame(rows, f"k long, s long, {name} long").withColumn("ts", F.timestamp_seconds("s"))
    out = joins.asof_running(to_df(asks, "ask"), to_df(runs, "run_id"), "k", "ts", "run_id", "ask", width_seconds=500).collect()
    assert len(out) == len(asks)
    want = {a: max((r for k2, s2, r in runs if k2 == k and s2 <= s), default=None) for k, s, a in asks}
    assert {r.ask: r.run_id for r in out} == want


def test_renumber_is_dense(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k")
    got = ledger.renumber(df, "k", "n", 10).agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (11, 10 + df.count(), df.count())


def test_settlement_twice_is_the_same(spark):
    from ledgerlark.operators import settle

    parts = [adapters.load(spark, SF, n) for n in ("matches", "fetched", "runs")]
    # Run ids are unique by contract; the derived ids collide once at this scale.
    parts[2] = ledger.latest(parts[2], ["run_id"], [F.col("match_id")])
    feedback = ledger.latest(adapters.load(spark, SF, "feedback"), ["run_id"], [F.col("match_id")])
    first = settle.settle(*parts, feedback).filter("skip_reason = ''")
    again = feedback.join(first.select("match_id"), "match_id", "left_anti").select("run_id", "roi_delta", "roi_source", "notes").unionByName(
        first.select("run_id", "roi_delta", "roi_source", "notes"))
    second = settle.settle(*parts, again).filter("skip_reason = ''")
    cols = ["match_id", "run_id", "roi_delta", "roi_source", "notes"]
    assert sorted(map(tuple, first.select(*cols).collect())) == sorted(map(tuple, second.select(*cols).collect()))


def test_expanded_rules_equal_direct_filters(learn):
    """Random candidates of the expanded search against a plain Python evaluation."""
    top = learning.outcome_rules(learn).select("rule_id", *learning.O_ORDER).orderBy("rule_id").collect()
    rng = random.Random(11)
    tried = [(rng.randrange(len(top)), rng.randrange(11), rng.randrange(18)) for _ in range(25)]
    bases = [top[place].rule_id for place, _, _ in tried]
    extra = learning.filter_columns()
    packed = learn.withColumn("_x", F.struct(*[c.alias(n) for n, c in extra.items()]))
    rows = [r for r in learning.direction_rows(packed, ["is_validation", "_x"]).collect() if not r.is_validation]
    all_rules = learning.expanded_rules(learn).withColumn("base", F.floor(F.col("rule_id") / learning.VARIANTS_PER_RULE))
    got = {(r.base, r.cat, r.struct): r for r in all_rules.filter(F.col("base").isin(bases)).collect()}
    signed = lambda r, gap: {"home": r._x[gap], "away": -r._x[gap]}.get(r.outcome, -abs(r._x[gap]))
    g = V.OUTCOME_GRID
    for place, cat, struct in tried:
        rule = top[place]
        cats = V.CATEGORY_FILTERS[cat - 1] if cat else {}
        gaps = V.STRUCTURAL_FILTERS[struct - 1] if struct else {}
        floors = (("prob_min", "prob"), ("market_prob_min", "market_prob"), ("quality_min", "quality"), ("confidence_min", "confidence"),
                  ("ev_min", "ev"), ("prob_margin_min", "prob_margin"), ("ev_margin_min", "ev_margin"))
        passing = [
            r for r in rows
            if r.direction == rule.direction and 0 < r.odds <= g["odds_max"][rule.odds_max]
            and all(r[c] >= g[k][rule[k]] for k, c in floors)
            and all((r.outcome if k == "outcomes" else r._x[k]) in v for k, v in cats.items())
            and all(signed(r, k) >= v for k, v in gaps.items())
        ]
        found = got.get((rule.rule_id, cat, struct))
        assert (found.train_actions if found else 0) == len(passing)
        assert (found.train_hits if found else 0) == sum(r.hit for r in passing)
