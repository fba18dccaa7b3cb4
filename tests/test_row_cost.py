"""What a row costs: texts are read once, picks are not shuffled, generated methods stay within what the JIT compiles."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlark.fixed_values import RECORD_PATTERN, VARIANT_ROLES
from ledgerlark.operators import extract, features, observation, stability, strategies
from ledgerlark.plans import adapters, queries_backtest, queries_features, queries_learning


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_matched_once(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert optimised(extract.with_captures(df, {"g": ("t", RECORD_PATTERN, 9)})).count("regexp_extract(") == 1
    notes = optimised(extract.lineup_metrics(df, "t").select("home_absent_count", "home_availability", "data_available"))
    assert notes.count("regexp_extract(") == 1


def test_a_payload_group_is_parsed_once(spark):
    df = features.with_payload(spark.createDataFrame([("{}",)], "feature_payload string"))
    kept = optimised(df.select("p_recent_home", "p_split"))
    assert kept.count("from_json(") == 3  # the payload and two groups


def test_snapshot_payload_is_read_back_in_one_pass(spark):
    assert "get_json_object" not in optimised(queries_features.feature_snapshots(spark, SF))


def test_picks_are_not_shuffled_by_period(spark):
    plan = physical(queries_backtest.strategy_picks(spark, SF))
    assert plan.count("Exchange hashpartitioning(period") == 1  # the winners' own aggregate


def test_method_limit_is_set_unless_the_session_names_one(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for given, expected in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            adapters.wide(spark, SF).select(F.lit(1))
            assert spark.conf.get(key) == expected
    finally:
        spark.conf.set(key, before)


def test_learning_rows_are_not_shuffled_by_period(spark):
    plan = physical(queries_learning.rows(spark, SF).select("match_id", "period_rank"))
    assert plan.count("Exchange hashpartitioning(period") == 1  # the axis' own distinct


def test_a_value_line_is_matched_once_per_pattern(spark):
    said = ["EUR 1,5 BN\nx 20 Mil €", "€3\r\nx 4k EUR", "EUR 0\n7 K € EUR 9m\n5 Th EUR", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", extract.team_values("s").alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [[1500.0, 20.0], [3.0, 0.004], [9.0, 0.005], [], []]
    shown = optimised(df)
    assert shown.count("regexp_extract(") == 6 and "regexp_replace(" not in shown  # two on the line, four on the short match


def test_fixtures_are_counted_before_they_meet_the_strategies(spark):
    picks = queries_backtest.row_picks(spark, SF)
    for df in (stability.variant_periods(picks, strategies.ROW_LOCAL), observation.deltas(picks)):
        plan = optimised(df)
        assert plan.rindex("Generate ") < plan.rindex("Aggregate ")  # printed from the top: no generator below the first aggregate


def test_readiness_scores_its_fixtures_once(spark):
    df = queries_backtest.observation_readiness(spark, SF)
    assert len(df.collect()) == 11
    final = physical(df).split("== Initial Plan ==")[0]
    assert final.count("date_format(") == 1  # the period of a fixture, at the foot of the layers


def test_layers_carry_only_the_fields_a_report_reads(spark):
    assert "steady_R2_home_draw_pressure_guard" not in optimised(queries_backtest.observation_readiness(spark, SF))


def test_cell_facts_are_those_of_the_picks(spark):
    odd = adapters.wide(spark, SF).withColumns({
        "actual_result": F.when(F.col("match_id") % 5 == 0, F.lit(None)).when(F.col("match_id") % 7 == 0, "void").otherwise(F.col("actual_result")),
        "market_odds_home": F.when(F.col("match_id") % 3 == 0, 0.0).when(F.col("match_id") % 4 == 0, F.lit(None)).otherwise(F.col("market_odds_home")),
    })
    strategies.register_strategy("own", lambda: strategies.make_pick(F.when(F.col("match_id") % 2 == 0, "other").otherwise("home"), "core", "own", 2.5))
    try:
        picks = strategies.all_picks(odd)
        names = [*VARIANT_ROLES, "own"]
        facts = [F.struct(F.lit(v).alias("variant"), *[c.alias(n) for n, c in strategies.settle_pick(strategies.picked(v)).items()]) for v in names]
        rows = picks.select("period", F.explode(F.array(*facts)).alias("e")).select("period", "e.*")
        plain = rows.groupBy("variant", "period").agg(
            F.count(F.lit(1)), F.sum("acted"), F.sum("hit"), F.sum("roi"), F.sum("stake_units"))
        expected = {(r[0], r[1]): r[2:] for r in plain.collect()}
        found = {(r.variant, r.period): (r.samples, r.actions, r.hits, r.roi, r.stake) for r in stability.variant_periods(picks, names).collect()}
    finally:
        del strategies._EXTENSIONS["own"]
    assert found.keys() == expected.keys()
    for key, values in found.items():
        assert values == pytest.approx(tuple(expected[key]), abs=1e-9), key
