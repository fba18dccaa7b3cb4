"""Failure reasons and retries of single rows."""

from ledgerlark import fixed_values as V
from ledgerlark.operators import collection

T = V.COLLECTION_TEXTS
LONG = list(V.REQUIRED_DIMENSIONS.values())[3:]


def _outcome(spark, remarks="", status="", summary="", at="2024", **fields):
    full = {f: "x" for f in V.REQUIRED_DIMENSIONS} | fields
    cols = {"match_id": 1, "collected_at": at, "remarks": remarks, "collection_status": status, "collection_quality_summary": summary, **full}
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} {'long' if c == 'match_id' else 'string'}" for c in cols))
    matches = spark.createDataFrame([(1, "1")], "match_id long, period string")
    r = collection.collection_outcomes(matches, row if at != "none" else row.where("false")).first()
    return r["failure_reason"], r["needs_retry"], r["missing_dimensions"]


def test_order_of_reasons(spark):
    assert _outcome(spark, at="none") == (T["no_row"], True, [])
    assert _outcome(spark, at=" ")[:2] == (T["uncollected"], True)
    assert _outcome(spark) == ("", False, [])
    # an optional field alone is a reason to collect again, but no failure; a failed mark without gaps likewise
    assert _outcome(spark, elo_home="") == ("", True, []) and _outcome(spark, status="failed") == ("", True, [])
    # a line about missing fields holds only while something is missing; the next failure line then counts
    stale = T["missing_prefix"] + "old\r\nnote\n" + T["failure_prefix"] + "no  page"
    assert _outcome(spark, stale) == (T["failure_prefix"] + "no page", True, [])
    heat = V.REQUIRED_DIMENSIONS["betting_heat_summary"]
    assert _outcome(spark, stale, betting_heat_summary="\t")[0] == T["missing"] + heat
    assert _outcome(spark, status="success", betting_heat_summary=None) == ("", True, [heat])
    assert _outcome(spark, summary="a.b.betting_heat_summary: status=missing; x\na.elo_home: status=missing")[::2] == (T["missing"] + heat, [heat])
    many = _outcome(spark, **{f: "" for f in V.REQUIRED_DIMENSIONS})
    assert many[2] == LONG and many[0] == T["missing"] + "、".join(LONG[:8]) + " 等 9 项"
