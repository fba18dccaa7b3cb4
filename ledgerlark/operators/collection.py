"""What a collected match lacks, why its collection counts as failed, and which matches to collect again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numeric import ratio, round_to, text

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _clean(value: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(value), r"(?U)\s+", " "))


def _lines(value: Column | str) -> Column:
    """Non-empty lines, cleaned, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text(value), LINE_END), _clean), lambda x: x != ""))


def _placeholder(value: Column) -> Column:
    held = F.lit(False)
    for p in V.COLLECTION_PLACEHOLDERS:
        held = held | F.contains(value, F.lit(p))
    return held


def missing_dimensions(fields: dict[str, str] = V.REQUIRED_DIMENSIONS) -> Column:
    """Names of required fields that are empty or hold a placeholder, then of those that the quality log calls missing."""
    gaps = [F.when((_clean(f) == "") | _placeholder(_clean(f)), F.lit(name)) for f, name in fields.items() if f not in V.OPTIONAL_DIMENSIONS]
    names = F.create_map(*[F.lit(x) for kv in fields.items() if kv[0] not in V.OPTIONAL_DIMENSIONS for x in kv])
    told = F.filter(_lines("collection_quality_summary"), lambda x: F.contains(x, F.lit("status=missing")))
    logged = F.transform(told, lambda x: F.try_element_at(names, F.substring_index(F.substring_index(x, ":", 1), ".", -1)))
    return F.array_distinct(F.array_compact(F.concat(F.array(*gaps), logged)))


def failure_reason(stored: Column, missing: Column | None = None) -> Column:
    """Why a match's collection failed, '' where it did not; ``stored`` says whether it has an analysis row at all.

    First come a missing row and one that was never collected; then the first failure line of the remarks, where lines
    about missing dimensions hold only as long as something is missing; then what is missing, unless the row is marked
    a success.
    """
    t = V.COLLECTION_TEXTS
    missing = missing_dimensions() if missing is None else missing
    count, shown = F.size(missing), F.array_join(F.slice(missing, 1, V.SHOWN_DIMENSIONS), "、")
    listed = F.concat(F.lit(t["missing"]), shown, F.when(count > V.SHOWN_DIMENSIONS, F.concat(F.lit(" 等 "), count.cast("string"), F.lit(" 项"))).otherwise(""))
    failures = F.filter(_lines("remarks"), lambda x: x.startswith(t["failure_prefix"]))
    lasting = F.get(F.filter(failures, lambda x: (count > 0) | ~x.startswith(t["missing_prefix"])), F.lit(0))
    return (
        F.when(~stored, t["no_row"]).when(_clean("collected_at") == "", t["uncollected"])
        .when(lasting.startswith(t["missing_prefix"]), listed).when(lasting.isNotNull(), lasting)
        .when(_clean("collection_status") == "success", "").when(count > 0, listed).otherwise("")
    )


def needs_retry(stored: Column) -> Column:
    """No row, never collected, marked failed, remarks that begin with a failure, or any required field (optional ones too) not usable."""
    bad = ~stored | (F.trim(text("collected_at")) == "") | (F.trim(text("collection_status")) == "failed") | text("remarks").startswith(V.COLLECTION_TEXTS["failure_prefix"])
    for f in V.REQUIRED_DIMENSIONS:
        bad = bad | (F.trim(text(f)) == "") | _placeholder(text(f))
    return bad


def collection_outcomes(matches: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every match with what is missing, the failure reason, and whether to collect it again.

    One analysis per match counts, that of the latest collection; matches keep one row each.
    """
    wanted = [*V.REQUIRED_DIMENSIONS, "remarks", "collection_status", "collection_quality_summary"]
    newest = analyses.groupBy("match_id").agg(F.max(F.struct("collected_at", *wanted)).alias("_a"))
    rows = matches.select("match_id", "period").join(newest, "match_id", "left").select("match_id", "period", F.col("_a").isNotNull().alias("_stored"), "_a.*")
    rows = rows.withColumn("missing_dimensions", F.when(F.col("_stored"), missing_dimensions()).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "match_id", "period", "missing_dimensions", failure_reason(F.col("_stored"), F.col("missing_dimensions")).alias("failure_reason"), needs_retry(F.col("_stored")).alias("needs_retry")
    )


def retry_summary(outcomes: DataFrame) -> DataFrame:
    """Per period: matches, those to collect again, those with a reason, and the share that is fine."""
    counted = outcomes.groupBy("period").agg(
        F.count(F.lit(1)).alias("match_count"), F.count_if("needs_retry").alias("retry_count"), F.count_if(F.col("failure_reason") != "").alias("failed_count"),
        F.sum(F.size("missing_dimensions")).alias("missing_count"),
    )
    return counted.withColumn("complete_share", round_to(ratio(F.col("match_count") - F.col("retry_count"), F.col("match_count")), 6))
