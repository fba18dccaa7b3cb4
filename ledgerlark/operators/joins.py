"""Join operators the engine has no single primitive for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import text


def star(feedback: DataFrame, runs: DataFrame, snapshots: DataFrame, analyses: DataFrame, matches: DataFrame) -> DataFrame:
    """Settlements with their run, match, snapshot and analysis.

    No hints: the sides grow with the data and AQE picks per stage.  Inner
    joins come first so that the optional sides are only matched to settled rows.
    """
    base = feedback.join(runs, "run_id").join(matches, "match_id")
    return base.join(snapshots, "match_id", "left").join(analyses, "match_id", "left")


def canonical_run(runs: DataFrame, kickoffs: DataFrame, kickoff: str = "match_time", created: str = "created_at") -> DataFrame:
    """Per match: newest run made before kickoff, else newest run with a readable time.

    One kickoff per match, so the as-of choice is two conditional ``max`` over
    an equi join, combined map-side.
    """
    joined = kickoffs.select("match_id", kickoff).join(runs.select("match_id", "run_id", created), "match_id", "left")
    before = F.max(F.when(F.col(created) <= F.col(kickoff), F.col("run_id")))
    readable = F.max(F.when(F.col(created).isNotNull(), F.col("run_id")))
    any_run = F.max("run_id")
    agg = joined.groupBy("match_id").agg(
        F.max(kickoff).alias("_k"), before.alias("_before"), readable.alias("_readable"), any_run.alias("_any")
    )
    timed = F.col("_k").isNotNull()
    return agg.select(
        "match_id",
        F.when(timed, F.coalesce("_before", "_readable")).alias("run_id"),
        F.when(~timed, "kickoff_unreadable").when(F.col("_any").isNull(), "no_run")
        .when(F.col("_readable").isNull(), "run_time_unreadable").otherwise("").alias("reason"),
    )


def asof_running(
    left: DataFrame, right: DataFrame, key: str, ts: str, value: str, left_id: str, width_seconds: int = 3600
) -> DataFrame:
    """For every left row the largest ``value`` of right rows of its key up to its time.

    Linear, no range join.  Each key's time axis is cut into buckets so that
    one hot key spreads over many tasks: a running maximum inside the bucket,
    and a carried maximum from earlier buckets computed on one row per (key, bucket).
    """
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width_seconds * 1_000_000)).alias("_b")
    marks = right.select(key, ts, F.col(value).alias("_v"), F.lit(None).cast("long").alias("_id"), F.lit(0).alias("_side"), bucket)
    asks = left.select(key, ts, F.lit(None).cast("long").alias("_v"), F.col(left_id).alias("_id"), F.lit(1).alias("_side"), bucket)
    both = marks.unionByName(asks)
    per_bucket = both.groupBy(key, "_b").agg(F.max("_v").alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(key, "_b", F.max("_m").over(earlier).alias("_carry"))
    inside = Window.partitionBy(key, "_b").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.withColumn("_run", F.max("_v").over(inside)).filter("_side = 1")
    return running.join(carried, [key, "_b"]).select(
        F.col("_id").alias(left_id), key, ts, F.greatest("_run", "_carry").alias(value)
    )


def _prefixes(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda n: F.substring(value, F.lit(1), n))


def resolve_names(rows: DataFrame, row_id: str | list[str], aliases: str, dim: DataFrame, title: str, dim_order: str, within: str | None = None) -> DataFrame:
    """First dimension entry for an ordered alias list: exact title, else prefix either way.

    Prefix containment in both directions is expressed as equi joins on the
    (short) exploded prefixes, so neither side is ever paired with all of the
    other.  Preference: alias position, exact before prefix, dimension order.
    With ``within`` both sides carry that column and only equal values meet.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    group = [] if within is None else [F.col(within).alias("_g")]
    exploded = rows.select(*ids, *group, F.posexplode(aliases).alias("_pos", "_a")).withColumn("_a", F.lower(F.trim("_a")))
    exploded = exploded.filter("_a <> ''")
    d = dim.select(*group, F.lower(F.trim(title)).alias("_t"), F.col(title).alias("_title"), F.col(dim_order).alias("_o")).filter("_t <> ''")
    on = [] if within is None else ["_g"]
    keep = [*ids, "_pos", "_kind", "_o", "_title"]
    exact = exploded.withColumn("_t", F.col("_a")).join(d, [*on, "_t"]).withColumn("_kind", F.lit(0)).select(*keep)
    longer = (
        exploded.withColumn("_t", F.explode(_prefixes(F.col("_a")))).filter(F.col("_t") != F.col("_a"))
        .join(d, [*on, "_t"]).withColumn("_kind", F.lit(1)).select(*keep)
    )
    shorter = (
        exploded.join(d.withColumn("_a", F.explode(_prefixes(F.col("_t")))).filter(F.col("_a") != F.col("_t")), [*on, "_a"])
        .withColumn("_kind", F.lit(1)).select(*keep)
    )
    found = exact.unionByName(longer).unionByName(shorter)
    return found.groupBy(*ids).agg(
        F.min(F.struct("_pos", "_kind", "_o", "_title")).alias("_best")
    ).select(*ids, F.col("_best._title").alias(title), (F.col("_best._kind") == 0).alias("exact"))


#: Parts of a hot key: rows that meet a small side on few keys are dealt out over so many, with a copy of that side for each.
SALTS = 16


def both_team_metrics(matches: DataFrame, teams: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of both teams of a match from the first of its league codes that knows both.

    ``matches`` has (match_id, codes, home_aliases, away_aliases), arrays in order of preference; ``teams`` has one row per
    (code, title) with place and metrics, ``place`` being the order within a code.  A match without such a code has no row.

    Names are resolved once per code and alias list, not per match.  A league has few names, so the matches meet the
    resolved ones by salted keys: neither a code nor a name is ever one task.
    """
    cases = matches.select("match_id", "home_aliases", "away_aliases", F.posexplode("codes").alias("_c", "code"), F.pmod(F.hash("match_id"), F.lit(SALTS)).alias("_salt"))
    sides = F.explode(F.array("home_aliases", "away_aliases")).alias("aliases")
    asked = matches.select(F.explode("codes").alias("code"), "home_aliases", "away_aliases").select("code", sides).distinct().withColumn("_given", F.col("aliases"))
    found = resolve_names(asked, ["code", "_given"], "aliases", teams, "title", "place", "code")
    known = found.join(teams.select("code", "title", *metrics), ["code", "title"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for s in ("home", "away"):
        own = known.select("code", F.col("_given").alias(f"{s}_aliases"), "_salt", F.col("title").alias(f"{s}_title"), *[F.col(m).alias(f"{s}_{m}") for m in metrics])
        cases = cases.join(own, ["code", f"{s}_aliases", "_salt"])
    names = ["code", "home_title", "away_title", *[f"{s}_{m}" for s in ("home", "away") for m in metrics]]
    return cases.groupBy("match_id").agg(F.min(F.struct("_c", *names)).alias("_b")).select("match_id", *[F.col(f"_b.{n}").alias(n) for n in names])


def alias_list(name: Column, known: Column | None = None) -> Column:
    """Known alias, the name without its bracketed suffix, then the raw name."""
    bare = F.trim(F.regexp_replace(name, r"[（(].*?[)）]", ""))
    first = [known] if known is not None else []
    return F.array_distinct(F.array_compact(F.array(*first, bare, name)))


def codes_of_label(label: Column, keywords: dict[str, str]) -> Column:
    """Codes whose keyword the label contains, in keyword order (a fixed rule list)."""
    hits = [F.when(F.instr(text(label), k) > 0, F.lit(code)) for k, code in keywords.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def prefer(df: DataFrame, keys: list[str], rank: Column, keep: list[str]) -> DataFrame:
    """Best-ranked candidate per key as a ``min`` over structs."""
    best = df.groupBy(*keys).agg(F.min(F.struct(rank.alias("_r"), *keep)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep])


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    return child.join(parent.select(on).distinct(), on, "left_anti")


def scoped(df: DataFrame, ids: DataFrame | None, period: str | None = None) -> DataFrame:
    """An explicit id selection wins over the whole period."""
    if ids is not None:
        return df.join(ids.select("match_id").distinct(), "match_id", "left_semi")
    return df if period is None else df.filter(F.col("period") == period)


#: 64-bit words of a sieve, which is broadcast: at most one row a word, whatever the input.
SIEVE_WORDS = 1 << 20


def sieved(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of ``keys``: none of those is lost, others pass where all their three bits are set.

    In front of a shuffle by ``key`` that most rows would take in vain; a join behind it settles which rows match.
    """
    part = lambda shift, width: F.shiftrightunsigned(F.xxhash64(key), shift).bitwiseAND(F.lit(width - 1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), part(shift, 64).cast("int")) for shift in (0, 6, 12)]
    word, mask = part(18, SIEVE_WORDS).alias("_slot"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("_mask")
    marks = keys.select(word, mask).groupBy("_slot").agg(F.bit_or("_mask").alias("_bits"))
    met = df.select("*", word, mask).join(F.broadcast(marks), "_slot")
    return met.where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*df.columns)
