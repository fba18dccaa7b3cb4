"""Feature snapshots of the analyses table, match features read back from them, and their quality checks.

A snapshot keeps its features as flat columns and, in whole, as a JSON payload.  The payload is read schema-on-read,
group by group: a group that is absent, empty or unreadable is derived again from the stored text, so snapshots of any
age and half-written ones serve.  Everything is one projection chain per match beside the joins that bring schedule,
team metrics and the newest snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import probs
from ..functions.models import quality_score
from ..functions.numeric import clamp, num, round_to, text, text_num
from . import extract
from .ledger import latest

_RECORD = {"matches": int, "wins": int, "draws": int, "losses": int, "goals_for": int, "goals_against": int, "win_rate": float, "points_per_game": float,
           "goal_diff_per_game": float, "goals_for_per_game": float, "goals_against_per_game": float}
_STRENGTH = {"rank": int, "team_count": int, "points": int, "rating": float}
_TRIPLE = dict.fromkeys(V.OUTCOMES, float)
#: Groups of a payload, and how their fields are read.
PAYLOAD: dict[str, dict[str, type]] = {
    "recent_home": _RECORD, "recent_away": _RECORD,
    "split": {f"{s}_{c}": t for s in ("home", "away") for c, t in (("wins", int), ("draws", int), ("losses", int), ("gf", int), ("ga", int), ("ppg", float), ("goal_diff_pg", float))},
    "h2h": {"matches": int, "wins": int, "draws": int, "losses": int, "edge": float},
    "strength_home": _STRENGTH, "strength_away": _STRENGTH,
    "market_value": {"home_value_eur_m": float, "away_value_eur_m": float, "ratio": float, "log_gap": float, "coverage": int},
    "lineup": {f"{s}_{c}": t for s in ("home", "away") for c, t in (("starters", int), ("absent_count", int), ("doubtful_count", int), ("absence_impact", float), ("availability", float))} | {"data_available": int},
    "schedule": {"home_rest_days": float, "away_rest_days": float, "home_load_14": int, "away_load_14": int},
    "market_odds": _TRIPLE, "market_probs": _TRIPLE,
    "asian_handicap": {f"{w}_{c}": float for w in ("initial", "current") for c in ("home_odds", "line", "away_odds")},
    "xg": {"coverage": int, "home_xg": float, "away_xg": float, "home_xga": float, "away_xga": float},
}
LISTED_LINEUP = ("home_lineup", "away_lineup", "home_missing", "away_missing")
#: JSON texts of a group that count as no group.
_NOTHING = ("", "{}", "[]", "null", "0", "false", '""')


def _pack(fields: dict[str, Column], kinds: dict[str, type]) -> Column:
    return F.struct(*[fields[n].cast("int" if t is int else "double").alias(n) for n, t in kinds.items()])


def team_schedule(matches: DataFrame, ts: str = "match_time") -> DataFrame:
    """Rest days and games of the fortnight before each match, for both its teams: (match_id, schedule columns).

    Busy teams are one row per day before any window or join sees them.
    """
    day = F.to_date(ts)
    games = matches.select(F.explode(F.array("home_team", "away_team")).alias("team"), F.col(ts).alias("ts")).where("ts is not null")
    load = extract.rest_and_load(games, "team", "ts")
    own = matches.select("match_id", "home_team", "away_team", day.alias("day"))
    for side in ("home", "away"):
        found = load.select(
            F.col("team").alias(f"{side}_team"), "day", F.col("rest_days").cast("double").alias(f"{side}_rest_days"), F.col("load").cast("int").alias(f"{side}_load_14"),
        )
        own = own.join(found, [f"{side}_team", "day"], "left")
    names = list(PAYLOAD["schedule"])
    return own.select("match_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def derived_groups(analyses: DataFrame) -> DataFrame:
    """``analyses`` with every payload group that its texts and listed odds give, as ``d_<group>``."""
    listed = tuple(text_num(c) for c in ("list_odds_win", "list_odds_draw", "list_odds_loss"))
    df = extract.lineup_metrics(extract.summary_features(analyses, listed), "injury_or_lineup_notes")
    source = {"recent_home": "recent_home", "recent_away": "recent_away", "split": "split", "h2h": "h2h", "strength_home": "strength_home",
              "strength_away": "strength_away", "market_value": "team_value", "market_odds": "odds", "asian_handicap": "handicap"}
    df = df.withColumns({f"d_{g}": _pack({n: F.col(f"{c}.{n}") for n in PAYLOAD[g]}, PAYLOAD[g]) for g, c in source.items()})
    df = df.withColumn("d_lineup", _pack({n: F.col(n) for n in PAYLOAD["lineup"]}, PAYLOAD["lineup"]))
    return df.drop("recent_home", "recent_away", "split", "h2h", "strength_home", "strength_away", "team_value", "odds", "handicap", "heat", *PAYLOAD["lineup"])


def implied(odds: str) -> Column:
    """Probabilities of the odds in a struct column; odds that are missing count as 0.33."""
    inverse = {o: F.coalesce(F.when(F.col(f"{odds}.{o}") > 0, F.try_divide(F.lit(1.0), F.col(f"{odds}.{o}"))), F.lit(0.33)) for o in V.OUTCOMES}
    return _pack(probs.normalise(inverse), _TRIPLE)


def _beside(df: DataFrame, group: str, found: DataFrame | None) -> DataFrame:
    """``df`` with the group's columns of ``found`` (by match_id) as ``d_<group>``; zeros where there are none."""
    kinds = PAYLOAD[group]
    if found is None:
        return df.withColumn(f"d_{group}", _pack({n: F.lit(0) for n in kinds}, kinds))
    got = found.select("match_id", *[F.col(n).alias(f"_{n}") for n in kinds])
    return df.join(got, "match_id", "left").withColumn(f"d_{group}", _pack({n: F.coalesce(f"_{n}", F.lit(0)) for n in kinds}, kinds)).drop(*[f"_{n}" for n in kinds])


def feature_snapshots(analyses: DataFrame, at: Column, schedule: DataFrame | None = None, xg: DataFrame | None = None) -> DataFrame:
    """One snapshot per analysis: flat features rounded for storage, and all groups unrounded as ``feature_payload``.

    ``schedule`` is as ``team_schedule`` returns it, ``xg`` has (match_id, coverage, home_xg, away_xg, home_xga, away_xga).
    """
    df = _beside(_beside(derived_groups(analyses), "schedule", schedule), "xg", xg).withColumn("d_market_probs", implied("d_market_odds"))
    of = lambda path, digits: round_to(F.col(f"d_{path}"), digits)
    flat = {f"{s}_rating": of(f"strength_{s}.rating", 3) for s in ("home", "away")}
    for name, field in (("ppg", "points_per_game"), ("gf_pg", "goals_for_per_game"), ("ga_pg", "goals_against_per_game")):
        flat |= {f"recent_{s}_{name}": of(f"recent_{s}.{field}", 4) for s in ("home", "away")}
    for s in ("home", "away"):
        flat |= {
            f"{s}_split_ppg": of(f"split.{s}_ppg", 4), f"{s}_absent_count": F.col(f"d_lineup.{s}_absent_count"), f"{s}_doubtful_count": F.col(f"d_lineup.{s}_doubtful_count"),
            f"{s}_absence_impact": of(f"lineup.{s}_absence_impact", 4), f"lineup_{s}_availability": of(f"lineup.{s}_availability", 4),
            f"rest_days_{s}": of(f"schedule.{s}_rest_days", 2), f"schedule_load_{s}": F.col(f"d_schedule.{s}_load_14"),
        }
    flat |= {"h2h_edge": of("h2h.edge", 4)} | {f"market_{o}_prob": of(f"market_probs.{o}", 6) for o in V.OUTCOMES}
    payload = F.to_json(F.struct(*[F.col(f"d_{g}").alias(g) for g in PAYLOAD]))
    return df.select("match_id", "period", at.alias("snapshot_at"), *[c.alias(n) for n, c in flat.items()], payload.alias("feature_payload"))


def _parsed(group: str) -> Column:
    """A group of the payload as struct of texts; null where the payload has none."""
    raw = F.col(f"_p.{group}")
    return F.when(raw.isNotNull() & ~raw.isin(*_NOTHING), F.from_json(raw, ", ".join(f"{n} string" for n in PAYLOAD[group])))


def _typed(group: str) -> Column:
    """The fields of a parsed group; numbers may be stored as text."""
    raw, fields = F.col(f"_p.{group}"), F.col(f"_g_{group}")
    typed = F.struct(*[text_num(fields[n]).cast("int" if t is int else "double").alias(n) for n, t in PAYLOAD[group].items()])
    return F.when(raw.isNotNull() & ~raw.isin(*_NOTHING), typed)


def with_payload(df: DataFrame, payload: str = "feature_payload") -> DataFrame:
    """Adds ``p_<group>`` per payload group; anything but a JSON object holds no group.

    A parsed text is a column of its own: fields taken from the parse itself would each parse the text again.
    """
    own = text(payload)
    whole = F.ltrim(own).startswith("{") & F.try_parse_json(own).isNotNull()
    schema = ", ".join(f"{g} string" for g in (*PAYLOAD, "lineup_raw"))
    df = df.withColumn("_p", F.when(whole, F.from_json(own, schema)))
    raw = F.from_json(F.col("_p.lineup_raw"), ", ".join(f"{n} array<string>" for n in LISTED_LINEUP))
    df = df.withColumns({f"_g_{g}": _parsed(g) for g in PAYLOAD} | {"_raw": raw})
    listed = F.exists(F.array(*[F.coalesce(F.size(F.col(f"_raw.{n}")), F.lit(0)) for n in LISTED_LINEUP]), lambda n: n > 0)
    return df.withColumns({f"p_{g}": _typed(g) for g in PAYLOAD} | {"lineup_listed": F.coalesce(listed, F.lit(False))}).drop("_p", "_raw", *[f"_g_{g}" for g in PAYLOAD])


def match_features(analyses: DataFrame, snapshots: DataFrame, xg: DataFrame | None = None) -> DataFrame:
    """Per analysis all groups as structs, and the gaps that the models read.

    The newest snapshot of a match counts.  Its payload's groups win; what it lacks comes from the texts, the schedule
    from the snapshot's own columns, ratings from those too.  Without a snapshot everything comes from the texts.
    """
    stored = ("home_rating", "away_rating", "rest_days_home", "rest_days_away", "schedule_load_home", "schedule_load_away")
    newest = latest(snapshots, ["match_id"], [F.col("snapshot_at").desc_nulls_last(), F.col("snapshot_id").desc()])
    newest = newest.select("match_id", F.col("snapshot_id").alias("_sid"), "feature_payload", *[F.col(c).alias(f"_s_{c}") for c in stored])
    df = with_payload(_beside(derived_groups(analyses), "xg", xg).join(newest, "match_id", "left"))
    schedule = {f"{s}_rest_days": num(f"_s_rest_days_{s}") for s in ("home", "away")} | {f"{s}_load_14": num(f"_s_schedule_load_{s}") for s in ("home", "away")}
    df = df.withColumn("d_schedule", _pack(schedule, PAYLOAD["schedule"]))
    df = df.withColumns({g: F.coalesce(f"p_{g}", f"d_{g}") for g in PAYLOAD if g != "market_probs"})
    df = df.withColumn("market_probs", F.coalesce("p_market_probs", implied("market_odds")))
    seen = F.col("_sid").isNotNull()
    df = df.withColumns({f"{s}_rating": F.when(seen, num(f"_s_{s}_rating")).otherwise(F.col(f"d_strength_{s}.rating")) for s in ("home", "away")})
    gap = F.when(F.col("market_value.coverage") != 0, clamp(F.col("market_value.log_gap") * V.VALUE_GAP_SCALE, -V.VALUE_GAP_LIMIT, V.VALUE_GAP_LIMIT)).otherwise(0.0)
    df = df.withColumn("market_value_rating_gap", gap)
    for s, sign in (("home", 1.0), ("away", -1.0)):
        points, goals = extract.expected_form(F.col(f"strength_{s}.rank"), F.col(f"strength_{s}.team_count"))
        strength = F.col(f"{s}_rating") + F.greatest(F.col("market_value_rating_gap") * sign, F.lit(0.0)) * V.STRENGTH_SHARES["value"]
        for share, c in (("points", f"recent_{s}.points_per_game"), ("split", f"split.{s}_ppg"), ("goals", f"recent_{s}.goal_diff_per_game")):
            strength = strength + F.col(c) * V.STRENGTH_SHARES[share]
        df = df.withColumns({
            f"{s}_ppg_residual": F.col(f"recent_{s}.points_per_game") - points, f"{s}_goal_diff_residual": F.col(f"recent_{s}.goal_diff_per_game") - goals, f"{s}_strength": strength,
        })
    df = df.withColumns({
        "rating_gap": F.col("home_rating") - F.col("away_rating"), "strength_gap": F.col("home_strength") - F.col("away_strength"),
        "form_residual_gap": F.col("home_ppg_residual") - F.col("away_ppg_residual"), "goal_diff_residual_gap": F.col("home_goal_diff_residual") - F.col("away_goal_diff_residual"),
        "rest_advantage": F.col("schedule.home_rest_days") - F.col("schedule.away_rest_days"), "schedule_gap": (F.col("schedule.away_load_14") - F.col("schedule.home_load_14")).cast("double"),
        "motivation_signal": F.when(F.contains(text("motivation_or_schedule_notes"), F.lit(V.MOTIVATION_MARK)), V.MOTIVATION_SIGNAL).otherwise(0.0),
        "market_bias_anchor": F.col("market_probs.home") - F.col("market_probs.away"), "feature_snapshot_id": F.coalesce("_sid", F.lit(0)),
    })
    return df.drop("feature_payload", "_sid", *[f"_s_{c}" for c in stored], *[f"{p}_{g}" for p in "dp" for g in PAYLOAD if g != "market_probs"], "p_market_probs")


def quality_checks() -> dict[str, Column]:
    """Which of the nine inputs a row of ``match_features`` could use."""
    c = F.col
    games = lambda s: c(f"split.{s}_wins") + c(f"split.{s}_draws") + c(f"split.{s}_losses")
    return {
        "recent_home": c("recent_home.matches") >= V.ENOUGH_GAMES, "recent_away": c("recent_away.matches") >= V.ENOUGH_GAMES,
        "home_away": (games("home") >= V.ENOUGH_GAMES) & (games("away") >= V.ENOUGH_GAMES),
        "ratings": (c("home_rating") > 0) & (c("away_rating") > 0), "market_value": c("market_value.coverage") != 0,
        "lineup": (c("lineup.data_available") != 0) | c("lineup_listed"), "h2h": c("h2h.matches") > 0,
        "schedule": (c("schedule.home_rest_days") > 0) | (c("schedule.away_rest_days") > 0) | (c("schedule.home_load_14") > 0) | (c("schedule.away_load_14") > 0),
        "market": (c("market_odds.home") > 0) & (c("market_odds.draw") > 0) & (c("market_odds.away") > 0),
    }


def data_quality(features: DataFrame) -> DataFrame:
    """Score, model weight and named problems of each row of ``match_features``."""
    checks = quality_checks()
    notes = text("injury_or_lineup_notes")
    placeholder = F.lit(True)
    for token in V.LINEUP_FALLBACKS:
        placeholder = placeholder & F.contains(notes, F.lit(token))
    df = features.withColumns({f"check_{n}": c for n, c in checks.items()})
    no = lambda n: ~F.col(f"check_{n}")
    problems = F.array_compact(F.array(
        F.when(no("recent_home") | no("recent_away"), "recent_form"), F.when(no("home_away"), "home_away_form"), F.when(no("ratings"), "ratings"),
        F.when(no("lineup"), F.when(placeholder, "lineup_placeholder").otherwise("lineup_text_only")), F.when(no("market"), "market_odds"), F.when(no("schedule"), "schedule"),
    ))
    df = df.withColumns({"quality": quality_score({n: F.col(f"check_{n}") for n in checks}), "problems": problems})
    return df.withColumn("weight_adjustment", clamp(0.72 + F.col("quality") * 0.28, 0.72, 1.0))
