"""Stored text and pages to tables.

Patterns run JVM-side.  A pattern with many groups is applied twice (find, then
split the captures), not once per group; rows of a page come from
``regexp_extract_all`` + explode.  Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numeric import clamp, log1p_gap, num, ratio, round_to, text, text_num

_SEP = "\u0001"
_SPACE = r"(?U)\s+"


def squeeze(value: Column | str) -> Column:
    """Collapse every kind of white space and trim."""
    return F.trim(F.regexp_replace(text(value), _SPACE, " "))


def captures(value: Column, pattern: str, groups: int) -> Column:
    """Captured groups of the first match as an array; null when nothing matches."""
    return _groups(F.regexp_extract(value, pattern, 0), pattern, groups)


def _groups(found: Column, pattern: str, groups: int) -> Column:
    joined = F.regexp_replace(found, pattern, _SEP.join(f"${i}" for i in range(1, groups + 1)))
    return F.when(found != "", F.split(joined, _SEP))


def with_captures(df: DataFrame, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds one array per spec (text column, pattern, group count).

    The match is a column of its own: below a condition an expression that occurs twice is evaluated twice, text and all.
    """
    df = df.withColumns({f"_m{out}": F.regexp_extract(squeeze(c), p, 0) for out, (c, p, _) in specs.items()})
    return df.withColumns({out: _groups(F.col(f"_m{out}"), p, n) for out, (_, p, n) in specs.items()}).drop(*[f"_m{out}" for out in specs])


def _int(array: str, i: int) -> Column:
    return F.coalesce(F.get(F.col(array), F.lit(i)).try_cast("int"), F.lit(0))


def _dbl(array: str, i: int) -> Column:
    return F.coalesce(F.get(F.col(array), F.lit(i)).try_cast("double"), F.lit(0.0))


def record_metrics(array: str) -> dict[str, Column]:
    n = [_int(array, i) for i in range(9)]
    games = F.greatest(n[0], F.lit(1))
    return {
        "matches": n[0], "wins": n[1], "draws": n[2], "losses": n[3], "goals_for": n[4], "goals_against": n[5],
        "win_rate": n[6] / 100.0, "handicap_rate": n[7] / 100.0, "over_rate": n[8] / 100.0,
        "points_per_game": (n[1] * 3 + n[2]) / games, "goal_diff_per_game": (n[4] - n[5]) / games,
        "goals_for_per_game": n[4] / games, "goals_against_per_game": n[5] / games,
    }


def home_away_metrics(array: str) -> dict[str, Column]:
    n = [_int(array, i) for i in range(10)]
    out = {}
    for side, k in (("home", 0), ("away", 5)):
        games = F.greatest(n[k] + n[k + 1] + n[k + 2], F.lit(1))
        out |= {
            f"{side}_wins": n[k], f"{side}_draws": n[k + 1], f"{side}_losses": n[k + 2], f"{side}_gf": n[k + 3], f"{side}_ga": n[k + 4],
            f"{side}_ppg": (n[k] * 3 + n[k + 1]) / games, f"{side}_goal_diff_pg": (n[k + 3] - n[k + 4]) / games,
        }
    return out


def h2h_metrics(array: str) -> dict[str, Column]:
    n = [_int(array, i) for i in range(6)]
    names = ("matches", "wins", "draws", "losses", "goals_for", "goals_against")
    return dict(zip(names, n)) | {"edge": (n[1] - n[3]) / F.greatest(n[0], F.lit(1))}


def strength_metrics(array: str) -> dict[str, Column]:
    names = ("rank", "team_count", "points", "wins", "draws", "losses", "goals_for", "goals_against", "goal_diff")
    n = {name: _int(array, i) for i, name in enumerate(names)}
    place = F.when(n["team_count"] > 1, (0.5 - (n["rank"] - 1) / F.when(n["team_count"] > 1, n["team_count"] - 1)) * 180.0).otherwise(0.0)
    rating = clamp(1450.0 + place + n["points"] * 2.4 + n["goal_diff"] * 3.0 + n["wins"] * 1.5, 1325.0, 1875.0)
    return n | {"rating": F.when(F.col(array).isNull(), 1500.0).otherwise(rating)}


def expected_form(rank: Column, teams: Column) -> tuple[Column, Column]:
    """Points and goal difference per game a rank stands for."""
    ranked = (rank > 0) & (teams > 1)
    depth = (rank - 1) / F.when(teams > 1, teams - 1)
    return (
        F.when(ranked, clamp(2.4 - depth * 1.7, 0.6, 2.5)).otherwise(1.4),
        F.when(ranked, clamp(1.5 - depth * 2.7, -1.4, 1.6)).otherwise(0.0),
    )


def odds_triple(array: str, fallback: tuple[Column, Column, Column]) -> dict[str, Column]:
    """Current odds when quoted, else initial, else the fixture list's."""
    current = F.coalesce(F.get(F.col(array), F.lit(3)), F.lit("")) != ""
    return {
        o: F.when(F.col(array).isNull(), fallback[i]).when(current, _dbl(array, i + 3)).otherwise(_dbl(array, i))
        for i, o in enumerate(V.OUTCOMES)
    }


_LINE_NUMBER = r"([+-]?\d+(?:\.\d+)?)"


def handicap_line(value: Column) -> Column:
    """Number in the text, else the longest known wording it contains, signed."""
    cleaned = squeeze(value)
    return _line(cleaned, F.regexp_extract(cleaned, _LINE_NUMBER, 1))


def _line(cleaned: Column, number: Column) -> Column:
    sign = F.when(cleaned.startswith("-") | F.contains(cleaned, F.lit("受")), -1.0).otherwise(1.0)
    words = sorted(V.HANDICAP_WORDS.items(), key=lambda kv: -len(kv[0]))
    worded = F.coalesce(*[F.when(F.contains(cleaned, F.lit(w)), F.lit(v)) for w, v in words], F.lit(0.0))
    return F.when(number != "", text_num(number)).otherwise(sign * worded)


def with_lines(df: DataFrame, array: str) -> DataFrame:
    """Adds the two handicap lines of a captured quote, ``_line1`` and ``_line4``; each text is cleaned once, not per wording."""
    df = df.withColumns({f"_c{i}": squeeze(F.get(F.col(array), F.lit(i))) for i in (1, 4)})
    df = df.withColumns({f"_n{i}": F.regexp_extract(f"_c{i}", _LINE_NUMBER, 1) for i in (1, 4)})
    return df.withColumns({f"_line{i}": F.coalesce(_line(F.col(f"_c{i}"), F.col(f"_n{i}")), F.lit(0.0)) for i in (1, 4)}).drop("_c1", "_c4", "_n1", "_n4")


def handicap_quotes(array: str) -> dict[str, Column]:
    """Quotes of a captured array; the lines are those of ``with_lines``."""
    return {
        "initial_home_odds": _dbl(array, 0), "initial_line": F.col("_line1"), "initial_away_odds": _dbl(array, 2),
        "current_home_odds": _dbl(array, 3), "current_line": F.col("_line4"), "current_away_odds": _dbl(array, 5),
    }


#: What an amount is multiplied by, per unit; any other unit counts as millions.
_UNITS = {1.0: ("", "m", "mil", "million"), 1000.0: ("bn", "b", "billion"), 0.001: ("k", "th", "thousand")}


def _scaled(amount: Column, unit: Column) -> Column:
    def known(u: Column, rest: Column) -> Column:
        chain = F
        for factor, words in _UNITS.items():
            chain = chain.when(u.isin(*words), factor)
        return chain.otherwise(rest)

    # A unit in lower case is known as it stands; lower-casing costs far more than the comparisons.
    return F.replace(amount, F.lit(","), F.lit(".")).try_cast("double") * known(unit, known(F.lower(unit), F.lit(1.0)))


def team_values(summary: Column | str) -> Column:
    """EUR millions of the first two lines that quote an amount.

    A line is matched once per pattern; amount and unit are read from the short match.  What a lambda uses twice is an
    element of the array before it: lambdas are interpreted, and nothing in them is evaluated only once.
    """
    quotes = F.transform(F.split(text(summary), r"\r?\n"), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, V.EUR_AMOUNT_PATTERN, 0).alias("before")))
    quotes = F.transform(quotes, lambda q: F.struct(
        q["before"].alias("before"), F.when(q["before"] != "", "").otherwise(F.regexp_extract(q["line"], V.AMOUNT_EUR_PATTERN, 0)).alias("after"),
    ))
    part = lambda q, i: F.when(q["before"] != "", F.regexp_extract(q["before"], V.EUR_AMOUNT_PATTERN, i)).otherwise(F.regexp_extract(q["after"], V.AMOUNT_EUR_PATTERN, i))
    found = F.transform(F.filter(quotes, lambda q: (q["before"] != "") | (q["after"] != "")), lambda q: F.struct(part(q, 1).alias("amount"), part(q, 2).alias("unit")))
    values = F.transform(found, lambda f: F.coalesce(_scaled(f["amount"], f["unit"]), F.lit(0.0)))
    return F.slice(F.filter(values, lambda v: v > 0), 1, 2)


def team_value_metrics(array: str) -> dict[str, Column]:
    both = F.size(F.col(array)) >= 2
    home, away = F.get(F.col(array), F.lit(0)), F.get(F.col(array), F.lit(1))
    when = lambda c: F.when(both, c).otherwise(0.0)
    return {
        "home_value_eur_m": when(round_to(home, 3)), "away_value_eur_m": when(round_to(away, 3)),
        "gap_eur_m": when(round_to(home - away, 3)), "ratio": when(round_to(ratio(home, away), 4)),
        "log_gap": when(round_to(log1p_gap(home, away), 6)), "coverage": both.cast("int"),
    }


def _after_label(lines: Column, label: str) -> Column:
    hits = F.filter(lines, lambda x: x.startswith(label))
    return F.coalesce(F.substring(F.try_element_at(hits, F.lit(-1)), len(label) + 1, 2**31 - 1), F.lit(""))


def _items(value: Column, pattern: str, placeholder: str) -> Column:
    parts = F.filter(F.transform(F.split(value, pattern), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((value == "") | F.contains(value, F.lit(placeholder)), F.array().cast("array<string>")).otherwise(parts)


_INJURIES = r"主队(.*?)(?:；|;)\s*客队(.*)"


def lineup_metrics(df: DataFrame, column: str) -> DataFrame:
    """Starters, absences, availability from labelled lineup notes."""
    raw = text(column)
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, _SPACE, " ")))
    placeholder = F.lit(False)
    for token in V.LINEUP_PLACEHOLDERS:
        placeholder = placeholder | F.contains(raw, F.lit(token))
    concrete = F.contains(raw, F.lit("主队：")) | F.contains(raw, F.lit("客队：")) | F.contains(raw, F.lit("关键伤停："))
    df = df.withColumn("_lines", lines).withColumns(
        {
            "_signal": (F.trim(raw) != "") & (~placeholder | concrete),
            "_home": _after_label(F.col("_lines"), "主队："), "_away": _after_label(F.col("_lines"), "客队："),
            "_hurt": F.regexp_extract(_after_label(F.col("_lines"), "关键伤停："), _INJURIES, 0),
        }
    ).withColumn("_injury", _groups(F.col("_hurt"), _INJURIES, 2))
    df = df.withColumns(
        {
            "_hs": _items(F.col("_home"), "/", V.LINEUP_PLACEHOLDERS[0]), "_as": _items(F.col("_away"), "/", V.LINEUP_PLACEHOLDERS[0]),
            **{
                f"_{s}i": _items(F.coalesce(F.get(F.col("_injury"), F.lit(k)), F.lit("")), "[；;]", V.LINEUP_PLACEHOLDERS[1])
                for k, s in enumerate("ha")
            },
        }
    )
    df = df.withColumns({f"_{s}d": F.size(F.filter(F.col(f"_{s}i"), lambda x: F.contains(x, F.lit("成疑")))) for s in "ha"})
    out = {}
    for s, side in (("h", "home"), ("a", "away")):
        starters, doubt = F.size(f"_{s}s"), F.col(f"_{s}d")
        absent = F.size(f"_{s}i") - doubt
        impact = clamp(absent * 0.06 + doubt * 0.03 + F.greatest(F.lit(0), F.lit(11) - starters) * 0.015, 0.0, 0.36)
        on = F.col("_signal")
        out |= {
            f"{side}_starters": F.when(on, starters).otherwise(0), f"{side}_absent_count": F.when(on, absent).otherwise(0),
            f"{side}_doubtful_count": F.when(on, doubt).otherwise(0), f"{side}_absence_impact": F.when(on, impact).otherwise(0.0),
            f"{side}_availability": F.when(on, clamp(1.0 - impact, 0.58, 1.0)).otherwise(0.92),
        }
    payload = F.size("_hs") + F.size("_as") + F.size("_hi") + F.size("_ai") > 0
    out["data_available"] = (F.col("_signal") & payload).cast("int")
    return df.withColumns(out).drop("_lines", "_signal", "_home", "_away", "_hurt", "_injury", "_hs", "_as", "_hi", "_ai", "_hd", "_ad")


def summary_features(df: DataFrame, listed: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """All summary-text features of the analyses table as structs, one projection chain; ``listed`` odds stand in for quoted ones."""
    df = with_captures(df, {
        "_rh": ("recent_form_home", V.RECORD_PATTERN, 9), "_ra": ("recent_form_away", V.RECORD_PATTERN, 9),
        "_ha": ("home_away_form", V.HOME_AWAY_PATTERN, 10), "_hh": ("head_to_head_summary", V.H2H_PATTERN, 6),
        "_eh": ("elo_home", V.STRENGTH_PATTERN, 9), "_ea": ("elo_away", V.STRENGTH_PATTERN, 9),
        "_od": ("european_odds_movement_summary", V.ODDS_PATTERN, 6),
        "_hc": ("asian_handicap_summary", V.HANDICAP_PATTERN, 6), "_bh": ("betting_heat_summary", V.HEAT_PATTERN, 3),
    }).withColumn("_mv", team_values("market_value_summary"))
    df = with_lines(df, "_hc")
    pack = lambda d: F.struct(*[c.alias(n) for n, c in d.items()])
    listed = listed or (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    heat = {o: _dbl("_bh", i) / 100.0 for i, o in enumerate(V.OUTCOMES)}
    return df.withColumns(
        {
            "recent_home": pack(record_metrics("_rh")), "recent_away": pack(record_metrics("_ra")),
            "split": pack(home_away_metrics("_ha")), "h2h": pack(h2h_metrics("_hh")),
            "strength_home": pack(strength_metrics("_eh")), "strength_away": pack(strength_metrics("_ea")),
            "odds": pack(odds_triple("_od", listed)), "handicap": pack(handicap_quotes("_hc")),
            "heat": pack(heat), "team_value": pack(team_value_metrics("_mv")),
        }
    ).drop("_rh", "_ra", "_ha", "_hh", "_eh", "_ea", "_od", "_hc", "_bh", "_mv", "_line1", "_line4")


# --- dates and schedule ------------------------------------------------------------


def loose_time(value: Column, now: Column) -> Column:
    """Timestamp from the accepted spellings; month-day ones take the nearest year."""
    v = squeeze(value)
    year = F.year(now)
    md = F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), v), F.lit("yyyy-MM-dd HH:mm"))
    span = F.expr("INTERVAL 200 DAYS")
    shifted = (
        F.when(md - now > span, md - F.expr("INTERVAL 1 YEAR")).when(now - md > span, md + F.expr("INTERVAL 1 YEAR"))
        .otherwise(md)
    )
    fits = lambda pattern, fmt: F.when(v.rlike(pattern), F.try_to_timestamp(v, F.lit(fmt)))
    return F.coalesce(
        fits(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
        fits(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
        F.when(v.rlike(r"^\d{2}-\d{2} \d{2}:\d{2}$"), shifted),
        fits(r"^\d{2}-\d{2}-\d{2}$", "yy-MM-dd"),
        fits(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )


def rest_and_load(games: DataFrame, team: str, ts: str, days: int = 14) -> DataFrame:
    """Rest days and games in the previous fortnight, per team and game.

    A range frame over (team, day): the per-day pre-aggregate keeps a busy key
    to one row per day, so the window never sees raw duplicates.
    """
    daily = games.withColumn("_d", F.datediff(F.to_date(ts), F.lit("1970-01-01"))).groupBy(team, "_d").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(team).orderBy("_d")
    return daily.select(
        team, F.col("_d"), F.col("_n").alias("games_on_day"),
        F.coalesce(F.col("_d") - F.lag("_d").over(w), F.lit(0)).alias("rest_days"),
        F.coalesce(F.sum("_n").over(w.rangeBetween(-days, -1)), F.lit(0)).alias("load"),
    ).withColumn("day", F.date_add(F.lit("1970-01-01"), F.col("_d").cast("int"))).drop("_d")


# --- pages ---------------------------------------------------------------------------


def page_links(pages: DataFrame) -> DataFrame:
    """One row per list link of a page: position, target, label; first occurrence of a target wins."""
    item = r'(?s)<li>\s*<a href="([^"]*)">(.*?)</a>'
    hrefs = F.regexp_extract_all("html", F.lit(item), F.lit(1))
    names = F.regexp_extract_all("html", F.lit(item), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("h"), names.alias("n"))).alias("pos", "e"))
    rows = rows.select("page_id", "pos", F.col("e.h").alias("href"), squeeze(F.col("e.n")).alias("label"))
    return rows.groupBy("page_id", "href").agg(
        F.min(F.struct("pos", "label")).alias("_f"), F.count(F.lit(1)).alias("copies")
    ).select("page_id", "href", F.col("_f.pos").cast("long").alias("pos"), F.col("_f.label").alias("label"), "copies")


def page_group(url: Column) -> Column:
    """Source group of a page by host and path; the fixed rule list is a CASE."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), "^www[.]", "")
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    chain = None
    for group, h, p in V.PAGE_GROUPS:
        test = F.contains(host, F.lit(h)) & (F.contains(path, F.lit(p)) if p else F.lit(True))
        chain = F.when(test, group) if chain is None else chain.when(test, group)
    return chain.otherwise("other")


def quoted_prices(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Every amount quoted with a currency in a text, in EUR millions."""
    parts = [F.regexp_extract_all(column, F.lit(V.PRICE_PATTERN), F.lit(i)) for i in (1, 2, 3)]
    rows = docs.select(key, F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "cau")])).alias("e"))
    currency = F.lower("e.c")
    factor = F.when(currency.isin("£", "gbp"), 1.17).when(currency.isin("$", "usd"), 0.92).otherwise(1.0)
    return rows.select(key, (_scaled(F.col("e.a"), F.col("e.u")) * factor).alias("eur_m")).filter("eur_m > 0")


def partial_values(docs: DataFrame, key: str, column: str, at_least: int = 4) -> DataFrame:
    """Sum of quoted amounts for texts with enough of them."""
    agg = quoted_prices(docs, key, column).groupBy(key).agg(
        F.count(F.lit(1)).alias("price_count"), F.sum("eur_m").alias("_s"), F.max("eur_m").alias("_m")
    )
    return agg.select(
        key, "price_count", F.when(F.col("price_count") >= at_least, round_to("_s", 3)).otherwise(0.0).alias("partial_value"),
        round_to("_m", 3).alias("max_value"),
    )


def bookmaker_rows(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Decimal quotes of each line of a text; lines with at least six valid ones."""
    lines = docs.select(key, F.posexplode(F.split(text(column), "\n")).alias("line_no", "line"))
    numbers = F.transform(F.regexp_extract_all("line", F.lit(r"(?<![\d.])(\d+\.\d+)(?![\d.])"), F.lit(1)), lambda x: x.cast("double"))
    valid = F.filter(numbers, lambda v: (v >= 1.01) & (v <= 30.0))
    names = ("initial_home", "initial_draw", "initial_away", "current_home", "current_draw", "current_away")
    # The numbers leave through a one-element generator: the filter would go below them otherwise, and read each line twice.
    return lines.select(key, "line_no", F.explode(F.array(valid)).alias("_v")).filter(F.size("_v") >= 6).select(
        key, "line_no", *[F.get(F.col("_v"), F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def median_odds(rows: DataFrame, key: str) -> DataFrame:
    """Median quote over bookmakers and the move from initial to current.

    Spark's exact median holds counts per distinct price and merges them map-side, so one shuffle of a row per key and
    task serves all six quotes; a key with very many rows sends its distinct prices.
    """
    names = [f"{when}_{o}" for when in ("initial", "current") for o in V.OUTCOMES]
    return rows.groupBy(key).agg(*[F.median(n).alias(n) for n in names]).select(
        key, *[round_to(n, 4).alias(n) for n in names],
        *[round_to(F.col(f"current_{o}") - F.col(f"initial_{o}"), 4).alias(f"move_{o}") for o in V.OUTCOMES],
    )


def table_cells(rows: DataFrame, key: str, column: str, headers: dict[str, str], sep: str = "|") -> DataFrame:
    """Standings from delimited table text: header-mapped columns plus rows per table.

    The first line names the columns; each later line is zipped with it into a
    map and the wanted headers are read from that map.
    """
    lines = F.filter(F.split(text(column), "\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.split(line, "[" + sep + "]"), lambda x: F.trim(x))
    df = rows.select(key, lines.alias("_l")).filter(F.size("_l") > 1)
    df = df.select(key, cells(F.get(F.col("_l"), F.lit(0))).alias("_h"), F.explode(F.slice("_l", 2, F.size("_l"))).alias("_row"))
    df = df.select(key, F.map_from_entries(F.arrays_zip("_h", cells(F.col("_row")).alias("_c"))).alias("_m"))
    out = df.select(key, *[F.try_element_at("_m", F.lit(h)).alias(n) for n, h in headers.items()])
    sizes = out.groupBy(key).agg(F.count(F.lit(1)).alias("team_count"))
    return out.join(sizes, key)


# --- provenance -------------------------------------------------------------------------

_EVENT = r"^([^.:]+)\.([^:]+): status=([^;]*); stage=([^;]*); source=([^;]*); quality=([0-9.]+)(?:; detail=(.*))?$"


def quality_log(df: DataFrame, key: str, column: str) -> DataFrame:
    """Event lines of a quality summary as rows; the last line per field counts."""
    lines = df.select(key, F.posexplode(F.split(text(column), "\n")).alias("pos", "line"))
    parsed = lines.withColumn("_c", captures(F.col("line"), _EVENT, 7)).filter("_c is not null")
    names = ("dimension", "field", "status", "stage", "source", "quality", "detail")
    rows = parsed.select(key, "pos", *[F.get(F.col("_c"), F.lit(i)).alias(n) for i, n in enumerate(names)])
    last = rows.groupBy(key, "dimension", "field").agg(F.max(F.struct("pos", "status", "stage", "source", "quality", "detail")).alias("_l"))
    return last.select(
        key, "dimension", "field", "_l.status", "_l.stage", "_l.source", F.col("_l.quality").cast("double").alias("quality"), "_l.detail"
    )


def render_quality(rows: DataFrame, key: str) -> DataFrame:
    """Quality rows back to one sorted text per key (bounded by the field list)."""
    line = F.concat(
        F.col("dimension"), F.lit("."), F.col("field"), F.lit(": status="), F.col("status"), F.lit("; stage="), F.col("stage"),
        F.lit("; source="), F.col("source"), F.lit("; quality="), F.format_string("%.2f", "quality"),
        F.when(F.col("detail") != "", F.concat(F.lit("; detail="), F.col("detail"))).otherwise(""),
    )
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("summary"))


def collection_status(required: list[str], placeholders: list[str], all_fields: list[str], failure_prefix: str, missing_prefix: str) -> Column:
    """uncollected / success / failed from stored fields."""
    ok = F.lit(True)
    for f in required:
        ok = ok & (text(f) != "")
    for f in all_fields:
        for p in placeholders:
            ok = ok & ~F.contains(text(f), F.lit(p))
    remarks = text("remarks")
    ok = ok & (~remarks.startswith(failure_prefix) | remarks.startswith(missing_prefix))
    return F.when(F.col("collected_at").isNull(), "uncollected").when(ok, "success").otherwise("failed")


def missing_fields(fields: list[str], optional: list[str], placeholders: list[str]) -> Column:
    """Required fields that are empty or hold a placeholder."""
    def gap(f: str) -> Column:
        test = text(f) == ""
        for p in placeholders:
            test = test | F.contains(text(f), F.lit(p))
        return F.when(test, F.lit(f))

    return F.array_compact(F.array(*[gap(f) for f in fields if f not in optional]))


def first_usable(sources: DataFrame, keys: list[str], value: str, priority: str, placeholders: list[str]) -> DataFrame:
    """Best-priority value per key that is neither empty nor a placeholder."""
    usable = text(value) != ""
    for p in placeholders:
        usable = usable & ~F.contains(text(value), F.lit(p))
    return sources.filter(usable).groupBy(*keys).agg(F.min(F.struct(priority, value)).alias("_b")).select(
        *keys, F.col(f"_b.{value}").alias(value), F.col(f"_b.{priority}").alias(priority)
    )


def link_scores(label: str, rules: dict[str, float]) -> Column:
    """Additive keyword score of a link label (a fixed rule list)."""
    score = F.lit(0.0)
    lowered = F.lower(text(label))
    for word, points in rules.items():
        score = score + F.when(F.contains(lowered, F.lit(word)), float(points)).otherwise(0.0)
    return score


def top_snippets(df: DataFrame, keys: list[str], value: str, rank: str, noise: list[str], k: int = 3) -> DataFrame:
    """First k non-noise texts per key, joined; k rows per key and task leave the map side."""
    clean = F.trim(text(value)) != ""
    for phrase in noise:
        clean = clean & ~F.contains(F.lower(text(value)), F.lit(phrase))
    w = Window.partitionBy(*keys).orderBy(rank)
    kept = df.filter(clean).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    ordered = F.sort_array(F.collect_list(F.struct("_rn", value)))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value]), " | ").alias("summary"))


# --- stored reviews -------------------------------------------------------------------------


def review_payload(df: DataFrame, raw: str, action: str) -> DataFrame:
    """Stored review text to decision, target, multiplier and delta; bad rows carry their error."""
    from ..functions import labels

    schema = "decision string, target_action string, reason string, risk_flags array<string>, evidence_grade string, confidence_delta string, stake_multiplier string"
    body = F.regexp_extract(text(raw), r"(?s)(\{.*\})", 1)
    df = df.withColumn("_j", F.from_json(body, schema)).withColumns(
        {"_d": F.lower(F.trim(text("_j.decision"))), "_g": F.lower(F.trim(text("_j.evidence_grade")))}
    )
    d, g = F.col("_d"), F.col("_g")
    unified = d.isin("approve", "reject", "yes", "no", "ok", "veto", "go", "skip") & F.col("_j.target_action").isNull()
    side = F.when(d.isin(*V.REVIEW_WORDS_APPROVE), "approve").otherwise("reject")
    grade = F.when(g.isin(*V.EVIDENCE_GRADES), g).when(side == "reject", "unsafe").otherwise("adequate")
    side = F.when((side == "approve") & (grade == "unsafe"), "reject").otherwise(side)
    df = df.withColumns({"_u": unified, "_rule": F.concat_ws("/", side, grade), "_grade": F.when(unified, grade).otherwise(g)})
    rule = lambda i: F.coalesce(*[
        F.when(F.col("_rule") == f"{a}/{b}", F.lit(v[i])) for (a, b), v in V.REVIEW_RULES.items()
    ])
    now = labels.action_label(action)
    legacy_target = labels.action_label("_j.target_action")
    decided = F.when(F.col("_u"), rule(0)).otherwise(d)
    target = F.when(
        F.col("_u"),
        F.when(rule(0) == "downgrade", labels.step_down(now, F.lit("watch")))
        .when(rule(0) == "abstain", "watch").otherwise(now),
    ).otherwise(legacy_target)
    error = (
        F.when(F.col("_j.decision").isNull() & F.col("_j.reason").isNull(), "not_json")
        .when(F.trim(text("_j.reason")) == "", "no_reason")
        .when(~F.col("_u") & ~d.isin("keep", "promote", "downgrade", "abstain"), "bad_decision")
        .when(~F.col("_u") & ~legacy_target.isin(*V.ACTIONS), "bad_target")
        .when(~F.col("_u") & (g != "") & ~g.isin(*V.EVIDENCE_GRADES), "bad_grade")
        .otherwise("")
    )
    return df.withColumns(
        {
            "decision": decided, "target_action": target, "evidence_grade": F.col("_grade"),
            "stake_multiplier": clamp(F.when(F.col("_u"), rule(2)).otherwise(text_num("_j.stake_multiplier", 1.0)), 0.0, 1.0),
            "confidence_delta": clamp(F.when(F.col("_u"), rule(3)).otherwise(text_num("_j.confidence_delta")), -0.12, 0.08),
            "error": error,
        }
    ).drop("_j", "_d", "_g", "_u", "_rule", "_grade")


def score_candidates(raw: Column, fallback: Column, limit: int = 4) -> Column:
    """Distinct scores named in a stored text, else the model's own, at most ``limit``."""
    home = F.regexp_extract_all(text(raw), F.lit(r"(\d+)\s*[:\-]\s*(\d+)"), F.lit(1))
    away = F.regexp_extract_all(text(raw), F.lit(r"(\d+)\s*[:\-]\s*(\d+)"), F.lit(2))
    goal = lambda x: F.least(F.coalesce(x.try_cast("int"), F.lit(9)), F.lit(9)).cast("string")
    named = F.array_distinct(F.zip_with(home, away, lambda h, a: F.concat(goal(h), F.lit("-"), goal(a))))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(fallback), 1, limit)


def coverage_class(label: Column, groups: dict[str, list[str]]) -> Column:
    """First group with a keyword in the label (fixed lists, in order)."""
    chain = None
    for name, words in groups.items():
        test = F.lit(False)
        for w in words:
            test = test | F.contains(label, F.lit(w))
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("other")


def coverage_report(df: DataFrame, scopes: dict[str, Column], klass: Column, name: str, top: int = 12) -> DataFrame:
    """Counts and shares of each class per scope; the largest ``top``."""
    entries = F.array(*[F.struct(F.lit(s).alias("scope"), c.alias("on")) for s, c in scopes.items()])
    rows = df.select(klass.alias(name), F.explode(entries).alias("e")).filter("e.on")
    counted = rows.groupBy("e.scope", name).agg(F.count(F.lit(1)).alias("match_count"))
    whole = Window.partitionBy("scope")
    place = F.row_number().over(whole.orderBy(F.col("match_count").desc(), name))
    return counted.withColumns(
        {"place": place.cast("long"), "share": round_to(ratio("match_count", F.sum("match_count").over(whole)), 6)}
    ).filter(F.col("place") <= top)


def metric_ratios(df: DataFrame, games: str, totals: list[str]) -> DataFrame:
    """Per-game ratios of a team metric table."""
    return df.withColumns({f"{t}_per_game": round_to(ratio(num(t), num(games)), 6) for t in totals})
