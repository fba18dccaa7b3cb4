"""Text and page extraction, forecast models and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels, models, probs
from ..functions.numeric import num, round_to
from ..operators import extract
from .adapters import ctes, load, plain, view
from .oracle import argmax, big, by_outcome, clip, ratio, with_ctes
from .registry import query


def sql(body: str, *views: str, extra=()) -> str:
    return with_ctes(plain(body), *ctes(*views), *[plain(e) for e in extra])


_S = lambda e: f"CAST({e} AS {{string}})"
N = {
    "n": "5 + k % 6", "w": "k % 5", "d": "k % 3", "l": "k % 4", "gf": "k % 19", "ga": "k % 17", "wr": "k % 101", "hr": "k % 97", "orr": "k % 89",
    "rk": "1 + k % 18", "tc": "18 + k % 3", "pts": "k % 60", "gd": "k % 41 - 20",
    "o1": "150 + k % 300", "o2": "300 + k % 100", "o3": "200 + k % 400",
}
NUMS = "SELECT match_id, match_id AS k, home_team, away_team, league FROM {wide}"


def _D2(e: str) -> str:
    """Integer hundredths as decimal text."""
    whole = f"CAST(floor(({e}) / 100e0) AS INT)"
    return f"concat({_S(whole)}, '.', substring({_S(f'CAST(100 + ({e}) % 100 AS INT)')}, 2, 2))"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(f"'{p[1:]}'" if p.startswith("=") else _S(f"CAST({N[p]} AS INT)") for p in parts) + ")"


TEXTS = "SELECT match_id, k, " + ", ".join([
    _cat("=近", "n", "=场  ", "w", "=胜", "d", "=平", "l", "=负，进", "gf", "=球失", "ga", "=球，胜率", "wr", "=%，赢盘率", "hr", "=%，大球率", "orr", "=%") + " AS recent_form_home",
    "'暂无' AS recent_form_away",
    _cat("=主场 ", "w", "=胜", "d", "=平", "l", "=负，进", "gf", "=失", "ga", "= | 客场 ", "d", "=胜", "l", "=平", "w", "=负，进", "ga", "=失", "gf") + " AS home_away_form",
    _cat("=近", "n", "=次交锋 ", "w", "=胜", "d", "=平", "l", "=负，进", "gf", "=球失", "ga", "=球") + " AS head_to_head_summary",
    _cat("=第", "rk", "=/", "tc", "=，", "pts", "=分，", "w", "=胜", "d", "=平", "l", "=负，进", "gf", "=，失", "ga", "=，净胜", "gd") + " AS elo_home",
    "'' AS elo_away",
    f"concat('初赔 ', {_D2(N['o1'])}, '/', {_D2(N['o2'])}, '/', {_D2(N['o3'])}, CASE WHEN k % 2 = 0 THEN concat(' -> 即时 ', {_D2(N['o2'])}, '/', {_D2(N['o3'])}, '/', {_D2(N['o1'])}) ELSE '' END) AS european_odds_movement_summary",
    f"concat('亚盘平均 初盘 ', {_D2('80 + k % 30')}, '/', CASE k % 4 WHEN 0 THEN '半球' WHEN 1 THEN '受半球' WHEN 2 THEN '球半' ELSE '平手' END, '/', {_D2('85 + k % 20')}, ' -> 即时 ', {_D2('82 + k % 25')}, '/', CASE k % 3 WHEN 0 THEN '一球' WHEN 1 THEN '-0.25' ELSE '受平半' END, '/', {_D2('83 + k % 27')}) AS asian_handicap_summary",
    f"concat('投注比 胜', {_S('CAST(k % 50 AS INT)')}, '% 平', {_S('CAST(k % 30 AS INT)')}, '% 负', {_S('CAST(k % 40 AS INT)')}, '%') AS betting_heat_summary",
    f"concat('A: squad market value EUR ', {_D2('1000 + k % 9000')}, 'm\\n', 'B: ', CASE WHEN k % 3 = 0 THEN 'unknown' ELSE concat({_D2('200 + k % 700')}, 'm EUR') END) AS market_value_summary",
    "CASE k % 3 WHEN 0 THEN '主队：A/B/C\\n客队：D/E\\n关键伤停：主队X成疑，一；客队Y，二' WHEN 1 THEN '未在公开来源中命中预计首发' ELSE '' END AS injury_or_lineup_notes",
]) + f" FROM ({NUMS}) nums"
NUM_CTE = f"nums AS ({NUMS})"


def texts(spark, sf_dir):
    return view(spark, sf_dir, TEXTS)


_G = lambda a: f"greatest({a}, 1)"
_n = lambda c: f"({N[c]})"


@query("extract_recent_form", sql(
    f"""SELECT match_id, {', '.join(f'CAST({N[c]} AS INT) AS {a}' for c, a in (('n', 'matches'), ('w', 'wins'), ('d', 'draws'), ('l', 'losses'), ('gf', 'goals_for'), ('ga', 'goals_against')))},
    {_n('wr')} / 100e0 AS win_rate, {_n('hr')} / 100e0 AS handicap_rate, {_n('orr')} / 100e0 AS over_rate,
    round(({_n('w')} * 3 + {_n('d')}) / {_n('n')}::DOUBLE, 6) AS points_per_game, round(({_n('gf')} - {_n('ga')}) / {_n('n')}::DOUBLE, 6) AS goal_diff_per_game, 0 AS away_matches FROM nums""",
    "wide", extra=[NUM_CTE]))
def extract_recent_form(spark, sf_dir):
    df = extract.summary_features(texts(spark, sf_dir))
    r = F.col("recent_home")
    return df.select(
        "match_id", *[r[c].alias(c) for c in ("matches", "wins", "draws", "losses", "goals_for", "goals_against", "win_rate", "handicap_rate", "over_rate")],
        round_to(r["points_per_game"], 6).alias("points_per_game"), round_to(r["goal_diff_per_game"], 6).alias("goal_diff_per_game"),
        F.col("recent_away.matches").alias("away_matches"),
    )


_PLACE = f"(0.5::DOUBLE - ({_n('rk')} - 1) / ({_n('tc')} - 1)::DOUBLE) * 180e0"
_rt = clip(f"1450e0 + {_PLACE} + {_n('pts')} * 2.4::DOUBLE + {_n('gd')} * 3e0 + {_n('w')} * 1.5::DOUBLE", "1325e0", "1875e0")


@query("extract_strength_and_splits", sql(
    f"""SELECT match_id, CAST({N['rk']} AS INT) AS rank, CAST({N['tc']} AS INT) AS team_count, CAST({N['gd']} AS INT) AS goal_diff, round({_rt}, 6) AS rating, 1500e0 AS away_rating,
    round(({_n('w')} * 3 + {_n('d')}) / {_G(f"{_n('w')} + {_n('d')} + {_n('l')}")}::DOUBLE, 6) AS home_ppg, round(({_n('d')} * 3 + {_n('l')}) / {_G(f"{_n('w')} + {_n('d')} + {_n('l')}")}::DOUBLE, 6) AS away_ppg,
    round(({_n('w')} - {_n('l')}) / {_n('n')}::DOUBLE, 6) AS h2h_edge FROM nums""", "wide", extra=[NUM_CTE]))
def extract_strength_and_splits(spark, sf_dir):
    df = extract.summary_features(texts(spark, sf_dir))
    return df.select(
        "match_id", *[F.col(f"strength_home.{c}").alias(c) for c in ("rank", "team_count", "goal_diff")],
        round_to("strength_home.rating", 6).alias("rating"), F.col("strength_away.rating").alias("away_rating"),
        round_to("split.home_ppg", 6).alias("home_ppg"), round_to("split.away_ppg", 6).alias("away_ppg"), round_to("h2h.edge", 6).alias("h2h_edge"),
    )


@query("extract_market_quotes", sql(
    f"""SELECT match_id, CASE WHEN k % 2 = 0 THEN {_n('o2')} ELSE {_n('o1')} END / 100e0 AS odds_home, CASE WHEN k % 2 = 0 THEN {_n('o3')} ELSE {_n('o2')} END / 100e0 AS odds_draw,
    CASE WHEN k % 2 = 0 THEN {_n('o1')} ELSE {_n('o3')} END / 100e0 AS odds_away,
    CASE k % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 1.5::DOUBLE ELSE 0e0 END AS initial_line, CASE k % 3 WHEN 0 THEN 1e0 WHEN 1 THEN -0.25::DOUBLE ELSE -0.25::DOUBLE END AS current_line,
    (82 + k % 25) / 100e0 AS current_home_odds, k % 50 / 100e0 AS heat_home, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS value_coverage,
    CASE WHEN k % 3 = 0 THEN 0e0 ELSE round(((1000 + k % 9000) / 100e0) / ((200 + k % 700) / 100e0), 4) END AS value_ratio,
    CASE WHEN k % 3 = 0 THEN 0e0 ELSE round(ln(1e0 + (1000 + k % 9000) / 100e0) - ln(1e0 + (200 + k % 700) / 100e0), 6) END AS value_log_gap FROM nums""", "wide", extra=[NUM_CTE]))
def extract_market_quotes(spark, sf_dir):
    df = extract.summary_features(texts(spark, sf_dir))
    return df.select(
        "match_id", *[F.col(f"odds.{o}").alias(f"odds_{o}") for o in V.OUTCOMES], F.col("handicap.initial_line").alias("initial_line"),
        F.col("handicap.current_line").alias("current_line"), F.col("handicap.current_home_odds").alias("current_home_odds"),
        F.col("heat.home").alias("heat_home"), F.col("team_value.coverage").alias("value_coverage"), F.col("team_value.ratio").alias("value_ratio"),
        F.col("team_value.log_gap").alias("value_log_gap"),
    )


@query("extract_lineups", sql(
    """SELECT match_id, CASE k % 3 WHEN 0 THEN 3 ELSE 0 END AS home_starters, CASE k % 3 WHEN 0 THEN 2 ELSE 0 END AS away_starters,
    CASE k % 3 WHEN 0 THEN 0 ELSE 0 END AS home_absent_count, CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS home_doubtful_count, CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS away_absent_count,
    CASE k % 3 WHEN 0 THEN round(1e0 - (0.03::DOUBLE + 8 * 0.015::DOUBLE), 6) ELSE 0.92::DOUBLE END AS home_availability, CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS data_available FROM nums""",
    "wide", extra=[NUM_CTE]))
def extract_lineups(spark, sf_dir):
    df = extract.lineup_metrics(texts(spark, sf_dir), "injury_or_lineup_notes")
    return df.select(
        "match_id", "home_starters", "away_starters", "home_absent_count", "home_doubtful_count", "away_absent_count",
        round_to("home_availability", 6).alias("home_availability"), "data_available",
    )


@query("collection_status_counts", sql(
    """SELECT CASE WHEN k % 13 = 0 THEN 'uncollected' WHEN k % 3 = 2 OR k % 3 = 1 OR k % 11 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS match_count FROM nums GROUP BY 1""", "wide", extra=[NUM_CTE]))
def collection_status_counts(spark, sf_dir):
    df = texts(spark, sf_dir).withColumns(
        {
            "collected_at": F.when(F.col("k") % 13 != 0, F.lit("2024-01-01")),
            "remarks": F.when(F.col("k") % 11 == 0, "采集失败：x").otherwise(""),
        }
    )
    fields = ["recent_form_home", "home_away_form", "injury_or_lineup_notes", "asian_handicap_summary"]
    status = extract.collection_status(fields, ["未在公开来源中命中"], fields, "采集失败", "采集失败：缺少")
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("match_count"))


@query("missing_field_counts", sql(
    """SELECT 'injury_or_lineup_notes' AS field, count(*) AS match_count FROM nums WHERE k % 3 <> 0 UNION ALL SELECT 'elo_away', count(*) FROM nums""", "wide", extra=[NUM_CTE]))
def missing_field_counts(spark, sf_dir):
    fields = ["recent_form_home", "injury_or_lineup_notes", "elo_away", "elo_home"]
    missing = extract.missing_fields(fields, [], ["未在公开来源中命中"])
    return texts(spark, sf_dir).select(F.explode(missing).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("match_count"))


# --- pages and documents -----------------------------------------------------------


@query("page_list_links", plain(
    """SELECT page_id, href, min(pos) AS pos, arg_min(label, pos) AS label, count(*) AS copies FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 1, 's')) AS href, trim(unnest(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 2, 's'))) AS label,
      generate_subscripts(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 1, 's'), 1) - 1 AS pos FROM pages) GROUP BY 1, 2"""))
def page_list_links(spark, sf_dir):
    return extract.page_links(load(spark, sf_dir, "pages"))


PAGE_URLS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://www.flashscore.com/m/', {pid}) WHEN 1 THEN concat('https://odds.500.com/fenxi/shuju-', {pid}, '.shtml')
 WHEN 2 THEN concat('https://odds.500.com/fenxi/ouzhi-', {pid}, '.shtml') WHEN 3 THEN concat('https://trade.500.com/sfc/?expect=', {pid}) ELSE url END AS url FROM {pages}""".replace(
    "{pid}", "CAST(page_id AS {string})")


@query("page_source_groups", plain(
    """SELECT CASE page_id % 5 WHEN 0 THEN 'dim2-lineup' WHEN 1 THEN 'dim12-data' WHEN 2 THEN 'dim3-odds' WHEN 3 THEN 'match-list' ELSE 'other' END AS page_group, count(*) AS page_count FROM pages GROUP BY 1"""))
def page_source_groups(spark, sf_dir):
    rows = view(spark, sf_dir, PAGE_URLS)
    return rows.groupBy(extract.page_group(F.col("url")).alias("page_group")).agg(F.count(F.lit(1)).alias("page_count"))


_PRICED = """SELECT doc_id, concat(text, ' €', CAST(doc_id % 90 + 1 AS {string}), '.5m and £2bn, $ 300k then EUR ', CAST(doc_id % 7 + 1 AS {string}), ' m') AS text FROM {documents}"""


_RE = "(?i)(€|EUR|£|GBP|\\$|USD)\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(bn|b|billion|m|mil|million|k|th|thousand)?"


@query("quoted_value_sums", with_ctes(
    """SELECT doc_id, count(*) AS price_count, CASE WHEN count(*) >= 4 THEN round(sum(v), 3) ELSE 0 END AS partial_value, round(max(v), 3) AS max_value FROM (
      SELECT doc_id, CAST(replace(a, ',', '.') AS DOUBLE) * CASE WHEN lower(u) IN ('bn', 'b', 'billion') THEN 1000e0 WHEN lower(u) IN ('k', 'th', 'thousand') THEN 0.001::DOUBLE ELSE 1e0 END
        * CASE WHEN lower(c) IN ('£', 'gbp') THEN 1.17::DOUBLE WHEN lower(c) IN ('$', 'usd') THEN 0.92::DOUBLE ELSE 1e0 END AS v FROM parts) WHERE v > 0 GROUP BY 1""",
    f"priced AS ({plain(_PRICED)})",
    f"parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RE}', 1)) AS c, unnest(regexp_extract_all(text, '{_RE}', 2)) AS a, unnest(regexp_extract_all(text, '{_RE}', 3)) AS u FROM priced)"))
def quoted_value_sums(spark, sf_dir):
    return extract.partial_values(view(spark, sf_dir, _PRICED), "doc_id", "text")


_QUOTES = """SELECT l_orderkey AS match_id, concat({a}, ' ', {b}, ' 3.10 ', {c}, ' 3.05 4.20') AS line, {ia} / 100e0 AS a, {ib} / 100e0 AS b, {ic} / 100e0 AS c FROM {lineitem}""".replace(
    "{a}", _D2("150 + l_partkey % 200")).replace("{b}", _D2("250 + l_suppkey % 80")).replace("{c}", _D2("140 + l_partkey % 210")).replace(
    "{ia}", "(150 + l_partkey % 200)").replace("{ib}", "(250 + l_suppkey % 80)").replace("{ic}", "(140 + l_partkey % 210)")


@query("bookmaker_median_odds", plain(
    f"""SELECT match_id, round(median(a), 4) AS initial_home, round(median(b), 4) AS initial_draw, 3.1::DOUBLE AS initial_away, round(median(c), 4) AS current_home, 3.05::DOUBLE AS current_draw, 4.2::DOUBLE AS current_away,
    round(round(median(c), 10) - round(median(a), 10), 4) AS move_home, round(3.05::DOUBLE - round(median(b), 10), 4) AS move_draw, 1.1::DOUBLE AS move_away FROM ({_QUOTES}) GROUP BY 1"""))
def bookmaker_median_odds(spark, sf_dir):
    rows = extract.bookmaker_rows(view(spark, sf_dir, _QUOTES), "match_id", "line")
    return extract.median_odds(rows, "match_id")


_TABLES = """SELECT o_orderkey AS table_id, concat('team|played|points\\nA|', CAST(o_orderkey % 30 AS {string}), '|', CAST(o_custkey % 60 AS {string}), '\\nB|', CAST(o_custkey % 30 AS {string}), '|7') AS body FROM {orders}"""


@query("standings_from_tables", plain(
    """SELECT o_orderkey AS table_id, 'A' AS team, CAST(o_orderkey % 30 AS VARCHAR) AS played, CAST(o_custkey % 60 AS VARCHAR) AS points, 2 AS team_count FROM orders
    UNION ALL SELECT o_orderkey, 'B', CAST(o_custkey % 30 AS VARCHAR), '7', 2 FROM orders"""))
def standings_from_tables(spark, sf_dir):
    return extract.table_cells(view(spark, sf_dir, _TABLES), "table_id", "body", {"team": "team", "played": "played", "points": "points"})


_QLOG = """SELECT match_id, concat('dim1.elo: status=ok; stage=primary; source=a; quality=0.86\\nnoise\\ndim1.elo: status=missing; stage=fallback; source=b; quality=0.', CAST(10 + match_id % 90 AS {string}), '; detail=x',
 '\\ndim3.heat: status=ok; stage=primary; source=c; quality=0.50') AS log FROM {wide}"""


@query("quality_log_fields", sql(
    """SELECT match_id, 'dim1' AS dimension, 'elo' AS field, 'missing' AS status, 'fallback' AS stage, 'b' AS source, (10 + match_id % 90) / 100e0 AS quality, 'x' AS detail FROM wide
    UNION ALL SELECT match_id, 'dim3', 'heat', 'ok', 'primary', 'c', 0.5::DOUBLE, '' FROM wide""", "wide"))
def quality_log_fields(spark, sf_dir):
    return extract.quality_log(view(spark, sf_dir, _QLOG), "match_id", "log")


@query("quality_log_rendered", sql(
    """SELECT match_id, concat('dim1.elo: status=missing; stage=fallback; source=b; quality=0.', 10 + match_id % 90, '; detail=x', chr(10), 'dim3.heat: status=ok; stage=primary; source=c; quality=0.50') AS summary FROM wide""", "wide"))
def quality_log_rendered(spark, sf_dir):
    return extract.render_quality(extract.quality_log(view(spark, sf_dir, _QLOG), "match_id", "log"), "match_id")


_SRC = """SELECT l_orderkey AS match_id, l_linenumber AS priority, CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN '未命中' ELSE concat('v', CAST(l_partkey AS {string})) END AS value FROM {lineitem}"""


@query("coalesced_sources", plain(
    f"""SELECT match_id, arg_min(value, (priority, value)) AS value, min(priority) AS priority FROM ({_SRC}) WHERE value NOT IN ('', '未命中') GROUP BY 1"""))
def coalesced_sources(spark, sf_dir):
    return extract.first_usable(view(spark, sf_dir, _SRC), ["match_id"], "value", "priority", ["未命中"])


_RULES = {"the": 2, "ion": 3, "er": 1, "privacy": -5}


_LINKS = """links AS (SELECT page_id, href, min(pos) AS pos, arg_min(label, pos) AS label FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 1, 's')) AS href, trim(unnest(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 2, 's'))) AS label,
  generate_subscripts(regexp_extract_all(html, '<li>\\s*<a href="([^"]*)">(.*?)</a>', 1, 's'), 1) - 1 AS pos FROM pages) GROUP BY 1, 2)"""
_POINTS = " + ".join(f"CASE WHEN contains(lower(label), '{w}') THEN {p}e0 ELSE 0e0 END" for w, p in _RULES.items())


@query("best_page_link", with_ctes(
    f"SELECT page_id, pos, href, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, href) AS rn FROM (SELECT *, {_POINTS} AS score FROM links)) WHERE rn = 1", _LINKS))
def best_page_link(spark, sf_dir):
    from ..operators.joins import prefer

    links = extract.page_links(load(spark, sf_dir, "pages")).withColumn("score", extract.link_scores("label", _RULES))
    return prefer(links, ["page_id"], -F.col("score"), ["pos", "href", "score"])


@query("conversation_snippets", plain(
    """SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations
    WHERE trim(text) <> '' AND NOT contains(lower(text), 'privacy policy')) WHERE rn <= 3 GROUP BY 1"""))
def conversation_snippets(spark, sf_dir):
    return extract.top_snippets(load(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn", ["privacy policy"])


_REV = """SELECT match_id, recommendation, CASE match_id % 5 WHEN 0 THEN 'note {{"decision": "approve", "evidence_grade": "weak", "reason": "r", "risk_flags": []}} end'
 WHEN 1 THEN '{{"decision": "no", "evidence_grade": "strong", "reason": "r"}}' WHEN 2 THEN '{{"decision": "downgrade", "target_action": "轻仓", "reason": "r", "stake_multiplier": "1.7", "confidence_delta": "-0.5"}}'
 WHEN 3 THEN '{{"decision": "maybe", "target_action": "main", "reason": "r"}}' ELSE 'no json here' END AS raw FROM {wide}"""


@query("stored_review_payloads", sql(
    """SELECT match_id, CASE match_id % 5 WHEN 0 THEN 'downgrade' WHEN 1 THEN 'abstain' WHEN 2 THEN 'downgrade' WHEN 3 THEN 'maybe' ELSE '' END AS decision,
    CASE match_id % 5 WHEN 0 THEN CASE recommendation WHEN 'main' THEN 'light' ELSE 'watch' END WHEN 1 THEN 'watch' WHEN 2 THEN 'light' WHEN 3 THEN 'main' ELSE 'watch' END AS target_action,
    CASE match_id % 5 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0e0 ELSE 1e0 END AS stake_multiplier, CASE match_id % 5 WHEN 0 THEN -0.04::DOUBLE WHEN 1 THEN -0.06::DOUBLE WHEN 2 THEN -0.12::DOUBLE ELSE 0e0 END AS confidence_delta,
    CASE match_id % 5 WHEN 3 THEN 'bad_decision' WHEN 4 THEN 'not_json' ELSE '' END AS error FROM wide""", "wide"))
def stored_review_payloads(spark, sf_dir):
    rows = extract.review_payload(view(spark, sf_dir, _REV), "raw", "recommendation")
    return rows.select("match_id", "decision", "target_action", "stake_multiplier", "confidence_delta", "error")


_SC = """SELECT match_id, CASE WHEN match_id % 3 = 0 THEN '' ELSE concat('最可能比分：', predicted_score, ' 次选比分一: 2:1 / 12-0 / 2-1') END AS raw FROM {wide}"""


@query("stored_score_candidates", sql(
    """SELECT match_id, CASE WHEN match_id % 3 = 0 THEN '1-1,0-0' WHEN predicted_score = '' THEN '2-1,9-0' WHEN predicted_score = '2-1' THEN '2-1,9-0' ELSE concat(predicted_score, ',2-1,9-0') END AS scores FROM wide""", "wide"))
def stored_score_candidates(spark, sf_dir):
    rows = view(spark, sf_dir, _SC)
    fallback = F.array(F.lit("1-1"), F.lit("0-0"))
    return rows.select("match_id", F.array_join(extract.score_candidates(F.col("raw"), fallback), ",").alias("scores"))


@query("league_coverage_report", sql(
    f"""SELECT scope, coverage, match_count, place, round(match_count / sum(match_count) OVER (PARTITION BY scope)::DOUBLE, 6) AS share FROM (
      SELECT scope, coverage, count(*) AS match_count, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, coverage) AS place FROM (
        SELECT CASE WHEN league IN ('英超', '英冠') THEN 'england' WHEN league IN ('西甲', '意甲', '德甲', '法甲') THEN 'top' ELSE 'other' END AS coverage, 'all' AS scope FROM wide
        UNION ALL SELECT CASE WHEN league IN ('英超', '英冠') THEN 'england' WHEN league IN ('西甲', '意甲', '德甲', '法甲') THEN 'top' ELSE 'other' END, 'settled' FROM wide WHERE match_id % 2 = 0) GROUP BY 1, 2)""", "wide"))
def league_coverage_report(spark, sf_dir):
    groups = {"england": ["英超", "英冠"], "top": ["西甲", "意甲", "德甲", "法甲"]}
    wide = load(spark, sf_dir, "wide")
    return extract.coverage_report(
        wide, {"all": F.lit(True), "settled": F.col("match_id") % 2 == 0}, extract.coverage_class(F.col("league"), groups), "coverage"
    )


@query("top_missing_names", plain(
    """SELECT c_name, missing_count FROM (SELECT o_custkey, count(*) AS missing_count FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey ORDER BY missing_count DESC, c_name LIMIT 30"""))
def top_missing_names(spark, sf_dir):
    missing = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("missing_count"))
    named = missing.join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return named.select("c_name", "missing_count").orderBy(F.col("missing_count").desc(), "c_name").limit(30)


@query("team_metric_ratios", plain(
    """SELECT l_suppkey, games, round(xg, 6) AS xg, coalesce(round(xg / games, 6), 0) AS xg_per_game FROM (SELECT l_suppkey, count(*) AS games, round(sum(l_quantity), 6) AS xg FROM lineitem GROUP BY 1)"""))
def team_metric_ratios(spark, sf_dir):
    teams = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("games"), round_to(F.sum("l_quantity"), 6).alias("xg"))
    return extract.metric_ratios(teams, "games", ["xg"]).select("l_suppkey", "games", "xg", "xg_per_game")


@query("rest_days_and_load", plain(
    """WITH g AS (SELECT o_custkey AS team, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT team, day, n AS games_on_day, coalesce(date_diff('day', lag(day) OVER w, day), 0) AS rest_days,
    CAST(coalesce(sum(n) OVER (PARTITION BY team ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS load FROM g WINDOW w AS (PARTITION BY team ORDER BY day)"""))
def rest_days_and_load(spark, sf_dir):
    games = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team"), F.col("o_orderdate").alias("ts"))
    return extract.rest_and_load(games, "team", "ts")


_LOOSE = """SELECT match_id, CASE match_id % 6 WHEN 0 THEN concat('2024-03-', d, ' 10:20:30') WHEN 1 THEN concat(' 2024-03-', d, '  10:20') WHEN 2 THEN concat('12-', d, ' 08:00') WHEN 3 THEN concat('24-03-', d)
 WHEN 4 THEN concat('2024-03-', d) ELSE 'tbd' END AS t FROM (SELECT match_id, CAST(10 + match_id % 9 AS {string}) AS d FROM {wide}) x"""


@query("loose_match_times", sql(
    """SELECT match_id, CASE match_id % 6 WHEN 0 THEN concat('2024-03-', d, ' 10:20:30') WHEN 1 THEN concat('2024-03-', d, ' 10:20:00') WHEN 2 THEN concat('2023-12-', d, ' 08:00:00') WHEN 5 THEN NULL
    ELSE concat('2024-03-', d, ' 00:00:00') END AS parsed FROM (SELECT match_id, CAST(10 + match_id % 9 AS VARCHAR) AS d FROM wide)""", "wide"))
def loose_match_times(spark, sf_dir):
    t = extract.loose_time(F.col("t"), F.expr("TIMESTAMP '2024-03-15 00:00:00'"))
    return view(spark, sf_dir, _LOOSE).select("match_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("event_payload_fields", plain("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"))
def event_payload_fields(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- models ------------------------------------------------------------------------------


def feature_map() -> models.Features:
    c = num
    home_ppg, away_ppg = c("recent_home_ppg"), c("recent_away_ppg")
    return {
        "home_ppg": home_ppg, "away_ppg": away_ppg, "home_gd": c("recent_home_gf_pg") - c("recent_home_ga_pg"),
        "away_gd": c("recent_away_gf_pg") - c("recent_away_ga_pg"), "home_gf": c("recent_home_gf_pg"), "home_ga": c("recent_home_ga_pg"),
        "away_gf": c("recent_away_gf_pg"), "away_ga": c("recent_away_ga_pg"), "split_home_ppg": c("home_split_ppg"), "split_away_ppg": c("away_split_ppg"),
        "split_home_gf": c("recent_home_gf_pg"), "split_home_ga": c("recent_home_ga_pg"), "split_away_gf": c("recent_away_gf_pg"), "split_away_ga": c("recent_away_ga_pg"),
        "rating_gap": c("home_rating") - c("away_rating"), "value_gap": (c("value_ratio") - 3.0) * 10.0,
        "form_residual_gap": home_ppg - 1.4, "goal_residual_gap": away_ppg - 1.4,
        "lineup_on": F.col("match_id") % 5 != 0, "home_available": c("lineup_home_availability"), "away_available": c("lineup_away_availability"),
        "rest_gap": c("rest_days_home") - c("rest_days_away"), "load_gap": c("schedule_load_away") - c("schedule_load_home"),
        "h2h": c("h2h_edge"), "motivation": F.lit(0.15), "xg_on": F.col("xg_coverage") != 0,
        "home_xg": c("home_xg"), "home_xga": c("home_xga"), "away_xg": c("away_xg"), "away_xga": c("away_xga"),
        "value_on": F.col("value_available") != 0, "home_win_rate": c("quality_score"), "away_win_rate": c("model_agreement"),
    }


def modelled(spark, sf_dir):
    """Quant, heuristic, legacy and blended probabilities in one projection chain."""
    f = feature_map()
    df = load(spark, sf_dir, "wide").withColumns(models.quant_rates(f))
    df = models.with_goal_columns(df)
    quant = models.score_outcomes()
    ml, _ = models.heuristic_model(f)
    legacy = models.legacy_model(f, probs.triple("market"), probs.triple("market"))
    df = df.withColumns({f"q_{o}": quant[o] for o in V.OUTCOMES} | {f"ml_{o}": ml[o] for o in V.OUTCOMES} | {f"lg_{o}": legacy[o] for o in V.OUTCOMES})
    q, m = ({o: F.col(f"{p}_{o}") for o in V.OUTCOMES} for p in ("q", "ml"))
    df = df.withColumn("agree", models.agreement(q, m))
    b = models.blend(q, m, num("quality_score"), F.col("agree"), probs.triple("market"))
    return df.withColumns({f"b_{o}": b[o] for o in V.OUTCOMES})


_FX = {
    "form": "(recent_home_ppg - recent_away_ppg) * 0.40::DOUBLE + (recent_home_ppg - 1.4::DOUBLE) * 0.60::DOUBLE",
    "goal": "((recent_home_gf_pg - recent_home_ga_pg) - (recent_away_gf_pg - recent_away_ga_pg)) * 0.40::DOUBLE + (recent_away_ppg - 1.4::DOUBLE) * 0.60::DOUBLE",
    "rating": "(home_rating - away_rating) + (value_ratio - 3e0) * 10e0 * 0.35::DOUBLE", "split": "home_split_ppg - away_split_ppg",
    "lineup": "CASE WHEN match_id % 5 <> 0 THEN lineup_home_availability - lineup_away_availability ELSE 0e0 END",
    "rest": clip("(rest_days_home - rest_days_away) / 7e0", "-0.35::DOUBLE", "0.35::DOUBLE"), "ld": clip("(schedule_load_away - schedule_load_home) * 0.12::DOUBLE", "-0.30::DOUBLE", "0.30::DOUBLE"),
    "hh": clip("h2h_edge * 0.16::DOUBLE", "-0.18::DOUBLE", "0.18::DOUBLE"),
    "ha": "CASE WHEN xg_on THEN home_xg * 0.7::DOUBLE + recent_home_gf_pg * 0.3::DOUBLE ELSE recent_home_gf_pg END", "aa": "CASE WHEN xg_on THEN away_xg * 0.7::DOUBLE + recent_away_gf_pg * 0.3::DOUBLE ELSE recent_away_gf_pg END",
    "hl": "CASE WHEN xg_on THEN home_xga * 0.7::DOUBLE + recent_home_ga_pg * 0.3::DOUBLE ELSE recent_home_ga_pg END", "al": "CASE WHEN xg_on THEN away_xga * 0.7::DOUBLE + recent_away_ga_pg * 0.3::DOUBLE ELSE recent_away_ga_pg END",
}
_FACT = "CASE {0} WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 WHEN 5 THEN 120 WHEN 6 THEN 720 WHEN 7 THEN 5040 ELSE 40320 END"
_PO = lambda lam, g: f"exp(-{lam}) * pow({lam}, {g}) / ({_FACT.format(g)})"
_LAM = f"""fx AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FX.items())} FROM (SELECT *, xg_coverage <> 0 AS xg_on FROM wide)),
lam AS (SELECT *, {clip('1.34 + (ha - 1.45) * 0.34 + (al - 1.10) * 0.24 + form * 0.16 + split * 0.14 + goal * 0.10 + rating / 470e0 + lineup * 0.22 + rest * 0.12 + ld * 0.10 + hh * 0.28 + 0.15 * 0.18', 0.35, 3.2)} AS lh,
  {clip('1.10 + (aa - 1.30) * 0.34 + (hl - 1.05) * 0.24 - form * 0.14 - split * 0.12 - goal * 0.08 - rating / 520e0 - lineup * 0.20 - rest * 0.10 - ld * 0.08 - hh * 0.24', 0.30, 3.0)} AS la,
  {clip('-0.06 + abs(hh) * 0.04', -0.12, 0.02)} AS rho FROM fx),
cells AS (SELECT lam.*, h, a, greatest({_PO('lh', 'h')} * {_PO('la', 'a')} * CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * rho WHEN h = 0 AND a = 1 THEN 1 + lh * rho WHEN h = 1 AND a = 0 THEN 1 + la * rho WHEN h = 1 AND a = 1 THEN 1 - rho ELSE 1 END, 0e0) AS p
  FROM lam, range(7) t1(h), range(7) t2(a)),
quant AS (SELECT match_id, any_value(lh) AS lh, any_value(la) AS la, sum(p) FILTER (h > a) / sum(p) AS q_home, sum(p) FILTER (h = a) / sum(p) AS q_draw, sum(p) FILTER (h < a) / sum(p) AS q_away FROM cells GROUP BY 1)"""


@query("goal_model", sql(
    "SELECT match_id, round(lh, 6) AS lambda_home, round(la, 6) AS lambda_away, round(q_home, 6) AS q_home, round(q_draw, 6) AS q_draw, round(q_away, 6) AS q_away FROM quant", "wide", extra=[_LAM]))
def goal_model(spark, sf_dir):
    df = modelled(spark, sf_dir)
    return df.select("match_id", *[round_to(c, 6).alias(c) for c in ("lambda_home", "lambda_away", "q_home", "q_draw", "q_away")])


@query("likely_scores", sql(
    "SELECT match_id, string_agg(s, ',' ORDER BY rn) AS scores FROM (SELECT match_id, concat(h, '-', a) AS s, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h * 7 + a) AS rn FROM cells) WHERE rn <= 4 GROUP BY 1", "wide", extra=[_LAM]))
def likely_scores(spark, sf_dir):
    return modelled(spark, sf_dir).select("match_id", F.array_join(models.top_scores(), ",").alias("scores"))


_W = {True: {True: (0.20, 0.16, 0.12, 0.10, 0.12, 0.06, 0.04, 0.20), False: (0.26, 0.20, 0.18, 0.14, 0.12, 0.06, 0.04, 0.0)},
      False: {True: (0.24, 0.18, 0.14, 0.12, 0.0, 0.07, 0.05, 0.20), False: (0.30, 0.22, 0.20, 0.16, 0.0, 0.07, 0.05, 0.0)}}
_SUB = [
    clip("0.5 + rating / 220e0", 0.05, 0.95),
    clip("0.5 + (recent_home_ppg - recent_away_ppg) / 3e0 * 0.40 + (recent_home_ppg - 1.4) / 1.4 * 0.60 * 0.5", 0.05, 0.95),
    clip("0.5 + ((recent_home_gf_pg - recent_home_ga_pg) - (recent_away_gf_pg - recent_away_ga_pg)) / 2.8 * 0.40 + (recent_away_ppg - 1.4) / 1.4 * 0.60 * 0.5", 0.05, 0.95),
    clip("0.5 + split / 2.6", 0.05, 0.95), clip("0.5 + lineup_home_availability - lineup_away_availability", 0.08, 0.92),
    clip(f"0.5 + rest * 0.55 + {clip('(schedule_load_away - schedule_load_home) * 0.10', -0.25, 0.25)}", 0.08, 0.92), clip("0.5 + h2h_edge * 0.28", 0.10, 0.90),
    "CASE WHEN xg_on THEN " + clip("0.5 + ((home_xg - home_xga) - (away_xg - away_xga)) / 2e0", 0.05, 0.95) + " ELSE 0.5::DOUBLE END",
]


def _wt(k):
    base = f"CASE WHEN match_id % 5 <> 0 AND xg_on THEN {_W[True][True][k]}::DOUBLE WHEN match_id % 5 <> 0 THEN {_W[True][False][k]}::DOUBLE WHEN xg_on THEN {_W[False][True][k]}::DOUBLE ELSE {_W[False][False][k]}::DOUBLE END"
    if k == 0:
        return f"({base} + CASE WHEN value_available <> 0 THEN 0.04::DOUBLE ELSE 0e0 END)"
    return f"({base} * CASE WHEN value_available <> 0 THEN 0.94::DOUBLE ELSE 1e0 END)" if k < 4 else f"({base})"


_ML = f"""sc AS (SELECT *, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_SUB))}, {', '.join(f'{_wt(i)} AS w{i}' for i in range(8))} FROM lam),
hs AS (SELECT *, ({' + '.join(f's{i} * w{i}' for i in range(8))}) / ({' + '.join(f'w{i}' for i in range(8))}) AS hsc FROM sc),
ml AS (SELECT match_id, hsc / t AS ml_home, dsc / t AS ml_draw, (1e0 - hsc) / t AS ml_away FROM (SELECT *, 1e0 + dsc AS t FROM (SELECT *, {clip('0.18 + (1 - abs(hsc - (1e0 - hsc))) * 0.22 + (1 - abs(h2h_edge)) * 0.06', 0.12, 0.34)} AS dsc FROM hs))),
bl AS (SELECT w.*, {', '.join(f'q_{o}, ml_{o}' for o in V.OUTCOMES)}, {clip('1 - (abs(q_home - ml_home) + abs(q_draw - ml_draw) + abs(q_away - ml_away)) / 2e0', '0e0', '1e0')} AS agree FROM wide w JOIN quant USING (match_id) JOIN ml USING (match_id)),
bd AS (SELECT *, {clip('0.35 * ' + clip('(quality_score - 0.55) / 0.30', 0.3, 1.1) + ' * ' + clip('(agree - 0.55) / 0.30', 0.4, 1.0), 0.10, 0.55)} AS alpha FROM bl)"""


@query("blended_forecast", sql(
    f"""SELECT match_id, {', '.join(f'round(ml_{o}, 6) AS ml_{o}' for o in V.OUTCOMES)}, round(agree, 6) AS agree,
    {', '.join(f'round(alpha * (q_{o} * 0.56 + ml_{o} * 0.44) + (1e0 - alpha) * market_{o}_prob, 6) AS b_{o}' for o in V.OUTCOMES)} FROM bd""", "wide", extra=[_LAM, _ML]))
def blended_forecast(spark, sf_dir):
    df = modelled(spark, sf_dir)
    return df.select("match_id", *[round_to(c, 6).alias(c) for c in ("ml_home", "ml_draw", "ml_away", "agree", "b_home", "b_draw", "b_away")])


_CV = f"""cv AS (SELECT match_id, {', '.join(f"sum(p) FILTER ({t}) / sum(p) AS {n}" for n, t in (('h_home_cover', 'h - a + handicap_line > 0'), ('h_away_cover', 'h - a + handicap_line < 0'), ('h_push_cover', 'h - a + handicap_line = 0')))}
 FROM (SELECT match_id, handicap_line, h, a, {_PO('lh', 'h')} * {_PO('la', 'a')} AS p FROM lam, range(9) t1(h), range(9) t2(a)) GROUP BY 1)"""


@query("handicap_cover_probabilities", sql(
    "SELECT match_id, round(h_home_cover, 6) AS h_home_cover, round(h_away_cover, 6) AS h_away_cover, coalesce(round(h_push_cover, 6), 0) AS h_push_cover FROM cv", "wide", extra=[_LAM, _CV]))
def handicap_cover_probabilities(spark, sf_dir):
    df = load(spark, sf_dir, "wide").withColumns(models.quant_rates(feature_map()))
    cover = models.cover_probabilities(num("handicap_line"))
    return models.with_goal_columns(df).select("match_id", *[round_to(cover[k], 6).alias(f"h_{k}_cover") for k in ("home", "away", "push")])


@query("handicap_recommendations", None)
def handicap_recommendations(spark, sf_dir):
    f = feature_map()
    f |= {
        "form_gap": (f["home_ppg"] - f["away_ppg"]) * 0.40 + f["form_residual_gap"] * 0.60,
        "goal_gap": (f["home_gd"] - f["away_gd"]) * 0.40 + f["goal_residual_gap"] * 0.60, "split_gap": f["split_home_ppg"] - f["split_away_ppg"],
        "lineup_gap": f["home_available"] - f["away_available"],
        "schedule_edge": models.clamp(f["rest_gap"] / 7.0, -0.5, 0.5) * 0.70 + models.clamp(f["load_gap"] * 0.10, -0.4, 0.4),
        "xg_gap": (f["home_xg"] - f["home_xga"]) - (f["away_xg"] - f["away_xga"]), "market_gap": num("market_home_prob") - num("market_away_prob"),
        "market_on": F.lit(True), "heat_gap": F.lit(0.0), "heat_on": F.lit(False), "motivation_on": F.lit(True),
    }
    df = load(spark, sf_dir, "wide").withColumns(models.quant_rates(f) | {"handicap_initial_home_odds": num("handicap_home_odds"), "handicap_initial_away_odds": num("handicap_away_odds")})
    df = models.handicap_recommendation(models.with_goal_columns(df), f)
    return df.select(
        "match_id", "h_side", "h_action", round_to("h_ev", 6).alias("h_ev"), "h_dimension_score", "h_dimension_coverage",
        round_to("h_confidence", 6).alias("h_confidence"),
    )


@query("escalation_reasons", sql(
    f"""SELECT match_id, array_to_string(list_filter([CASE WHEN gap >= 0.10 AND quality_score < 0.78 THEN 'model_gap' END,
      CASE WHEN ev >= 0.12 AND abs(bias) >= 0.08 AND quality_score < 0.78 THEN 'high_ev_weak_data' WHEN ev >= 0.12 AND bias <= -0.08 THEN 'high_ev_negative_bias' END,
      CASE WHEN quality_score < 0.68 THEN 'low_quality' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT *,
      abs({by_outcome('recommended_outcome', *[f'legacy_{o}_prob' for o in V.OUTCOMES])} - {by_outcome('recommended_outcome', *[f'final_{o}_prob' for o in V.OUTCOMES])}) AS gap,
      {by_outcome('recommended_outcome', *[f'ev_{o}' for o in V.OUTCOMES])} AS ev,
      {by_outcome('recommended_outcome', *[f'final_{o}_prob - market_{o}_prob' for o in V.OUTCOMES])} AS bias FROM wide)""", "wide"))
def escalation_reasons(spark, sf_dir):
    wide = load(spark, sf_dir, "wide")
    final, market = probs.triple("final"), probs.triple("market")
    o = F.col("recommended_outcome")
    ev = probs.pick({x: num(f"ev_{x}") for x in V.OUTCOMES}, o)
    bias = probs.pick({x: final[x] - market[x] for x in V.OUTCOMES}, o)
    reasons = models.escalation_reasons(probs.triple("legacy"), final, o, ev, bias, num("quality_score"))
    return wide.select("match_id", F.array_join(reasons, ",").alias("reasons"))
