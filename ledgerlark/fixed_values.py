"""Fixed values that decide results: thresholds, weights, grids and labels.

Everything in this file is a constant that has to hold exactly for a result to
be right.  Keep the values here, in their natural order; code elsewhere refers
to them by name.
"""

OUTCOMES = ("home", "draw", "away")
SIDES = ("home", "away")
ACTIONS = ("watch", "light", "main")          # level 0, 1, 2

# --- fixed values: action labels and their spellings ------------------------
ACTION_ALIASES = {
    "watch": "watch", "hold": "watch", "skip": "watch", "abstain": "watch", "观望": "watch", "瑙傛湜": "watch",
    "light": "light", "small": "light", "lean": "light", "轻仓": "light", "杞讳粨": "light",
    "main": "main", "strong": "main", "top": "main", "主推": "main", "涓绘帹": "main",
}

# --- fixed values: policy gates ---------------------------------------------
DEFAULT_GATES = {
    "main": {"ev": 0.08, "confidence": 0.58, "market_bias": 0.020, "quality": 0.68},
    "light": {"ev": 0.02, "confidence": 0.48, "market_bias": 0.005, "quality": 0.58},
    "promote": {"ev": 0.06, "confidence": 0.55, "market_bias": 0.020, "quality": 0.68},
}
BASE_GATES = {
    "main": {"ev": 0.10, "confidence": 0.62, "market_bias": 0.030, "quality": 0.68},
    "light": {"ev": 0.04, "confidence": 0.52, "market_bias": 0.015, "quality": 0.58},
    "promote": {"ev": 0.08, "confidence": 0.58, "market_bias": 0.030, "quality": 0.70},
}
GATE_GRID = {
    "main_ev": (0.08, 0.10, 0.12),
    "main_confidence": (0.58, 0.62, 0.68),
    "main_market_bias": (0.020, 0.030, 0.040),
    "light_ev": (0.03, 0.04, 0.06),
    "light_confidence": (0.48, 0.52, 0.58),
    "light_market_bias": (0.010, 0.015, 0.025),
    "promote_ev": (0.06, 0.08, 0.10),
    "promote_confidence": (0.54, 0.58, 0.64),
    "promote_market_bias": (0.020, 0.030, 0.040),
}

# --- fixed values: execution control ----------------------------------------
CONTROL = {
    "main_score": 0.74, "light_score": 0.50,
    "main_ev_margin": 0.030, "light_ev_margin": 0.005,
    "main_probability": 0.20, "light_probability": 0.14,
    "main_agreement": 0.70, "light_agreement": 0.55,
    "main_gap_cap": 0.16, "light_gap_cap": 0.24, "gap_quality_floor": 0.70,
    "main_probability_margin": -0.060, "light_probability_margin": -0.140,
    "home_soft_odds": 1.65,
    "home_ev": 0.70, "home_bias": 0.350, "home_ev_margin": 0.800,
    "home_probability_margin": 0.450, "home_score": 0.980,
    "away_odds": 2.00, "away_ev": 0.32, "away_bias": 0.220, "away_ev_margin": 0.700,
    "away_probability_margin": 0.500, "away_score": 0.950,
    "draw_odds": 4.20, "draw_ev": 0.18, "draw_bias": 0.080, "draw_ev_margin": 0.160,
    "draw_probability_margin": 0.060, "draw_score": 0.900,
    "favourite_odds": 1.55, "favourite_quality": 0.58, "favourite_agreement": 0.55,
    "favourite_probability": 0.52, "favourite_main_score": 0.70,
}
SCORE_WEIGHTS = {
    "ev": 0.26, "confidence": 0.14, "quality": 0.14, "market_bias": 0.16,
    "ev_margin": 0.12, "agreement": 0.08, "legacy_alignment": 0.04, "probability": 0.06,
}
VALUE_WEIGHTS = {
    "ev": 0.24, "market_bias": 0.16, "probability": 0.16, "ev_margin": 0.16,
    "probability_margin": 0.10, "legacy_alignment": 0.04, "quality": 0.08, "agreement": 0.06,
}

# --- fixed values: leagues named by strategy guards -------------------------
GUARDED_LEAGUES = ("挪超", "欧罗巴", "意甲")
LOW_ODDS_LEAGUES = ("法甲",)
CAUTIOUS_LEAGUES = ("英冠",)
STABLE_FILL_SKIP_LEAGUES = ("西甲", "挪超")

# --- fixed values: strategy names in report order, with their role ----------
VARIANT_ROLES = {
    "base": "candidate", "league_guarded": "candidate", "selective": "candidate",
    "selective_league_guarded": "candidate", "strict": "candidate", "deep": "candidate",
    "refined": "candidate", "hardened": "candidate", "polished": "candidate",
    "steady": "production", "clean": "observation", "precise": "observation",
    "rescue": "observation", "broad": "observation", "cautious": "observation",
    "ultra": "observation", "coverage_push": "observation", "coverage_stable": "observation",
    "coverage_refined": "observation", "coverage_value_guarded": "observation",
    "coverage_xg_guarded": "observation", "coverage_draw_rescue": "production",
}

# --- fixed values: learning floors and grids --------------------------------
EPSILON = 1e-6
CALIBRATION_MIN_ROWS = 200
CALIBRATION_MIN_CLASS_ROWS = 25
TEMPERATURES = (0.75, 0.9, 1.0, 1.15, 1.3, 1.5)
BIAS_SCALES = (0.0, 0.5, 1.0, 1.5, 2.0)
GATE_MIN_TRAIN_ACTIONS = 40
GATE_MIN_VALIDATION_ACTIONS = 10
RULE_MIN_TRAIN_ROWS = 40
RULE_MIN_VALIDATION_ROWS = 10
OUTCOME_TARGET = {"hit_rate": 0.75, "action_share": 0.50}
HANDICAP_TARGET = {"hit_rate": 0.70, "action_share": 0.60}
DIRECTION_SOURCES = ("market", "model", "current", "algo", "low_odds", "ev")
OUTCOME_GRID = {
    "odds_max": (1.4, 1.5, 1.8, 2.0, 10.0),
    "prob_min": (0.0, 0.50, 0.60),
    "market_prob_min": (0.0, 0.55, 0.65),
    "quality_min": (0.0, 0.70, 0.80),
    "confidence_min": (0.0, 0.60),
    "ev_min": (-1.0, 0.0),
    "prob_margin_min": (-1.0, 0.0),
    "ev_margin_min": (-2.0, 0.0),
}
HANDICAP_GRID = {
    "ev_min": (-0.20, -0.05, 0.0, 0.03, 0.06),
    "confidence_min": (0.0, 0.52, 0.58, 0.62),
    "cover_prob_min": (0.0, 0.50, 0.54),
    "cover_margin_min": (-1.0, 0.0, 0.04),
    "quality_min": (0.0, 0.70),
    "odds_max": (1.8, 2.2, 10.0),
    "sides": ("any", "home", "away"),
    "base_actions": ("any", "active", "main"),
}
BUCKET_FEATURE_SETS = {
    "line50|coverdiff10|evdiff10|awayodds20": ("line50", "coverdiff10", "evdiff10", "awayodds20"),
    "line50|coverdiff10|evdiff10": ("line50", "coverdiff10", "evdiff10"),
    "line25|evdiff10": ("line25", "evdiff10"),
}
BUCKET_MIN_ROWS = 3
BUCKET_MIN_HIT = 0.55
CATEGORY_FILTERS = (
    {"outcomes": ("home",)},
    {"outcomes": ("away",)},
    {"outcomes": ("home", "away")},
    {"review_decisions": ("keep",)},
    {"review_decisions": ("", "skipped")},
    {"arbiter_decisions": ("keep",)},
    {"arbiter_decisions": ("downgrade", "watch")},
    {"effective_sources": ("expert_llm", "arbiter", "manual")},
    {"algo_actions": ("light", "main")},
    {"algo_actions": ("watch",)},
)
STRUCTURAL_FILTERS = (
    {"rating_gap": -100.0}, {"rating_gap": 0.0}, {"rating_gap": 50.0},
    {"ppg_gap": -0.30}, {"ppg_gap": 0.0}, {"ppg_gap": 0.30},
    {"split_ppg_gap": -0.30}, {"split_ppg_gap": 0.0},
    {"lineup_gap": -0.05}, {"lineup_gap": 0.0},
    {"absence_gap": -0.05}, {"absence_gap": 0.0},
    {"h2h_gap": -0.20}, {"h2h_gap": 0.0},
    {"rating_gap": 0.0, "ppg_gap": 0.0},
    {"rating_gap": 0.0, "lineup_gap": 0.0},
    {"ppg_gap": 0.0, "split_ppg_gap": 0.0},
)

# --- fixed values: stored-review rule table ---------------------------------
# (unified decision, evidence grade): decision, outcome decision, stake multiplier, confidence delta
REVIEW_RULES = {
    ("approve", "strong"): ("keep", "confirm", 1.00, 0.04),
    ("approve", "adequate"): ("keep", "confirm", 0.85, 0.00),
    ("approve", "weak"): ("downgrade", "confirm", 0.60, -0.04),
    ("reject", "strong"): ("abstain", "veto_to_watch", 0.0, -0.06),
    ("reject", "adequate"): ("abstain", "veto_to_watch", 0.0, -0.06),
    ("reject", "weak"): ("abstain", "veto_to_watch", 0.0, -0.06),
    ("reject", "unsafe"): ("abstain", "veto_to_watch", 0.0, -0.08),
}
REVIEW_WORDS_APPROVE = ("approve", "yes", "ok", "confirm", "go")
REVIEW_WORDS_REJECT = ("reject", "no", "veto", "skip", "abstain")
EVIDENCE_GRADES = ("strong", "adequate", "weak", "unsafe")

# --- fixed values: handicap wordings ----------------------------------------
HANDICAP_WORDS = {
    "平手": 0.0, "平": 0.0, "平/半": 0.25, "平半": 0.25, "半球": 0.5, "半": 0.5,
    "半/一": 0.75, "半一": 0.75, "一球": 1.0, "一": 1.0, "一/球半": 1.25, "一/一半": 1.25,
    "一球/球半": 1.25, "球半": 1.5, "球半/两": 1.75, "球半/两球": 1.75, "两球": 2.0, "两": 2.0,
    "两/两半": 2.25, "两球/两球半": 2.25, "两半": 2.5, "两球半": 2.5, "两半/三": 2.75,
    "三球": 3.0, "三": 3.0,
}

# --- fixed values: summary-text patterns (named by what they read) ----------
RECORD_PATTERN = (
    r"近(\d+)场\s*(\d+)胜(\d+)平(\d+)负[，,]\s*进(\d+)球失(\d+)球[，,]\s*"
    r"胜率(\d+)%[，,]\s*赢盘率(\d+)%[，,]\s*大球率(\d+)%"
)
HOME_AWAY_PATTERN = (
    r"主场\s*(\d+)胜(\d+)平(\d+)负[，,]\s*进(\d+)失(\d+)\s*\|\s*"
    r"客场\s*(\d+)胜(\d+)平(\d+)负[，,]\s*进(\d+)失(\d+)"
)
H2H_PATTERN = r"近(\d+)次交锋\s*(\d+)胜(\d+)平(\d+)负[，,]\s*进(\d+)球失(\d+)球"
STRENGTH_PATTERN = (
    r"第(\d+)(?:/(\d+))?[，,]\s*(\d+)分[，,]\s*(\d+)胜(\d+)平(\d+)负[，,]\s*"
    r"进(\d+)[，,]\s*失(\d+)[，,]\s*净胜(-?\d+)"
)
ODDS_PATTERN = (
    r"(?:初赔|列表均赔)\s*(\d+\.\d+)/(\d+\.\d+)/(\d+\.\d+)"
    r"(?:\s*->\s*即时\s*(\d+\.\d+)/(\d+\.\d+)/(\d+\.\d+))?"
)
HANDICAP_PATTERN = (
    r"初盘\s*([0-9.]+)\s*/\s*([^/]*?)\s*/\s*([0-9.]+)\s*->\s*即时\s*"
    r"([0-9.]+)\s*/\s*([^/]*?)\s*/\s*([0-9.]+)"
)
HEAT_PATTERN = r"投注比\s*胜\s*(\d+(?:\.\d+)?)%\s*平\s*(\d+(?:\.\d+)?)%\s*负\s*(\d+(?:\.\d+)?)%"
EUR_AMOUNT_PATTERN = r"(?i)(?:EUR|€)\s*([0-9]+(?:[.,][0-9]+)?)\s*(bn|b|billion|m|mil|million|k|th|thousand)?"
AMOUNT_EUR_PATTERN = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(bn|b|billion|m|mil|million|k|th|thousand)\s*(?:EUR|€)"
LINEUP_PLACEHOLDERS = (
    "未在公开来源中命中预计首发", "未在公开来源中命中明确伤停", "外部公开来源补采未命中",
    "伤停/阵容补采失败", "页面含预计阵容模块", "当前页面未列出明确伤停名单",
)

# --- fixed values: escalation thresholds ------------------------------------
ESCALATION = {"model_gap": 0.10, "low_quality": 0.68, "high_ev": 0.12, "high_bias": 0.08, "trusted_quality": 0.78}

# --- fixed values: currency factors and unit words --------------------------
EUR_PER = {"£": 1.17, "gbp": 1.17, "$": 0.92, "usd": 0.92}
UNIT_TO_MILLION = {"bn": 1000.0, "b": 1000.0, "billion": 1000.0, "k": 0.001, "th": 0.001, "thousand": 0.001}
PRICE_PATTERN = r"(?i)(€|EUR|£|GBP|\$|USD)\s*([0-9]+(?:[.,][0-9]+)?)\s*(bn|b|billion|m|mil|million|k|th|thousand)?"

# --- fixed values: page groups in display order -----------------------------
# (group, host contains, path contains)
PAGE_GROUPS = (
    ("match-list", "trade.500.com", "/sfc/"),
    ("dim12-data", "odds.500.com", "shuju-"),
    ("dim3-odds", "odds.500.com", "ouzhi-"),
    ("dim3-heat", "odds.500.com", "touzhu-"),
    ("dim1-strength", "liansai.500.com", "jifen-"),
    ("dim2-lineup", "flashscore", ""),
    ("dim2-lineup", "soccerway.com", ""),
    ("dim2-lineup", "livescore.com", ""),
)

# --- fixed values: match features -------------------------------------------
# points a rating gains per point a game, split point a game, goal difference a game, and per point of the value gap
STRENGTH_SHARES = {"points": 24.0, "split": 18.0, "goals": 22.0, "value": 0.45}
VALUE_GAP_SCALE, VALUE_GAP_LIMIT = 85.0, 190.0
MOTIVATION_MARK, MOTIVATION_SIGNAL = "参考最近交锋", 0.15
ENOUGH_GAMES = 6
LINEUP_FALLBACKS = ("lineup fallback not found", "injury fallback not found")

# --- fixed values: collected dimensions and their failure texts --------------
REQUIRED_DIMENSIONS = {
    "elo_home": "维度一：基础实力/主队 Elo/实力代理",
    "elo_away": "维度一：基础实力/客队 Elo/实力代理",
    "market_value_summary": "维度一：基础实力/球队球员身价",
    "recent_form_home": "维度一：基础实力/主队近期状态",
    "recent_form_away": "维度一：基础实力/客队近期状态",
    "home_away_form": "维度一：基础实力/主客场表现",
    "head_to_head_summary": "维度二：近期动态/交锋记录",
    "injury_or_lineup_notes": "维度二：近期动态/伤停/阵容",
    "motivation_or_schedule_notes": "维度二：近期动态/战意/赛程",
    "european_odds_movement_summary": "维度三：市场数据/欧赔变化",
    "asian_handicap_summary": "维度三：市场数据/让球亚盘变化",
    "betting_heat_summary": "维度三：市场数据/投注热度",
}
OPTIONAL_DIMENSIONS = ("elo_home", "elo_away", "market_value_summary")
SHOWN_DIMENSIONS = 8
COLLECTION_PLACEHOLDERS = (
    "未在公开来源中命中预计首发", "外部公开来源补采未命中", "伤停/阵容补采失败", "collection note",
    "user_daily_quota_exhausted", "quota_exhausted", "quota_limit",
)
COLLECTION_TEXTS = {
    "failure_prefix": "采集失败：", "missing_prefix": "采集失败：缺少采集维度：", "missing": "缺少采集维度：",
    "no_row": "未找到对赛采集记录", "uncollected": "当前场次未采集，请先采集",
}
