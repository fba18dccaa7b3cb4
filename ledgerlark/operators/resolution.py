"""The final action of a forecast: the algorithm's, moved by first reviewer, guards, arbiter and expert in their order.

How a verdict moves an action is a table over (verb, action now, action asked for).  A row's reviewers become a short
list of verbs in their order, and the action is that list folded over the table, so rules stay data and every step that
changed something is kept.  Then the arbiter's and the expert's last words give what is executed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import labels, policy
from ..functions.numeric import clamp, num, round_to, text

LEVELS = ("watch", "light", "main")
VERBS = ("keep", "watch", "down", "up", "no_main", "gate_main", "gate_light", "gate_both")


def moved(verb: str, level: int, target: int) -> int:
    """One entry of the transition table."""
    return {
        "keep": level, "watch": 0, "down": max(level - 1, target) if target < level else level, "up": min(level + 1, target) if target > level else level,
        "no_main": min(level, 1), "gate_main": min(level, 1), "gate_light": 0 if level == 1 else level, "gate_both": 0,
    }[verb]


def table() -> Column:
    return F.array(*[F.lit(moved(v, a, t)) for v in VERBS for a in range(3) for t in range(3)])


def _verb(*cases: tuple[Column, str]) -> Column:
    """Number of the first verb whose condition holds, else of keep."""
    out = F.lit(VERBS.index("keep"))
    for condition, verb in reversed(cases):
        out = F.when(condition, VERBS.index(verb)).otherwise(out)
    return out


def _step(by: str, verb: Column, target: Column | None = None, ends: bool = False) -> Column:
    """``ends``: no later step of the fold counts if this one changes the action."""
    target = F.lit(0) if target is None else target
    return F.struct(F.lit(by).alias("by"), verb.cast("int").alias("verb"), target.cast("int").alias("target"), F.lit(ends).alias("ends"))


def folded(start: Column, steps: list[Column]) -> Column:
    """(level, ended, path): the level after all steps, and which steps changed it to what."""
    begin = F.struct(start.cast("int").alias("level"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("path"))
    rules, names = table(), F.array(*[F.lit(a) for a in LEVELS])

    def turn(state: Column, step: Column) -> Column:
        after = F.when(state["ended"], state["level"]).otherwise(F.get(rules, (step["verb"] * 3 + state["level"]) * 3 + step["target"]))
        changed = after != state["level"]
        path = F.when(changed, F.concat(state["path"], F.array(F.concat_ws(":", step["by"], F.get(names, after))))).otherwise(state["path"])
        return F.struct(after.alias("level"), (state["ended"] | (changed & step["ends"])).alias("ended"), path.alias("path"))

    return F.aggregate(F.array(*steps), begin, turn)


def _action(level: Column) -> Column:
    return F.when(level == 2, "main").when(level == 1, "light").otherwise("watch")


def may_promote(target: Column, gates: dict) -> Column:
    """Hard limits of a promotion; watch never becomes main."""
    g = gates["promote"]
    jump = (F.col("policy_action") == "watch") & (target == "main")
    known = F.col("policy_outcome").isin(*V.OUTCOMES)
    worth = known & (F.col("policy_ev") >= g["ev"]) & (F.col("policy_bias") >= g["market_bias"])
    return ~jump & worth & (num("quality_score") >= g["quality"]) & (F.col("policy_confidence") >= g["confidence"]) & (labels.risk_level(F.col("policy_confidence")) != "very_high")


def resolve_actions(df: DataFrame, gates: dict = V.DEFAULT_GATES, at: Column | None = None) -> DataFrame:
    """Adds final action, confidence, risk and stake, then what is executed and the state of the manual review.

    Expects the columns of ``policy.action_policy`` with its working columns, and those of the reviewers: review_
    (status, decision, target_action, evidence_grade, stake_multiplier, confidence_delta, outcome_decision,
    target_outcome), arbiter_ (status, decision, target_action, reason) and expert_ (status, target_action,
    evidence_grade, stake_multiplier).  A null status of arbiter or expert means that nobody was asked.
    """
    at = F.lit("") if at is None else at.cast("string")
    status, decision, grade = text("review_status"), text("review_decision"), F.lower(F.trim(text("review_evidence_grade")))
    done, guard = status == "completed", F.col("favourite_guard")
    asked = F.trim(text("review_target_action"))
    target = F.when(asked == "", F.col("policy_action")).otherwise(labels.action_label(asked))
    share = clamp(F.coalesce(F.col("review_stake_multiplier").cast("double"), F.lit(1.0)), 0.0, 1.0)
    delta = F.when(done, clamp(num("review_confidence_delta"), -0.12, 0.08)).otherwise(0.0)
    confidence = clamp(F.col("policy_confidence") + delta, 0.18, 0.88)
    df = df.withColumns({"_share": F.when(done, share).otherwise(1.0), "final_confidence": confidence, "_target": target})

    level = lambda c: labels.action_level(c)
    abstained = (decision == "abstain") & ~guard
    turn = F.lower(F.trim(text("review_outcome_decision")))
    other = F.lower(F.trim(text("review_target_outcome")))
    low_main, low_light = (F.col("final_confidence") < gates[g]["confidence"] for g in ("main", "light"))
    arb_status, arb_decision = text("arbiter_status"), text("arbiter_decision")
    arb = F.col("arbiter_status").isNotNull()
    arb_target = labels.action_label("arbiter_target_action")
    steps = [
        _step("review", _verb(
            (~done | (decision == "keep") | ((decision == "abstain") & guard), "keep"), (decision == "downgrade", "down"),
            ((decision == "promote") & may_promote(F.col("_target"), gates), "up"), (decision == "promote", "keep"), (F.lit(True), "watch"),
        ), level(F.col("_target"))),
        _step("evidence", _verb((~done | ((decision == "abstain") & guard), "keep"), (abstained | (grade == "unsafe") | (F.col("_share") <= 0), "watch"), (grade == "weak", "no_main"))),
        _step("outcome", _verb(
            (~done | (guard & turn.isin("veto_to_watch", "challenge")), "keep"), (turn == "veto_to_watch", "watch"),
            ((turn == "challenge") & other.isin(*V.OUTCOMES) & (other != F.col("policy_outcome")), "watch"),
        )),
        _step("confidence", _verb((~done, "keep"), (low_main & low_light, "gate_both"), (low_main, "gate_main"), (low_light, "gate_light"))),
        # The arbiter's hearing reads the first review once more; what that changes stands.
        _step("hearing", _verb(
            (~arb, "keep"), (status == "failed", "watch"), (done & ((decision == "reject") | abstained), "watch"), (done & (decision == "downgrade"), "down"),
        ), level(labels.action_label("review_target_action")), ends=True),
        _step("arbiter", _verb(
            (~arb, "keep"), (arb_status == "failed", "watch"), (arb_status != "completed", "keep"), (arb_decision.isin("skip", "manual_review"), "watch"), (arb_decision == "downgrade", "down"),
        ), level(arb_target)),
    ]
    df = df.withColumn("_fold", folded(level(F.col("policy_action")), steps))
    df = df.withColumns({"final_action": _action(F.col("_fold.level")), "resolution_path": F.col("_fold.path"), "final_risk": labels.risk_level(F.col("final_confidence"))})
    full = policy.stake(F.col("final_action"), F.col("final_confidence"))
    capped = F.when(F.col("policy_stake") > 0, F.least(full, F.col("policy_stake"))).otherwise(full)
    kept = F.when(guard & (F.col("_share") <= 0), 1.0).otherwise(F.col("_share"))
    df = df.withColumn("final_stake", F.when(F.col("final_action") == "watch", 0.0).when(done, round_to(capped * kept, 2)).otherwise(full))
    return _executed(df, at)


def _executed(df: DataFrame, at: Column) -> DataFrame:
    """The arbiter's and the expert's word on the final action; an uplift restores at most the algorithm's action."""
    now, guard_level = F.col("final_action"), labels.action_level(F.col("final_action"))
    done, decision = text("arbiter_status") == "completed", text("arbiter_decision")
    asked = F.trim(text("arbiter_target_action"))
    target = F.when(asked == "", now).otherwise(labels.action_label(asked))
    algo = labels.action_level(F.col("policy_action"))
    raised = _action(F.least(algo, F.greatest(labels.action_level(target), guard_level)))
    lowered = labels.step_down(now, target)
    lowered = F.when(lowered != now, lowered).otherwise(_action(F.greatest(guard_level - 1, F.lit(0))))
    expert = F.col("expert_status").isNotNull()
    heard = text("expert_status") == "completed"
    share = clamp(num("expert_stake_multiplier"), 0.0, 1.0)
    sound = heard & (F.lower(F.trim(text("expert_evidence_grade"))) != "unsafe") & (share > 0)
    word = F.when(sound, labels.action_label("expert_target_action")).otherwise("watch")
    case = (
        F.when(~done, "model").when((decision == "allow_with_uplift") & (raised != now), "uplift").when(decision == "downgrade", "lower")
        .when((decision == "manual_review") & expert, "expert").when(decision == "manual_review", "pending").when(decision == "skip", "skip").otherwise("model")
    )
    df = df.withColumns({"_case": case, "_raised": raised, "_lowered": lowered, "_word": word})
    stake = lambda a: policy.stake(F.col(a), F.col("final_confidence"))
    c = F.col("_case")
    manual = c.isin("expert", "pending")
    return df.withColumns({
        "effective_recommendation": F.when(c == "uplift", F.col("_raised")).when(c == "lower", F.col("_lowered")).when(c == "expert", F.col("_word")).when(c == "pending", "").when(c == "skip", "watch").otherwise(now),
        "effective_stake_pct": (
            F.when(c == "uplift", stake("_raised")).when(c == "lower", stake("_lowered"))
            .when(c == "expert", F.when(F.col("_word") == "watch", 0.0).otherwise(round_to(stake("_word") * share, 2))).when(c.isin("pending", "skip"), 0.0).otherwise(F.col("final_stake"))
        ),
        "effective_action_source": F.when(c == "uplift", "arbiter_uplift").when(c.isin("lower", "skip"), "arbiter").when(c == "expert", F.when(heard, "expert_llm").otherwise("expert_llm_failed")).when(c == "pending", "").otherwise("model"),
        "manual_review_status": F.when(c == "expert", "resolved").when(c == "pending", "pending").otherwise(""),
        "manual_review_reason": F.when(manual, text("arbiter_reason")).otherwise(""),
        "manual_review_requested_at": F.when(manual, at).otherwise(""), "manual_review_resolved_at": F.when(c == "expert", at).otherwise(""),
        "execution_status": (
            F.when(c == "uplift", "arbiter_uplifted").when(c.isin("lower", "skip"), "arbiter_downgraded")
            .when(c == "expert", F.when(heard, "expert_review_resolved").otherwise("expert_review_failed")).when(c == "pending", "manual_review_pending").otherwise("executable")
        ),
    })
