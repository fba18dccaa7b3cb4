"""Manual reviews of forecast runs: expired at kickoff, superseded by newer runs, resolved by decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ACTIONS, OUTCOMES
from ..functions import labels, policy, probs
from ..functions.numeric import kelly, num, text
from .joins import sieved

EXPIRED, SUPERSEDED = "expired at kickoff", "replaced by a newer run"


def _pending() -> Column:
    return text("manual_review_status") == "pending"


def _stored(runs: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in runs.columns else F.lit(None).cast(kind)


def _closed(runs: DataFrame, hits: list[tuple[Column, str, str]], asof: Column) -> dict[str, Column]:
    """Status, reason and time after the given transitions; a reason or time that is there already stays."""
    status, reason = F.col("manual_review_status"), text(_stored(runs, "manual_review_reason", "string"))
    at, blank = _stored(runs, "manual_review_resolved_at", "timestamp"), reason == ""
    any_hit = F.lit(False)
    for hit, to, note in hits:
        status = F.when(hit, to).otherwise(status)
        reason = F.when(hit & blank, note).otherwise(reason)
        any_hit = any_hit | hit
    return {"manual_review_status": status, "manual_review_reason": reason, "manual_review_resolved_at": F.when(any_hit & at.isNull(), asof).otherwise(at)}


def started(matches: DataFrame, asof: Column) -> DataFrame:
    return matches.filter(F.col("match_time") <= asof).select("match_id", F.lit(True).alias("_started")).distinct()


def expire_reviews(runs: DataFrame, matches: DataFrame, asof: Column, note: str = EXPIRED) -> DataFrame:
    """Pending reviews of matches that have started become expired."""
    j = runs.join(started(matches, asof), "match_id", "left")
    return j.withColumns(_closed(runs, [(_pending() & F.coalesce("_started", F.lit(False)), "expired", note)], asof)).drop("_started")


def supersede_reviews(runs: DataFrame, asof: Column, note: str = SUPERSEDED) -> DataFrame:
    """Pending reviews of runs that a newer run of the match has replaced; runs without a match are kept as they are."""
    newest = runs.groupBy("match_id").agg(F.max("run_id").alias("_newest"))
    j = runs.join(newest, "match_id", "left")
    hit = _pending() & F.coalesce(F.col("run_id") != F.col("_newest"), F.lit(False))
    return j.withColumns(_closed(runs, [(hit, "superseded", note)], asof)).drop("_newest")


def decided_stake(action: Column) -> Column:
    """Stake of an action on a stored run: its own probabilities, prices, expected values and confidence."""
    outcome = text("recommended_outcome")
    p, odds = probs.pick(probs.triple("final"), outcome), probs.pick(probs.market_odds(), outcome)
    ev = F.when(outcome == "home", num("ev_home")).when(outcome == "draw", num("ev_draw")).otherwise(num("ev_away"))
    pct = policy.stake_from(action, kelly(p, odds), ev, num("confidence_score"), num("quality_score"), num("model_agreement"))
    return F.when(outcome.isin(*OUTCOMES), pct).otherwise(0.0)


def _asked(decisions: DataFrame) -> DataFrame:
    """Runs that decisions name, with their number (``_n``) and the first one that has a known action (``_word``)."""
    known = (F.trim(text("action")) != "") & labels.action_label("action").isin(*ACTIONS)
    word = F.struct("decision_id", labels.action_label("action").alias("action"), F.trim(text("notes")).alias("notes"))
    return decisions.where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(known, word)).alias("_word"))


def _per_match(j: DataFrame, matches: DataFrame, asof: Column, *of_newest: str) -> DataFrame:
    """Matches with a decision: their newest run (with ``of_newest``), their reviews that wait and are decided about, ``_started``."""
    waiting = F.col("_n").isNotNull() & F.col("_pending")
    per = j.where("match_id is not null").groupBy("match_id").agg(
        F.max(F.struct("run_id", waiting.alias("waiting"), *of_newest)).alias("_newest"), F.count_if(waiting).alias("_waiting"), F.count("_n").alias("_asked")
    )
    return per.join(started(matches, asof), "match_id", "left").where("_asked > 0")


def _fates() -> dict[str, Column]:
    """``_top``, ``_expired`` and ``_stale`` of a run from the row of its match; without such a row it is on its own.

    A decision looks at its whole match, as it was before all decisions: reviews of a match that has started expire,
    and one for a run that is not the newest supersedes the match's other pending runs.  Everything per match is an
    aggregate that is joined back, so a match with most of the runs is combined before the shuffle.
    """
    top = F.coalesce(F.col("run_id") == F.col("_newest.run_id"), F.lit(True))
    expired = F.coalesce("_started", F.lit(False))
    stale = ~expired & F.coalesce(F.col("_waiting") > F.col("_newest.waiting").cast("int"), F.lit(False))
    return {"_top": top, "_expired": expired, "_stale": stale}


def _judged(runs: DataFrame, decisions: DataFrame, matches: DataFrame, asof: Column) -> DataFrame:
    """All runs with ``_n`` and ``_word`` of :func:`_asked` and their :func:`_fates`."""
    j = runs.withColumn("_pending", _pending()).join(_asked(decisions), "run_id", "left")
    return j.join(_per_match(j, matches, asof), "match_id", "left").withColumns(_fates())


def _judged_waiting(runs: DataFrame, decisions: DataFrame, matches: DataFrame, asof: Column) -> DataFrame:
    """As :func:`_judged`, but right for pending runs only, with ``_word`` where a run is the newest.

    Other runs stay as they are, so only runs of matches with a pending review meet decisions, by their keys, and only
    decisions that may name one of those leave their scan.  What is found comes back as one row per match: whole runs
    are never shuffled by their id, and not at all where they already lie by match.
    """
    keys = runs.select("match_id", "run_id", _pending().alias("_pending"))
    alone = keys.where("match_id is null and _pending")
    near = keys.join(keys.where("match_id is not null and _pending").select("match_id"), "match_id", "left_semi").unionByName(alone)
    asked = _asked(sieved(decisions, "run_id", near))
    per = _per_match(near.join(asked, "run_id", "left"), matches, asof, "_word")
    word = F.when(F.col("run_id") == F.col("_newest.run_id"), F.col("_newest._word"))
    of_match = runs.where("match_id is not null").join(per, "match_id", "left").withColumns({**_fates(), "_word": word}).drop(*per.columns[1:])
    no, yes = F.lit(False), F.lit(True)
    of_none = runs.where("match_id is null").join(asked, "run_id", "left").withColumns({"_top": yes, "_expired": no, "_stale": no}).drop("_n")
    return of_match.unionByName(of_none)


def resolve_reviews(runs: DataFrame, decisions: DataFrame, matches: DataFrame, asof: Column) -> DataFrame:
    """Runs after decisions (decision_id, run_id, action, notes), one row per run whatever their number.

    Of several decisions for a run the first with a known action counts.  Only a pending review of the newest run of a
    match that has not started is resolved; its action becomes the effective one, with the stake of the stored risk.
    Decisions without such a run leave their mark all the same: see :func:`_fates`.
    """
    j = _judged_waiting(runs, decisions, matches, asof)
    expired = _pending() & F.col("_expired")
    superseded = _pending() & F.col("_stale") & ~F.col("_top")
    resolved = _pending() & ~F.col("_expired") & F.col("_top") & F.col("_word").isNotNull()
    action = F.col("_word.action")
    closed = _closed(runs, [(expired, "expired", EXPIRED), (superseded, "superseded", SUPERSEDED)], asof)
    out = j.withColumns({"_resolved": resolved, **{f"_to_{k}": c for k, c in closed.items()}})
    hit = F.col("_resolved")
    written = {
        "effective_recommendation": (action, F.col("effective_recommendation")),
        "effective_stake_pct": (F.when(action == "watch", 0.0).otherwise(decided_stake(action)), F.col("effective_stake_pct")),
        "effective_action_source": (F.lit("manual_review"), F.col("effective_action_source")),
        "manual_review_status": (F.lit("resolved"), F.col("_to_manual_review_status")),
        "manual_review_reason": (F.col("_to_manual_review_reason"), F.col("_to_manual_review_reason")),
        "manual_review_resolved_at": (asof, F.col("_to_manual_review_resolved_at")),
        "manual_review_notes": (F.col("_word.notes"), text(_stored(runs, "manual_review_notes", "string"))),
    }
    return policy.drop_working(out.withColumns({name: F.when(hit, new).otherwise(old) for name, (new, old) in written.items()}))


def rejected_decisions(runs: DataFrame, decisions: DataFrame, matches: DataFrame, asof: Column) -> DataFrame:
    """Every decision with the reason it was not taken ('' = taken)."""
    j = _judged(runs, decisions, matches, asof)
    state = j.where("_n is not null").select("run_id", text("manual_review_status").alias("_status"), "_top", "_expired", F.col("_word.decision_id").alias("_first"), F.lit(True).alias("_found"))
    d = decisions.join(state, "run_id", "left")
    closed = F.when(F.col("_status").isin("resolved", "expired", "superseded"), F.col("_status")).otherwise("not_pending")
    reason = (
        F.when(F.col("_found").isNull(), "unknown_run").when(~F.col("_top"), "superseded").when(F.col("_status") != "pending", closed)
        .when(F.col("_expired"), "expired").when(F.col("decision_id") > F.col("_first"), "resolved").when(F.trim(text("action")) == "", "no_action")
        .when(~labels.action_label("action").isin(*ACTIONS), "unknown_action").otherwise("")
    )
    return d.select("decision_id", "run_id", reason.alias("reject_reason"))
