"""Sessions as folds over logged events, in batch.  ``streaming`` has the same folds on streams, ``pacing`` the request delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.order import numbered

#: The phases of a sync in order; any of them may end in the last.
PHASES = ("validating", "exporting", "parsing", "fetching_activity_order", "fetching_lists", "queueing", "enriching", "completed", "failed")
#: Fixed values of the state machines.
PAUSE_AT, COOLDOWN_MS, SESSION_TTL_MS, AUTH_ERRORS, MAX_SESSIONS = 3, 20_000, 600_000, 2, 100


def failure_runs(events: DataFrame) -> DataFrame:
    """Events (session_id, ts, seq, kind: failure, success, resume) with ``failures``, the run of failures up to each."""
    by = Window.partitionBy("session_id").orderBy("ts", "seq")
    rows = events.withColumn("run", F.sum(F.when(F.col("kind") == "failure", 0).otherwise(1)).over(by))
    return rows.withColumn("failures", F.count_if(F.col("kind") == "failure").over(Window.partitionBy("session_id", "run").orderBy("ts", "seq")))


def session_states(events: DataFrame) -> DataFrame:
    """Per session after its last event: failures, is_paused, last_failure, pauses (events sent).

    A third failure in a row pauses; success ends the run but not the pause; only resume does.
    """
    rows = failure_runs(events)
    order = F.struct("ts", "seq")
    pausing = (F.col("kind") == "failure") & (F.col("failures") >= PAUSE_AT)
    out = rows.groupBy("session_id").agg(
        F.max_by("failures", order).alias("failures"), F.max(F.when(pausing, order)).alias("paused_at"), F.max(F.when(F.col("kind") == "resume", order)).alias("resumed_at"),
        F.max(F.when(F.col("kind") == "failure", F.col("ts"))).alias("last_failure"), F.count_if(pausing).alias("pauses"),
    )
    paused = F.col("paused_at").isNotNull() & (F.col("resumed_at").isNull() | (F.col("resumed_at") < F.col("paused_at")))
    return out.select("session_id", "failures", paused.alias("is_paused"), "last_failure", "pauses")


def cooldown_ms(last_failure: Column, now: Column) -> Column:
    gap = F.unix_millis(now) - F.unix_millis(last_failure.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0), COOLDOWN_MS - gap), F.lit(0))


def session_valid(validated_at: Column, auth_errors: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(validated_at.cast("timestamp")) < SESSION_TTL_MS) & (auth_errors < AUTH_ERRORS)


def session_stats(states: DataFrame, now: Column) -> DataFrame:
    return states.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("is_paused").alias("paused"), F.count_if(cooldown_ms(F.col("last_failure"), now) > 0).alias("cooling"))


def kept_sessions(sessions: DataFrame, most: int = MAX_SESSIONS) -> DataFrame:
    """The ``most`` sessions validated last: the cache's capacity."""
    return sessions.orderBy(F.desc("validated_at"), "session_id").limit(most)


def oldest_session(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.min_by("session_id", F.struct("validated_at", "session_id")).alias("session_id"))


def session_activity(sessions: DataFrame, now: Column) -> DataFrame:
    """One row: sessions cached, and of those active, validated less than ``SESSION_TTL_MS`` ago."""
    age = F.unix_millis(now) - F.unix_millis(F.col("validated_at").cast("timestamp"))
    return sessions.agg(F.count(F.lit(1)).alias("cached"), F.count_if(age < SESSION_TTL_MS).alias("active"))


def auth_states(events: DataFrame) -> DataFrame:
    """Events (session_id, ts, seq, kind: validated, auth_error, ...) with ``known``, ``errors`` since the last validation
    and ``invalidated``, true where the session is dropped: at its second error.  Errors of an unknown or dropped session
    change nothing."""
    by = Window.partitionBy("session_id").orderBy("ts", "seq")
    rows = events.withColumn("run", F.count_if(F.col("kind") == "validated").over(by))
    errors = F.count_if(F.col("kind") == "auth_error").over(Window.partitionBy("session_id", "run").orderBy("ts", "seq"))
    rows = rows.withColumn("errors", errors).withColumn("invalidated", (F.col("kind") == "auth_error") & (F.col("run") > 0) & (F.col("errors") == AUTH_ERRORS))
    gone = F.col("errors") - F.col("invalidated").cast("int") >= AUTH_ERRORS
    return rows.withColumn("known", (F.col("run") > 0) & ~gone).drop("run")


def session_notices(events: DataFrame) -> DataFrame:
    """session_id, ts, seq, reason: what subscribers of sessions are told, as rows: paused, auth_error, and for sessions
    known at the time rate_limited or cloudflare.  Kinds besides those of ``auth_states``: failure, success, resume,
    rate_limited, cloudflare."""
    known = auth_states(events)
    paused = failure_runs(events).where((F.col("kind") == "failure") & (F.col("failures") >= PAUSE_AT)).select("session_id", "ts", "seq", F.lit("paused").alias("reason"))
    dropped = known.where("invalidated").select("session_id", "ts", "seq", F.lit("auth_error").alias("reason"))
    blocked = known.where("known and kind in ('rate_limited', 'cloudflare')").select("session_id", "ts", "seq", F.col("kind").alias("reason"))
    return paused.unionByName(dropped).unionByName(blocked)


def attempt_actions(attempts: DataFrame, most: int) -> DataFrame:
    """Attempts (item_id, ts, seq, error: null for success, has_session, is_paused) with ``retries`` and ``action``.

    A success ends an item (completed).  A failure of a request with a session is requeued, or held while the session is
    paused, whatever its kind; any other is requeued while its kind and the number of failures allow, else failed, which
    ends the item.  Attempts after the end are ignored.
    """
    by = Window.partitionBy("item_id").orderBy("ts", "seq")
    rows = attempts.withColumn("retries", F.count("error").over(by))
    again = rules.retry_eligible(rules.error_class(F.col("error")), F.col("retries"), F.lit(most))
    action = F.when(F.col("error").isNull(), "completed").when(F.col("has_session") & F.col("is_paused"), "held").when(F.col("has_session") | again, "requeued").otherwise("failed")
    rows = rows.withColumn("action", action)
    ended = F.max(F.col("action").isin("completed", "failed")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("action", F.when(F.coalesce(ended, F.lit(False)), "ignored").otherwise(F.col("action")))


def phase_progress(steps: DataFrame) -> DataFrame:
    """Steps (session_id, ts, seq, phase) with ``number`` in the fixed order and ``in_order``: a session starts with the
    first phase, goes on to the next one, or fails; nothing follows its end."""
    by = Window.partitionBy("session_id").orderBy("ts", "seq")
    number = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")).cast("int")
    rows = steps.withColumn("number", number).withColumn("before", F.lag("number").over(by))
    last = len(PHASES)
    goes_on = F.when(F.col("before").isNull(), F.col("number").isin(1, last)).otherwise((F.col("before") < last - 1) & ((F.col("number") == F.col("before") + 1) | (F.col("number") == last)))
    return rows.withColumn("in_order", F.coalesce(goes_on, F.lit(False))).drop("before")


def retry_rounds(queue: DataFrame, attempts: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The queue round by round until nothing goes back: round, item_id, lane, position, tries, action, and the queue's
    other columns as they were.

    ``queue`` has a row for each item, ``attempts`` what became of its tries (see ``attempt_actions``).  In each round all
    that wait are tried in the queue's order (lane, then ``order``); what is requeued or held waits in the next round with
    its lane and age kept, what is completed or failed leaves.  An item without a further try waits (action ``waiting``).
    An item's rounds depend on its own tries alone, so all rounds come from one pass and no loop on the driver.
    """
    tried = attempt_actions(attempts, most).where("action <> 'ignored'")
    tried = tried.withColumn("round", F.row_number().over(Window.partitionBy("item_id").orderBy("ts", "seq"))).select("item_id", "round", "action")
    last = tried.groupBy("item_id").agg(F.max("round").alias("round"), F.max_by("action", "round").alias("action"))
    waits = queue.select("item_id").join(last, "item_id", "left").where("action is null or action in ('requeued', 'held')")
    waits = waits.select("item_id", (F.coalesce("round", F.lit(0)) + 1).alias("round"), F.lit("waiting").alias("action"))
    rows = queue.join(tried.unionByName(waits), "item_id").withColumn("tries", F.col("round") - 1)
    return numbered(rows.withColumn("_lane", -rules.lane_rank(F.col("lane"))), ["round"], [F.col("_lane"), *order], "position").drop("_lane")


def phase_times(steps: DataFrame, key: str, phase: str) -> DataFrame:
    """Per key: milliseconds from each step to the next, those of ``phase`` alone as ``phase_ms`` and all as ``total_ms``."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gaps = steps.select(key, "phase", (F.lead(ms).over(Window.partitionBy(key).orderBy("ts", "seq")) - ms).alias("gap"))
    return gaps.groupBy(key).agg(F.sum(F.when(F.col("phase") == phase, F.col("gap"))).cast("double").alias("phase_ms"), F.sum("gap").cast("double").alias("total_ms"))


def surviving(sessions: DataFrame, validations: DataFrame) -> DataFrame:
    """Sessions (session_id, validated_at, auth_errors, failures, last_failure) after new validations (session_id, ts): the
    time is the newest, errors start anew, and what is known of failures survives.  A session that is validated for the
    first time has no failures; one without a new validation stays as it is."""
    newest = validations.groupBy("session_id").agg(F.max("ts").alias("_ts"))
    out = sessions.join(newest, "session_id", "full")
    fresh = F.col("_ts").isNotNull()
    return out.select(
        "session_id", F.greatest("validated_at", "_ts").alias("validated_at"), F.when(fresh, 0).otherwise(F.col("auth_errors")).cast("long").alias("auth_errors"),
        F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), "last_failure",
    )
