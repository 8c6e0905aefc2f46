"""Outboxes and logs: what is sent or appended, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import hmac_sha256
from ..functions.rules import webhook_delay_ms
from ..functions.text import log_line

MAX_RETRIES = 3


def outbox(events: DataFrame, hooks: DataFrame, kind: str) -> DataFrame:
    """Signed payloads for the sessions that have a hook (session_id, url, secret); others' events are dropped."""
    body = F.to_json(F.struct(*(c for c in events.columns)))
    joined = events.withColumn("payload", body).join(hooks.select("session_id", "url", "secret"), "session_id")
    return joined.select(F.lit(kind).alias("kind"), "session_id", "url", "payload", F.concat(F.lit("sha256="), hmac_sha256(F.col("secret"), F.col("payload"))).alias("signature"))


def item_events(outcomes: DataFrame, hooks: DataFrame) -> DataFrame:
    """item-complete events of outcomes (session_id, item_id, status: completed, failed or skipped, error_kind, error, data):
    failures carry "kind: message", successes their data."""
    failed, done = F.col("status") == "failed", F.col("status") == "completed"
    rows = outcomes.select("session_id", "item_id", "status", F.when(failed, F.concat_ws(": ", "error_kind", "error")).alias("error"), F.when(done, F.col("data")).alias("scraped_data"))
    return outbox(rows, hooks, "item-complete")


def phase_events(steps: DataFrame, hooks: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """phase-change events of steps (session_id, phase, message); those that queue carry the session's ``items``."""
    rows = steps.select("session_id", "phase", "message")
    if items is not None:
        entry = F.struct(*(c for c in items.columns if c != "session_id"))
        listed = items.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("items"))
        rows = rows.join(listed, "session_id", "left").withColumn("items", F.when(F.col("phase") == "queueing", F.col("items")))
    return outbox(rows, hooks, "phase-change")


def lists_events(lists: DataFrame, hooks: DataFrame) -> DataFrame:
    """One lists-sync event for each session that has lists."""
    entry = F.struct(*(c for c in lists.columns if c != "session_id"))
    return outbox(lists.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("lists")), hooks, "lists-sync")


def retry_at_ms(status: Column, attempt: Column, retry_after_s: Column) -> Column:
    """Delay before the next attempt; null where none is due."""
    again = (status == 429) | (status >= 500) | status.isNull()
    return F.when(again & (attempt < MAX_RETRIES), webhook_delay_ms(retry_after_s, attempt))


def event_line(time: Column, kind: Column, item_id: Column, detail: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] [ENRICHMENT] "), F.upper(kind), F.lit(" itemId="), item_id.cast("string"), F.lit(" "), log_line(detail))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def success_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def delivery_attempts(answers: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """What a hook answered, attempt by attempt (session_id, event_id, attempt from 0, status, null where it could not be
    reached, retry_after_s), to the attempts that were made: session_id, event_id, attempt, status, sent_at_ms (after the
    first), outcome: delivered, retry or given_up.

    An attempt follows only on one that is to be repeated; later answers are left out.  The wait is what the hook asks for,
    else it doubles.
    """
    by = Window.partitionBy("session_id", "event_id").orderBy("attempt")
    wait = F.when(F.col("attempt") < most, retry_at_ms(F.col("status"), F.col("attempt"), F.col("retry_after_s")))
    rows = answers.withColumn("wait", wait)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("wait").isNull()).over(before), F.lit(False))).withColumn("sent_at_ms", F.coalesce(F.sum("wait").over(before), F.lit(0)))
    outcome = F.when(F.col("wait").isNotNull(), "retry").when(F.col("status").between(200, 299), "delivered").otherwise("given_up")
    return rows.where("not over").select("session_id", "event_id", "attempt", "status", "sent_at_ms", outcome.alias("outcome"))


def put_batch(rows: DataFrame, number: int, path: str, key: list[str]) -> None:
    """One micro-batch's outbox rows under its number, each ``key`` once: a batch that runs again replaces what it wrote,
    so each event is there once whatever fails in between."""
    rows.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")


def stream_outbox(events: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Start a stream of outbox rows (from ``item_events``, ``phase_events`` or ``lists_events``) into ``path``, for all there is."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: put_batch(rows, n, path, key)).start()
