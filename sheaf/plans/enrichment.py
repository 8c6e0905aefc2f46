"""From an inventory, an activity order and lists to requests in the order they should be served."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cache, rules
from ..session import written
from .order import numbered

#: Requests of a lane beyond this many are rejected where a capacity is asked for.
LANE_CAPACITY = 10_000


def status_stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "owned").alias("owned"), F.count_if(F.col("status") == "ordered").alias("ordered"),
        F.count_if(~F.col("status").isin("owned", "ordered")).alias("wished"), F.count_if(F.coalesce(F.col("is_nsfw"), F.lit(False))).alias("nsfw"),
    )


def merge_activity(items: DataFrame, activity: DataFrame) -> DataFrame:
    """Items with their place in the activity order of their status; of places given twice the last counts."""
    last = activity.groupBy("item_id", "status").agg(F.max("activity_order").alias("activity_order"))
    return items.join(last, ["item_id", "status"], "left")


def orphans(list_items: DataFrame, items: DataFrame) -> DataFrame:
    """Items that lists name and the inventory lacks."""
    ids = list_items.select(F.col("item_id").cast("string").alias("item_id")).distinct()
    return ids.join(items.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("wished").alias("status"), F.lit(True).alias("is_orphan"))


def plan(items: DataFrame, orphans_: DataFrame | None = None, statuses: list[str] | None = None, cached: DataFrame | None = None, now=None) -> DataFrame:
    """Requests with their lane.  ``statuses`` keeps items of these (none of them for an empty list) and all orphans;
    ``cached`` (item_id, cached_at, release) leaves out items whose record is still good at ``now``."""
    kept = items if statuses is None else items.where(F.col("status").isin(*statuses) if statuses else F.lit(False))
    every = kept if orphans_ is None else kept.unionByName(orphans_, allowMissingColumns=True)
    every = every if "is_orphan" in every.columns else every.withColumn("is_orphan", F.lit(None).cast("boolean"))
    if cached is not None:
        good = cached.where(cache.valid(F.col("cached_at"), F.col("release"), now)).select("item_id")
        every = every.join(good, "item_id", "left_anti")
    return every.withColumn("lane", rules.lane(F.col("status"), F.col("is_nsfw"), F.col("is_orphan")))


def merge_requests(requests: DataFrame) -> DataFrame:
    """One row per item that is asked for: the final lane, its users, when it was first queued, and requests merged.

    The lane rises with any higher request, and to HOT where cookies come in with a request that isn't COLD.  That needs
    no replay in order: the highest lane asked for, and the first request with cookies, decide.  So tasks combine
    before they shuffle and a popular item is no hot spot.
    """
    order = F.struct("queued_at", "request_id")
    with_cookies = F.col("has_cookies")
    cookie_lane = F.min(F.when(with_cookies, F.struct("queued_at", "request_id", "lane")))["lane"]
    rank = F.max(rules.lane_rank(F.col("lane")))
    merged = requests.groupBy("item_id").agg(
        F.when((rank == 3) | F.coalesce(cookie_lane != "COLD", F.lit(False)), "HOT").when(rank == 2, "WARM").otherwise("COLD").alias("lane"),
        F.count_distinct("user_id").alias("users"), F.min("queued_at").alias("queued_at"), F.max("has_cookies").alias("has_cookies"),
        F.min_by(F.coalesce("status", F.lit("wished")), order).alias("status"), F.min_by("session_id", F.when(with_cookies, order)).alias("session_id"), F.count(F.lit(1)).alias("requests"),
    )
    return merged


def pending_entries(log: DataFrame) -> DataFrame:
    """The queue's entries over time: item_id, opened (seq of the first request), lane, users, has_cookies, requests,
    ended_by (seq of the row that ended it, null while it waits).

    ``log`` has item_id, ts, seq, kind (request, or anything else for the item's end), user_id, lane, has_cookies.  A
    request of an item that waits joins its entry; one after the end opens a new entry.  An end without an entry changes
    nothing.
    """
    before = Window.partitionBy("item_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    asks = F.col("kind") == "request"
    rows = log.withColumn("asks", F.coalesce(asks, F.lit(False))).withColumn("ends", F.count_if(~F.col("asks")).over(before))
    first = F.struct("ts", "seq")
    cookie_lane = F.min(F.when(F.col("asks") & F.col("has_cookies"), F.struct("ts", "seq", "lane")))["lane"]
    rank = F.max(F.when(F.col("asks"), rules.lane_rank(F.col("lane"))))
    merged = rows.groupBy("item_id", "ends").agg(
        F.min_by("seq", F.when(F.col("asks"), first)).alias("opened"),
        F.when((rank == 3) | F.coalesce(cookie_lane != "COLD", F.lit(False)), "HOT").when(rank == 2, "WARM").otherwise("COLD").alias("lane"),
        F.count_distinct(F.when(F.col("asks"), F.col("user_id"))).alias("users"), F.coalesce(F.max(F.when(F.col("asks"), F.col("has_cookies"))), F.lit(False)).alias("has_cookies"),
        F.count_if("asks").alias("requests"), F.max(F.when(~F.col("asks"), F.col("seq"))).alias("ended_by"),
    )
    return merged.where("requests > 0").drop("ends")


def admission_counts(merged: DataFrame) -> DataFrame:
    """One row over ``merge_requests``: requests that joined a waiting one, and entries queued."""
    return merged.agg(F.sum(F.col("requests") - 1).alias("deduplicated"), F.count(F.lit(1)).alias("queued"))


def session_users(requests: DataFrame) -> DataFrame:
    """Per session the users that ask through it, each once, in order."""
    return requests.where("session_id is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("user_id")).alias("users"))


def scored(queue: DataFrame, now) -> DataFrame:
    age = (F.unix_millis(now) - F.unix_millis(F.col("queued_at").cast("timestamp"))) / 60000
    return queue.withColumn("score", rules.score(F.col("status"), F.col("has_cookies") & F.col("session_id").isNotNull(), F.col("users"), age))


def admitted(queue: DataFrame, capacity: int | None = None) -> DataFrame:
    """The first ``capacity`` requests of each lane in order of arrival; all without a capacity."""
    if capacity is None:
        return queue
    return numbered(queue, ["lane"], [F.col("queued_at"), F.col("item_id")], "_n").where(F.col("_n") < capacity).drop("_n")


def positions(queue: DataFrame) -> DataFrame:
    """Place in the whole queue, from 0: lane, then score, then arrival."""
    return numbered(queue, [], [F.desc(rules.lane_rank(F.col("lane"))), F.desc("score"), F.col("queued_at"), F.col("item_id")], "position")


def dispatchable(queue: DataFrame, sessions: DataFrame, now_ms) -> DataFrame:
    """Requests that may run: those without a session, and those whose session is neither paused nor cooling down."""
    joined = queue.join(sessions.select("session_id", "is_paused", "cooldown_until_ms"), "session_id", "left")
    blocked = F.col("has_cookies") & F.col("session_id").isNotNull() & (F.coalesce("is_paused", F.lit(False)) | (F.coalesce("cooldown_until_ms", F.lit(0)) > now_ms))
    return joined.where(~F.coalesce(blocked, F.lit(False))).drop("is_paused", "cooldown_until_ms")


def cancel_failed(queue: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of the queue, and what is cancelled: a session's waiting requests whose item failed."""
    keys = failed.select("session_id", "item_id").distinct()
    return queue.join(keys, ["session_id", "item_id"], "left_anti"), queue.join(keys, ["session_id", "item_id"], "left_semi")


def plan_from_inventory(items: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Requests for an inventory alone."""
    return plan(items, statuses=statuses)


def plan_full(items: DataFrame, activity: DataFrame, list_items: DataFrame, statuses: list[str] | None = None, cached: DataFrame | None = None, now=None) -> DataFrame:
    """Requests for an inventory in activity order and for what lists name beyond it.  The inventory is computed once and
    written, as both parts read it."""
    items = written(items, "items")
    return plan(merge_activity(items, activity), orphans(list_items, items), statuses, cached, now)


def pending(ids: DataFrame, queue: DataFrame) -> DataFrame:
    """Those of ``ids`` (item_id) that wait in the queue."""
    return ids.join(queue.select("item_id"), "item_id", "left_semi")


def queue_stats(queue: DataFrame, attempts: DataFrame, delay_ms: float) -> DataFrame:
    """One row: requests by lane and in all, attempts that are processing, completed and failed (``attempts`` has outcome), and the delay now."""
    waiting = queue.agg(*(F.count_if(F.col("lane") == x).alias(x.lower()) for x in ("HOT", "WARM", "COLD")), F.count(F.lit(1)).alias("total"))
    done = attempts.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("processing", "completed", "failed")))
    return waiting.crossJoin(done).withColumn("delay_ms", F.lit(delay_ms))  # one row each


def status_progress(requests: DataFrame) -> DataFrame:
    """status, queued, completed, failed; requests without a status count as wished.  ``requests`` has status and outcome."""
    done = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return requests.groupBy(F.coalesce("status", F.lit("wished")).alias("status")).agg(F.count(F.lit(1)).alias("queued"), done("completed"), done("failed"))


def pending_by_session(queue: DataFrame) -> DataFrame:
    return queue.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))


def cancel(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays and what is cancelled when single items are: ``ids`` has item_id."""
    return queue.join(ids, "item_id", "left_anti"), queue.join(ids, "item_id", "left_semi")


def cancel_sessions(queue: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays and what is cancelled when whole sessions are: ``sessions`` has session_id."""
    return queue.join(sessions, "session_id", "left_anti"), queue.join(sessions, "session_id", "left_semi")


def webhook_items(items: DataFrame) -> DataFrame:
    return items.withColumnRenamed("status", "collection_status")
