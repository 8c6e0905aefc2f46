"""Keyed state that ends: queue entries that are released when their item is done, sessions whose cooldown runs out.

Both need a store with several values and timers for each key, so the session must name RocksDB as its state store (see
``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import COOLDOWN_MS, PAUSE_AT

RANK = {"COLD": 1, "WARM": 2, "HOT": 3}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Pending(StatefulProcessor):
    """An item's entry: a value for what is shown, a map for its users; both are released when the item ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "opened long, lane string, users int, cookies boolean, requests long")
        self.users = handle.getMapState("users", "user_id long", "asked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.entry.get() if self.entry.exists() else None
        for x in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            if x.kind != "request":
                if now is not None:
                    out.append((*key, *now, int(x.seq)))
                    self.entry.clear()
                    self.users.clear()
                now = None
                continue
            if now is None:
                now = (int(x.seq), "HOT" if x.has_cookies and x.lane != "COLD" else x.lane, 0, bool(x.has_cookies), 0)
            opened, lane, users, cookies, requests = now
            if not self.users.containsKey((int(x.user_id),)):
                self.users.updateValue((int(x.user_id),), (True,))
                users += 1
            lane = x.lane if RANK[x.lane] > RANK[lane] else lane
            if x.has_cookies and not cookies:
                cookies, lane = True, "HOT" if x.lane != "COLD" else lane
            now = (opened, lane, users, cookies, requests + 1)
        if now is not None:
            self.entry.update(now)
            out.append((*key, *now, None))
        frame = pd.DataFrame(out, columns=["item_id", "opened", "lane", "users", "has_cookies", "requests", "ended_by"])
        yield frame.astype({"ended_by": "Int64"})

    def close(self) -> None:
        pass


def pending_entries(log: DataFrame) -> DataFrame:
    """Batch ``plans.enrichment.pending_entries`` on a stream: an entry's row whenever it changes, the last when it ends."""
    rows = log.select("item_id", "ts", "seq", "kind", "user_id", "lane", "has_cookies")
    shown = "item_id long, opened long, lane string, users int, has_cookies boolean, requests long, ended_by long"
    return rows.groupBy("item_id").transformWithStateInPandas(Pending(), shown, "Update", "None")


class Cooling(StatefulProcessor):
    """A session's failures and pause, and a timer for the end of its cooldown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "failures long, paused boolean, pauses long, until long")

    def _row(self, key, s: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, *s[:3], s[3] > 0)], columns=["session_id", "failures", "is_paused", "pauses", "is_cooling"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, paused, pauses, until = self.state.get() if self.state.exists() else (0, False, 0, 0)
        failed = 0
        for x in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            if x.kind == "failure":
                failures, failed = failures + 1, int(x.ms) + COOLDOWN_MS
                if failures >= PAUSE_AT:
                    paused, pauses = True, pauses + 1
            elif x.kind == "resume":
                failures, paused = 0, False
            else:
                failures = 0
        if failed > until:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            until = failed
            self.handle.registerTimer(until)
        self.state.update((failures, paused, pauses, until))
        yield self._row(key, (failures, paused, pauses, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, paused, pauses, until = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= until:
            until = 0
            self.state.update((failures, paused, pauses, until))
        yield self._row(key, (failures, paused, pauses, until))

    def close(self) -> None:
        pass


def session_cooldowns(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """session_id, failures, is_paused, pauses, is_cooling: a row whenever a session changes, also when its cooldown ends
    without a new event of its own.  Time is that of the events, ``late`` behind the newest seen."""
    rows = events.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "kind").withColumn("ms", F.unix_millis("ts"))
    shown = "session_id long, failures long, is_paused boolean, pauses long, is_cooling boolean"
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(Cooling(), shown, "Update", "EventTime")
