"""The request delay as a scan that composes blocks of outcomes, so that one key's log takes as many tasks as it needs.

Three successes in a row shorten the delay, a rate limit lengthens it, any failure ends the streak.  Each outcome is a step
function on (delay, streak).  Of a block of outcomes only this is needed: the successes before its first failure (the
streak that came in decides which of them shorten), the steps on the delay after that, and the streak it ends with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the state machine.
BASE_MS, LEAST_MS, MOST_MS, FACTOR, STREAK = 2067, 274, 180_000, 1.4, 3

BLOCK = "lead long, failed boolean, steps binary, level double, trail int, n long"


def paced(state: tuple[float, int, int], outcome: str) -> tuple[float, int, int]:
    """Delay, streak and count after one more outcome."""
    delay, streak, n = state
    if outcome == "success":
        streak += 1
        if streak >= STREAK:
            delay, streak = shorter(delay), 0
    else:
        delay, streak = longer(delay) if outcome == "rate_limited" else delay, 0
    return delay, streak, n + 1


def shorter(delay: float) -> float:
    return max(float(LEAST_MS), float(math.floor(delay / FACTOR)))


def longer(delay: float) -> float:
    return min(float(MOST_MS), delay * FACTOR)


def stepped(delay: float, steps: bytes) -> float:
    for s in steps:
        delay = longer(delay) if s else shorter(delay)
    return delay


def summary(success: np.ndarray, limited: np.ndarray) -> tuple[int, bool, bytes, float | None, int, int]:
    """One block: lead, failed, steps after the first failure (0 shortens, 1 lengthens), level, trail, n.

    Steps never cross: they keep the order of two delays.  So once the least and the greatest delay have come to the same
    value, whatever came in is forgotten: ``level`` is that value, and the steps that led to it are left out.
    """
    n, bad = len(success), np.flatnonzero(~success)
    if not len(bad):
        return n, False, b"", None, 0, n
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(success, -1, place))  # successes in a row up to here
    kind = np.where(success & (since % STREAK == 0), 0, np.where(limited, 1, 2)).astype(np.int8)[bad[0] :]
    steps = kind[kind < 2].tobytes()
    level, low, high, kept = None, float(LEAST_MS), float(MOST_MS), 0
    for k, s in enumerate(steps):
        low, high = (longer(low), longer(high)) if s else (shorter(low), shorter(high))
        if low == high:
            level, kept = low, k + 1
            break
    if level is not None:
        level, steps = stepped(level, steps[kept:]), b""
    return int(bad[0]), True, steps, level, int((n - 1 - bad[-1]) % STREAK), n


def after(state: tuple[float, int, int], block: tuple) -> tuple[float, int, int]:
    """State after a block."""
    delay, streak, n = state
    lead, failed, steps, level, trail, size = block
    for _ in range((streak + lead) // STREAK):
        if delay == LEAST_MS:
            break
        delay = shorter(delay)
    if not failed:
        return delay, (streak + lead) % STREAK, n + size
    return stepped(delay if level is None else level, steps), trail, n + size


def blocks(outcomes: DataFrame, key: str) -> DataFrame:
    """Key, range, part and what ``summary`` has: outcomes are dealt by ranges of key and order, whatever a key's share."""
    rows = outcomes.select(key, "ts", "seq", "outcome").repartitionByRange(key, "ts", "seq").sortWithinPartitions(key, "ts", "seq")
    rows = rows.select(key, (F.col("outcome") == "success").alias("success"), (F.col("outcome") == "rate_limited").alias("limited"), F.spark_partition_id().alias("range"))

    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.float64(), pa.int32(), pa.int64())
    names = [key, "range", "part", "lead", "failed", "steps", "level", "trail", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in enumerate(batches):
            keys = b.column(0)
            codes = np.array(keys.dictionary_encode().indices.fill_null(-1))
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            if not b.num_rows:
                continue
            success, limited = (np.array(b.column(c).fill_null(False)).astype(bool) for c in (1, 2))
            found = [summary(success[x:y], limited[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            at = pa.array(cuts[:-1], pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([keys.take(at), b.column(3).take(at), pa.array([part] * len(found), pa.int64()), *columns], names=names)

    return rows.mapInArrow(run, f"{key} {outcomes.schema[key].dataType.simpleString()}, range int, part long, {BLOCK}")


def adaptive_delay(outcomes: DataFrame, key: str) -> DataFrame:
    """key, delay_ms, streak, n after all of a key's outcomes (columns ts, seq, outcome: success, rate_limited, other).

    Every task turns its range of the log into blocks; what one key's blocks give is then followed in order.  A block has
    at most a byte for each change of the delay since delays last met, and a task holds one block at a time.  A null
    outcome counts as ``other``, a null key is a key, and an empty table gives no rows.
    """
    rows = blocks(outcomes, key).repartition(key).sortWithinPartitions(key, "range", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def shown(kind: pa.DataType, done: list) -> pa.RecordBatch:
            states = [pa.array([d[1][k] for d in done], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *states], names=[key, "delay_ms", "streak", "n"])

        kind = None
        for b in batches:
            done, kind = [], b.schema.field(0).type
            for k, *block in zip(*(b.column(c).to_pylist() for c in (0, *range(3, 9))), strict=True):
                if state is None or k != at:
                    if state is not None:
                        done.append((at, state))
                    at, state = k, (float(BASE_MS), 0, 0)
                state = after(state, tuple(block))
            yield shown(kind, done)
        if state is not None:
            yield shown(kind, [(at, state)])

    return rows.mapInArrow(run, f"{key} {outcomes.schema[key].dataType.simpleString()}, delay_ms double, streak int, n long")


def request_gaps(requests: DataFrame, key: str, delay_ms: Column) -> DataFrame:
    """Requests (ts, seq) with ``gap_ms`` since the key's last one, null for its first, and ``too_early``: the gap is
    shorter than the delay asked for, so the request would have to wait ``wait_ms`` more."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = requests.withColumn("gap_ms", (ms - F.lag(ms).over(Window.partitionBy(key).orderBy("ts", "seq"))).cast("double"))
    wait = F.greatest(F.lit(0.0), delay_ms - F.col("gap_ms"))
    return rows.withColumn("too_early", F.coalesce(F.col("gap_ms") < delay_ms, F.lit(False))).withColumn("wait_ms", F.coalesce(wait, F.lit(0.0)))
