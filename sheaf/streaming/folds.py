"""The queue's and the sessions' state machines on streams: keyed state, updated per micro-batch.

A key's rows are folded in order of ts and seq within a micro-batch, and batches in order of arrival: a source that
delivers a key's rows late, in a later batch than newer ones, gives what the live service would give, which acts on
arrival too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pacing import BASE_MS, paced
from ..operators.sessions import PAUSE_AT
from ..session import shared_dir

RANK = {"COLD": 1, "WARM": 2, "HOT": 3}


def _stateful(rows: DataFrame, key: str, kind: str, state: str, start: tuple, step: Callable[[tuple, object], tuple], shown: Callable[[tuple], tuple], out: str) -> DataFrame:
    """Fold each key's rows of a batch, in order of ts and seq, into its state, and emit what the state shows."""
    names = [key, *(c.split()[0] for c in out.split(", "))]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = held.get if held.exists else start
        for x in pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            s = step(s, x)
        held.update(s)
        yield pd.DataFrame([(*k, *shown(s))], columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "update", GroupStateTimeout.NoTimeout)


def adaptive_delay(outcomes: DataFrame, key: str) -> DataFrame:
    return _stateful(outcomes, key, "long", "delay double, streak int, n int", (float(BASE_MS), 0, 0), lambda s, x: paced(s, x.outcome), lambda s: s, "delay_ms double, streak int, n int")


def session_states(events: DataFrame) -> DataFrame:
    def step(s: tuple, x) -> tuple:
        failures, paused, pauses = s
        if x.kind == "failure":
            failures += 1
            if failures >= PAUSE_AT:
                paused, pauses = True, pauses + 1
        elif x.kind == "resume":
            failures, paused = 0, False
        else:
            failures = 0
        return failures, paused, pauses

    return _stateful(events, "session_id", "long", "failures long, paused boolean, pauses long", (0, False, 0), step, lambda s: s, "failures long, is_paused boolean, pauses long")


def merged_requests(requests: DataFrame) -> DataFrame:
    """Requests of one item while it waits: users, the lane as it rises, cookies as they come in."""

    def step(s: tuple, x) -> tuple:
        lane, users, cookies, n = s
        if not n:
            return "HOT" if x.has_cookies and x.lane != "COLD" else x.lane, [int(x.user_id)], bool(x.has_cookies), 1
        users = [*users, int(x.user_id)] if x.user_id not in users else users
        lane = x.lane if RANK[x.lane] > RANK[lane] else lane
        if x.has_cookies and not cookies:
            cookies, lane = True, "HOT" if x.lane != "COLD" else lane
        return lane, users, cookies, n + 1

    rows = requests.withColumnsRenamed({"queued_at": "ts", "request_id": "seq"})
    return _stateful(rows, "item_id", "long", "lane string, users array<long>, cookies boolean, n long", ("COLD", [], False, 0), step, lambda s: (s[0], len(s[1]), s[2], s[3]), "lane string, users int, has_cookies boolean, requests long")


def replay(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], key: str | list[str], per_batch: int = 4) -> DataFrame:
    """Run a fold over the files at ``path`` as a stream, to its end; the last row of each key.

    Batches go to a folder of the shared directory by number, so a batch that is run again replaces itself.
    """
    base = f"{shared_dir(spark)}/sheaf-stream-{uuid.uuid4().hex}"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch)
    source = source.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0]) if single else source.parquet(path)
    out = build(source)

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    done = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).foreachBatch(put).start()
    done.awaitTermination()
    rows = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{base}/out")
    last = rows.withColumn("n_batch", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch"))))
    return last.where("n_batch = 1").drop("batch", "n_batch")


