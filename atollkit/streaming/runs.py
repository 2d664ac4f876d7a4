"""Run events as streams; every function takes a static or a streaming table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("Completed", "Stopped", "Killed")


def latest_run_state(events: DataFrame) -> DataFrame:
    """(pid, status, done, ts) of each run from events (pid, ts, status, done): the first terminal state is final, else the
    latest state counts. One aggregate by pid, so partial states combine and a stream keeps a few values a run."""
    end = F.col("status").isin(*TERMINAL)
    state = F.struct("ts", "status", "done")
    rows = events.groupBy("pid").agg(F.min(F.when(end, state)).alias("last"), F.max(state).alias("now"))
    s = F.coalesce("last", "now")
    return rows.select("pid", s.status.alias("status"), s.done.alias("done"), s.ts.alias("ts"))


def runs_per_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, user_id, started, finished) in tumbling windows; a stream drops what comes later than the watermark and counts
    an event_id once."""
    rows = events.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    end = F.col("status").isin(*TERMINAL)
    out = rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.sum((~end).cast("long")).alias("started"), F.sum(end.cast("long")).alias("finished"))
    return out.select(F.col("w.start").alias("start"), "user_id", "started", "finished")


STATE = "status string, done int, ts timestamp, final boolean"
CHANGED = "pid long, status string, done int, ts timestamp"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """A run's state after more of its events; a row where it changed. A state that nothing has touched for keep_ms of event time goes."""
    if state.hasTimedOut:
        state.remove()
        return
    before = tuple(state.get) if state.exists else None
    now = before
    for rows in frames:
        for row in rows.sort_values(["ts", "status", "done"], na_position="first").itertuples():
            end = row.status in TERMINAL
            one = (row.status, None if pd.isna(row.done) else int(row.done), row.ts.to_pydatetime(), end)
            if now is None or (end and (not now[3] or one[2] < now[2])) or (not end and not now[3] and one[2] >= now[2]):
                now = one
    state.update(now)
    last = int(now[2].replace(tzinfo=timezone.utc).timestamp() * 1000) if now[2].tzinfo is None else int(now[2].timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
    if now != before:
        yield pd.DataFrame({"pid": [key[0]], "status": [now[0]], "done": [now[1]], "ts": [now[2]]})


def run_states(events: DataFrame, late: str = "30 minutes", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """The changes of latest_run_state in a stream of events: a row whenever a run's state becomes another.

    State is kept by pid: a terminal state is final but for an earlier one that comes late; events after it and repeated ones change nothing. A run's
    state is let go once event time has moved on by `keep`; events later than `late` are dropped."""
    rows = events.select(F.col("pid").cast("long").alias("pid"), "ts", "status", F.col("done").cast("int").alias("done")).where("pid IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    keep_ms = int(keep.total_seconds() * 1000)
    step = lambda key, frames, state: _advance(key, frames, state, keep_ms)
    return rows.groupBy("pid").applyInPandasWithState(step, CHANGED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start_upsert(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, late: str = "30 minutes"):
    """Write what changes in a stream's run states to a table at path, an epoch a batch: rows grow with the changes, and a batch that
    runs again writes the same epoch. read_run_states() gives the present states."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run_states(events, late).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_run_states(spark: SparkSession, path: str) -> DataFrame:
    """(pid, status, done, ts) of each run, by the last of its changes."""
    rows = spark.read.schema(f"{CHANGED}, epoch long").parquet(path)
    return rows.groupBy("pid").agg(F.max_by(F.struct("status", "done", "ts"), "epoch").alias("s")).select("pid", "s.*")


def compact_run_states(spark: SparkSession, path: str, into: str) -> None:
    """Present states as a table of one epoch at another path, for a log of many changes."""
    read_run_states(spark, path).write.mode("overwrite").parquet(f"{into}/epoch=0")
