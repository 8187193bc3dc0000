"""Task events as streams: retention, task states, throttled progress, daily sums, windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How many events a task keeps, the kinds that end it and the one that may be dropped.
MOST_EVENTS = 4000
ENDS = ("done", "failed", "canceled")
PROGRESS = "progress"


def read_events(spark: SparkSession, path: str, schema: Any, per_trigger: int = 16) -> DataFrame:
    """A folder of event files as a stream. A reader that comes later starts from the first file: that is the replay."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def retained(events: DataFrame, *, task: str, seq: str, kind: str, most: int = MOST_EVENTS) -> DataFrame:
    """A batch of events as a trimmed log keeps them: beyond `most`, all but progress, and the newest half of `most`.

    Numbers never change, so a reader's cursor stays valid. Only progress events of tasks above the limit are ranked: a
    count decides first, and what it leaves alone is not sorted.
    """
    progress = F.coalesce(F.col(kind) == PROGRESS, F.lit(False))
    large = events.groupBy(F.col(task).alias("large")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("large")
    found = F.col(task).eqNullSafe(F.col("large"))
    few = events.join(large, found & progress, "left_anti")
    rank = F.row_number().over(W.partitionBy(task).orderBy(F.desc(seq)))
    kept = events.where(progress).join(large, found, "left_semi").select(F.struct(*events.columns).alias("row"), rank.alias("rank")).where(F.col("rank") <= most // 2)
    return few.unionByName(kept.select("row.*"))


STATE = "task_id string, status string, events long, progress double, last_seq long"


def task_states(events: DataFrame, *, task: str = "task_id", seq: str = "seq", kind: str = "event", progress: str = "progress", retain_seconds: int | None = None) -> DataFrame:
    """A stream of task states: queued, running, then done, failed or canceled. After its end a task changes no more:
    late events are dropped. With `retain_seconds`, the state of an ended task goes so long after its last event; such
    a stream always has a next batch to wait for, so it is for continuous triggers, not for `available_now`.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if state.get[0] in ENDS:
                state.remove()
            return
        status, n, part, last = state.get if state.exists else ("queued", 0, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for s, event, p in zip(rows["seq"], rows["event"], rows["progress"], strict=True):
            if status in ENDS:
                break
            n, last = n + 1, max(last, int(s))
            status = event if event in ENDS else "running"
            if not pd.isna(p):
                part = min(1.0, max(0.0, float(p)))
        part = 1.0 if status == "done" else part
        state.update((status, n, part, last))
        if retain_seconds is not None:
            state.setTimeoutDuration(retain_seconds * 1000)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "events": [n], "progress": [part], "last_seq": [last]})

    rows = events.select(F.col(task).cast("string").alias("task_id"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("event"), F.col(progress).cast("double").alias("progress"))
    return rows.groupBy("task_id").applyInPandasWithState(update, STATE, "status string, n long, part double, last long", "update", GroupStateTimeout.NoTimeout if retain_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)


def throttled(events: DataFrame, *, task: str, ts: str, value: str, every: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last progress of each task in each window: what a writer that waits between writes would store."""
    done = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(task, F.window(ts, every)).agg(F.max_by(done, F.col(ts)).alias("progress")).select(task, "window.start", "progress")


def daily(events: DataFrame, *, ts: str, sums: dict[str, Any], late: str = "1 day") -> DataFrame:
    """Sums by day over a stream or a table. Streams close a day once events are `late` past it (an extension)."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.window(ts, "1 day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).select(F.to_date("window.start").alias("day"), *sums)


def sessions(events: DataFrame, *, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by key in sessions that end after a gap (an extension)."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("events")).select(key, "session_window.start", "session_window.end", "events")


def backfilled(events: DataFrame, tasks: DataFrame, *, task: str = "task_id", kind: str = "event", status: str = "status") -> DataFrame:
    """Events (task, kind) with a closing one for each task that has ended but whose log has none: readers wait for one.

    Cancelled tasks close as failed. The added rows have nulls in the events' other columns.
    """
    closed = events.where(F.col(kind).isin(*ENDS)).select(F.col(task).alias("closed")).distinct()
    ended = tasks.where(F.col(status).isin(*ENDS)).select(F.col(task), F.when(F.col(status) == "done", "done").otherwise("failed").alias(kind)).distinct()
    return events.unionByName(ended.join(closed, F.col(task) == F.col("closed"), "left_anti"), allowMissingColumns=True)


def overdue(tasks: DataFrame, now: Column, *, since: str = "cancel_requested", status: str = "status", seconds: int = 10) -> DataFrame:
    """Tasks that were asked to stop `seconds` or more before `now` and still run: to be closed as canceled. What they
    send later comes after their end, and is dropped by `task_states`."""
    return tasks.where((F.col(status) == "running") & (F.col(since) <= now - F.make_dt_interval(secs=F.lit(seconds)))).withColumn(status, F.lit("canceled"))


def deliver(stream: DataFrame, sink, checkpoint: str, *, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Feed each micro-batch to sink(batch, number). A batch may come twice after a failure, with the same number."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()
