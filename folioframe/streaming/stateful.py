"""Task logs, watchdogs and feeds as streams with state, all on event time: what a run gives depends on the events'
times, not on how they fall into batches, and a restart from the checkpoint goes on where the last batch ended.

The processors keep their state in RocksDB (`running` sets that up); a task's state is a few rows and a trimmed log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import ENDS, MOST_EVENTS, PROGRESS

# Seconds that an ended task's log stays, seconds that a task may go on after it was asked to stop, and
# the code of the warning that comes before its forced end.
HOLD, GRACE, FORCED = 120, 10, "E06"
CANCEL, QUEUED, WARNING = "cancel", "queued", "warning"
EVENT = "seq long, kind string, at timestamp, body string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def logged(events: DataFrame, *, task: str = "task_id", seq: str = "seq", kind: str = "kind", at: str = "at", body: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of events in the processors' columns, with its watermark. Rows without a task or a time are left out."""
    rows = events.select(F.col(task).cast("string").alias("task_id"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"), (F.col(body).cast("string") if body else F.lit(None).cast("string")).alias("body"))
    return rows.where("task_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)


def _millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class RetainedLog(StatefulProcessor):
    """A task's log, trimmed as `events.retained` does it: of more than `most` events all but progress stay, and the
    newest half of `most` of these. `hold` seconds after the task's end its state goes. Passes on what comes."""

    def __init__(self, most: int = MOST_EVENTS, hold: int = HOLD) -> None:
        self.most, self.hold = most, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getListState("marks", EVENT)
        self.progress = handle.getListState("progress", EVENT)
        self.count = handle.getValueState("count", "n long, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, ended = self.count.get() if self.count.exists() else (0, False)
        for pdf in rows:
            plain = [(int(s), k, a.to_pydatetime(), b) for s, k, a, b in zip(pdf["seq"].fillna(-1), pdf["kind"], pdf["at"], pdf["body"], strict=True)]
            marks = [e for e in plain if e[1] != PROGRESS]
            moving = [e for e in plain if e[1] == PROGRESS]
            if marks:
                self.marks.appendList(marks)
            if moving:
                self.progress.appendList(moving)
            n += len(plain)
            for stamp in pdf["at"][pdf["kind"].isin(ENDS)]:
                if not ended:
                    self.handle.registerTimer(_millis(stamp) + self.hold * 1000)
                ended = True
            yield pdf
        if n > self.most and self.progress.exists():
            newest = sorted((tuple(e) for e in self.progress.get()), key=lambda e: e[0])
            if len(newest) > self.most // 2:
                self.progress.put(newest[-(self.most // 2) :])
        self.count.update((n, ended))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.marks, self.progress, self.count):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Watchdog(StatefulProcessor):
    """A task's events up to its end, which comes `grace` seconds after a request to stop at the latest.

    A task that has sent nothing but `queued` is canceled at once by a request. One that runs gets a timer; if it has not
    ended by then, a warning (code FORCED) and its end as canceled are sent, both with the deadline as their time and no
    number. Further requests change nothing. Whatever comes after the end is dropped, until `hold` seconds later the
    task is forgotten.
    """

    def __init__(self, grace: int = GRACE, hold: int = HOLD) -> None:
        self.grace, self.hold = grace, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, deadline long, forget long")

    def _forced(self, key: Any, deadline: int) -> list[tuple]:
        at = pd.Timestamp(deadline, unit="ms")
        return [(key[0], None, WARNING, at, None, FORCED), (key[0], None, "canceled", at, None, None)]

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            made = pd.DataFrame(out, columns=["task_id", "seq", "kind", "at", "body", "code"])
            yield made.astype({"seq": "Int64", "at": "datetime64[us]"})

    def _end(self, status: str, at: int, deadline: int | None) -> tuple[str, None, int]:
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        self.handle.registerTimer(at + self.hold * 1000)
        return status, None, at + self.hold * 1000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, deadline, forget = self.state.get() if self.state.exists() else (QUEUED, None, None)
        out: list[tuple] = []
        for seq, kind, at, body in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")[["seq", "kind", "at", "body"]].itertuples(index=False):
            ms = _millis(at)
            if status not in ENDS and deadline is not None and ms >= deadline:
                out += self._forced(key, deadline)
                status, deadline, forget = self._end("canceled", deadline, deadline)
            if status in ENDS:
                continue
            if kind == CANCEL and status == QUEUED:
                out.append((key[0], seq, "canceled", at, body, None))
                status, deadline, forget = self._end("canceled", ms, None)
            elif kind == CANCEL:
                if deadline is None:
                    deadline = ms + self.grace * 1000
                    self.handle.registerTimer(deadline)
            else:
                out.append((key[0], seq, kind, at, body, None))
                if kind in ENDS:
                    status, deadline, forget = self._end(kind, ms, deadline)
                elif kind != QUEUED:
                    status = "running"
        self.state.update((status, deadline, forget))
        yield from self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, deadline, forget = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if status not in ENDS and deadline is not None and now >= deadline:
            self.state.update(self._end("canceled", deadline, None))
            yield from self._frame(self._forced(key, deadline))
        elif status in ENDS and forget is not None and now >= forget:
            self.state.clear()

    def close(self) -> None:
        pass


def retained_stream(events: DataFrame, *, most: int = MOST_EVENTS, hold: int = HOLD) -> DataFrame:
    """The events of `logged`, passed on; their trimmed logs are the stream's state, which `retained_log` reads."""
    return events.groupBy("task_id").transformWithStateInPandas(RetainedLog(most, hold), f"task_id string, {EVENT}", "Append", "EventTime")


def retained_log(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(task_id, seq, kind, at, body) as the state of a `retained_stream` has them after its last batch."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().select("key.task_id", "list_element.*")
    return read("marks").union(read("progress"))


def watched(events: DataFrame, *, grace: int = GRACE, hold: int = HOLD) -> DataFrame:
    """(task_id, seq, kind, at, body, code): the events of `logged` as `Watchdog` lets them through."""
    return events.groupBy("task_id").transformWithStateInPandas(Watchdog(grace, hold), f"task_id string, {EVENT}, code string", "Append", "EventTime")


def _here(at: str, condition: Column) -> Column:
    """A condition on a stream that stays above its watermark: below, rows that it drops would not move the time on."""
    return F.when(F.col(at).isNotNull(), condition).otherwise(False)


def closing_feed(events: DataFrame, ended: DataFrame, *, within: str = "1 minute") -> DataFrame:
    """The events of `logged`, and a closing one for each ended task without: readers wait for one.

    `ended` is a stream (task_id, status, ended_at) of tasks that have come to an end, with its watermark on ended_at; of
    repeated rows of a task, and time, one counts. A closing event belongs to an end not more than `within` away. A
    missing one is added as soon as the watermarks rule out that it still comes, once, with the end's time, no number,
    and kind done or (failed, canceled or interrupted tasks) failed.
    """
    near = F.expr(f"INTERVAL {within}")
    closing = events.where(_here("at", F.col("kind").isin(*ENDS))).select(F.col("task_id").alias("closed"), F.col("at").alias("closed_at"))
    ends = ended.select(F.col("task_id").cast("string").alias("task_id"), "status", "ended_at").where(_here("ended_at", F.col("status").isin(*ENDS, "interrupted"))).dropDuplicates(["task_id", "ended_at"])
    pairs = ends.join(closing, (F.col("task_id") == F.col("closed")) & (F.col("closed_at") >= F.col("ended_at") - near) & (F.col("closed_at") <= F.col("ended_at") + near), "left_outer")
    none = lambda kind: F.lit(None).cast(kind)
    added = pairs.where("closed IS NULL").select("task_id", none("long").alias("seq"), F.when(F.col("status") == "done", "done").otherwise("failed").alias("kind"), F.col("ended_at").alias("at"), none("string").alias("body"))
    return events.union(added)


def running(stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Append a stream to a Parquet table, each row once, also over restarts: files count when their batch is in the
    sink's log. `available_now` takes what there is and ends."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
