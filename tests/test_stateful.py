"""Streams with state: on files of events that come batch by batch, over restarts, against plain Python."""

from datetime import datetime, timedelta

import pytest

from folioframe.streaming import stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "task_id string, seq long, kind string, at timestamp"


class Feed:
    """A folder of event files, read as a stream, a file a batch."""

    def __init__(self, spark, top, schema=SCHEMA):
        self.spark, self.top, self.schema, self.n = spark, top, schema, 0
        (top / "in").mkdir(parents=True)

    def put(self, *rows):
        self.n += 1
        one = self.spark.createDataFrame([(t, s, k, T0 + timedelta(seconds=x)) for t, s, k, x in rows], self.schema).coalesce(1)
        one.write.parquet(str(self.top / "stage" / str(self.n)))
        (part,) = (self.top / "stage" / str(self.n)).glob("part-*.parquet")
        part.rename(self.top / "in" / f"{self.n:04}.parquet")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.top / "in"))

    def run(self, made):
        """Take all there is, from the checkpoint; the whole output."""
        stateful.running(made, str(self.top / "out"), str(self.top / "check")).awaitTermination()
        return self.spark.read.parquet(str(self.top / "out")).collect()


def seconds(row):
    return (row.at - T0).total_seconds()


def test_retained_log_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    make = lambda: stateful.retained_stream(stateful.logged(feed.stream(), late="1 minute"), most=20, hold=120)
    rows = [("a", k, "progress" if k % 5 else "stage", k) for k in range(30)]
    small = [("b", k, "progress", k) for k in range(20)]
    feed.put(*rows[:12], *small[:10])
    assert len(feed.run(make())) == 22
    feed.put(*rows[12:], *small[10:])
    assert len(feed.run(make())) == 50  # each event once, after a restart too
    got = {(r.task_id, r.seq) for r in stateful.retained_log(spark, str(tmp_path / "check")).collect()}
    marks, moving = [r for r in rows if r[2] != "progress"], [r for r in rows if r[2] == "progress"]
    assert got == {("a", r[1]) for r in marks + moving[-10:]} | {("b", k) for k in range(20)}  # b never passed the limit


def test_ended_log_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    make = lambda: stateful.retained_stream(stateful.logged(feed.stream()), most=20, hold=120)
    feed.put(("a", 0, "progress", 0), ("a", 1, "done", 10), ("b", 0, "progress", 100))
    feed.run(make())
    held = lambda: {r.task_id for r in stateful.retained_log(spark, str(tmp_path / "check")).collect()}
    assert held() == {"a", "b"}
    feed.put(("b", 1, "progress", 131))  # 121 s after the end of a
    feed.run(make())
    assert held() == {"b"}


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_watchdog(spark, tmp_path, batches):
    feed = Feed(spark, tmp_path)
    make = lambda: stateful.watched(stateful.logged(feed.stream(), late="2 seconds"), grace=10, hold=1000)
    rows = [
        ("queued", 0, "queued", 0), ("queued", 1, "cancel", 5), ("queued", 2, "done", 6),
        ("stuck", 0, "progress", 1), ("stuck", 1, "cancel", 7), ("stuck", 2, "cancel", 12), ("stuck", 3, "done", 18),
        ("polite", 0, "progress", 2), ("polite", 1, "cancel", 8), ("polite", 2, "progress", 9), ("polite", 3, "canceled", 15), ("polite", 4, "progress", 16),
        ("silent", 0, "progress", 3), ("silent", 1, "cancel", 9), ("well", 0, "progress", 4), ("well", 1, "done", 30), ("clock", 0, "progress", 40),
    ]
    rows.sort(key=lambda r: r[3])
    step = -(-len(rows) // batches)
    for k in range(0, len(rows), step):
        feed.put(*rows[k : k + step])
        out = feed.run(make())  # each batch is a restart
    got = {t: [(r.kind, r.seq, seconds(r), r.code) for r in sorted((r for r in out if r.task_id == t), key=lambda r: (r.at, r.kind != "warning"))] for t in {r[0] for r in rows}}
    forced = lambda at: [("warning", None, at, "E06"), ("canceled", None, at, None)]
    assert got == {
        "queued": [("queued", 0, 0.0, None), ("canceled", 1, 5.0, None)],
        "stuck": [("progress", 0, 1.0, None), *forced(17.0)],  # its result came a second too late
        "polite": [("progress", 0, 2.0, None), ("progress", 2, 9.0, None), ("canceled", 3, 15.0, None)],
        "silent": [("progress", 0, 3.0, None), *forced(19.0)],  # by the timer alone
        "well": [("progress", 0, 4.0, None), ("done", 1, 30.0, None)], "clock": [("progress", 0, 40.0, None)],
    }


def test_closing_feed_once(spark, tmp_path):
    feed, ends = Feed(spark, tmp_path / "e"), Feed(spark, tmp_path / "t", "task_id string, n long, status string, ended_at timestamp")

    def make():
        return stateful.closing_feed(stateful.logged(feed.stream()), ends.stream().withWatermark("ended_at", "0 seconds"), within="60 seconds")

    feed.put(("a", 0, "progress", 1), ("a", 1, "done", 10), ("b", 0, "progress", 2))
    ends.put(("a", 0, "done", 11), ("b", 0, "canceled", 20), ("b", 1, "canceled", 20), ("c", 0, "done", 30), ("d", 0, "running", 31))
    assert {(r.task_id, r.kind) for r in feed.run(make())} == {("a", "progress"), ("a", "done"), ("b", "progress")}  # a closing one may still come
    feed.put(("c", 1, "done", 50), ("z", 0, "progress", 300))
    ends.put(("y", 0, "running", 300))
    feed.run(make())
    feed.put(("z", 1, "progress", 400))
    ends.put(("y", 1, "running", 400))
    out = feed.run(make())
    closing = sorted((r.task_id, r.kind, r.seq, seconds(r)) for r in out if r.kind in ("done", "failed"))
    assert closing == [("a", "done", 1, 10.0), ("b", "failed", None, 20.0), ("c", "done", 1, 50.0)]
    assert sum(r.kind == "progress" for r in out) == 4
