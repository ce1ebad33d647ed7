"""Streams: state without caps, state that goes, windows that close, sinks that write once."""

from __future__ import annotations

import shutil
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modiste.sources import sinks
from modiste.streaming import jobs

C = F.col
START = datetime(2024, 1, 1)
SIGNALS = "event_id long, user_token string, object_id string, ts timestamp, session_id string, dwell_ms double, kind string"
EVENTS = "event_id long, event_type string, user_id long, ts timestamp, value double"


class Log:
    """A folder that gets files, and streams over it with a file per micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        path.mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.02)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


@pytest.fixture
def signals(spark, tmp_path):
    return Log(spark, tmp_path / "signals", SIGNALS)


@pytest.fixture
def events(spark, tmp_path):
    return Log(spark, tmp_path / "events", EVENTS)


def signal(i, user, item, minutes, kind, dwell=5000.0):
    return (i, user, item, START + timedelta(minutes=minutes), "s", dwell, kind)


def end_of_log(i=10**9):
    return [(None, "end", None, START + timedelta(days=4000), None, None, None)]


def test_a_user_with_more_likes_than_any_cap(signals):
    n = 6000
    for part in range(3):
        signals.add([signal(i, "u", f"p{i}", i / 100, "like") for i in range(part * n // 3, (part + 1) * n // 3)])
    signals.add([signal(10_000 + i, "u", f"p{i * 50}", 1000 + i, "impression", 300.0) for i in range(140)])
    got = jobs.dwell_dislikes(signals.stream(), keep=1000).select("event_id", "rank").collect()
    want = jobs.dwell_dislikes_batch(signals.batch(), keep=1000).select("event_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.event_id for r in got} == set(range(10_120, 10_140))


def test_likes_live_for_their_time(signals):
    stream = jobs.fast_swipes(signals.stream(), ttl_days=3 / 86_400, parts=1)
    sink = jobs.Sink(stream, "swipes")
    where = sinks.scratch_path(signals.spark, "checkpoint")
    signals.add([signal(1, "u", "p1", 0, "like"), signal(2, "u", "p2", 0, "like")])
    signals.add([signal(3, "u", "p1", 1, "impression", 100.0)])
    jobs.drain(stream, sink, keyed=True, checkpoint=where)
    assert sink.read().count() == 0
    time.sleep(4)
    signals.add([signal(4, "u", "p2", 2, "impression", 100.0)])
    jobs.drain(stream, sink, keyed=True, checkpoint=where)
    assert [r.event_id for r in sink.read().collect()] == [4]


def test_buffers_of_idle_users_are_emptied(signals):
    signals.add([signal(1, "idle", "p1", 0, "click"), signal(2, "busy", "p1", 0, "click")])
    signals.add([signal(3, "busy", "p2", 60 * 24 * 5, "click")])
    signals.add([signal(4, "busy", "p3", 60 * 24 * 5 + 1, "click")])
    signals.add([signal(5, "idle", "p4", 60 * 24 * 5 + 2, "click"), signal(6, "busy", "p5", 60 * 24 * 5 + 2, "click")])
    got = jobs.buffered(signals.stream(), delay="1 hour", idle_days=6, parts=1)
    sink = jobs.Sink(got, "buffers")
    jobs.drain(got, sink, "update", keyed=True)
    held = jobs.newest_version(sink.read(), ["user_token", "buffer", "part"]).where("buffer = 'click'").collect()
    assert Counter(r.user_token for r in held) == {"idle": 2, "busy": 4}
    got = jobs.buffered(signals.stream(), delay="1 hour", idle_days=2, parts=1)
    sink = jobs.Sink(got, "buffers")
    jobs.drain(got, sink, "update", keyed=True)
    held = jobs.newest_version(sink.read(), ["user_token", "buffer", "part"]).where("buffer = 'click'").collect()
    assert sorted((r.user_token, r.event_id) for r in held) == [("busy", 2), ("busy", 3), ("busy", 4), ("busy", 6), ("idle", 5)]


def test_buffers_of_a_busy_user_equal_the_batch(signals):
    for part in range(3):
        signals.add([signal(i, "u", f"p{i % 40}", i, ["like", "click", "dislike"][i % 3]) for i in range(part * 300, part * 300 + 300)])
    for parts in (1, 3):
        got = jobs.session_buffers(signals.stream(), parts=parts).select("user_token", "buffer", "event_id", "rank").collect()
        want = jobs.session_buffers_batch(signals.batch()).select("user_token", "buffer", "event_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_outcomes_without_a_steer_come_out_after_the_watermark(signals):
    signals.add([signal(1, "u", "p", 0, "like"), signal(2, "u", "p", 5, "click"), signal(3, "u", "p", 50, "dislike"), signal(4, "v", "p", 3, "save")])
    signals.add([signal(5, "u", "p", 60, "like"), signal(6, "u", "p", 59, "like"), signal(7, "u", "p", 90, "save"), signal(8, "u", "p", 91, "click"), signal(9, None, "p", 91, "click")])
    where = sinks.scratch_path(signals.spark, "checkpoint")
    stream = jobs.credited(signals.stream(), C("kind") == "like")
    sink = jobs.Sink(stream, "credited")
    jobs.drain(stream, sink, checkpoint=where)
    early = {r.event_id for r in sink.read().collect()}
    assert 8 not in early and 7 not in early  # the watermark hasn't passed them
    signals.add(end_of_log())
    jobs.drain(stream, sink, checkpoint=where)
    assert sorted((r.event_id, r.steer_id) for r in sink.read().collect()) == [(2, 1), (3, None), (4, None), (7, 5), (8, None), (9, None)]


def event(i, minutes, kind="a"):
    return (i, kind, i % 3, START + timedelta(minutes=minutes), float(i))


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_windows_close_once_and_late_rows_are_counted_apart(events, kind):
    rows = [event(i, i * 7) for i in range(1200)]  # 140 hours
    for at in range(0, 1200, 100):
        late = [event(5000 + at + j, (at - 400) * 7 + j) for j in range(3)] if at >= 400 else []
        events.add(rows[at : at + 100] + late)
    events.add([(None, None, None, START + timedelta(days=4000), None)])
    (q, sink), (apart, late) = jobs.windows_and_late(events.stream(), kind)
    q.awaitTermination()
    apart.awaitTermination()
    got, apart = sink.read().collect(), late.read().collect()
    assert len({(r.event_type, r.start_s) for r in got}) == len(got)
    whole = Counter({(r.start_s): r.n for r in jobs.window_counts(events.batch().where("event_id IS NOT NULL"), kind).collect()})
    seen = Counter({r.start_s: r.n for r in got})
    seen.update({r.start_s: r.n for r in apart})
    assert seen == whole and sum(r.n for r in apart) == 24 * (2 if kind == "sliding" else 1)
    # state holds the windows of the last two files, not of the log
    rows_held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(rows_held) <= 60 < len(got)


def test_sessions_close(events):
    events.add([event(i, i * 5) for i in range(20)])
    events.add([event(100 + i, 3000 + i * 5) for i in range(20)])
    events.add([(None, None, None, START + timedelta(days=4000), None)])
    ((q, sink),) = jobs.windows_and_late(events.stream(), "session")
    q.awaitTermination()
    got = sorted((r.user_id, r.start_s, r.end_s, r.n) for r in sink.read().collect())
    want = sorted((r.user_id, r.start_s, r.end_s, r.n) for r in jobs.window_counts(events.batch().where("event_id IS NOT NULL"), "session").collect())
    assert got == want and len(got) == 6


def test_a_failed_batch_of_a_log_is_written_once(spark, signals, tmp_path):
    path, where = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    signals.add([signal(i, "u", "p", i, "click") for i in range(50)])
    signals.add([signal(50 + i, "u", "p", i, "click") for i in range(50)])
    entries = signals.stream().select("event_id", "user_token")
    sinks.stream_jsonl(entries, path, where)
    read = lambda: sorted(r.event_id for r in spark.read.schema("event_id long, user_token string").json(path).collect())
    assert read() == list(range(100))
    # the last micro-batch has written its files, but died before it could say so
    commits = Path(where) / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    # and files of an attempt that never got as far as the sink's log lie about
    orphan = next(f for f in Path(path).iterdir() if f.name.startswith("part-"))
    shutil.copy(orphan, orphan.with_name("part-99999-orphan.json"))
    sinks.stream_jsonl(entries, path, where)
    assert read() == list(range(100))
    signals.add([signal(100 + i, "u", "p", i, "click") for i in range(10)])
    sinks.stream_jsonl(entries, path, where)
    assert read() == list(range(110))


def test_a_batch_of_a_log_that_is_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(20).select(C("id").alias("event_id"))
    sinks.append_jsonl(rows.where("id < 10"), path, "one")
    sinks.append_jsonl(rows.where("id >= 10"), path, "two")
    sinks.append_jsonl(rows.where("id >= 10"), path, "two")
    assert sorted(r.event_id for r in sinks.read_jsonl(spark, path, "event_id long").collect()) == list(range(20))
