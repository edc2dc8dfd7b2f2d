"""Bursts by timers: the same as on a table, nothing lost when changes come late or the source goes idle."""

import random
import signal
import time

import pandas as pd

from codewarden.streaming import changes, debounce
from tests.test_streaming import CASES, SESSION, bursts, events, write_changes
from verification import spark_queries


def until(spark, folder, enough, seconds=120):
    got, stop = [], time.time() + seconds
    while time.time() < stop:
        if (folder / "_spark_metadata").exists():
            got = spark.read.schema(SESSION).parquet(str(folder)).collect()
            if enough(got):
                break
        time.sleep(1)
    return got


def start(spark, tmp_path, quiet):
    read = changes.read_changes(spark, str(tmp_path / "changes"))
    return debounce.live_sessions(read, 1.0, quiet).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(
        processingTime="1 second").start()


def test_merging_is_the_same_in_any_order():
    draw = random.Random(1)
    for _ in range(200):
        parts = [(t, t + draw.randrange(3), 1, draw.choice("ab")) for t in draw.sample(range(60), draw.randrange(1, 12))]
        whole = debounce.merged(parts, 4)
        draw.shuffle(parts)
        cut = draw.randrange(len(parts) + 1)
        assert debounce.merged(debounce.merged(parts[:cut], 4) + parts[cut:], 4) == whole
        assert sum(b[2] for b in whole) == len(parts)
        assert all(b[0] - a[1] > 4 for a, b in zip(whole, whole[1:]))


def test_idle_source_closes_its_bursts(spark, tmp_path):
    write_changes(tmp_path / "changes", "1.json", [*CASES, ("notes.md", 0)])
    run = start(spark, tmp_path, 1.0)
    try:
        got = until(spark, tmp_path / "out", lambda rows: sum(r.n for r in rows) == len(CASES))
    finally:
        run.stop()
    want = bursts(changes.sessions(events(spark, CASES), 1.0))
    assert sorted((r.path, r.first_ts, r.last_ts, r.n) for r in got) == want


def test_changes_out_of_order_over_batches_are_all_kept(spark, tmp_path):
    newer = [("a.js", 100), ("b.js", 100), ("b.js", 100.5), ("c.js", 900)]
    older = [("a.js", 99.5), ("a.js", 0), ("b.js", 101), ("d.js", 1)]
    write_changes(tmp_path / "changes", "1.json", newer)
    run = start(spark, tmp_path, 15.0)
    try:
        # the second file comes as a batch of its own, while the first one's bursts are open
        stop = time.time() + 60
        while time.time() < stop and not any(p["numInputRows"] for p in run.recentProgress):
            time.sleep(0.5)
        write_changes(tmp_path / "changes", "2.json", older)
        got = until(spark, tmp_path / "out", lambda rows: sum(r.n for r in rows) >= 8)
        # a change that comes when its burst is gone makes one of its own
        write_changes(tmp_path / "changes", "3.json", [("a.js", 100.2)])
        got = until(spark, tmp_path / "out", lambda rows: sum(r.n for r in rows) >= 9)
    finally:
        run.stop()
    want = bursts(changes.sessions(events(spark, newer + older), 1.0))
    late = bursts(events(spark, [("a.js", 100.2)]).selectExpr("path", "ts AS first_ts", "ts AS last_ts", "1L AS n"))
    assert sorted((r.path, r.first_ts, r.last_ts, r.n) for r in got) == sorted(want + late)


class _Bucket:
    """The state of one bucket, with a clock set by hand."""

    held = timeout = None
    now = 0

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)
    hasTimedOut = property(lambda self: self.timeout is not None and self.timeout < self.now)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.held = value

    def setTimeoutDuration(self, ms):
        self.timeout = self.now + ms

    def remove(self):
        self.held = self.timeout = None


def test_files_of_a_bucket_keep_their_own_times(monkeypatch):
    monkeypatch.setattr(debounce, "_MERGED_ROWS", 3)
    draw, state, step = random.Random(3), _Bucket(), debounce._debounced(4, 100)
    columns = ["path", "first", "last", "n", "last_event", "bucket"]
    waiting, came, got, want = {}, {}, [], []
    for now in range(0, 6000, 30):
        state.now = now
        rows = [(draw.choice("abcde"), t, t, 1, draw.choice(["x", "y", None]), 0)
                for t in (draw.randrange(60) for _ in range(draw.randrange(9) if now < 5000 and draw.random() < 0.3 else 0))]
        for path, *part, _ in rows:
            waiting.setdefault(path, []).append(tuple(part))
            came[path] = now
        if rows or state.hasTimedOut:
            timed_out = state.hasTimedOut and not rows
            if not timed_out:
                state.timeout = None
            batches = [] if timed_out else [pd.DataFrame(rows[:2], columns=columns), pd.DataFrame(rows[2:], columns=columns)]
            for out in step((0,), iter(b for b in batches if len(b)), state):
                got += [(now, *r) for r in out[["path", "first", "last", "n"]].itertuples(index=False, name=None)]
            for path in [p for p in waiting if came[p] + 100 <= now]:
                want += [(now, path, *b[:3]) for b in debounce.merged(waiting.pop(path), 4)]
    assert not waiting and state.held is None
    assert len({r[0] for r in got}) > 10 and sorted(got) == sorted(want)


def test_state_grows_with_buckets_not_with_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(debounce, "BUCKETS", 4)
    rows = [(f"f{k}.js", t) for k in range(40) for t in (0, 0.5, 100)]
    write_changes(tmp_path / "changes", "1.json", rows)
    run = start(spark, tmp_path, 1.0)
    try:
        got = until(spark, tmp_path / "out", lambda found: sum(r.n for r in found) >= len(rows))
        held = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    finally:
        run.stop()
    assert 0 < max(held) <= 4
    assert sorted((r.path, r.first_ts, r.last_ts, r.n) for r in got) == bursts(changes.sessions(events(spark, rows), 1.0))


def test_changes_without_file_or_time_are_not_waited_for(spark, tmp_path):
    def late(*_):
        raise TimeoutError("the query waits for changes that no burst has")

    spark.sql("""SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00', 7L, 'view', 1.0D, ''),
        (2L, timestamp'2024-01-01 00:10:00', 7L, NULL, 1.0D, ''), (3L, timestamp'2024-01-01 00:00:00', NULL, 'view', 1.0D, ''),
        (4L, NULL, 7L, 'view', 1.0D, '') AS e(event_id, ts, user_id, event_type, value, props)""").toPandas().convert_dtypes().to_parquet(
        tmp_path / "events.parquet", coerce_timestamps="us")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(120)
    try:
        got = spark_queries.stream_debounce_live(spark, str(tmp_path)).collect()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert [r.n for r in got] == [2]
