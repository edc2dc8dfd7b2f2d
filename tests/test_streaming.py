import datetime as dt
import json
import time

from pyspark.sql import functions as F

from codewarden.operators import learn
from codewarden.sources import rules
from codewarden.streaming import changes, monitor

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(p, at(s), "change") for p, s in rows], changes.CHANGES)


def bursts(df):
    return sorted((r.path, r.first_ts, r.last_ts, r.n) for r in df.collect())


CASES = [("a.js", 0), ("a.js", 0.5), ("a.js", 1.4), ("a.js", 5), ("a.js", 6), ("b.js", 0), ("b.js", 1.000001), ("b.js", 2.5)]


def test_bursts_and_events_exactly_one_gap_apart(spark):
    got = bursts(changes.sessions(events(spark, CASES), 1.0))
    window = (
        events(spark, CASES).groupBy("path", F.session_window("ts", "1 second").alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    )
    assert got == bursts(window)
    assert [g[3] for g in got] == [3, 2, 1, 1, 1]


def test_many_changes_of_one_file(spark):
    hot = spark.range(50_000).selectExpr(
        "if(id % 3 = 0, 'hot.js', concat('f', id % 997, '.js')) AS path",
        "timestamp_millis(1700000000000 + (id * 7919) % 3600000) AS ts", "'change' AS event_type")
    window = (
        hot.groupBy("path", F.session_window("ts", "1 second").alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    )
    assert bursts(changes.sessions(hot, 1.0)) == bursts(window)


def write_changes(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"path": p, "ts": at(s).isoformat() + "Z", "event_type": "change"}) for p, s in rows]
    (folder / name).write_text("\n".join(lines))


def test_stream_gives_the_closed_bursts(spark, tmp_path):
    source = tmp_path / "changes"
    write_changes(source, "1.json", [*CASES, ("notes.md", 0), ("z.js", 100)])
    stream = changes.stream_sessions(changes.read_changes(spark, str(source)), 1.0, "0 seconds")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option(
        "path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = bursts(spark.read.parquet(str(tmp_path / "out")))
    assert got == bursts(changes.sessions(events(spark, CASES), 1.0))


def run_sessions(stream, tmp_path):
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option(
        "path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(120)


def test_replay_closes_its_last_bursts(spark, tmp_path):
    source = tmp_path / "changes"
    write_changes(source, "1.json", CASES)
    replay = changes.with_end(changes.read_changes(spark, str(source)), str(tmp_path / "end"))
    run_sessions(changes.stream_sessions(replay, 1.0, "0 seconds"), tmp_path)
    got = bursts(spark.read.parquet(str(tmp_path / "out")))
    assert got == bursts(changes.sessions(events(spark, CASES), 1.0))


def test_late_changes_within_the_lateness_come_out(spark, tmp_path):
    source = tmp_path / "changes"
    for name, rows in [("1.json", [("a.js", 0), ("b.js", 30)]), ("2.json", [("late.js", 28), ("c.js", 31)]),
                       ("3.json", [("z.js", 500)])]:
        write_changes(source, name, rows)
        read = changes.read_changes(spark, str(source))
        run_sessions(changes.stream_sessions(read, 1.0, "60 seconds"), tmp_path)
    got = {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.js", "b.js", "late.js", "c.js"}


def test_clock_closes_the_last_burst_of_a_live_stream(spark, tmp_path):
    source, out = tmp_path / "changes", tmp_path / "out"
    source.mkdir()
    now = dt.datetime.now(dt.timezone.utc)
    (source / "1.json").write_text(json.dumps({"path": "a.js", "ts": now.isoformat(), "event_type": "change"}))
    live = changes.with_clock(changes.read_changes(spark, str(source)))
    run = changes.stream_sessions(live, 1.0, "0 seconds").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(processingTime="1 second").start()
    try:
        got, stop = [], time.time() + 90
        while not got and time.time() < stop:
            time.sleep(1)
            got = spark.read.schema(SESSION).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
    finally:
        run.stop()
    assert [(r.path, r.n) for r in got] == [("a.js", 1)]


SESSION = "path string, first_ts timestamp, last_ts timestamp, session_end timestamp, n long, last_event string"


def test_monitor_appends_each_burst_once(spark, tmp_path):
    source, log = tmp_path / "changes", str(tmp_path / "log")
    files = lambda s: s.createDataFrame([("a.js", "eval(x)"), ("b.js", "ok()")], "path string, content string")
    learned = learn.learn(files(spark))
    learned.write.parquet(str(tmp_path / "profile"))

    def run():
        stream = changes.stream_sessions(changes.read_changes(spark, str(source)), 1.0, "0 seconds")
        q = monitor.start_monitor(
            stream, files, log, str(tmp_path / "cp"), rules=rules.initial_rules,
            learned=lambda s: s.read.parquet(str(tmp_path / "profile")), trigger={"availableNow": True})
        q.awaitTermination(180)

    write_changes(source, "1.json", [*CASES, ("gone.js", 1), ("z.js", 50)])
    run()
    first = monitor.read_monitor_log(spark, log)
    assert first.count() == 5
    assert {r.file for r in first.collect()} == {"a.js", "b.js"}
    write_changes(source, "2.json", [("a.js", 60), ("z.js", 90)])
    run()
    assert monitor.read_monitor_log(spark, log).count() == 6
    run()
    assert monitor.read_monitor_log(spark, log).count() == 6
    stats = monitor.running_stats(monitor.read_monitor_log(spark, log)).first()
    assert stats.changes_detected == 6
    started = monitor.lifecycle_event(spark, "monitor_started", T0)
    assert monitor.read_monitor_log(spark, log).unionByName(started, allowMissingColumns=True).count() == 7


def test_checkpoint_folder_is_the_clusters(spark, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert monitor.checkpoint_root(spark, str(tmp_path)) == (configured or str(tmp_path)).rstrip("/")
