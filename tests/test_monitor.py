"""The file table, the written log, and a monitor that uses both."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from codewarden.operators import learn
from codewarden.plans import activity
from codewarden.schemas import ANALYSIS_LOG
from codewarden.sources import rules, storage
from codewarden.sources.analysis_log import AnalysisLog
from codewarden.sources.file_table import FileTable
from codewarden.streaming import changes, monitor
from tests.test_streaming import T0, at, write_changes
from verification import spark_queries

FILES = "path string, content string, size int"


def files(spark, n, text="content of"):
    return spark.range(n).selectExpr("concat('src/f', id, '.js') AS path", f"concat('{text} ', id) AS content", "cast(id AS int) AS size")


def paths(spark, *names):
    return spark.createDataFrame([(p,) for p in names], "path string")


def folders(df):
    """Bucket folders that a frame reads."""
    return {f.split("/bucket=")[1].split("/")[0] for f in df.inputFiles() if "/bucket=" in f}


def test_named_files_are_read_from_their_buckets_only(spark, tmp_path):
    table = FileTable.create(files(spark, 500), str(tmp_path / "t"), 64)
    assert FileTable.open(spark, str(tmp_path / "t")) == table
    got = table.select(paths(spark, "src/f7.js", "src/f7.js", "src/f400.js", "gone.js"))
    assert sorted((r.path, r.content, r.size) for r in got.collect()) == [
        ("src/f400.js", "content of 400", 400), ("src/f7.js", "content of 7", 7)]
    assert len(folders(got)) <= 3 and got.columns == ["path", "content", "size"]
    assert table.select(paths(spark)).collect() == []
    assert table.all(spark).count() == 500


def test_versions_replace_remove_and_repeat(spark, tmp_path):
    table = FileTable.create(files(spark, 60), str(tmp_path / "t"), 8)
    new = spark.createDataFrame([("src/f1.js", "new", 1), ("src/added.js", "more", 2)], FILES)
    for _ in range(2):
        table.put(new, 1)
        table.remove(paths(spark, "src/f2.js", "never.js"), 2)

    def check():
        got = {r.path: r.content for r in table.all(spark).collect()}
        assert len(got) == 60 and got["src/f1.js"] == "new" and got["src/added.js"] == "more" and "src/f2.js" not in got
        named = table.select(paths(spark, "src/f1.js", "src/f2.js", "src/f3.js", "src/added.js"))
        assert {r.path: r.content for r in named.collect()} == {"src/f1.js": "new", "src/f3.js": "content of 3", "src/added.js": "more"}

    check()
    table.compact(spark, 3)
    assert all(len(storage.children(spark, f"{table.root}/{b}")) == 1 for b in storage.children(spark, table.root) if b.startswith("bucket="))
    check()
    table.put(spark.createDataFrame([("src/f2.js", "back", 2)], FILES), 4)
    assert {r.content for r in table.select(paths(spark, "src/f2.js")).collect()} == {"back"}


def entry(day, name, severities, ai=False):
    found = [{"rule": "r", "category": "c", "severity": s, "message": "m", "line": 1} for s in severities]
    return {"event": "file_analyzed", "file": name, "ts": dt.datetime(2024, 1, day, 10), "violations": found, "insights": [],
            "ai": {"isLikelyAI": ai, "confidence": 0.5}, "driftScore": 90.0,
            "summary": {"hasViolations": bool(found), "hasInsights": False, "totalIssues": len(found), "severity": "high"}}


def test_log_counts_each_batch_once_and_reads_the_last_days(spark, tmp_path):
    log = AnalysisLog(str(tmp_path / "log"))
    assert log.entries(spark).collect() == [] and log.stats(spark).first().changes_detected == 0
    one = spark.createDataFrame([entry(1, "a.js", ["high", "low"]), entry(2, "b.js", [], True)], ANALYSIS_LOG)
    two = spark.createDataFrame([entry(d, f"f{d}.js", ["high"]) for d in range(2, 9)], ANALYSIS_LOG)
    log.write_batch(one, 0)
    for _ in range(2):
        log.write_batch(two, 1)
    assert log.entries(spark).count() == 9
    for _ in range(2):
        daily = {(str(r.date), r.severity): r.n for r in log.daily(spark).collect()}
        assert daily["2024-01-01", None] == 1 and daily["2024-01-01", "low"] == 1 and daily["2024-01-02", None] == 2
        assert daily["2024-01-02", "high"] == 1
        log.compact_summary(spark)
    log.write_batch(spark.createDataFrame([entry(9, "z.js", ["info"])], ANALYSIS_LOG), 2)
    log.add_lifecycle(spark, "monitor_started", dt.datetime(2024, 1, 1))
    log.add_lifecycle(spark, "monitor_stopped", dt.datetime(2024, 1, 9, 12))
    assert tuple(log.stats(spark).first()) == (10, 10, 1, 8 * 86400 + 12 * 3600)
    recent = log.recent(spark, 3)
    assert {f.split("/date=")[1].split("/")[0] for f in recent.inputFiles() if "/date=" in f} == {"2024-01-07", "2024-01-08", "2024-01-09"}
    assert [r.file for r in activity.last_entries(recent, 3).where("file IS NOT NULL").collect()] == ["z.js", "f8.js"]


CODE = [("a.js", "eval(x)"), ("b.js", "ok()"), *[(f"f{k}.js", f"let f{k} = {k}") for k in range(40)]]


def start(spark, tmp_path, table, trigger):
    stream = changes.stream_sessions(changes.read_changes(spark, str(tmp_path / "changes")), 1.0, "0 seconds")
    return monitor.start_monitor(
        stream, table, str(tmp_path / "log"), str(tmp_path / "cp"), rules=rules.initial_rules,
        learned=lambda s: s.read.parquet(str(tmp_path / "profile")), trigger=trigger)


def events_of(spark, log, n):
    stop = time.time() + 60
    while time.time() < stop and log.lifecycle(spark).count() < n:
        time.sleep(0.5)
    return [r.event for r in log.lifecycle(spark).orderBy("ts").collect()]


def test_monitor_reads_changed_buckets_and_writes_its_lifecycle(spark, tmp_path, monkeypatch):
    code = spark.createDataFrame(CODE, "path string, content string")
    learn.learn(code).write.parquet(str(tmp_path / "profile"))
    table, log = FileTable.create(code, str(tmp_path / "files"), 16), AnalysisLog(str(tmp_path / "log"))
    read = []
    plain = FileTable._read
    monkeypatch.setattr(FileTable, "_read", lambda self, s, f: read.append(f) or plain(self, s, f))

    write_changes(tmp_path / "changes", "1.json", [("a.js", 0), ("b.js", 0), ("b.js", 3), ("gone.js", 1), ("z.js", 50)])
    start(spark, tmp_path, table, {"availableNow": True}).awaitTermination(180)
    assert sorted(r.file for r in log.entries(spark).collect()) == ["a.js", "b.js", "b.js"]
    assert read and all(f is not None and len(f) <= 3 for f in read)
    assert events_of(spark, log, 2) == ["monitor_started", "monitor_stopped"]

    # a changed file is read in its new version, and entries are added once
    table.put(spark.createDataFrame([("b.js", "eval(y)")], "path string, content string"), 1)
    write_changes(tmp_path / "changes", "2.json", [("b.js", 60), *[(f"f{k}.js", 60 + k / 9) for k in range(30)], ("z.js", 200)])
    run = start(spark, tmp_path, table, {"processingTime": "1 second"})
    try:
        stop = time.time() + 120
        while time.time() < stop and log.stats(spark).first().changes_detected < 34:
            time.sleep(1)
        # more than twenty entries later, the start still counts; three starts and stops are among the last twenty
        status = activity.monitor_status(log.recent(spark, 20), log.lifecycle(spark)).first()
        assert status.is_running and status.files_analyzed == 20 - 3
    finally:
        run.stop()
    assert events_of(spark, log, 4) == ["monitor_started", "monitor_stopped"] * 2
    assert not activity.monitor_status(log.recent(spark, 20), log.lifecycle(spark)).first().is_running
    latest = log.entries(spark).where("file = 'b.js'").orderBy(F.desc("ts")).first()
    assert any("eval" in v.rule for v in latest.violations)
    assert log.stats(spark).first().changes_detected == 34


def test_failed_monitor_says_so(spark, tmp_path):
    write_changes(tmp_path / "changes", "1.json", [("a.js", 0), ("z.js", 50)])

    def broken(_):
        raise ValueError("no files")

    stream = changes.stream_sessions(changes.read_changes(spark, str(tmp_path / "changes")), 1.0, "0 seconds")
    run = monitor.start_monitor(stream, broken, str(tmp_path / "log"), str(tmp_path / "cp"), trigger={"availableNow": True})
    with pytest.raises(Exception, match="no files"):
        run.awaitTermination(120)
    log = AnalysisLog(str(tmp_path / "log"))
    assert events_of(spark, log, 2) == ["monitor_started", "monitor_failed"]


def test_status_lists_recent_activity(spark):
    rows = spark.createDataFrame([entry(d, f"f{d}.js", ["high"] * (d % 3), d == 9) for d in range(1, 28)], ANALYSIS_LOG)
    status = activity.monitor_status(rows, rows.sparkSession.createDataFrame([("monitor_started", T0)], "event string, ts timestamp")).first()
    assert [r.file for r in status.recent] == [f"f{d}.js" for d in range(18, 28)]
    assert status.recent[-1].total_issues == 0 and status.is_running and status.files_analyzed == 20
    assert at(0) == T0


def test_changed_files_that_stand_together_are_dealt_out(spark):
    table = files(spark, 400).coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = monitor.changed_files(table, table.where("size < 40").select("path"))
        assert got.count() == 40 and got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_written_log_learns_once(spark, tmp_path, monkeypatch):
    calls, profiled = [], learn.learn(files(spark, 20))
    monkeypatch.setattr(spark_queries, "learned", lambda s, d: calls.append(d) or profiled)
    monkeypatch.setattr(spark_queries, "_scratch", lambda s: str(tmp_path))
    monkeypatch.setattr(spark_queries, "files", lambda s, d, policy: files(s, 20))
    monkeypatch.setattr(spark_queries, "exceptions", lambda s, d: None)
    bursts = files(spark, 3).selectExpr("path", "timestamp '2024-01-01 00:00:00' AS session_end").union(
        files(spark, 1).selectExpr("path", "timestamp '2024-01-01 00:00:05'"))
    monkeypatch.setattr(spark_queries, "debounced", lambda s, d: bursts)
    assert spark_queries.saved_profile(spark, str(tmp_path)).collect() == profiled.collect()
    assert len(calls) == 1
    entries = spark_queries.written_log(spark, str(tmp_path)).entries(spark)
    assert sorted(r.file for r in entries.collect()) == ["src/f0.js", "src/f0.js", "src/f1.js", "src/f2.js"]
