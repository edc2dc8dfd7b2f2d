"""The continuous monitor: debounced changes -> analysis of the changed files -> analysis log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from codewarden.operators import learn
from codewarden.plans import analysis
from codewarden.schemas import ANALYSIS_LOG
from codewarden.sources.analysis_log import AnalysisLog
from codewarden.sources.file_table import FileTable


def checkpoint_root(spark: SparkSession, default: str | None = None) -> str:
    """Shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``, else ``default``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or default
    if root is None:
        raise ValueError("set spark.checkpoint.dir, or pass a folder all executors can reach")
    return root.rstrip("/")


def changed_files(files: DataFrame | FileTable, sessions: DataFrame) -> DataFrame:
    """Files named in a batch of sessions. A file table opens their buckets only; a plain table is scanned.

    Changed files often stand together in the table, so they are dealt out by path before they are analysed.
    """
    if isinstance(files, FileTable):
        return files.select(sessions)
    return files.join(sessions.select("path").distinct(), "path", "left_semi").repartition("path")


def analyze_sessions(
    sessions: DataFrame, files: DataFrame, rules: DataFrame | None = None,
    exceptions: DataFrame | None = None, learned: DataFrame | None = None, **options,
) -> DataFrame:
    """Analysis-log rows of a finished set of sessions: every changed file is analysed once, then
    joined to its sessions. Sessions of files that do not exist are skipped."""
    analyzed = analysis.analyze(
        learn.with_profile(files, learned), rules, exceptions,
        drift_detection=learned is not None, **options,
    )
    # the entry of a file is made once, however many sessions it has
    entries = analysis.as_events(analyzed, "cast(NULL AS timestamp)")
    ends = sessions.select(F.col("path").alias("file"), F.col("session_end").alias("ts"))
    return ends.join(entries.drop("ts"), "file").select(*entries.columns)


class Lifecycle(StreamingQueryListener):
    """Writes down when the monitor of a log starts, stops and fails."""

    def __init__(self, log: AnalysisLog, spark: SparkSession):
        self.log, self.spark = log, spark
        self.run_id: str | None = None

    def _add(self, event: str, detail: str | None) -> None:
        self.log.add_lifecycle(self.spark, event, dt.datetime.now(dt.timezone.utc), detail)

    def onQueryStarted(self, event) -> None:
        # called while the query is being started, whose name says which log it writes
        if event.name == query_name(self.log):
            self.run_id = str(event.runId)
            self._add("monitor_started", self.run_id)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self._add("monitor_failed" if event.exception else "monitor_stopped", event.exception or self.run_id)
            self.run_id = None
            self.spark.streams.removeListener(self)


def query_name(log: AnalysisLog) -> str:
    return f"monitor of {log.root}"


def start_monitor(
    sessions: DataFrame,
    files: FileTable | Callable[[SparkSession], DataFrame],
    log_path: str,
    checkpoint: str,
    rules: Callable[[SparkSession], DataFrame] | None = None,
    exceptions: Callable[[SparkSession], DataFrame] | None = None,
    learned: Callable[[SparkSession], DataFrame | None] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Analyse each finished burst and append it to the log (:class:`AnalysisLog`), with starts and stops.

    A file table is read in the buckets of the changed files; ``files`` may also be a callable, whose table
    is scanned per batch. Rules, exceptions and profile are callables, read anew per batch so that edits take
    effect. A batch replaces its own entries and summary, so one repeated after a failure leaves no duplicates.
    """

    bursts, log, spark = f"{checkpoint}/bursts", AnalysisLog(log_path), sessions.sparkSession

    def analyze_batch(batch: DataFrame, batch_id: int) -> None:
        # the bursts are used several times below; written down, they are read back instead of recomputed
        batch.write.mode("overwrite").parquet(f"{bursts}/batch={batch_id}")
        spark = batch.sparkSession
        finished = spark.read.schema(sessions.schema).parquet(f"{bursts}/batch={batch_id}")
        source = files if isinstance(files, FileTable) else files(spark)
        events = analyze_sessions(
            finished, changed_files(source, finished),
            rules(spark) if rules else None, exceptions(spark) if exceptions else None,
            learned(spark) if learned else None, **options,
        )
        log.write_batch(events, batch_id)

    spark.streams.addListener(Lifecycle(log, spark))
    writer = sessions.writeStream.foreachBatch(analyze_batch).option("checkpointLocation", checkpoint)
    return writer.queryName(query_name(log)).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_monitor_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The entries written by :func:`start_monitor`."""
    return AnalysisLog(log_path).entries(spark)


def with_lifecycle(log: DataFrame) -> DataFrame:
    """Add the monitor's own events: started with the first entry, stopped a second after the last.

    For logs rebuilt in batch; a live monitor's starts and stops are written by :class:`Lifecycle`.
    """
    bounds = log.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where("first IS NOT NULL")
    rows = bounds.selectExpr(
        "inline(array(named_struct('event', 'monitor_started', 'ts', first), "
        "named_struct('event', 'monitor_stopped', 'ts', last + INTERVAL 1 SECOND)))"
    )
    return log.unionByName(rows, allowMissingColumns=True)


def lifecycle_event(spark: SparkSession, event: str, ts) -> DataFrame:
    """A monitor_started / monitor_stopped row in the log's schema."""
    schema = T.StructType.fromDDL(ANALYSIS_LOG)
    return spark.createDataFrame([{"event": event, "ts": ts}], schema)


def running_stats(log_stream: DataFrame) -> DataFrame:
    """Counters over a streamed log, for ``update`` or ``complete`` mode."""
    analyzed = "event = 'file_analyzed'"
    return log_stream.groupBy().agg(
        F.count_if(F.expr(analyzed)).alias("changes_detected"),
        F.expr(f"coalesce(sum(summary.totalIssues) FILTER (WHERE {analyzed}), 0)").alias("violations_found"),
        F.count_if(F.expr(f"{analyzed} AND coalesce(ai.isLikelyAI, false)")).alias("ai_code_detected"),
    )
