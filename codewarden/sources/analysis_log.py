"""The analysis log as a table that micro-batches write and readers prune.

``entries/date=.../batch=...`` has the entries, ``summary/batch=...`` what each batch adds to the daily counts,
``lifecycle`` the starts and stops of monitors. Each batch replaces its own folders, so a repeated batch
counts once. Trends and counters read summaries only, a few rows per batch and day, and recent entries
the folders of the last days that have enough of them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.schemas import ANALYSIS_LOG, LOG_VIOLATIONS
from codewarden.sources import storage
from codewarden.sources.logs import with_date

#: Rows without severity count entries, rows with one the violations of that severity.
SUMMARY = "date date, severity string, n long, issues long, ai long, first_ts timestamp, last_ts timestamp"
LIFECYCLE = "event string, ts timestamp, detail string"
_NO_ENTRIES = f"cast(array() AS {LOG_VIOLATIONS})"


def summarize(entries: DataFrame) -> DataFrame:
    """What entries add to the daily counts (SUMMARY): few rows, summed before they are shuffled."""
    analyzed = with_date(entries.where("event = 'file_analyzed'"))
    files = analyzed.groupBy("date").agg(
        F.count("*").alias("n"), F.sum("summary.totalIssues").cast("long").alias("issues"),
        F.count_if(F.expr("coalesce(ai.isLikelyAI, false)")).alias("ai"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    found = analyzed.select("date", F.expr(f"explode(concat(violations, {_NO_ENTRIES})) AS v"))
    severities = found.groupBy("date", F.col("v.severity").alias("severity")).agg(F.count("*").alias("n"))
    out = files.unionByName(severities, allowMissingColumns=True)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SUMMARY)])


@dataclass(frozen=True)
class AnalysisLog:
    root: str

    def write_batch(self, events: DataFrame, batch: int) -> None:
        """Add a batch's entries and its part of the daily counts; a second time replaces the first."""
        spark = events.sparkSession
        rows = with_date(events).withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(
            f"{self.root}/entries")
        # the entries are read back, not made again
        days = [d for d in storage.children(spark, f"{self.root}/entries")
                if d.startswith("date=") and storage.exists(spark, f"{self.root}/entries/{d}/batch={batch}")]
        written = self._read(spark, [f"{self.root}/entries/{d}/batch={batch}" for d in days])
        summarize(written).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/summary/batch={batch}")

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromDDL(ANALYSIS_LOG).add("date", T.DateType()).add("batch", T.LongType())
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.root}/entries").parquet(*folders)

    def entries(self, spark: SparkSession, since: dt.date | None = None) -> DataFrame:
        """All entries, or those from a day on; earlier days are not even listed."""
        days = [d for d in storage.children(spark, f"{self.root}/entries") if d.startswith("date=")]
        if since is not None:
            days = [d for d in days if d >= f"date={since.isoformat()}"]
        return self._read(spark, [f"{self.root}/entries/{d}" for d in days])

    def _summaries(self, spark: SparkSession) -> DataFrame:
        names = storage.children(spark, f"{self.root}/summary")
        upto = max((int(x.split("=")[1]) for x in names if x.startswith("upto=")), default=-1)
        wanted = [x for x in names if x == f"upto={upto}" or x.startswith("batch=") and int(x.split("=")[1]) > upto]
        if not wanted:
            return spark.createDataFrame([], SUMMARY)
        return spark.read.schema(SUMMARY).parquet(*[f"{self.root}/summary/{x}" for x in wanted])

    def daily(self, spark: SparkSession) -> DataFrame:
        """Counts per day (severity null), and violations per day and severity."""
        return self._summaries(spark).groupBy("date", "severity").agg(
            *[F.sum(c).alias(c) for c in ("n", "issues", "ai")], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    def compact_summary(self, spark: SparkSession) -> None:
        """Put the batches' summaries into one; those it covers are ignored from then on, and deleted."""
        names = storage.children(spark, f"{self.root}/summary")
        batches = [int(x.split("=")[1]) for x in names if x.startswith("batch=")]
        if not batches:
            return
        upto = max(batches)
        self.daily(spark).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/summary/upto={upto}")
        for x in names:
            storage.delete(spark, f"{self.root}/summary/{x}")

    def add_lifecycle(self, spark: SparkSession, event: str, ts: dt.datetime, detail: str | None = None) -> None:
        """A monitor_started, monitor_stopped or monitor_failed row."""
        spark.createDataFrame([(event, ts, detail)], LIFECYCLE).coalesce(1).write.mode("append").parquet(f"{self.root}/lifecycle")

    def lifecycle(self, spark: SparkSession) -> DataFrame:
        """Starts and stops: as many rows as the monitor was started and stopped."""
        if not storage.exists(spark, f"{self.root}/lifecycle"):
            return spark.createDataFrame([], LIFECYCLE)
        return spark.read.schema(LIFECYCLE).parquet(f"{self.root}/lifecycle")

    def recent(self, spark: SparkSession, n: int) -> DataFrame:
        """Entries and lifecycle rows of the last days that have ``n`` entries; the newest ``n`` are among them."""
        days = [(r["date"], r["n"]) for r in self.daily(spark).where("severity IS NULL").orderBy(F.desc("date")).collect()]
        since, seen = None, 0
        for day, count in days:
            since, seen = day, seen + count
            if seen >= n:
                break
        rows = self.entries(spark, since) if since else self._read(spark, [])
        return rows.unionByName(self.lifecycle(spark).select("event", "ts"), allowMissingColumns=True)

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row of counters: changes, violations, AI files, seconds from the first start to the last event."""
        files = self.daily(spark).where("severity IS NULL").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("changes_detected"), F.coalesce(F.sum("issues"), F.lit(0)).alias("violations_found"),
            F.coalesce(F.sum("ai"), F.lit(0)).alias("ai_code_detected"), F.max("last_ts").alias("last"))
        life = self.lifecycle(spark).agg(
            F.expr("min(ts) FILTER (WHERE event = 'monitor_started')").alias("started"), F.max("ts").alias("stopped"))
        # one row each
        start, stop = (life.select(c).scalar() for c in ("started", "stopped"))
        uptime = F.unix_seconds(F.greatest(F.col("last"), stop)) - F.unix_seconds(start)
        return files.select("changes_detected", "violations_found", "ai_code_detected", uptime.alias("uptime_seconds"))
