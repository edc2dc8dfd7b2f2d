"""Analysis log: sinks, tolerant reading, retention and text renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.functions import text
from codewarden.functions.sql import case, keep, q
from codewarden.schemas import ANALYSIS_LOG
from codewarden.sources import storage

# Default retention, layout of the text logs and their severity markers.
DAYS_KEPT = 7
MARKERS = {"critical": "🔥", "high": "🚨", "medium": "⚠️", "low": "💡", "info": "ℹ️"}
UNKNOWN_MARKER = "❓"

# Microseconds, so that a timestamp survives the round trip.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def with_date(log: DataFrame) -> DataFrame:
    return log.withColumn("date", F.to_date("ts"))


def append_log(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append analysis events, one folder per day."""
    with_date(log).write.mode("append").partitionBy("date").format(fmt).save(path)


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The log with its ``date`` partition column; filters on it prune folders."""
    schema = T.StructType.fromDDL(ANALYSIS_LOG).add("date", T.DateType())
    return spark.read.schema(schema).format(fmt).load(path)


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines -> log rows; lines that do not parse are dropped."""
    schema = T.StructType.fromDDL(ANALYSIS_LOG).add("_bad", T.StringType())
    parsed = lines.select(
        F.from_json(F.col(column), schema, {**_JSON, "columnNameOfCorruptRecord": "_bad"}).alias("e")
    )
    return parsed.where("e IS NOT NULL AND e._bad IS NULL AND e.event IS NOT NULL").select("e.*").drop("_bad")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def to_json_lines(log: DataFrame) -> DataFrame:
    return log.select(F.to_json(F.struct("*"), _JSON).alias("value"))


def slim_entries(log: DataFrame) -> DataFrame:
    """The compact log: counts per analyzed file and its violations when there are any."""
    return log.where("event = 'file_analyzed'").selectExpr(
        "ts AS timestamp", "file",
        "named_struct('violations', size(violations), 'insights', size(insights), 'aiDetected', "
        "coalesce(ai.isLikelyAI, false), 'driftScore', driftScore) AS summary",
        "if(size(violations) > 0, violations, NULL) AS violations",
    )


def retained(log: DataFrame, today, days: int = DAYS_KEPT) -> DataFrame:
    """Log rows not older than ``days`` before ``today``; on a partitioned log whole folders drop out."""
    if "date" not in log.columns:
        log = with_date(log)
    return log.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days))


def drop_expired(spark: SparkSession, path: str, today, days: int = DAYS_KEPT, fmt: str = "parquet") -> DataFrame:
    """Delete expired days of a partitioned log through the file system of its path; returns the rest."""
    log = read_log(spark, path, fmt)
    cutoff = F.date_sub(F.lit(today).cast("date"), days)
    # one value per expired folder: bounded by the days logged, not by the rows
    expired = [r["date"] for r in log.where(F.col("date") < cutoff).select("date").distinct().collect()]
    for day in expired:
        storage.delete(spark, f"{path}/date={day}")
    return read_log(spark, path, fmt)


def marker(severity: str) -> str:
    level = f"lower({severity})"
    return case([(f"{level} = '{s}'", q(m)) for s, m in MARKERS.items()], q(UNKNOWN_MARKER))


def daily_lines(log: DataFrame) -> DataFrame:
    """date, line: time, file, number of violations and severity in fixed columns."""
    name = f"coalesce({text.basename('file')}, 'unknown')"
    pad = lambda s, n: f"if(length({s}) >= {n}, {s}, rpad({s}, {n}, ' '))"
    issues = "cast(coalesce(summary.totalIssues, 0) AS string)"
    severity = "coalesce(summary.severity, 'info')"
    line = (
        f"concat(date_format(ts, 'HH:mm:ss'), ' | ', {pad(name, 25)}, ' | ', "
        f"if(length({issues}) >= 3, {issues}, lpad({issues}, 3, ' ')), ' violations | ', "
        f"{pad(severity, 8)}, ' ', if(coalesce(summary.hasInsights, false), '[AI]', ''))"
    )
    return log.selectExpr("to_date(ts) AS date", "ts", "file", f"{line} AS line")


def context_entries(log: DataFrame) -> DataFrame:
    """ts, file, entry: a readable block per event."""
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    listed = (
        "flatten(transform(violations, (v, i) -> filter(array(concat('   ', i + 1, '. ', "
        f"{marker('v.severity')}, ' [', upper(v.severity), '] ', v.message), "
        "if(v.line IS NULL, NULL, concat('      📍 Line ', v.line, ' | Rule: ', coalesce(v.rule, 'unknown')))), "
        "x -> x IS NOT NULL)))"
    )
    insights = "transform(insights, (t, i) -> concat('   ', i + 1, '. ', t))"
    none = "cast(array() AS array<string>)"
    parts = [
        f"array(concat('📅 TIMESTAMP: ', {iso}), concat('🎯 EVENT: ', coalesce(event, 'unknown')))",
        f"if(file IS NULL, {none}, array(concat('📁 FILE: ', file)))",
        f"if(summary IS NULL, {none}, array('📊 SUMMARY:', concat('   • Violations: ', "
        "coalesce(summary.totalIssues, 0)), concat('   • Severity: ', coalesce(summary.severity, 'info')), "
        "concat('   • AI Detected: ', if(summary.hasInsights, 'YES', 'NO'))))",
        f"if(coalesce(size(violations), 0) > 0, concat(array('🚨 VIOLATIONS:'), {listed}), {none})",
        f"if(coalesce(ai.isLikelyAI, false), array('🤖 AI CODE DETECTED:', concat('   • Confidence: ', "
        f"format_number(ai.confidence * 100, 1), '%')), {none})",
        f"if(coalesce(size(insights), 0) > 0, concat(array('💡 INSIGHTS:'), {insights}), {none})",
    ]
    return log.selectExpr("ts", "file", f"array_join(concat({', '.join(parts)}), '\\n') AS entry")


def violation_reports(analyzed: DataFrame) -> DataFrame:
    """path, entry: a file's violations grouped by severity; files without any are left out.

    Needs the full violations (column, suggestion), as :func:`codewarden.plans.analysis.analyze` gives.
    """
    block = (
        "(v, i) -> array_join(filter(array(concat(i + 1, '. ', v.message), "
        "if(v.line IS NULL, NULL, concat('   📍 Line ', v.line, ', Column ', coalesce(cast(v.col AS string), 'N/A'))), "
        "if(v.rule IS NULL, NULL, concat('   📋 Rule: ', v.rule, ' (', coalesce(v.category, 'general'), ')')), "
        "if(v.suggestion IS NULL, NULL, concat('   💡 Suggestion: ', v.suggestion)), ''), x -> x IS NOT NULL), '\\n')"
    )
    groups = []
    for s, m in MARKERS.items():
        found = keep("violations", lambda v, s=s: f"{v}.severity = '{s}'")
        head = f"concat('\\n{m} {s.upper()} SEVERITY (', size({found}), ' issues):')"
        groups.append(
            f"if(size({found}) > 0, concat(array({head}, repeat('-', 50)), transform({found}, {block})), "
            "cast(array() AS array<string>))"
        )
    rule = "repeat('=', 100)"
    lines = (
        f"concat(array({rule}, 'VIOLATIONS REPORT', concat('FILE: ', path), "
        f"concat('TOTAL VIOLATIONS: ', size(violations)), {rule}), {', '.join(groups)}, array({rule}))"
    )
    return analyzed.where("size(violations) > 0").selectExpr("path", f"array_join({lines}, '\\n') AS entry")


def write_text_log(entries: DataFrame, path: str, column: str, batch: int | None = None) -> None:
    """Append a text rendering; entries with a ``date`` go to one folder per day.

    Spark moves a task's lines into place when the task is committed, so a task that is repeated leaves none twice.
    With ``batch`` the lines go to a folder of their own, and writing the batch again replaces them.
    """
    rows = entries.select(*[c for c in ("date",) if c in entries.columns], F.col(column).alias("value"))
    if batch is not None:
        rows = rows.withColumn("batch", F.lit(batch))
    folders = [c for c in rows.columns if c != "value"]
    writer = rows.write.mode("append" if batch is None else "overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*folders) if folders else writer).text(path)


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text log, with its folders as columns."""
    return spark.read.text(path)


def summary_report(stats: DataFrame, files_watched: int | None = None) -> DataFrame:
    """One row of text from the monitor's counters."""
    watched = "0" if files_watched is None else str(int(files_watched))
    rule = "repeat('*', 80)"
    lines = (
        f"array({rule}, '📊 MONITORING SUMMARY', {rule}, concat('📁 Files Watched: ', {watched}), "
        "concat('🔄 Changes Detected: ', changes_detected), "
        "concat('🚨 Violations Found: ', violations_found), "
        "concat('🤖 AI Code Detected: ', ai_code_detected), "
        f"if(uptime_seconds IS NULL, NULL, concat('⏳ Uptime: ', uptime_seconds, ' seconds')), {rule})"
    )
    return stats.selectExpr(f"array_join({lines}, '\\n') AS entry")
