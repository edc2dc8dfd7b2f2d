"""Queries over the analysis log: recent activity, status, file lookups, context, trends, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.functions import scoring, text
from codewarden.functions.sql import q
from codewarden.operators import org_rules
from codewarden.schemas import LOG_VIOLATIONS

# How far back the readers look, and their messages.
LAST_LINES = 20
LAST_EVENTS = 10
CONTEXT_EVENTS = 5
NOT_FOUND = "No recent analysis found for this file"
NOT_FOUND_HINT = "Make a change to the file to trigger analysis (ensure monitoring is running)"
AI_REVIEW_HINT = "Consider adding human review comments for AI-generated code"

# Keeps a generator's input from being a bare column; see explode_violations.
_NO_ENTRIES = f"cast(array() AS {LOG_VIOLATIONS})"


def last_entries(log: DataFrame, n: int = LAST_LINES) -> DataFrame:
    """The newest n log entries; a distributed top-n, nothing is sorted globally."""
    return log.orderBy(F.desc("ts"), F.desc("file"), F.desc("event")).limit(n)


def recent_analysis(log: DataFrame, limit: int = LAST_EVENTS) -> DataFrame:
    """Analysis events among the last ``limit`` entries, oldest first."""
    return last_entries(log, limit).where("event = 'file_analyzed'").orderBy("ts", "file")


def recent_activity(log: DataFrame, lines: int = LAST_LINES, events: int = LAST_EVENTS) -> DataFrame:
    """The last ``events`` analysis events among the last ``lines`` entries."""
    return last_entries(last_entries(log, lines).where("event = 'file_analyzed'"), events)


def recent_violations(log: DataFrame, limit: int = 10, severity: str | None = None) -> DataFrame:
    """Violations of the recent activity in order: the first ``limit``, with the total in each row."""
    rows = recent_activity(log).selectExpr("file", "ts", "posexplode(violations) AS (pos, v)").selectExpr(
        "file", "ts", "pos", "v.*"
    )
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy("ts", "file", "pos").limit(limit).withColumn("total", total)


def file_analysis(log: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested files with their first analysis in the recent activity, or a not-found row."""
    first = Window.partitionBy("file").orderBy("ts")
    recent = (
        recent_activity(log).withColumn("rn", F.row_number().over(first)).where("rn = 1")
        .selectExpr("file AS path", "ts AS last_analyzed", "summary.totalIssues AS total_issues",
                    "summary.severity AS severity")
    )
    # at most as many rows as the recent window holds, so this side may be broadcast
    return paths.join(F.broadcast(recent), "path", "left").selectExpr(
        "path", "last_analyzed", "total_issues", "severity",
        f"if(last_analyzed IS NULL, {q(NOT_FOUND)}, NULL) AS error",
        f"if(last_analyzed IS NULL, {q(NOT_FOUND_HINT)}, NULL) AS suggestion",
    )


def monitor_status(log: DataFrame, lifecycle: DataFrame | None = None, listed: int = LAST_EVENTS) -> DataFrame:
    """One row: running, last lifecycle event, counts over the last entries, and the last ``listed`` analyses.

    The latest start or stop counts however far back it lies, if ``lifecycle`` has them; else the last entries
    are searched. ``recent`` runs from the oldest to the newest.
    """
    entries = last_entries(log)
    analyzed = "event = 'file_analyzed'"
    changed = "event IN ('monitor_started', 'monitor_stopped', 'monitor_failed')"
    found = (entries if lifecycle is None else lifecycle).where(changed).agg(
        F.struct(F.max_by("event", "ts").alias("event"), F.max("ts").alias("ts")).alias("s")).scalar()
    # at most LAST_LINES structs
    lines = F.expr(
        "array_sort(collect_list(struct(ts, file, coalesce(summary.totalIssues, 0) AS total_issues, "
        "coalesce(summary.severity, 'info') AS severity, coalesce(summary.hasInsights, false) AS has_insights)) "
        f"FILTER (WHERE {analyzed}))")
    out = entries.agg(
        F.count_if(F.expr(analyzed)).alias("files_analyzed"),
        F.expr(f"coalesce(sum(summary.totalIssues) FILTER (WHERE {analyzed}), 0)").alias("total_violations"),
        F.count_if(F.expr(f"{analyzed} AND coalesce(ai.isLikelyAI, false)")).alias("ai_code_detected"),
        lines.alias("lines"),
    ).withColumn("life", found)
    return out.select(
        F.coalesce(F.col("life.event") == "monitor_started", F.lit(False)).alias("is_running"),
        F.col("life.ts").alias("last_update"), "files_analyzed", "total_violations", "ai_code_detected",
        F.expr(f"slice(lines, greatest(size(lines) - {listed - 1}, 1), {listed})").alias("recent"),
    )


def organization_context(
    log: DataFrame, learned: DataFrame, rules: DataFrame, events: int = CONTEXT_EVENTS
) -> DataFrame:
    """One row: profile summary, rule categories, latest activity."""
    categories = rules.agg(F.sort_array(F.collect_set("category")).alias("c")).scalar()
    latest = last_entries(recent_activity(log), events)
    activity = latest.agg(F.expr(
        "transform(array_sort(collect_list(struct(ts, file, summary.totalIssues AS issues))), "
        "x -> concat(x.file, ':', x.issues))"
    ).alias("a")).scalar()
    return learned.select(
        "confidence", F.col("recommendations.naming.variables").alias("variables"),
        F.col("recommendations.naming.functions").alias("functions"),
        F.col("recommendations.imports.style").alias("import_style"),
        F.col("recommendations.imports.extensions").alias("import_extensions"),
        categories.alias("categories"), activity.alias("recent_activity"),
    )


def improvements(checked: DataFrame, focus: str = "all") -> DataFrame:
    """path, suggestions: compliance advice, AI advice and profile hints, each once, in that order.

    Takes the result of :func:`codewarden.plans.analysis.check_snippets`; a missing profile gives no hints.
    """
    hints = []
    if focus in ("naming", "all"):
        naming = "profile.recommendations.naming"
        hints.append(f"concat('Project uses ', {naming}.variables, ' for variables and ', "
                     f"{naming}.functions, ' for functions')")
    if focus in ("imports", "all"):
        imports = "profile.recommendations.imports"
        hints.append(f"concat('Project prefers ', {imports}.style, ' imports and ', "
                     f"{imports}.extensions, ' file extensions')")
    ai = f"if(is_likely_ai, array(recommendation, {q(AI_REVIEW_HINT)}), array())"
    parts = [org_rules.recommendations("violations"), ai]
    if hints:
        parts.append(f"filter(array({', '.join(hints)}), h -> h IS NOT NULL)")
    return checked.selectExpr("path", f"array_distinct(concat({', '.join(parts)})) AS suggestions")


def monitor_stats(log: DataFrame) -> DataFrame:
    """One row: changes, violations, AI files, uptime in seconds (last event minus first start)."""
    analyzed = "event = 'file_analyzed'"
    return log.agg(
        F.count_if(F.expr(analyzed)).alias("changes_detected"),
        F.expr(f"coalesce(sum(summary.totalIssues) FILTER (WHERE {analyzed}), 0)").alias("violations_found"),
        F.count_if(F.expr(f"{analyzed} AND coalesce(ai.isLikelyAI, false)")).alias("ai_code_detected"),
        F.expr("unix_seconds(max(ts)) - unix_seconds(min(ts) FILTER (WHERE event = 'monitor_started'))")
        .alias("uptime_seconds"),
    )


def violation_trend(log: DataFrame) -> DataFrame:
    """Violations per day and severity with the previous day's count and a 7-row moving average.

    Aggregated before the window, so each window partition holds one row per day.
    """
    daily = (
        log.where("event = 'file_analyzed'")
        .selectExpr("to_date(ts) AS date", f"explode(concat(violations, {_NO_ENTRIES})) AS v")
        .groupBy("date", F.col("v.severity").alias("severity")).agg(F.count("*").alias("n"))
    )
    return trend_of_days(daily)


def trend_of_days(daily: DataFrame) -> DataFrame:
    """The same from counts per day and severity, as the log's daily summary has them."""
    by_day = Window.partitionBy("severity").orderBy("date")
    return daily.where("severity IS NOT NULL").select(
        "date", "severity", "n",
        (F.col("n") - F.lag("n").over(by_day)).alias("change"),
        F.avg("n").over(by_day.rowsBetween(-6, 0)).alias("moving_avg"),
    )


def ai_usage_by_folder(detected: DataFrame) -> DataFrame:
    """Files, AI files and AI share per folder and overall (folder null)."""
    return (
        detected.selectExpr(f"{text.dirname('path')} AS folder", "is_likely_ai")
        .rollup("folder")
        .agg(
            F.count("*").alias("files"), F.count_if("is_likely_ai").alias("ai_files"),
            F.round(F.avg(F.col("is_likely_ai").cast("double")) * 100, 1).alias("ai_percent"),
        )
    )


def dashboard(analyzed: DataFrame) -> DataFrame:
    """One row for the organization: files, violations by severity, AI files and their share."""
    per = [
        F.coalesce(F.sum(F.expr(f"size(filter(violations, v -> v.severity = '{s}'))")), F.lit(0)).alias(s)
        for s in scoring.SEVERITIES[:-1]
    ]
    return analyzed.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.expr("size(violations)")), F.lit(0)).alias("active_violations"), *per,
        F.count_if(F.expr("ai.isLikelyAI")).alias("ai_files"),
        F.round(F.avg(F.expr("cast(ai.isLikelyAI AS double)")) * 100, 1).alias("ai_percent"),
    )


def top_violations(violations: DataFrame, n: int | None = None) -> DataFrame:
    """Rules by number of violations; ``n`` keeps the leaders."""
    counted = violations.groupBy("rule").agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("files")
    )
    ordered = counted.orderBy(F.desc("n"), "rule")
    return ordered if n is None else ordered.limit(n)
