"""The merged analysis of a file: AI detection, audit, drift and rules in one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import scoring
from codewarden.functions.sql import keep, q
from codewarden.operators import ai_audit, ai_detect, drift, org_rules
from codewarden.schemas import LOG_VIOLATIONS, NO_VIOLATIONS, VIOLATION, VIOLATION_FIELDS

# Insights.
INSIGHT_AI = "AI-generated code detected"
DRIFT_LIMIT = 80


def _audit_by_file(files, sections, responses) -> DataFrame:
    """path -> audit violations, most severe first, as one array per likely-AI file."""
    rows = ai_audit.violations(ai_audit.findings(files, sections, responses))
    return rows.groupBy("path").agg(
        F.expr("transform(array_sort(collect_list(struct(seq, "
               f"named_struct({', '.join(f'{q(f)}, {f}' for f in VIOLATION_FIELDS)}) AS v))), x -> x.v)")
        .alias("audit")
    )


def analyze(
    files: DataFrame, rules: DataFrame | None = None, exceptions: DataFrame | None = None,
    sections: DataFrame | None = None, responses: DataFrame | None = None,
    ai: bool = True, drift_detection: bool = True, keep_cols=("path",),
) -> DataFrame:
    """files(path, content, profile) -> kept columns, violations, insights, ai, drift_score.

    Parts switched off are not in the plan at all. Without sections, model responses and per-file
    exceptions everything happens in the file's row; what joins in later never carries contents.
    """
    steps = files
    columns = [*keep_cols]
    if ai:
        placeholder_only = ai_audit.candidates([ai_audit.PLACEHOLDERS])
        steps = steps.selectExpr(*_plus(keep_cols, "path", "content", "profile"), f"{ai_detect.counts()} AS counts")
        columns += ["counts"]
        if sections is None and responses is None:
            steps = steps.selectExpr("*", f"{ai_detect.confidence('counts')} AS confidence")
            placed = f"transform({placeholder_only}, c -> c.v)"
            columns += [
                "confidence",
                f"if(confidence >= {q(scoring.LIKELY_AI)}, {placed}, {NO_VIOLATIONS}) AS audit",
            ]
    if drift_detection:
        columns += [f"if(profile IS NULL, NULL, {drift.all_violations()}) AS drifted"]
    if rules is not None:
        active = None if exceptions is None else org_rules.active_exceptions(exceptions)
        checked = org_rules.rule_violations(
            steps, rules, active, keep_cols=[*columns] if "path" in keep_cols else [*columns, "path"]
        )
        steps = checked if active is None else org_rules.suppress(checked, active)
        steps = steps.withColumnRenamed("violations", "ruled")
    else:
        steps = steps.selectExpr(*columns)

    if ai and (sections is not None or responses is not None):
        if responses is None:
            steps = steps.selectExpr("*", f"{ai_detect.confidence('counts')} AS confidence")
        else:
            detected = ai_detect.detect(files, responses).select("path", "confidence")
            steps = steps.join(detected, "path")
        steps = steps.join(_audit_by_file(files, sections, responses), "path", "left")

    parts = []
    if ai:
        parts.append(f"coalesce(audit, {NO_VIOLATIONS})")
    if drift_detection:
        parts.append(f"coalesce({keep('drifted', lambda v: f'{v}.severity <> {q('info')}')}, {NO_VIOLATIONS})")
    if rules is not None:
        parts.append("ruled")
    merged = f"cast(concat({', '.join(parts + [NO_VIOLATIONS])}) AS array<{VIOLATION}>)"
    score = scoring.drift_score("drifted") if drift_detection else "cast(NULL AS double)"
    conf = "confidence" if ai else "cast(NULL AS double)"
    scored = steps.selectExpr(
        *keep_cols, f"{merged} AS violations", f"{conf} AS confidence", f"{score} AS drift_score"
    )
    insights = (
        f"filter(array(if(confidence >= {q(scoring.LIKELY_AI)}, {q(INSIGHT_AI)}, NULL), "
        f"if(drift_score < {DRIFT_LIMIT}, concat('Code drift detected (', cast(drift_score AS int), "
        "'/100 compliance)'), NULL)), i -> i IS NOT NULL)"
    )
    return scored.selectExpr(
        *keep_cols, "violations", f"{insights} AS insights",
        f"if(confidence IS NULL, NULL, named_struct('isLikelyAI', confidence >= {q(scoring.LIKELY_AI)}, "
        "'confidence', confidence)) AS ai",
        "drift_score",
    )


def check_snippets(
    files: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, keep_cols=("path",)
) -> DataFrame:
    """Rules and AI detection of submitted code in one pass: violations, score, confidence, advice."""
    counted = files.selectExpr(*_plus(keep_cols, "path", "content", "profile"), f"{ai_detect.counts()} AS counts")
    rated = counted.selectExpr("*", f"{ai_detect.confidence('counts')} AS confidence")
    total = " + ".join(f"counts.{t}" for t in ai_detect.TYPES)
    active = None if exceptions is None else org_rules.active_exceptions(exceptions)
    checked = org_rules.rule_violations(
        rated, rules, active, keep_cols=(*_plus(keep_cols, "path", "profile"), "counts", "confidence")
    )
    if active is not None:
        checked = org_rules.suppress(checked, active)
    return checked.selectExpr(
        *_plus(keep_cols, "path", "profile"), "violations", f"{scoring.rule_score('violations')} AS score",
        f"cast({total} AS int) AS n_indicators", "confidence",
        f"confidence >= {q(scoring.LIKELY_AI)} AS is_likely_ai", f"{scoring.advice('confidence')} AS recommendation",
    )


def _plus(columns, *more):
    return [*columns, *[m for m in more if m not in columns]]


def summarize(analyzed: DataFrame) -> DataFrame:
    """Add ``summary``: any violations, any insights, number of issues, highest severity."""
    return analyzed.withColumn("summary", F.expr(
        "named_struct('hasViolations', size(violations) > 0, 'hasInsights', size(insights) > 0, "
        f"'totalIssues', size(violations), 'severity', {scoring.highest_severity('violations')})"
    ))


def noteworthy(analyzed: DataFrame) -> DataFrame:
    """Only files with violations or insights."""
    return analyzed.where("size(violations) > 0 OR size(insights) > 0")


def as_events(analyzed: DataFrame, ts: str = "ts") -> DataFrame:
    """Analysis-log rows: slim violations, summary, event name."""
    slim = "transform(violations, v -> named_struct('rule', v.rule, 'category', v.category, " \
           "'severity', v.severity, 'message', v.message, 'line', v.line))"
    return summarize(analyzed).selectExpr(
        "'file_analyzed' AS event", "path AS file", f"{ts} AS ts",
        f"cast({slim} AS {LOG_VIOLATIONS}) AS violations", "insights", "ai", "drift_score AS driftScore",
        "summary",
    )


def group_by_severity(violations: str) -> str:
    """SQL text: struct with one array per severity; unknown severities count as info."""
    level = "lower(coalesce(v.severity, 'info'))"
    known = ", ".join(q(s) for s in scoring.SEVERITIES[:-1])
    groups = [f"'{s}', filter({violations}, v -> {level} = '{s}')" for s in scoring.SEVERITIES[:-1]]
    groups.append(f"'info', filter({violations}, v -> {level} NOT IN ({known}))")
    return f"named_struct({', '.join(groups)})"
