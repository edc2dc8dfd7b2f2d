"""The engine's operators as queries over the given tables, with flat result columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions import naming, scoring, text
from codewarden.functions.sql import q
from codewarden.operators import ai_audit, ai_detect, drift, learn, org_rules, registry, review
from codewarden.plans import activity, analysis
from codewarden.schemas import explode_violations
from codewarden.sources import code_files, corpus, logs, profile, storage
from codewarden.sources import rules as rule_source
from codewarden.sources.analysis_log import AnalysisLog
from codewarden.sources.file_table import FileTable
from codewarden.sources.learned_counts import LearnedCounts
from codewarden.streaming import changes, debounce, monitor

AS_OF = "2024-06-01"
GAP_SECONDS = 1800
#: Buckets of the monitor's file table: some 64 MB each at the sizes tested here.
FILE_BUCKETS = 8
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs -------------------------------------------------------------------------------------


def files(spark, d, policy="drift"):
    return code_files.select_code_files(corpus.code_files(spark, d), policy).select("path", "content")


def learned(spark, d):
    return learn.learn(files(spark, d, "learn"))


def profiled(spark, d, policy="drift"):
    return learn.with_profile(files(spark, d, policy), learned(spark, d))


def unprofiled(spark, d, policy="compliance"):
    return learn.with_profile(files(spark, d, policy), None)


def rules(spark):
    return rule_source.initial_rules(spark)


def exceptions(spark, d):
    return rule_source.normalise_exceptions(corpus.exceptions(spark, d))


def audit_sections(spark, d):
    return corpus.ai_sections(spark, d)


# --- scans and configuration --------------------------------------------------------------------


@query
def scan_code_files(spark, d):
    paths = corpus.code_files(spark, d).select("path")
    scans = [
        code_files.select_code_files(paths, p).selectExpr(f"{q(p)} AS policy", "path")
        for p in ("learn", "compliance", "drift", "watch")
    ]
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


@query
def scan_js_files(spark, d):
    return code_files.scan_js_files(corpus.code_files(spark, d)).select("path")


@query
def scan_file_cap(spark, d):
    """The learning command's file cap, which is its feature: the first 1000 paths."""
    paths = corpus.code_files(spark, d).select("path")
    return code_files.select_code_files(paths, "learn", max_files=1000)


@query
def scan_first_files(spark, d):
    """The learning command with a cap of 100 files: their paths and contents' lengths."""
    first = code_files.select_code_files(corpus.code_files(spark, d).select("path", "content"), "learn", max_files=100)
    return first.selectExpr("path", "length(content) AS n_chars")


@query
def watched_folders(spark, d):
    return code_files.watched_folders(files(spark, d, "watch"))


def _configs(spark, d):
    return rule_source.parse_config(corpus.rule_configs(spark, d), keep_cols=["doc_id"])


@query
def rules_flatten(spark, d):
    return rule_source.rules_of(_configs(spark, d), ["doc_id"]).selectExpr(
        "doc_id", "rule_id", "category", "name", "description", "severity", "enabled",
        "parameters['limit'] AS limit_param",
    )


@query
def rules_validate(spark, d):
    config = _configs(spark, d)
    flat = rule_source.rules_of(config, ["doc_id"])
    return rule_source.validate_config(config, ["doc_id"]).unionByName(
        rule_source.validate_rules(flat, ["doc_id"])
    )


@query
def rules_lookup(spark, d):
    flat = rule_source.rules_of(_configs(spark, d), ["doc_id"])
    enabled = rule_source.enabled_rules(rule_source.rules_by_category(flat, "security"))
    return enabled.select("doc_id", "rule_id", "severity")


@query
def rule_by_id(spark, d):
    flat = rule_source.rules_of(_configs(spark, d), ["doc_id"])
    return rule_source.rule_by_id(flat, "performance/no-sync-fs").select("doc_id", "rule_id", "severity", "enabled")


@query
def rules_history(spark, d):
    """A history row per configuration, with the number of rules that were loaded."""
    config = _configs(spark, d)
    flat = rule_source.rules_of(config, ["doc_id"])
    return rule_source.history_entry(config, flat, "2024-01-20 00:00:00")


@query
def registry_checks(spark, d):
    """User-defined checks beside the built-in ones: a SQL function and a table function."""
    rule_id = "custom/long-line"
    check = registry.sql_check(spark, "long_lines", "transform(filter(transform(split(content, '\\\\n', -1), (l, i) -> "
                               "named_struct('line', i + 1, 'n', length(l))), x -> x.n > 120), x -> "
                               "named_struct('line', x.line, 'message', concat('Line has ', x.n, ' characters')))")
    registry.register_rule(rule_id, "custom", "low", check)
    try:
        source = unprofiled(spark, d, "drift")
        found = org_rules.check(source, rules(spark).unionByName(registry.registered_rule_rows(spark)), only=[rule_id])
        rows = explode_violations(found).select("path", "rule", "line", "message")
    finally:
        registry.unregister_rule(rule_id)

    class TrailingBlanks:
        def eval(self, path: str, content: str):
            for k, line in enumerate(content.split("\n"), 1):
                if line.endswith(" "):
                    yield k, "Line ends in a blank"

    registry.table_check(spark, "trailing_blanks", TrailingBlanks)
    blanks = registry.table_rule(source, "trailing_blanks", "custom/trailing-blank", "custom", "info")
    return rows.unionByName(blanks.select("path", "rule", "line", "message"))


@query
def exceptions_normalised(spark, d):
    return exceptions(spark, d)


# --- organizational rules -----------------------------------------------------------------------

_RULE_COLUMNS = ["path", "seq", "rule", "category", "severity", "line", "message"]


def _rule_rows(spark, d, *only, profile=False):
    source = profiled(spark, d, "compliance") if profile else unprofiled(spark, d)
    return explode_violations(org_rules.check(source, rules(spark), only=only)).select(*_RULE_COLUMNS)


@query
def rule_no_eval(spark, d):
    return _rule_rows(spark, d, org_rules.NO_EVAL)


@query
def rule_dangerous_html(spark, d):
    return _rule_rows(spark, d, org_rules.NO_DANGEROUS_HTML)


@query
def rule_company_fetch(spark, d):
    return _rule_rows(spark, d, org_rules.COMPANY_FETCH)


@query
def rule_sync_fs(spark, d):
    return _rule_rows(spark, d, org_rules.NO_SYNC_FS)


@query
def rule_feature_folder(spark, d):
    return _rule_rows(spark, d, org_rules.FEATURE_FOLDERS)


@query
def rule_camelcase_vars(spark, d):
    return _rule_rows(spark, d, org_rules.CAMELCASE_VARIABLES, profile=True)


def checked(spark, d):
    return org_rules.check(
        profiled(spark, d, "compliance"), rules(spark), exceptions(spark, d), as_of=AS_OF
    )


@query
def exceptions_suppressed(spark, d):
    source = unprofiled(spark, d)
    kept = org_rules.check(source, rules(spark), exceptions(spark, d), as_of=AS_OF)
    return explode_violations(kept).select("path", "rule", "line", "message")


@query
def compliance_score(spark, d):
    return org_rules.compliance_by_file(checked(spark, d))


@query
def compliance_summary(spark, d):
    return org_rules.compliance_summary(checked(spark, d))


@query
def compliance_by_folder(spark, d):
    """The flagship: compliance per folder with severity counts and mean score."""
    per_file = org_rules.compliance_by_file(checked(spark, d))
    return per_file.withColumn("folder", F.expr(text.dirname("path"))).groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("n_violations").alias("violations"),
        *[F.sum(s).alias(s) for s in scoring.SEVERITIES[:-1]],
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


@query
def rule_recommendations(spark, d):
    listed = f"array_join({org_rules.recommendations('violations')}, '; ')"
    return checked(spark, d).selectExpr("path", f"{listed} AS recommendations")


@query
def rules_on_pages(spark, d):
    pages = learn.with_profile(corpus.pages_as_files(spark, d), None)
    only = [org_rules.NO_DANGEROUS_HTML, org_rules.NO_SYNC_FS, org_rules.NO_EVAL]
    return explode_violations(org_rules.check(pages, rules(spark), only=only)).select(*_RULE_COLUMNS)


@query
def missing_tests(spark, d):
    return org_rules.missing_tests(files(spark, d))


# --- functions ----------------------------------------------------------------------------------


@query
def path_functions(spark, d):
    return corpus.code_files(spark, d).selectExpr(
        "path", f"{text.basename('path')} AS base", f"{text.extname('path')} AS ext",
        f"{text.dirname('path')} AS folder", f"{text.stem('path')} AS stem",
        f"{text.expected_test_path('path')} AS expected_test",
        f"{text.in_feature_folder('path')} AS in_feature", f"{text.is_learner_test('path')} AS learner_test",
        f"{text.is_audit_test('path')} AS audit_test", f"{text.relative_to('path', 'src')} AS below_src",
    )


@query
def naming_style(spark, d):
    names = corpus.code_files(spark, d).selectExpr("path", f"{text.stem('path')} AS name")
    return names.selectExpr(
        "path", "name", f"{naming.naming_style('name', kebab=True)} AS drift_style",
        f"{naming.naming_style('name')} AS rule_style", f"{naming.file_style('name')} AS file_style",
    )


def _hits(source, hits, name):
    return source.selectExpr("path", f"posexplode({hits}) AS (i, h)").selectExpr(
        "path", "i", f"{name('h.text')} AS name", "h.line AS line", "h.col AS col"
    )


@query
def convert_naming(spark, d):
    names = _hits(files(spark, d), text.variables(), text.variable_name).select("name")
    stems = files(spark, d).selectExpr(f"{text.stem('path')} AS name")
    return names.union(stems).distinct().selectExpr(
        "name",
        *[f"{naming.convert_naming_style('name', q(t))} AS {c}" for c, t in [
            ("camel", "camelCase"), ("snake", "snake_case"), ("pascal", "PascalCase"),
            ("kebab", "kebab-case"), ("upper", "UPPER_CASE")]],
    )


@query
def extract_variables(spark, d):
    return _hits(files(spark, d), text.variables(), text.variable_name)


@query
def extract_functions(spark, d):
    source = files(spark, d)
    parts = [
        _hits(source, text.functions(k), lambda t, k=k: text.function_name(t, k))
        .selectExpr(f"{q(k)} AS dialect", "*")
        for k in text.FUNCTION
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def extract_constants(spark, d):
    return _hits(files(spark, d), text.constants(), text.constant_name)


@query
def extract_imports(spark, d):
    found = _hits(files(spark, d), text.imports(), text.import_path)
    return found.selectExpr(
        "path", "i", "name AS import_path", "line", f"{text.is_relative_import('name')} AS relative",
        f"{text.import_library('name')} AS library", f"{text.import_extension('name')} AS extension",
        f"{text.is_internal_import('name')} AS internal",
        f"{text.is_discouraged_import('name')} AS discouraged",
    )


@query
def export_styles(spark, d):
    return files(spark, d).selectExpr("path", f"coalesce({text.export_style('content')}, 'none') AS style")


@query
def comment_profile(spark, d):
    return files(spark, d).selectExpr("path", f"{text.comment_profile('content')} AS c").select("path", "c.*")


@query
def page_variables(spark, d):
    return _hits(corpus.pages_as_files(spark, d), text.variables(), text.variable_name)


@query
def page_comments(spark, d):
    pages = corpus.pages_as_files(spark, d)
    return pages.selectExpr("path", f"{text.comment_profile('content')} AS c").select("path", "c.*")


# --- learning -----------------------------------------------------------------------------------


def _counts(spark, d, section):
    return learn.pattern_counts(files(spark, d, "learn"), sections=[section])


@query
def learn_naming(spark, d):
    return _counts(spark, d, "naming")


@query
def learn_imports(spark, d):
    return _counts(spark, d, "imports")


@query
def learn_exports_folders(spark, d):
    return _counts(spark, d, "architecture")


@query
def learn_testing(spark, d):
    return _counts(spark, d, "testing")


@query
def learn_comments(spark, d):
    return _counts(spark, d, "comments")


def _profile_columns(profiles):
    r = "recommendations"
    return profiles.selectExpr(
        "confidence", f"{r}.naming.variables", f"{r}.naming.functions", f"{r}.naming.constants",
        f"{r}.naming.files", f"{r}.imports.style AS import_style",
        f"{r}.imports.extensions AS import_extensions",
        f"array_join({r}.imports.popularLibraries, ',') AS libraries",
        f"{r}.architecture.exportStyle AS export_style",
        f"array_join({r}.architecture.commonFolders, ',') AS folders",
        f"{r}.testing.fileNaming AS test_naming", f"{r}.testing.framework AS framework",
        f"{r}.comments.style AS comment_style", f"{r}.comments.density AS comment_density",
    )


@query
def learned_profile(spark, d):
    return _profile_columns(learned(spark, d))


@query
def profile_roundtrip(spark, d):
    """The learned profile, saved and loaded."""
    path = f"{_scratch(spark)}/profile"
    profile.save_profile(learned(spark, d), path)
    return _profile_columns(profile.load_profile(spark, path))


@query
def learned_incremental(spark, d):
    """The profile from counts that followed the change of every file named in the change stream."""
    source, out = files(spark, d, "learn"), _scratch(spark)
    edited = corpus.changes(spark, d).select("path").distinct()
    # before its change a file was something else
    before = source.join(edited.withColumn("edited", F.lit(True)), "path", "left").selectExpr(
        "path", "if(edited, concat('let old_name = 1; // ', upper(path)), content) AS content")
    table = FileTable.create(before, f"{out}/files", FILE_BUCKETS)
    counts = LearnedCounts(f"{out}/counts")
    counts.add(table.all(spark), 0)
    counts.follow(table, source.join(edited, "path", "left_semi"), 1)
    return _profile_columns(counts.profile(spark))


@query
def top_libraries(spark, d):
    return learn.top_keys(_counts(spark, d, "imports"), "libraries")


@query
def top_folders(spark, d):
    return learn.top_keys(_counts(spark, d, "architecture"), "folderStructure")


# --- drift --------------------------------------------------------------------------------------

_DRIFT_COLUMNS = ["path", "rule", "category", "severity", "line", "col", "message", "expected", "actual"]


def _drift_rows(spark, d, *detectors):
    found = drift.detect(profiled(spark, d), include_info=True, detectors=detectors)
    return explode_violations(found).select(*_DRIFT_COLUMNS, "suggestion")


@query
def drift_file_naming(spark, d):
    return _drift_rows(spark, d, "file_naming").drop("suggestion")


@query
def drift_naming(spark, d):
    return _drift_rows(spark, d, "variable_naming", "function_naming", "constant_naming")


@query
def drift_imports(spark, d):
    return _drift_rows(spark, d, "imports").drop("suggestion")


@query
def drift_folders(spark, d):
    return _drift_rows(spark, d, "folders").drop("suggestion")


@query
def drift_comments(spark, d):
    return _drift_rows(spark, d, "comments").drop("suggestion")


def drifted(spark, d, **options):
    return drift.detect(profiled(spark, d), **options)


@query
def drift_score(spark, d):
    return drifted(spark, d).selectExpr("path", "score", "size(violations) AS n_visible")


@query
def drift_below_threshold(spark, d):
    return drifted(spark, d, threshold=0.7).select("path", "score")


@query
def drift_summary(spark, d):
    return drift.summary(drifted(spark, d))


@query
def drift_by_folder(spark, d):
    return drift.summary_by_folder(drifted(spark, d))


@query
def drift_bulk_fix(spark, d):
    fixes = drifted(spark, d).selectExpr("path", f"inline({drift.bulk_fixes('violations')})")
    return fixes.selectExpr(
        "path", "type", "category", "message", "array_join(affected_lines, ',') AS affected_lines", "priority"
    )


@query
def line_context(spark, d):
    found = drift.detect(profiled(spark, d), detectors=["constant_naming"], context=3)
    rows = found.selectExpr("path", "inline(arrays_zip(violations, context))").toDF("path", "v", "c")
    return rows.selectExpr(
        "path", "v.line AS line", "array_join(c.before, '\\n') AS before", "c.line AS text",
        "array_join(c.after, '\\n') AS after",
    )


# --- AI detection -------------------------------------------------------------------------------

_CONFIDENCE = "round(confidence, 6) AS confidence"


@query
def ai_indicators(spark, d):
    return ai_detect.indicator_rows(files(spark, d)).select(
        "path", "seq", "type", "confidence", "evidence", "line"
    )


@query
def ai_first_n(spark, d):
    return ai_detect.indicator_rows(files(spark, d), first=3).select("path", "seq", "type", "line")


@query
def ai_confidence(spark, d):
    return ai_detect.detect(files(spark, d)).selectExpr(
        "path", "n_indicators", _CONFIDENCE, "is_likely_ai", "recommendation"
    )


@query
def ai_report(spark, d):
    return ai_detect.report_summary(ai_detect.detect(files(spark, d)))


@query
def ai_above_threshold(spark, d):
    return ai_detect.above(ai_detect.detect(files(spark, d)), 0.4).selectExpr("path", _CONFIDENCE)


@query
def ai_files_ranked(spark, d):
    likely = ai_detect.detect(files(spark, d)).where("is_likely_ai")
    return ai_detect.report(likely, f"{_scratch(spark)}/likely").selectExpr("path", _CONFIDENCE)


@query
def ai_model_indicators(spark, d):
    return ai_detect.model_indicators(corpus.ai_responses(spark, d)).select(
        "path", "seq", "type", "description", "confidence"
    )


@query
def ai_model_sections(spark, d):
    return ai_detect.model_sections(corpus.ai_responses(spark, d))


@query
def ai_model_confidence(spark, d):
    return ai_detect.detect(files(spark, d), corpus.ai_responses(spark, d)).selectExpr(
        "path", "n_indicators", _CONFIDENCE, "is_likely_ai"
    )


# --- AI audit -----------------------------------------------------------------------------------

_AUDIT_COLUMNS = ["path", "rule", "category", "severity", "line", "message"]


def _audit(spark, d, *only, org=False):
    found = ai_audit.findings(
        profiled(spark, d), audit_sections(spark, d), org_rules=org, only=only or None
    )
    return found


def _audit_rows(spark, d, *only, org=False, more=()):
    return ai_audit.violations(_audit(spark, d, *only, org=org)).select(*_AUDIT_COLUMNS, *more)


@query
def audit_human_comments(spark, d):
    return _audit_rows(spark, d, ai_audit.HUMAN_COMMENTS)


@query
def audit_unit_tests(spark, d):
    return _audit_rows(spark, d, ai_audit.UNIT_TESTS)


@query
def audit_complexity(spark, d):
    return _audit_rows(spark, d, ai_audit.COMPLEXITY_COMMENTS)


@query
def audit_placeholders(spark, d):
    found = ai_audit.findings(learn.with_profile(files(spark, d), None))
    return ai_audit.violations(found).select(*_AUDIT_COLUMNS, "evidence")


@query
def audit_naming(spark, d):
    return _audit_rows(spark, d, ai_audit.CONSISTENT_NAMING, more=["suggestion"])


@query
def audit_security(spark, d):
    return _audit_rows(spark, d, ai_audit.SECURITY_REVIEW, more=["evidence"])


@query
def audit_performance(spark, d):
    return _audit_rows(spark, d, ai_audit.PERFORMANCE_REVIEW, more=["evidence"])


@query
def org_error_handling(spark, d):
    return _audit_rows(spark, d, ai_audit.ERROR_HANDLING, org=True)


@query
def audit_ordered(spark, d):
    """Violations of an audited file, most severe first."""
    return ai_audit.violations(_audit(spark, d, org=True)).select("path", "seq", "rule", "severity", "line")


def _audit_report(spark, d):
    return ai_audit.report(_audit(spark, d, org=True))


@query
def audit_score(spark, d):
    return _audit_report(spark, d).selectExpr("path", _CONFIDENCE, "n_violations", "score")


@query
def audit_worst(spark, d):
    """The ten files with the lowest scores."""
    return ai_audit.worst_first(_audit_report(spark, d)).limit(10).select("path", "n_violations", "score")


@query
def audit_recommendations(spark, d):
    return _audit_report(spark, d).selectExpr("path", "array_join(recommendations, '; ') AS recommendations")


@query
def audit_actions(spark, d):
    return _audit_report(spark, d).selectExpr("path", "inline(actions)").select(
        "path", "priority", "action", "reason"
    )


@query
def audit_directory(spark, d):
    return ai_audit.directory_summary(_audit_report(spark, d), files(spark, d)).select(
        "files_analyzed", "ai_files", "total_violations", "average_score"
    )


# --- analysis log and its readers ---------------------------------------------------------------


def analyzed(spark, d, policy="watch", **options):
    return analysis.analyze(
        profiled(spark, d, policy), rules(spark),
        rule_source.normalise_exceptions(corpus.exceptions(spark, d)), **options,
    )


def debounced(spark, d):
    return changes.sessions(corpus.changes(spark, d), GAP_SECONDS)


def _events(spark, d, conventions=None):
    bursts = debounced(spark, d)
    source = monitor.changed_files(files(spark, d, "watch"), bursts)
    conventions = learned(spark, d) if conventions is None else conventions
    return monitor.analyze_sessions(bursts, source, rules(spark), exceptions(spark, d), conventions)


def log(spark, d):
    return monitor.with_lifecycle(_events(spark, d))


_WRITTEN: dict[tuple[str, str], AnalysisLog] = {}


def written_log(spark, d) -> AnalysisLog:
    """The log of the given tables as a monitor keeps it: written once per application, read by the queries below.

    The profile is learned once, saved beside the log and used for its entries.
    """
    key = spark.sparkContext.applicationId, d
    log = _WRITTEN.get(key)
    if log is None or not storage.exists(spark, f"{log.root}/summary/batch=0"):
        log = AnalysisLog(f"{_scratch(spark)}/log")
        profile.save_profile(learned(spark, d), f"{log.root}/profile")
        log.write_batch(_events(spark, d, profile.load_profile(spark, f"{log.root}/profile")), 0)
        times = log.daily(spark).agg(F.min("first_ts"), F.max("last_ts")).first()
        if times[0] is not None:
            log.add_lifecycle(spark, "monitor_started", times[0])
            log.add_lifecycle(spark, "monitor_stopped", times[1] + timedelta(seconds=1))
        _WRITTEN[key] = log
    return log


def recent_log(spark, d):
    return written_log(spark, d).recent(spark, activity.LAST_LINES)


def saved_profile(spark, d):
    """The learned profile, saved beside the written log and loaded again."""
    return profile.load_profile(spark, f"{written_log(spark, d).root}/profile")


@query
def analysis_merged(spark, d):
    rows = analysis.noteworthy(analysis.summarize(analyzed(spark, d)))
    return rows.selectExpr(
        "path", "array_join(insights, '; ') AS insights", "round(ai.confidence, 6) AS confidence",
        "drift_score", "summary.totalIssues AS total_issues", "summary.severity AS severity",
        "size(filter(violations, v -> v.source = 'audit')) AS n_audit",
        "size(filter(violations, v -> v.source = 'drift')) AS n_drift",
        "size(filter(violations, v -> v.source = 'rule')) AS n_rule",
    )


@query
def analysis_toggles(spark, d):
    """The analysis with one part switched on at a time."""
    source = profiled(spark, d, "watch")
    parts = {
        "ai": analysis.analyze(source, drift_detection=False), "drift": analysis.analyze(source, ai=False),
        "rules": analysis.analyze(source, rules(spark), exceptions(spark, d), ai=False, drift_detection=False),
    }
    out = [rows.selectExpr(f"{q(part)} AS part", "path", "size(violations) AS n", "ai IS NOT NULL AS has_ai",
                           "drift_score IS NOT NULL AS has_drift") for part, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def analysis_with_sections(spark, d):
    rows = analysis.analyze(profiled(spark, d, "watch"), rules(spark), sections=audit_sections(spark, d))
    return rows.selectExpr(
        "path", "size(violations) AS n", f"{scoring.highest_severity('violations')} AS severity",
        "size(filter(violations, v -> v.source = 'audit')) AS n_audit",
    )


@query
def highest_severity(spark, d):
    return analyzed(spark, d).selectExpr("path", f"{scoring.highest_severity('violations')} AS severity")


@query
def violations_by_severity(spark, d):
    grouped = analyzed(spark, d).selectExpr("path", f"{analysis.group_by_severity('violations')} AS g")
    return grouped.selectExpr("path", *[f"size(g.{s}) AS {s}" for s in scoring.SEVERITIES])


@query
def analysis_log(spark, d):
    return log(spark, d).selectExpr(
        "event", "file", "ts", "size(violations) AS n_violations", "array_join(insights, '; ') AS insights",
        "round(ai.confidence, 6) AS confidence", "driftScore AS drift_score",
        "summary.totalIssues AS total_issues", "summary.severity AS severity",
    )


@query
def log_json_roundtrip(spark, d):
    """Log rows written as JSON lines and read back."""
    return logs.parse_log_lines(logs.to_json_lines(log(spark, d))).selectExpr(
        "event", "file", "ts", "size(violations) AS n_violations", "summary.severity AS severity"
    )


@query
def slim_log(spark, d):
    return logs.slim_entries(log(spark, d)).selectExpr(
        "timestamp", "file", "summary.violations AS n_violations", "summary.insights AS n_insights",
        "summary.aiDetected AS ai_detected", "violations IS NOT NULL AS has_list",
    )


@query
def daily_log(spark, d):
    return logs.daily_lines(log(spark, d).where("event = 'file_analyzed'")).select("date", "ts", "file", "line")


@query
def text_log_written(spark, d):
    """The daily text log as written and read back; the second writing replaces the first."""
    path = f"{_scratch(spark)}/daily"
    lines = logs.daily_lines(written_log(spark, d).entries(spark))
    for _ in range(2):
        logs.write_text_log(lines, path, "line", batch=0)
    return logs.read_text_log(spark, path).selectExpr("date", "value AS line")


@query
def context_log(spark, d):
    return logs.context_entries(log(spark, d))


@query
def violations_report(spark, d):
    return logs.violation_reports(analyzed(spark, d))


@query
def log_retention(spark, d):
    kept = logs.retained(log(spark, d), "2024-01-20")
    return kept.groupBy("date").agg(F.count("*").alias("n"))


@query
def recent_analysis(spark, d):
    return activity.recent_analysis(recent_log(spark, d)).selectExpr("file", "ts", "summary.totalIssues AS total_issues")


@query
def recent_activity(spark, d):
    return activity.recent_activity(recent_log(spark, d)).selectExpr(
        "file", "ts", "summary.totalIssues AS total_issues", "summary.severity AS severity"
    )


@query
def recent_violations(spark, d):
    return activity.recent_violations(recent_log(spark, d), limit=10, severity="high").select(
        "file", "ts", "rule", "line", "message", "total"
    )


@query
def file_analysis(spark, d):
    return activity.file_analysis(recent_log(spark, d), files(spark, d, "watch").select("path"))


@query
def monitor_status(spark, d):
    status = activity.monitor_status(recent_log(spark, d), written_log(spark, d).lifecycle(spark))
    return status.drop("recent")


@query
def monitor_status_list(spark, d):
    """The status' last ten analyses, oldest first."""
    status = activity.monitor_status(recent_log(spark, d), written_log(spark, d).lifecycle(spark))
    return status.selectExpr("is_running", "posexplode(recent) AS (pos, r)").selectExpr(
        "is_running", "pos", "r.ts", "r.file", "r.total_issues", "r.severity", "r.has_insights")


@query
def monitor_stats(spark, d):
    return written_log(spark, d).stats(spark)


@query
def summary_report(spark, d):
    return logs.summary_report(written_log(spark, d).stats(spark))


@query
def org_context(spark, d):
    return activity.organization_context(recent_log(spark, d), saved_profile(spark, d), rules(spark)).selectExpr(
        "confidence", "variables", "functions", "import_style", "import_extensions",
        "array_join(categories, ',') AS categories", "array_join(recent_activity, ',') AS recent_activity",
    )


@query
def suggest_improvements(spark, d):
    checked_files = analysis.check_snippets(profiled(spark, d, "compliance"), rules(spark))
    return activity.improvements(checked_files).selectExpr(
        "path", "array_join(suggestions, '; ') AS suggestions"
    )


@query
def snippet_check(spark, d):
    """Submitted snippets: the turns of conversations, checked and rated in one go."""
    snippets = corpus.table(spark, d, "conversations").selectExpr(
        "concat('temp', conv_id, '_', turn, '.js') AS path",
        "concat('const user_reply = `', text, '`;\\neval(user_reply);') AS content",
    )
    checked_turns = analysis.check_snippets(learn.with_profile(snippets, learned(spark, d)), rules(spark))
    return checked_turns.selectExpr(
        "path", "size(violations) AS n_violations", "score", "n_indicators", _CONFIDENCE
    )


@query
def violation_trend(spark, d):
    return activity.trend_of_days(written_log(spark, d).daily(spark)).selectExpr(
        "date", "severity", "n", "change", "round(moving_avg, 6) AS moving_avg"
    )


@query
def ai_usage_by_folder(spark, d):
    return activity.ai_usage_by_folder(ai_detect.detect(files(spark, d)))


@query
def org_dashboard(spark, d):
    return activity.dashboard(analyzed(spark, d))


@query
def top_violations(spark, d):
    return activity.top_violations(explode_violations(analyzed(spark, d)))


# --- streaming ----------------------------------------------------------------------------------


@query
def debounce_sessions(spark, d):
    return debounced(spark, d)


def _scratch(spark: SparkSession) -> str:
    # a folder of this machine only where all of Spark runs on it
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-")
    default = os.path.join(tempfile.gettempdir(), "codewarden") if local else None
    return f"{monitor.checkpoint_root(spark, default)}/{uuid.uuid4().hex}"


def _as_changes(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(f"{corpus.file_path('user_id')} AS path", "cast(ts AS timestamp) AS ts", "event_type")


def _read_changes(spark: SparkSession, d: str) -> DataFrame:
    return _as_changes(corpus.table(spark, d, "events"))


def _change_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = corpus.table(spark, d, "events").schema
    return _as_changes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


@query
def stream_debounce(spark, d):
    """Bursts closed by the end of the change stream, through Structured Streaming."""
    out = _scratch(spark)
    stream = changes.stream_sessions(changes.with_end(_change_stream(spark, d), f"{out}/end"), GAP_SECONDS, "0 seconds")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/sessions").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/sessions")


@query
def stream_debounce_live(spark, d):
    """The same bursts from a stream that goes on, closed by timers once no change comes any more."""
    out = _scratch(spark)
    stream = debounce.live_sessions(_change_stream(spark, d), GAP_SECONDS, quiet_seconds=1)
    changed = _read_changes(spark, d).where("path IS NOT NULL AND ts IS NOT NULL").count()
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/sessions").trigger(processingTime="1 second").start()
    try:
        closed = 0
        while closed < changed:
            if run.awaitTermination(1):
                raise RuntimeError("the stream ended before its bursts were closed")
            if storage.exists(spark, f"{out}/sessions/_spark_metadata"):
                closed = spark.read.schema(stream.schema).parquet(f"{out}/sessions").agg(F.sum("n")).first()[0] or 0
    finally:
        run.stop()
    return spark.read.schema(stream.schema).parquet(f"{out}/sessions")


@query
def stream_monitor(spark, d):
    """The whole monitor on the change stream: debounce, analyse changed files, append to the log."""
    out = _scratch(spark)
    learned(spark, d).write.parquet(f"{out}/profile")
    table = FileTable.create(files(spark, d, "watch"), f"{out}/files", FILE_BUCKETS)
    run = monitor.start_monitor(
        changes.stream_sessions(changes.with_end(_change_stream(spark, d), f"{out}/end"), GAP_SECONDS, "0 seconds"),
        table, f"{out}/log", f"{out}/checkpoint",
        rules=rules, learned=lambda s: s.read.parquet(f"{out}/profile"),
        trigger={"availableNow": True},
    )
    run.awaitTermination()
    return monitor.read_monitor_log(spark, f"{out}/log").selectExpr(
        "file", "ts", "size(violations) AS n_violations", "driftScore AS drift_score",
        "summary.severity AS severity",
    )


# --- review responses ---------------------------------------------------------------------------


@query
def review_issues(spark, d):
    return review.practice_issues(corpus.practice_responses(spark, d), keep_cols=("path", "turn"))


@query
def perf_review(spark, d):
    return review.performance_rows(review.performance_reviews(corpus.performance_responses(spark, d)))


@query
def reviewable_files(spark, d):
    docs = corpus.table(spark, d, "documents").selectExpr("doc_id", "text AS content")
    return review.reviewable(docs).select("doc_id")


