import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from codewarden.operators import ai_audit, ai_detect, drift, learn, org_rules, registry, review
from codewarden.plans import activity, analysis
from codewarden.schemas import ANALYSIS_LOG, EXCEPTIONS, explode_violations
from codewarden.sources import code_files, logs, profile, rules
from verification import spark_queries

BAD = "var user_name = 1;\n// eval is bad\neval(user_name);\nfetch('/x');\nel.innerHTML = user_name;\n"
GOOD = "import a from './a.js';\nexport const itemCount = 1;\n"
AI = """// Helper function
function processUserInput(data) {
  // Add your code here
  // Your code here
  // Implementation goes here
  const config = {};
  eval(data);
  try { go(); } catch (e) { throw new Error('x'); }
  for (;;) { for (;;) { } }
}
"""


def files_of(spark, **contents):
    rows = [(p.replace("__", "/").replace("_DOT_", "."), c) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content string")


@pytest.fixture
def corpus(spark):
    return files_of(spark, src__bad_name_DOT_js=BAD, src__goodName_DOT_js=GOOD, root_DOT_js="const x = 1;")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rules_with_lines(spark, corpus):
    checked = org_rules.check(learn.with_profile(corpus, None), rules.initial_rules(spark))
    assert rows(explode_violations(checked), "path", "rule", "line", "severity") == [
        ("root.js", org_rules.FEATURE_FOLDERS, 1, "medium"),
        ("src/bad_name.js", org_rules.NO_DANGEROUS_HTML, 5, "high"),
        ("src/bad_name.js", org_rules.NO_EVAL, 3, "critical"),
        ("src/bad_name.js", org_rules.COMPANY_FETCH, 4, "medium"),
    ]


def test_compliance_of_nothing_has_no_rate(spark, corpus):
    empty = learn.with_profile(corpus.where("false"), None)
    got = org_rules.compliance_summary(org_rules.check(empty, rules.initial_rules(spark))).first()
    assert (got.files, got.compliance_rate, got.band) == (0, None, None)


@pytest.mark.parametrize("file, rule, expires, left", [
    ("src/bad_name.js", org_rules.NO_EVAL, None, {"html", "fetch"}),
    ("src/bad_name.js", None, None, set()),
    (None, org_rules.NO_EVAL, None, {"html", "fetch"}),
    (None, None, None, set()),
    ("src/other.js", None, None, {"html", "fetch", "eval"}),
    ("src/bad_name.js", org_rules.NO_EVAL, dt.date(2020, 1, 1), {"html", "fetch", "eval"}),
    (None, org_rules.NO_EVAL, dt.date(2020, 1, 1), {"html", "fetch", "eval"}),
    ("src/bad_name.js", org_rules.NO_EVAL, dt.date(2030, 1, 1), {"html", "fetch"}),
])
def test_exceptions(spark, corpus, file, rule, expires, left):
    excepted = rules.normalise_exceptions(spark.createDataFrame([(file, rule, "why", expires)], EXCEPTIONS))
    source = learn.with_profile(corpus.where("path LIKE '%bad%'"), None)
    found = explode_violations(org_rules.check(source, rules.initial_rules(spark), excepted, as_of="2024-01-01"))
    short = {org_rules.NO_EVAL: "eval", org_rules.NO_DANGEROUS_HTML: "html", org_rules.COMPANY_FETCH: "fetch"}
    assert {short[r.rule] for r in found.collect()} == left


def test_camelcase_rule_reports_first_textual_occurrence(spark):
    content = "let abc = 1;\nlet ab = 2;\nlet ab = 3;\nlet var\nvar q\nlet Zed = 1;"
    files = files_of(spark, s__f_DOT_js=content)
    learned = spark.range(1).selectExpr(
        "'high' AS confidence", "from_json('{\"naming\": {\"variables\": \"camelCase\"}}', "
        "'struct<naming:struct<variables:string,functions:string,constants:string,files:string>,"
        "imports:struct<style:string,extensions:string,popularLibraries:array<string>>,"
        "architecture:struct<exportStyle:string,commonFolders:array<string>>,"
        "testing:struct<fileNaming:string,framework:string>,comments:struct<style:string,density:string>>') AS recommendations")
    found = org_rules.check(learn.with_profile(files, learned), rules.initial_rules(spark), only=[org_rules.CAMELCASE_VARIABLES])
    got = [(r.message.split("'")[1], r.line) for r in explode_violations(found).orderBy("seq").collect()]
    text = content
    want = []
    import re
    for m in re.finditer(r"(?:let|const|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", content):
        want.append((m.group(1), text[: text.index(m.group(0))].count("\n") + 1))
    assert got == want
    assert got[1] == ("ab", 1)


def test_rule_config(spark, tmp_path):
    config = {
        "metadata": {"version": "2", "name": "x"},
        "rules": {
            "security": {"enabled": True, "rules": {
                "no-eval": {"severity": "high", "message": "unused", "parameters": {"message": "use this"}},
                "off": {"enabled": False}}},
            "naming": {"enabled": False, "rules": {"camelcase-variables": {}}},
            "odd": {"enabled": True, "rules": {"r": {"severity": "urgent"}}},
        },
        "exceptions": [{"file": "a.js"}, {"rule": "security/no-eval", "reason": "first"},
                       {"rule": "security/no-eval", "reason": "second"}],
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(config, indent=2))
    loaded = rules.load_rules(spark, str(path))
    assert rows(loaded, "rule_id", "name", "severity", "enabled") == [
        ("odd/r", "r", "urgent", True), ("security/no-eval", "no-eval", "high", True), ("security/off", "off", "medium", False)]
    parsed = rules.read_config(spark, str(path))
    assert {(r.file, r.rule, r.reason) for r in rules.exceptions_of(parsed).collect()} == {
        ("a.js", "*", None), ("*", "security/no-eval", "second")}
    issues = rules.validate_config(parsed).unionByName(rules.validate_rules(loaded))
    assert {(r.level, r.message) for r in issues.collect()} >= {
        ("warning", "Unknown rule category: odd"), ("error", "Rule odd/r has invalid severity: urgent"),
        ("warning", "Rule odd/r is missing name or description")}
    assert rules.history_entry(parsed, loaded, "2024-01-01 00:00:00").first().rules_count == 3
    assert rules.rule_by_id(loaded, "odd/r").count() == 1
    found = explode_violations(org_rules.check(learn.with_profile(files_of(spark, s__a_DOT_js=BAD), None), loaded)).collect()
    assert [(f.message, f.severity) for f in found] == [("use this", "high")]
    assert rules.load_rules(spark, str(tmp_path / "none.json")).count() == 2


def test_broken_config_is_reported(spark):
    texts = spark.createDataFrame([('{"rules": {}}',), ('{"metadata": {"name": "x"}, "rules": {}}',)], "value string")
    got = {r.message for r in rules.validate_config(rules.parse_config(texts)).collect()}
    assert got == {"Missing required section: metadata", "Missing required metadata field: version"}


def test_registered_and_python_rules(spark, corpus):
    registry.register_rule("custom/no-one", "custom", "low", lambda: (
        "if(contains(content, '= 1'), array(named_struct('line', 1, 'message', 'one found')), "
        "cast(array() AS array<struct<line:int,message:string>>))"))
    try:
        table = rules.initial_rules(spark).unionByName(registry.registered_rule_rows(spark))
        found = org_rules.check(learn.with_profile(corpus, None), table, only=["custom/no-one"])
        assert explode_violations(found).count() == 3
    finally:
        registry.unregister_rule("custom/no-one")
    assert registry.registered_rule_rows(spark) is None
    py = registry.python_rule(corpus, "custom/long", "custom", "info", lambda path, content: [(1, "long")] if len(content) > 60 else [])
    assert [r.path for r in py.collect()] == ["src/bad_name.js"]


def test_learn_ties_and_empty_corpus(spark):
    tied = files_of(spark, a__one_DOT_js="let aB = 1; let c_d = 1;")
    got = learn.learn(tied).first()
    assert got.recommendations.naming.variables == "camelCase"
    empty = learn.learn(tied.where("false")).first()
    assert empty.confidence == "low"
    assert empty.recommendations.naming.constants == "UPPER_CASE"
    assert empty.recommendations.testing.fileNaming == "spec"
    assert empty.recommendations.testing.framework is None
    assert empty.recommendations.imports.popularLibraries == []


def test_learn_compat(spark):
    many = spark.range(60).selectExpr("concat('src/my-file', id, '.js') AS path", "'function do_it(a) {}' AS content")
    intent, compat = learn.learn(many).first(), learn.learn(many, compat=True).first()
    assert (intent.confidence, compat.confidence) == ("high", "low")
    assert intent.recommendations.naming.functions == "snake_case"
    assert compat.recommendations.naming.functions == "camelCase"
    assert intent.recommendations.naming.files == "kebab-case"
    assert compat.recommendations.naming.files == "kebab_case"


def test_learning_does_not_depend_on_order(spark, corpus):
    a = learn.learn(corpus).first()
    b = learn.learn(corpus.orderBy(F.desc("path")).repartition(3)).first()
    assert a == b


def test_profile_round_trip(spark, corpus, tmp_path):
    learned = learn.learn(corpus)
    profile.save_profile(learned, str(tmp_path / "p"))
    again = profile.load_profile(spark, str(tmp_path / "p"))
    assert again.first().asDict(True) == learned.first().asDict(True)
    assert profile.load_profile(spark, str(tmp_path / "missing")) is None


def test_drift_scores_count_hidden_violations(spark, corpus):
    learned = learn.learn(corpus)
    source = learn.with_profile(corpus, learned)
    shown = {r.path: r for r in drift.detect(source).collect()}
    full = {r.path: r for r in drift.detect(source, include_info=True).collect()}
    for path, row in full.items():
        weights = {"critical": 10, "high": 5, "medium": 3, "low": 1, "info": 0.5}
        assert row.score == max(0, 100 - min(100, 2 * sum(weights[v.severity] for v in row.violations)))
        assert shown[path].score == row.score
        assert [v for v in row.violations if v.severity != "info"] == shown[path].violations
    assert drift.summary(drift.detect(source.where("false"))).first().overall_score == 100


def test_ai_detection(spark):
    files = files_of(spark, s__ai_DOT_js=AI, s__plain_DOT_js=GOOD, s__empty_DOT_js="")
    got = {r.path: r for r in ai_detect.detect(files).collect()}
    assert got["s/ai.js"].is_likely_ai and not got["s/plain.js"].is_likely_ai
    assert got["s/empty.js"].confidence == 0
    kinds = [r.type for r in ai_detect.indicator_rows(files).where("path = 's/ai.js'").orderBy("seq").collect()]
    assert len(kinds) == got["s/ai.js"].n_indicators
    assert kinds[0] == "comment_pattern" and kinds[-1] == "ai_signature"


def test_model_answers_raise_confidence(spark):
    files = files_of(spark, s__plain_DOT_js=GOOD)
    answers = spark.createDataFrame([
        ("s/plain.js", "ai", json.dumps({"reasons": ["a"] * 9, "confidence": 0.9, "sections": [{"line": 2, "reason": "r"}]})),
        ("s/plain.js", "ai", "sorry"),
    ], "path string, kind string, response string")
    row = ai_detect.detect(files, answers).first()
    assert row.n_indicators == 9 and row.is_likely_ai
    assert [(r.line, r.confidence) for r in ai_detect.model_sections(answers).collect()] == [(2, 0.9)]


def test_audit_distances(spark):
    files = learn.with_profile(files_of(spark, s__ai_DOT_js=AI), None)
    for line, near in [(7, True), (10, True), (4, True), (11, False), (3, False)]:
        sections = spark.createDataFrame([("s/ai.js", line, "r", 0.9)], "path string, line int, reason string, confidence double")
        found = ai_audit.findings(files, sections, only=[ai_audit.SECURITY_REVIEW]).where("rule IS NOT NULL")
        assert (found.count() == 1) == near, line
    for line, near in [(14, True), (15, False)]:
        sections = spark.createDataFrame([("s/ai.js", line, "r", 0.9)], "path string, line int, reason string, confidence double")
        found = ai_audit.findings(files, sections, only=[ai_audit.PERFORMANCE_REVIEW]).where("rule IS NOT NULL")
        assert (found.count() == 1) == near, line


def test_audit_counts_repeated_sections_per_section_rule_only(spark):
    files = learn.with_profile(files_of(spark, s__ai_DOT_js=AI), None)
    sections = spark.createDataFrame([("s/ai.js", 9, "r", 0.9)] * 3, "path string, line int, reason string, confidence double")
    everything = ai_audit.findings(files, sections, org_rules=True)
    found = ai_audit.violations(everything)
    assert sorted(r.seq for r in found.collect()) == list(range(found.count()))
    assert ai_audit.report(everything).first().n_violations == found.count()
    n = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}
    assert n[ai_audit.COMPLEXITY_COMMENTS] == 3
    assert n[ai_audit.SECURITY_REVIEW] == 1


def test_audit_without_sections_reports_clean_files(spark):
    clean = AI.replace("// Add your code here\n", "").replace("// Your code here\n", "").replace("// Implementation goes here\n", "")
    files = learn.with_profile(files_of(spark, s__ai_DOT_js=AI, s__other_DOT_js=clean), None)
    report = ai_audit.report(ai_audit.findings(files)).collect()
    likely = ai_detect.detect(files).where("is_likely_ai").count()
    assert len(report) == likely


def test_windows_match_a_direct_slice(spark):
    """Section windows against brute force on every line of a small file."""
    import re
    content = AI + "\n" * 7 + "if (a) {\n if (b) {\n  if (c) {}\n }\n}\n// Why not\n"
    files = learn.with_profile(files_of(spark, s__ai_DOT_js=content), None)
    lines = content.split("\n")
    sections = spark.createDataFrame([("s/ai.js", n, "r", 0.9) for n in range(1, len(lines) + 9)], "path string, line int, reason string, confidence double")
    found = ai_audit.findings(files, sections, only=[ai_audit.COMPLEXITY_COMMENTS]).where("rule IS NOT NULL")
    got = sorted(r.line for r in found.collect())
    want = []
    for n in range(1, len(lines) + 9):
        w = "\n".join(lines[max(0, n - 5): n + 5])
        if any(re.search(p, w) for p in ai_audit.COMPLEX) and not re.search(ai_audit.EXPLAINED, w):
            want.append(n)
    assert got == want


def test_very_many_copies_of_a_section(spark):
    files = learn.with_profile(files_of(spark, s__ai_DOT_js=AI), None)
    many = 2 * ai_audit.COPY_BLOCK + 3
    sections = spark.range(many).selectExpr("'s/ai.js' AS path", "9 AS line", "'r' AS reason", "0.9D AS confidence")
    found = ai_audit.violations(ai_audit.findings(files, sections, only=[ai_audit.COMPLEXITY_COMMENTS]))
    got = found.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.max("seq").alias("m")).first()
    assert (got.n, got.d, got.m) == (many, many, many - 1)


def test_merged_analysis_and_switches(spark, corpus):
    source = learn.with_profile(corpus, learn.learn(corpus))
    table = rules.initial_rules(spark)
    merged = {r.path: r for r in analysis.summarize(analysis.analyze(source, table)).collect()}
    bad = merged["src/bad_name.js"]
    assert bad.summary.severity == "critical" and bad.summary.totalIssues == len(bad.violations)
    only_rules = analysis.analyze(source, table, ai=False, drift_detection=False)
    assert {v.source for r in only_rules.collect() for v in r.violations} == {"rule"}
    assert only_rules.first().drift_score is None
    nothing = analysis.analyze(source, None, ai=True, drift_detection=False)
    assert {v.source for r in nothing.collect() for v in r.violations} <= {"audit"}
    assert analysis.noteworthy(nothing).count() == 0


def test_log_round_trip_and_retention(spark, corpus, tmp_path):
    source = learn.with_profile(corpus, None)
    analyzed = analysis.analyze(source, rules.initial_rules(spark), drift_detection=False)
    stamped = analyzed.withColumn("ts", F.expr("timestamp'2024-03-01 10:00:00' + make_interval(0, 0, 0, length(path))"))
    events = analysis.as_events(stamped)
    path = str(tmp_path / "log")
    logs.append_log(events, path)
    assert logs.read_log(spark, path).count() == 3
    left = logs.drop_expired(spark, path, "2024-03-20", days=7)
    assert left.count() == logs.retained(events, "2024-03-20").count()
    lines = logs.to_json_lines(events).unionByName(spark.createDataFrame([("{broken",), ("",), ("[1]",)], "value string"))
    back = logs.parse_log_lines(lines)
    assert rows(back, "file", "ts") == rows(events, "file", "ts")
    entry = {r.file: r.entry for r in logs.context_entries(events).collect()}["src/bad_name.js"]
    assert "🎯 EVENT: file_analyzed" in entry and "🔥 [CRITICAL] eval()" in entry and "📍 Line 3" in entry
    report = logs.violation_reports(analyzed).where("path = 'src/bad_name.js'").first().entry
    assert "🔥 CRITICAL SEVERITY (1 issues):" in report and "Line 3, Column N/A" in report


def test_readers_on_a_short_log(spark):
    schema = ANALYSIS_LOG
    ev = lambda i, name="file_analyzed", file="a.js", sev="high": {
        "event": name, "file": file if name == "file_analyzed" else None, "ts": dt.datetime(2024, 1, 1, 0, i),
        "violations": [{"rule": "r", "category": "c", "severity": sev, "message": "m", "line": i}],
        "summary": {"hasViolations": True, "hasInsights": False, "totalIssues": 1, "severity": sev},
        "ai": {"isLikelyAI": i % 2 == 0, "confidence": 0.5}}
    rows_ = [ev(0, "monitor_started")] + [ev(i, file=f"f{i}.js", sev="high" if i % 2 else "low") for i in range(1, 31)]
    rows_.append(ev(31, "monitor_stopped"))
    log = spark.createDataFrame(rows_, schema)
    assert [r.file for r in activity.recent_activity(log).orderBy("ts").collect()] == [f"f{i}.js" for i in range(21, 31)]
    assert activity.recent_analysis(log, 5).count() == 4
    status = activity.monitor_status(log).first()
    assert (status.is_running, status.files_analyzed, status.total_violations, status.ai_code_detected) == (False, 19, 19, 10)
    recent = activity.recent_violations(log, limit=2, severity="high").collect()
    assert [(r.file, r.total) for r in recent] == [("f21.js", 5), ("f23.js", 5)]
    paths = spark.createDataFrame([("f30.js",), ("f1.js",)], "path string")
    got = {r.path: r.error for r in activity.file_analysis(log, paths).collect()}
    assert got == {"f30.js": None, "f1.js": activity.NOT_FOUND}


def test_reviews(spark):
    rows_ = [
        ("a", "practice", '[{"line": 3, "message": "m", "suggestion": "s"}]'),
        ("b", "practice", '{"line": 3}'), ("c", "practice", "no json"), ("d", "practice", "[]"),
        ("e", "performance", 'x {"metrics": [1], "issues": {"a": 1}, "suggestions": "s"} y'),
        ("f", "performance", 'x {"metrics": {"k": 1}, "issues": ["plain", {"type": "error", "line": 2, "message": "m", "snippet": "s"}], "suggestions": [{"description": "d", "code": "c"}]}'),
        ("g", "performance", "nothing"),
    ]
    responses = spark.createDataFrame(rows_, "path string, kind string, response string")
    issues = review.practice_issues(responses).collect()
    assert [(i.path, i.line, i.suggestion, i.model_suggestion) for i in issues] == [("a", 3, "Review: m", "s")]
    perf = {r.path: r for r in review.performance_reviews(responses).collect()}
    assert (perf["e"].metrics, perf["e"].issues, perf["e"].suggestions) == ({}, [], [])
    assert (perf["g"].metrics, perf["g"].issues) == ({}, [])
    assert perf["f"].metrics == {"k": "1"}
    assert [(i.message, i.code_snippet) for i in perf["f"].issues] == [("plain", ""), ("m", "s")]
    assert [(x.description, x.code_snippet) for x in perf["f"].suggestions] == [("d", "c")]
    texts = {r.text: r.suggestion for r in review.performance_rows(review.performance_reviews(responses)).where("kind = 'issue'").collect()}
    assert texts == {"plain": "Review performance issue: plain", "m": "m"}


def test_directory_scan(spark, tmp_path):
    for name, content in {"src/a.js": "let a_b = 1;\n", "src/b.css": "x", "node_modules/p/c.js": "y", "d e%41+.ts": "z"}.items():
        p = tmp_path / "my root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    root = str(tmp_path / "my root")
    got = code_files.scan_code_files(spark, root, policy="none")
    assert rows(got, "path") == [("d e%41+.ts",), ("node_modules/p/c.js",), ("src/a.js",)]
    assert rows(code_files.scan_code_files(spark, root), "path", "content") == [("d e%41+.ts", "z"), ("src/a.js", "let a_b = 1;\n")]
    assert code_files.scan_code_files(spark, root, max_files=1).count() == 1
    assert code_files.scan_code_files(spark, root).first().mtime is not None


def test_scan_keeps_hidden_names(spark, tmp_path):
    names = ["src/_app.js", "src/__tests__/b.test.js", ".storybook/main.js", "src/a.js", "_d/.e.ts", "notes.md"]
    for name in names:
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    for policy in code_files.POLICIES:
        got = {r.path: r.content for r in code_files.scan_code_files(spark, str(tmp_path / "tree"), policy).collect()}
        wanted = {n for n in names[:5] if policy != "watch" or not n.startswith(".")}
        assert got == {n: n for n in wanted}, policy
    by_uri = code_files.scan_code_files(spark, (tmp_path / "tree").as_uri(), "learn")
    assert by_uri.count() == 5
    (tmp_path / "empty").mkdir()
    assert code_files.scan_code_files(spark, str(tmp_path / "empty")).count() == 0


def test_scan_walks_a_tree_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    for i in range(60):
        folder = tree / "one" / f"part{i % 20}" / f"deep{i}"
        folder.mkdir(parents=True)
        (folder / "a.js").write_text(str(i))
        ignored = tree / "one" / "node_modules" / f"p{i}"
        ignored.mkdir(parents=True)
        (ignored / "x.js").write_text("")
    opened = tmp_path / "opened"
    opened.mkdir()

    class Listing:
        """Notes each folder that a task lists."""

        def get_file_info(self, selector):
            import os
            import uuid

            from pyarrow.fs import LocalFileSystem
            from pyspark import TaskContext

            (opened / uuid.uuid4().hex).write_text(f"{os.path.relpath(selector.base_dir, tree)} {TaskContext.get().taskAttemptId()}")
            return LocalFileSystem().get_file_info(selector)

        def open_input_stream(self, path, compression=None):
            from pyarrow.fs import LocalFileSystem

            return LocalFileSystem().open_input_stream(path, compression=compression)

    monkeypatch.setattr(code_files, "_file_system", lambda directory: (Listing(), str(tree)))
    got = code_files.scan_code_files(spark, str(tree))
    assert sorted(int(r.content) for r in got.collect()) == list(range(60))
    assert got.count() == 60
    notes = [n.read_text().rsplit(" ", 1) for n in opened.iterdir()]
    # the root, "one", its parts, their folders; nothing ignored, nothing twice
    assert len(notes) == len({n for n, _ in notes}) == 1 + 1 + 20 + 60
    assert len({task for _, task in notes}) > 10


def test_sizes_as_settings_write_them():
    assert [code_files._bytes(x) for x in ("134217728", "7b", "16m", "1 GB")] == [134217728, 7, 16 << 20, 1 << 30]


def test_threshold_does_not_copy_the_patterns(spark):
    files = spark.createDataFrame([("a.js", "var a = 1; // x")], "path string, content string")

    def patterns(df):
        return df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp")

    detected = ai_detect.detect(files)
    assert patterns(ai_detect.above(detected)) == patterns(detected)


def test_long_lines_take_time_by_the_text_not_by_its_square(spark, monkeypatch):
    content = "\n".join(["x" * 121, "short"] * 20_000)
    monkeypatch.setattr(spark_queries, "unprofiled", lambda s, d, policy: learn.with_profile(files_of(s, a_DOT_js=content), None))
    start = time.time()
    rows = spark_queries.registry_checks(spark, "").where("rule = 'custom/long-line'").orderBy("line").collect()
    assert time.time() - start < 60 and len(rows) == 20_000
    assert (rows[1].line, rows[1].message) == (3, "Line has 121 characters")
