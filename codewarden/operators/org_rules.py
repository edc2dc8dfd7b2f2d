"""Organizational rules: one violation generator per rule, evaluated in the file's row.

The rule table is tiny and used by id only, so its known rows travel as one struct through a scalar
subquery; files are never joined, shuffled or multiplied by the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import naming, scoring, text
from codewarden.functions.regex import SPACE, contains, matches, newlines, quick
from codewarden.functions.sql import array, keep, leading, let, q, struct, transform
from codewarden.operators.registry import registered_rules
from codewarden.schemas import NO_VIOLATIONS, VIOLATION, Sql, violation

# Rule ids, searched tokens and messages.
NO_EVAL = "security/no-eval"
NO_DANGEROUS_HTML = "security/no-dangerous-html"
COMPANY_FETCH = "security/require-company-fetch"
NO_SYNC_FS = "performance/no-sync-fs"
FEATURE_FOLDERS = "architecture/feature-folder-structure"
CAMELCASE_VARIABLES = "naming/camelcase-variables"
HTML_TOKENS = ["innerHTML", "outerHTML"]
SYNC_FS_TOKENS = ["readFileSync", "writeFileSync", "statSync"]
WRAPPER = "companyFetch"
EVAL_MESSAGE = "eval() usage is prohibited for security reasons"
FOLDER_MESSAGE = "File should follow feature folder structure"


def _found(rule: str, message: str, line: str) -> str:
    return violation(
        source="rule", rule=Sql(f"{rule}.rule_id"), category=Sql(f"{rule}.category"), type="rule",
        severity=Sql(f"{rule}.severity"), line=Sql(line), message=Sql(message),
    )


def _tokens(tokens, message):
    """One violation per token that occurs, at its first occurrence."""

    def build(rule):
        present = keep(array(tokens), lambda t: f"contains(content, {t})")
        return transform(present, lambda t: _found(rule, message(t), text.line_at("content", t)))

    return build


def _no_eval(rule: str) -> str:
    message = f"coalesce(nullif({rule}.parameters['message'], ''), {q(EVAL_MESSAGE)})"
    found = f"array({_found(rule, message, text.first_line_of('content', 'eval('))})"
    return f"if({contains('content', 'eval(')}, {found}, {NO_VIOLATIONS})"


def _company_fetch(rule: str) -> str:
    wrapper = f"coalesce(nullif({rule}.parameters['wrapperName'], ''), {q(WRAPPER)})"
    message = f"concat('Use ', {wrapper}, ' instead of raw fetch()')"
    found = f"array({_found(rule, message, text.first_line_of('content', 'fetch('))})"
    raw = f"{contains('content', 'fetch(')} AND NOT contains(content, {wrapper})"
    return f"if({raw}, {found}, {NO_VIOLATIONS})"


def _feature_folders(rule: str) -> str:
    found = f"array({_found(rule, q(FOLDER_MESSAGE), '1')})"
    return f"if({text.in_feature_folder('path')}, {NO_VIOLATIONS}, {found})"


def _first_lines(hits: str, found) -> str:
    """Bind a function giving the line where a hit's text first occurs anywhere in the file.

    A text occurs where a hit begins with it. The one other place is the end of a hit whose name ends in a
    keyword, with another name behind it. These are sorted by text once; the texts that begin with one text
    stand side by side, so its first line is the least of that stretch, found by binary search. All stretches
    together are no longer than the texts.
    """

    def overlapping(h):
        behind = f"regexp_extract_all(content, {q(f'{quick(text.VARIABLE)}(?=({SPACE}+{text.NAME})?)')}, 2)"
        keyword = f"regexp_extract(x.text, {q('(let|const|var)$')}, 1)"
        spot = struct(text=f"concat({keyword}, b)", line=f"x.line + {newlines('x.text')}")
        return f"filter(zip_with({h}, {behind}, (x, b) -> if({keyword} <> '' AND b <> '', {spot}, NULL)), s -> s IS NOT NULL)"

    def by_text(h):
        spots = transform(h, lambda x: struct(text=f"{x}.text", line=f"{x}.line"))
        chained = f"exists({h}, x -> {matches('x.text', '(?:let|const|var)$')})"
        every = f"array_sort(if({chained}, concat({spots}, {overlapping(h)}), {spots}))"
        return let(every, lambda e: f"filter({e}, (s, i) -> i = 0 OR get({e}, i - 1).text <> s.text)")

    def first(spots):
        # no name goes on with a tilde or anything behind it
        end = leading(spots, lambda other: f"{other}.text < concat(s.text, '~')")
        least = f"array_min(transform(slice({spots}, i + 1, {end} - i), o -> o.line))"
        return f"transform({spots}, (s, i) -> {struct(text='s.text', line=least)})"

    def bind(h):
        return let(let(by_text(h), first), lambda firsts: found(h, lambda t: (
            f"get({firsts}, {leading(firsts, lambda other: f'{other}.text < {t}')}).line")))

    return let(hits, bind)


def _camelcase_variables(rule: str) -> str:
    """Reported at the first place where the same declaration text occurs."""

    def found(hits, first_line):
        declared = transform(
            hits, lambda h: struct(text=f"{h}.text", name=text.variable_name(f"{h}.text"))
        )
        other = keep(declared, lambda d: f"{naming.naming_style(f'{d}.name')} <> 'camelCase'")
        return transform(other, lambda d: _found(
            rule, f"concat('Variable \\'', {d}.name, '\\' should use camelCase naming')",
            first_line(f"{d}.text"),
        ))

    learned = "profile.recommendations.naming.variables <=> 'camelCase'"
    return f"if({learned}, {_first_lines(text.variables(), found)}, {NO_VIOLATIONS})"


BUILDERS = {
    NO_EVAL: _no_eval,
    NO_DANGEROUS_HTML: _tokens(
        HTML_TOKENS,
        lambda t: f"concat('Direct ', {t}, ' manipulation can lead to XSS vulnerabilities')",
    ),
    COMPANY_FETCH: _company_fetch,
    NO_SYNC_FS: _tokens(
        SYNC_FS_TOKENS, lambda t: f"concat('Avoid synchronous file operation: ', {t})"
    ),
    FEATURE_FOLDERS: _feature_folders,
    CAMELCASE_VARIABLES: _camelcase_variables,
}


def active_exceptions(exceptions: DataFrame, as_of=None) -> DataFrame:
    """Exceptions still valid on a day; without a day, all of them."""
    if as_of is None:
        return exceptions
    return exceptions.where(F.col("expires").isNull() | (F.col("expires") > F.lit(as_of).cast("date")))


def without_excepted_rules(rules: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Drop rules excepted for every file: both sides are configuration, the files are not involved."""
    everywhere = exceptions.where("file = '*'").select(F.col("rule").alias("rule_id")).distinct()
    all_off = everywhere.where("rule_id = '*'").agg(F.count("*").alias("n")).scalar()
    return rules.join(everywhere, "rule_id", "left_anti").where(all_off == 0)


def _rule_struct(rules: DataFrame, ids) -> DataFrame:
    """One row, one column: a struct with a field per known rule, null for rules not active."""
    known = rules.where(F.col("enabled") & F.col("rule_id").isin(list(ids)))
    row = "named_struct('rule_id', rule_id, 'category', category, 'severity', severity, " \
          "'parameters', parameters, 'ord', ord)"
    fields = [
        F.expr(f"max_by({row}, ord) FILTER (WHERE rule_id = {q(r)})").alias(f"r{i}")
        for i, r in enumerate(ids)
    ]
    return known.agg(*fields).select(F.struct("*").alias("rules"))


def rule_violations(
    files: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, only=None, keep_cols=("path",),
) -> DataFrame:
    """files(path, content, profile) -> kept columns + ``violations`` array in rule order.

    Disabled rules and rules excepted everywhere are pruned before any content is read; exceptions for
    single files are left to :func:`suppress`, because they need the path only.
    """
    builders = {**BUILDERS, **{k: v.build for k, v in registered_rules().items()}}
    ids = [r for r in builders if only is None or r in only]
    if exceptions is not None:
        rules = without_excepted_rules(rules, exceptions)
    files = files.withColumn("rules", _rule_struct(rules, ids).scalar())
    groups = ", ".join(
        f"if(rules.r{i} IS NULL, NULL, named_struct('ord', rules.r{i}.ord, 'found', {builders[r](f'rules.r{i}')}))"
        for i, r in enumerate(ids)
    )
    ordered = f"array_sort(filter(array({groups}), g -> g IS NOT NULL), " \
              "(a, b) -> cast(a.ord - b.ord AS int))"
    found = f"flatten(transform({ordered}, g -> g.found))"
    return files.selectExpr(*keep_cols, f"cast({found} AS array<{VIOLATION}>) AS violations")


def suppress(violations: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Remove violations excepted for their own file, by rule or by '*'.

    The rules excepted per file are gathered first (at most one entry per rule and file), so this is
    one equi-join on the path that carries findings but no contents; Spark broadcasts the exceptions
    when they are small and shuffles both sides when they are not.
    """
    per_file = (
        exceptions.where("file <> '*'").select("file", "rule").distinct()
        .groupBy(F.col("file").alias("path")).agg(F.collect_set("rule").alias("excepted"))
    )
    kept = keep(
        "violations",
        lambda v: f"NOT (array_contains(excepted, {v}.rule) OR array_contains(excepted, '*'))",
    )
    return (
        violations.join(per_file, "path", "left")
        .withColumn("violations", F.expr(f"if(excepted IS NULL, violations, {kept})"))
        .drop("excepted")
    )


def check(
    files: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, as_of=None, only=None,
) -> DataFrame:
    """path, violations array after exceptions; files need (path, content, profile)."""
    if exceptions is None:
        return rule_violations(files, rules, only=only)
    active = active_exceptions(exceptions, as_of)
    return suppress(rule_violations(files, rules, active, only=only), active)


def compliance_by_file(checked: DataFrame) -> DataFrame:
    """path, number of violations, counts per severity and the rule compliance score."""
    per_severity = [
        f"size(filter(violations, v -> v.severity = '{s}')) AS {s}" for s in scoring.SEVERITIES
    ]
    return checked.selectExpr(
        "path", "size(violations) AS n_violations", *per_severity,
        f"{scoring.rule_score('violations')} AS score",
    )


def compliance_summary(checked: DataFrame) -> DataFrame:
    """One row: files, files with violations, violations, rate (null for no files), band."""
    totals = checked.agg(
        F.count("*").alias("files"),
        F.count_if(F.expr("size(violations) > 0")).alias("files_with_violations"),
        F.coalesce(F.sum(F.expr("size(violations)")), F.lit(0)).alias("total_violations"),
    )
    rate = scoring.round_half_up("(files - files_with_violations) / nullif(files, 0) * 100")
    return totals.withColumn("compliance_rate", F.expr(rate)).withColumn(
        "band",
        F.expr("CASE WHEN compliance_rate >= 80 THEN 'good' WHEN compliance_rate >= 60 THEN 'fair' "
               "WHEN compliance_rate < 60 THEN 'poor' END"),
    )


def recommendations(violations: str) -> str:
    """SQL text: advice for categories with more than one violation, then for critical ones."""
    categories = f"array_distinct(transform({violations}, v -> v.category))"
    counted = transform(
        categories, lambda c: struct(c=c, n=f"size(filter({violations}, v -> v.category = {c}))")
    )
    repeated = transform(
        keep(counted, lambda x: f"{x}.n > 1"),
        lambda x: f"concat('Address ', {x}.n, ' ', {x}.c, ' violations for better code quality')",
    )
    critical = (
        f"if(exists({violations}, v -> v.severity = 'critical'), "
        "array('Critical violations must be fixed before deployment'), cast(array() AS array<string>))"
    )
    return f"concat({repeated}, {critical})"


def missing_tests(files: DataFrame) -> DataFrame:
    """Code files without their expected test file in the corpus: an anti-join on paths alone."""
    paths = files.select("path")
    sources = paths.where(f"NOT {text.is_learner_test('path')}").selectExpr(
        "path", f"{text.expected_test_path('path')} AS expected_test"
    )
    present = paths.select(F.col("path").alias("expected_test"))
    return sources.join(present, "expected_test", "left_anti").select("path", "expected_test")
