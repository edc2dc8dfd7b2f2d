"""Drift of each file from the learned profile, evaluated in the file's row.

All detectors of a file are arrays in one projection: contents are read once and never shuffled, and
scores and bulk-fix advice come from the arrays without grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import naming, scoring, text
from codewarden.functions import regex as rx
from codewarden.functions.sql import case, keep, let, q, struct, transform
from codewarden.schemas import NO_VIOLATIONS, VIOLATION, Sql, violation

# Detector names and what severity a density mismatch has, by the expected level.
FILE_NAMING = "consistent_file_naming"
VARIABLE_NAMING = "consistent_variable_naming"
FUNCTION_NAMING = "consistent_function_naming"
CONSTANT_NAMING = "consistent_constant_naming"
IMPORT_STYLE = "consistent_import_style"
IMPORT_EXTENSIONS = "consistent_import_extensions"
DISCOURAGED_LIBRARY = "discouraged_library_usage"
FOLDER_STRUCTURE = "consistent_folder_structure"
COMMENT_STYLE = "consistent_comment_style"
COMMENT_DENSITY = "consistent_comment_density"
DENSITY_SEVERITY = {"none": "high", "low": "medium", "medium": "low", "high": "info"}

_REC = "profile.recommendations"


def _drift(kind, category, rule, severity, message, expected=None, actual=None, **where) -> str:
    at = {"line": 1, "col": 1, **where}
    opt = lambda v: None if v is None else Sql(v)
    return violation(
        source="drift", rule=rule, category=category, type=f"{kind}_drift", severity=severity,
        message=Sql(message), expected=opt(expected), actual=opt(actual), **at,
    )


def _one(condition: str, found: str) -> str:
    return f"if({condition}, array({found}), {NO_VIOLATIONS})"


def _file_naming() -> str:
    expected = f"{_REC}.naming.files"

    def check(actual):
        found = _drift(
            "naming", "file_naming", FILE_NAMING, "medium",
            f"concat('File naming style \\'', {actual}, '\\' differs from project standard \\'', "
            f"{expected}, '\\'')", expected, actual,
        )
        return _one(f"{expected} IS NOT NULL AND {actual} NOT IN ({expected}, 'unknown')", found)

    return let(naming.naming_style(text.stem("path"), kebab=True), check)


def _styled(hits: str, name) -> str:
    """Hits with their identifier and its style."""

    def styled(h):
        return let(name(f"{h}.text"), lambda n: struct(
            name=n, style=naming.naming_style(n, kebab=True), line=f"{h}.line", col=f"{h}.col"
        ))

    return transform(hits, styled)


def _identifier_naming(hits: str, name, expected: str, what: str, rule: str) -> str:
    drifted = keep(_styled(hits, name), lambda s: f"{s}.style NOT IN ({expected}, 'unknown')")
    found = transform(drifted, lambda s: _drift(
        "naming", f"{what.lower()}_naming", rule, "low",
        f"concat('{what} \\'', {s}.name, '\\' uses \\'', {s}.style, "
        f"'\\' naming but project standard is \\'', {expected}, '\\'')",
        expected, f"{s}.style", line=Sql(f"{s}.line"), col=Sql(f"{s}.col"),
        suggestion=Sql(naming.convert_naming_style(f"{s}.name", expected)),
    ))
    return f"if({expected} IS NULL, {NO_VIOLATIONS}, {found})"


def _constant_naming(hits: str) -> str:
    expected = f"{_REC}.naming.constants"
    styled = _styled(hits, text.constant_name)
    drifted = keep(styled, lambda s: f"{s}.style <> 'UPPER_CASE'")
    found = transform(drifted, lambda s: _drift(
        "naming", "constant_naming", CONSTANT_NAMING, "low",
        f"concat('Constant \\'', {s}.name, '\\' should use ', {expected}, ' naming convention')",
        expected, f"{s}.style", line=Sql(f"{s}.line"), col=Sql(f"{s}.col"),
    ))
    return f"if({expected} <=> 'UPPER_CASE', {found}, {NO_VIOLATIONS})"


def _import_checks(hit: str) -> str:
    """Violations of one import, in the order style, extension, library."""
    style, extensions = f"{_REC}.imports.style", f"{_REC}.imports.extensions"

    def check(p):
        at = {"line": Sql(f"{hit}.line"), "col": Sql(f"{hit}.col")}
        relative = text.is_relative_import(p)
        found = [
            _one(f"{relative} AND {style} <=> 'absolute'", _drift(
                "import", "import_style", IMPORT_STYLE, "low",
                q("Relative import detected but project prefers absolute imports"),
                style, q("relative"), **at,
            )),
            _one(f"NOT {relative} AND {style} <=> 'relative' AND {text.is_internal_import(p)}", _drift(
                "import", "import_style", IMPORT_STYLE, "low",
                q("Absolute import for internal module but project prefers relative imports"),
                style, q("absolute"), **at,
            )),
            let(text.import_extension(p), lambda actual: _one(
                f"{extensions} IS NOT NULL AND {actual} <> {extensions}", _drift(
                    "import", "import_extensions", IMPORT_EXTENSIONS, "info",
                    f"concat('Import ', {actual}, ' extensions but project standard is ', {extensions})",
                    extensions, actual, **at,
                ))),
            _one(text.is_discouraged_import(p), _drift(
                "import", "discouraged_library", DISCOURAGED_LIBRARY, "high",
                f"concat('Import of discouraged library \\'', {text.import_library(p)}, '\\'')", **at,
            )),
        ]
        return f"concat({', '.join(found)})"

    return let(text.import_path(f"{hit}.text"), check)


def _folders() -> str:
    folders = f"{_REC}.architecture.commonFolders"
    found = _drift(
        "architecture", "folder_structure", FOLDER_STRUCTURE, "info",
        q("File location may not follow established folder patterns"),
        f"concat('One of: ', array_join({folders}, ', '))", text.dirname("path"),
    )
    return _one(f"size({folders}) > 0 AND NOT exists({folders}, f -> contains(path, f))", found)


def _comments() -> str:
    style, density = f"{_REC}.comments.style", f"{_REC}.comments.density"

    def check(c):
        mismatch = lambda what, actual, expected: (
            f"concat('Comment {what} \\'', {actual}, '\\' differs from project standard \\'', {expected}, '\\'')"
        )
        by_expected = case([(f"{density} = '{k}'", q(v)) for k, v in DENSITY_SEVERITY.items()], "'info'")
        found = [
            _one(f"{c}.style <> {style}", _drift(
                "comment", "comment_style", COMMENT_STYLE, "info",
                mismatch("style", f"{c}.style", style), style, f"{c}.style",
            )),
            _one(f"{c}.level <> {density}", _drift(
                "comment", "comment_density", COMMENT_DENSITY, Sql(by_expected),
                mismatch("density", f"{c}.level", density), density, f"{c}.level",
            )),
        ]
        both = f"{style} IS NOT NULL AND {density} IS NOT NULL"
        return f"if({both}, concat({', '.join(found)}), {NO_VIOLATIONS})"

    return let(text.comment_profile("content"), check)


# Detectors that need the places of a pattern, and those that look at the file as a whole.
_PLACED = {
    "variable_naming": (text.VARIABLES, lambda hits: _identifier_naming(
        hits, text.variable_name, f"{_REC}.naming.variables", "Variable", VARIABLE_NAMING)),
    "function_naming": (text.FUNCTIONS["drift"], lambda hits: _identifier_naming(
        hits, lambda t: text.function_name(t, "drift"), f"{_REC}.naming.functions", "Function",
        FUNCTION_NAMING)),
    "constant_naming": (text.CONSTANTS, _constant_naming),
    "imports": (text.IMPORTS, lambda hits: f"flatten({transform(hits, _import_checks)})"),
}
_WHOLE = {"file_naming": _file_naming, "folders": _folders, "comments": _comments}
DETECTORS = [
    "file_naming", "variable_naming", "function_naming", "constant_naming", "imports", "folders", "comments",
]


def all_violations(detectors=None) -> str:
    """SQL text over (path, content, profile): every violation of the file, info included."""
    chosen = [d for d in DETECTORS if detectors is None or d in detectors]
    placed = [d for d in chosen if d in _PLACED]

    def listed(found):
        parts = [
            _PLACED[d][1](f"get({found}, {placed.index(d)})") if d in _PLACED else _WHOLE[d]()
            for d in chosen
        ]
        return f"cast(concat({', '.join(parts + [NO_VIOLATIONS])}) AS array<{VIOLATION}>)"

    if not placed:
        return listed("NULL")
    return let(rx.all_hits("content", [_PLACED[d][0] for d in placed]), listed)


def detect(
    files: DataFrame, include_info: bool = False, detectors=None, threshold: float | None = None,
    context: int | None = None, keep_cols=("path",),
) -> DataFrame:
    """files(path, content, profile) -> kept columns, ``score``, ``violations`` array.

    Scores count info violations even when they are left out of the list. ``threshold`` keeps files
    whose score/100 is below it; ``context`` adds that many lines around each violation.
    """
    scored = files.selectExpr(
        *keep_cols, *(["split(content, '\\n', -1) AS lines"] if context else []),
        f"{all_violations(detectors)} AS found",
    ).selectExpr(
        *keep_cols, *(["lines"] if context else []),
        f"{scoring.drift_score('found')} AS score",
        "found AS violations" if include_info
        else f"{keep('found', lambda v: f'{v}.severity <> {q('info')}')} AS violations",
    )
    if threshold is not None:
        scored = scored.where(F.col("score") / 100 < threshold)
    if context:
        around = transform("violations", lambda v: text.line_context("lines", f"{v}.line", context))
        scored = scored.selectExpr(*keep_cols, "score", "violations", f"{around} AS context")
    return scored


def summary(detected: DataFrame) -> DataFrame:
    """One row for a corpus: files, violations in total and per severity, overall score (100 if none)."""
    per = [
        F.coalesce(F.sum(F.expr(f"size(filter(violations, v -> v.severity = '{s}'))")), F.lit(0))
        .alias(f"{s}_violations")
        for s in scoring.SEVERITIES[:-1]
    ]
    return detected.agg(
        F.count("*").alias("files_analyzed"),
        F.coalesce(F.sum(F.expr("size(violations)")), F.lit(0)).alias("total_violations"), *per,
        F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(100)).alias("overall_score"),
    )


def summary_by_folder(detected: DataFrame) -> DataFrame:
    """The summary per folder and for the whole corpus (folder null)."""
    return (
        detected.selectExpr(f"{text.dirname('path')} AS folder", "score", "size(violations) AS n")
        .rollup("folder")
        .agg(
            F.count("*").alias("files_analyzed"), F.sum("n").alias("total_violations"),
            F.floor(F.avg("score") + 0.5).alias("overall_score"),
        )
    )


def bulk_fixes(violations: str) -> str:
    """SQL text: one entry per type and category with several violations, in order of appearance.

    The message shows the key with its first '_' only replaced by a space.
    """
    key = lambda v: f"concat({v}.type, '_', {v}.category)"
    keys = f"array_distinct({transform(violations, key)})"
    grouped = transform(
        keys, lambda k: struct(k=k, vs=keep(violations, lambda v: f"{key(v)} = {k}"))
    )
    return transform(
        keep(grouped, lambda g: f"size({g}.vs) > 1"),
        lambda g: struct(
            type="'bulk_fix'", category=f"{g}.k",
            message=f"concat('Consider fixing all ', size({g}.vs), ' ', "
                    f"regexp_replace({g}.k, '^([^_]*)_', '$1 '), ' violations')",
            affected_lines=f"transform({g}.vs, v -> v.line)",
            priority=f"get({g}.vs, 0).severity",
        ),
    )
