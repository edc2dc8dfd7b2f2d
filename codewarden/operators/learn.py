"""Learning a corpus' conventions by counting.

One pass over the files: each file adds its own counts in the row, Spark sums them per
(section, field, key) with a map-side combine, and the few winners per field become a one-row profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import naming, text
from codewarden.functions.regex import contains, quick
from codewarden.functions.sql import case, keep, let, q, struct, transform
from codewarden.schemas import PROFILE

# The declared keys of each counter, in their order; the first wins ties and empty counters.
KEYS = {
    ("naming", "variables"): ["camelCase", "snake_case", "PascalCase"],
    ("naming", "functions"): ["camelCase", "snake_case", "PascalCase"],
    ("naming", "constants"): ["UPPER_CASE", "camelCase", "PascalCase"],
    ("naming", "files"): ["camelCase", "kebab-case", "snake_case", "PascalCase"],
    ("imports", "style"): ["relative", "absolute"],
    ("imports", "extensions"): ["explicit", "implicit"],
    ("architecture", "exportStyles"): ["named", "default", "mixed"],
    ("testing", "fileNaming"): ["spec", "test"],
    ("comments", "style"): ["single", "multi", "jsdoc"],
    ("comments", "density"): ["high", "medium", "low", "none"],
}
TOP = 10
_ENTRIES = "array<struct<section:string,field:string,key:string,n:bigint>>"
_NONE = f"cast(array() AS {_ENTRIES})"


def _entry(section: str, field: str, key: str, n: str = "1") -> str:
    return struct(
        section=q(section), field=q(field), key=f"cast({key} AS string)", n=f"cast({n} AS bigint)"
    )


def _names(content: str, name, pattern: str) -> str:
    return transform(f"regexp_extract_all({content}, {q(quick(pattern))}, 0)", name)


def _styles(names: str, field: str) -> str:
    """Identifier styles of a name array, one entry per style present."""
    return let(
        keep(transform(names, naming.identifier_style), lambda s: f"{s} IS NOT NULL"),
        lambda styles: transform(
            f"array_distinct({styles})",
            lambda s: _entry("naming", field, s, f"size({keep(styles, lambda x: f'{x} = {s}')})"),
        ),
    )


def _naming(compat: bool) -> str:
    variables = _names("content", text.variable_name, text.VARIABLE)
    functions = _names("content", lambda m: text.function_name(m, "learn"), text.FUNCTION["learn"])
    constants = f"regexp_count(content, {q(text.CONSTANT)})"
    return (
        f"concat({_styles(variables, 'variables')}, "
        f"{_NONE if compat else _styles(functions, 'functions')}, "
        f"array({_entry('naming', 'constants', q('UPPER_CASE'), constants)}, "
        f"{_entry('naming', 'files', naming.file_style(text.stem('path')))}))"
    )


def _imports() -> str:
    def entries(p):
        relative = text.is_relative_import(p)
        return "array(" + ", ".join([
            _entry("imports", "style", f"if({relative}, 'relative', 'absolute')"),
            _entry("imports", "extensions", text.import_extension(p)),
            _entry("imports", "libraries", f"if({relative}, NULL, {text.import_library(p)})"),
        ]) + ")"

    paths = _names("content", text.import_path, text.IMPORT)
    return f"if({contains('content', 'import')}, flatten({transform(paths, entries)}), {_NONE})"


def _architecture() -> str:
    return "array(" + ", ".join([
        _entry("architecture", "exportStyles", text.export_style("content")),
        _entry("architecture", "folderStructure", f"nullif({text.dirname('path')}, '')"),
        _entry("architecture", "fileTypes", text.extname("path")),
        _entry("architecture", "files", q("all")),
    ]) + ")"


def _testing() -> str:
    base = text.basename("path")
    has = lambda token: contains("content", token)
    entries = "array(" + ", ".join([
        _entry("testing", "fileNaming", f"if({contains(base, '.spec.')}, 'spec', NULL)"),
        _entry("testing", "fileNaming", f"if({contains(base, '.test.')}, 'test', NULL)"),
        _entry("testing", "framework", f"if({has('describe(')} OR {has('it(')}, 'jest/mocha', NULL)"),
        _entry("testing", "framework", f"if({has('test(')}, 'jest', NULL)"),
    ]) + ")"
    return f"if({text.is_learner_test('path')}, {entries}, {_NONE})"


def _comments() -> str:
    return let(text.comment_profile("content"), lambda c: "array(" + ", ".join([
        _entry("comments", "style", q("single"), f"{c}.single"),
        _entry("comments", "style", q("multi"), f"{c}.multi"),
        _entry("comments", "style", q("jsdoc"), f"{c}.jsdoc"),
        _entry("comments", "density", f"{c}.level"),
    ]) + ")")


def pattern_counts(files: DataFrame, compat: bool = False, sections=None) -> DataFrame:
    """pattern_counts(section, field, key, n) over all files; ``sections`` limits what is counted.

    ``compat`` counts no function names, which is the historical behaviour.
    """
    parts = {
        "naming": lambda: _naming(compat), "imports": _imports, "architecture": _architecture,
        "testing": _testing, "comments": _comments,
    }
    wanted = list(parts) if sections is None else list(sections)
    entries = f"concat({', '.join([parts[s]() for s in wanted] + [_NONE])})"
    counted = keep(entries, lambda e: f"{e}.key IS NOT NULL AND {e}.n > 0")
    rows = files.selectExpr(f"inline({counted})")
    return rows.groupBy("section", "field", "key").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` keys per field, most frequent first; ties go to the declared order, then the name.

    Spark turns the row_number filter into a per-task group limit before the shuffle, so a field with
    very many keys (libraries, folders) sends only its leaders to one task.
    """
    order = case([
        (f"section = '{s}' AND field = '{f}'", f"coalesce(array_position({_list(keys)}, key), 0)")
        for (s, f), keys in KEYS.items()
    ], "0")
    rank = "row_number() OVER (PARTITION BY section, field ORDER BY n DESC, ord, key) AS rank"
    return counts.selectExpr("*", f"{order} AS ord").selectExpr("*", rank).where(f"rank <= {top}")


def _list(keys) -> str:
    return "array(" + ", ".join(q(k) for k in keys) + ")"


def _winner(section: str, field: str) -> str:
    best = f"max(key) FILTER (WHERE section = '{section}' AND field = '{field}' AND rank = 1)"
    default = KEYS.get((section, field))
    return f"coalesce({best}, {q(default[0])})" if default else best


def _leaders(section: str, field: str) -> str:
    listed = (
        "array_sort(collect_list(named_struct('rank', rank, 'key', key)) "
        f"FILTER (WHERE section = '{section}' AND field = '{field}'))"
    )
    return f"transform({listed}, p -> p.key)"


def profile(counts: DataFrame, compat: bool = False) -> DataFrame:
    """One row (confidence, recommendations) from the counts.

    ``compat`` keeps two quirks: confidence is always low, and kebab files are called ``kebab_case``.
    """
    total = "coalesce(max(n) FILTER (WHERE section = 'architecture' AND field = 'files'), 0)"
    confidence = "'low'" if compat else case(
        [(f"{total} < 10", "'low'"), (f"{total} < 50", "'medium'")], "'high'"
    )
    file_naming = _winner("naming", "files")
    if compat:
        file_naming = f"replace({file_naming}, 'kebab-case', 'kebab_case')"
    recommendations = struct(
        naming=struct(
            variables=_winner("naming", "variables"), functions=_winner("naming", "functions"),
            constants=_winner("naming", "constants"), files=file_naming,
        ),
        imports=struct(
            style=_winner("imports", "style"), extensions=_winner("imports", "extensions"),
            popularLibraries=_leaders("imports", "libraries"),
        ),
        architecture=struct(
            exportStyle=_winner("architecture", "exportStyles"),
            commonFolders=_leaders("architecture", "folderStructure"),
        ),
        testing=struct(
            fileNaming=_winner("testing", "fileNaming"), framework=_winner("testing", "framework")
        ),
        comments=struct(style=_winner("comments", "style"), density=_winner("comments", "density")),
    )
    return ranked(counts).agg(
        F.expr(confidence).alias("confidence"), F.expr(recommendations).alias("recommendations")
    )


def learn(files: DataFrame, compat: bool = False) -> DataFrame:
    """Learn the one-row profile of a corpus in one pass over its files."""
    return profile(pattern_counts(files, compat), compat)


def with_profile(files: DataFrame, learned: DataFrame | None) -> DataFrame:
    """Add the profile as a struct column: a scalar subquery, so nothing is joined or shuffled."""
    if learned is None:
        return files.withColumn("profile", F.lit(None).cast(PROFILE))
    one = learned.select(F.struct("confidence", "recommendations").alias("profile"))
    return files.withColumn("profile", one.scalar())


def top_keys(counts: DataFrame, field: str, n: int = TOP) -> DataFrame:
    """The n most frequent keys of one counter (libraries, folders)."""
    return (
        counts.where(F.col("field") == field).select("key", "n")
        .orderBy(F.desc("n"), F.col("key")).limit(n)
    )
