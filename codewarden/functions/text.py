"""Line, path, identifier and comment functions on file contents (SQL expression text)."""

from __future__ import annotations

from codewarden.functions import regex as rx
from codewarden.functions.regex import contains, js, matches, starting
from codewarden.functions.sql import case, let, q, struct

# The patterns that define identifiers, imports, exports and comments.
NAME = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
VARIABLE = starting("lcv", js(rf"(?:let|const|var)\s+({NAME})"))
CONSTANT = js(r"const\s+([A-Z][A-Z0-9_]*)\s*=")
IMPORT = js(r"""import\s+.*?\s+from\s+['"`]([^'"`]+)['"`]""")
_FUNCTION = rf"(?:function\s+({NAME})|(?:const|let)\s+({NAME})\s*=\s*(?:async\s+)?"
FUNCTION = {
    "learn": starting("fcl", js(_FUNCTION + r"\()")),
    "detect": starting("fcl", js(_FUNCTION + r"(?:\([^)]*\)\s*=>|function))")),
    "drift": starting("fcl", js(_FUNCTION + r"(?:\([^)]*\)\s*=>|\([^)]*\)))")),
    "audit": starting("fcl", js(_FUNCTION + r"(?:\([^)]*\)\s*=>|\())")),
}
NAMED_EXPORT = js(r"export\s+(?:const|let|var|function|class)")
DEFAULT_EXPORT = js(r"export\s+default")
LINE_COMMENT = js(r"//.*")
BLOCK_COMMENT = js(r"/\*[\s\S]*?\*/")
DOC_COMMENT = js(r"/\*\*[\s\S]*?\*/")
DISCOURAGED = ["eval", "vm", "child_process"]


def first_line_of(content: str, literal: str) -> str:
    """Line of the first occurrence of a literal that is known to occur (its length if it does not)."""
    return line_at(content, q(literal))


def line_at(content: str, token: str) -> str:
    """Line of the first occurrence of a token expression."""
    return let(f"substring_index({content}, {token}, 1)", lambda head: f"{rx.newlines(head)} + 1")


def line_number(content: str, offset: str) -> str:
    """Line of a 0-based character offset."""
    return let(f"left({content}, {offset})", lambda head: f"{rx.newlines(head)} + 1")


def column_number(content: str, offset: str) -> str:
    """1-based column of a 0-based character offset."""
    return f"length(substring_index(left({content}, {offset}), '\\n', -1)) + 1"


def line_count(content: str) -> str:
    return f"({rx.newlines(content)} + 1)"


def line_context(lines: str, line: str, size: int = 3) -> str:
    """The line and up to ``size`` lines on either side: struct<before, line, after>."""
    start = f"greatest({line} - {size}, 1)"
    return struct(
        before=f"slice({lines}, {start}, greatest({line} - {start}, 0))",
        line=f"coalesce(get({lines}, {line} - 1), '')",
        after=f"slice({lines}, {line} + 1, {size})",
    )


def basename(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def extname(path: str) -> str:
    """Extension with its dot; dot-files and '..' have none."""
    return f"regexp_extract({path}, {q(r'(?s)^(?:.*/)?(?!\.\.\z)[^/]+(\.[^./]*)\z')}, 1)"


def dirname(path: str) -> str:
    """Parent folder, '' for a bare file name."""
    return f"regexp_extract({path}, {q(r'(?s)^(.*)/[^/]*\z')}, 1)"


def stem(path: str) -> str:
    """Base name without its extension."""
    return f"regexp_extract({path}, {q(r'(?:^|/)([^/]+?)(?:\.[^./]*)?\z')}, 1)"


def relative_to(path: str, root: str) -> str:
    prefix = root.rstrip("/") + "/"
    return f"if(startswith({path}, {q(prefix)}), substr({path}, {len(prefix) + 1}), {path})"


def expected_test_path(path: str) -> str:
    """``dir/base.test.ext``."""
    folder = dirname(path)
    return f"concat(if({folder} = '', '', concat({folder}, '/')), {stem(path)}, '.test', {extname(path)})"


def in_feature_folder(path: str) -> str:
    return contains(path, "/")


def is_learner_test(path: str) -> str:
    return matches(path, r"(?:\.test\.|\.spec\.)[^/]*\z|(?:Test|Spec)\.js\z")


def is_audit_test(path: str) -> str:
    return f"({contains(path, '.test.')} OR {contains(path, '.spec.')})"


def is_blank(content: str) -> str:
    return f"NOT {matches(content, rx.NOT_SPACE)}"


# What to search in ``content`` for each kind of identifier: (pattern, gate, scope).
VARIABLES = (VARIABLE, "", None)
CONSTANTS = (CONSTANT, contains("content", "const"), None)
IMPORTS = (IMPORT, rx.may_contain("content", ["import", "from"]), None)
FUNCTIONS = {k: (p, "", None) for k, p in FUNCTION.items()}


def variables() -> str:
    """array<struct<text,line,col>> of variable declarations in ``content``."""
    return rx.hits("content", *VARIABLES)


def functions(dialect: str) -> str:
    return rx.hits("content", *FUNCTIONS[dialect])


def constants() -> str:
    return rx.hits("content", *CONSTANTS)


def imports() -> str:
    return rx.hits("content", *IMPORTS)


def variable_name(text: str) -> str:
    return rx.group(text, VARIABLE, 1)


def function_name(text: str, dialect: str) -> str:
    return rx.group(text, FUNCTION[dialect], 1, 2)


def constant_name(text: str) -> str:
    return rx.group(text, CONSTANT, 1)


def import_path(text: str) -> str:
    return rx.group(text, IMPORT, 1)


def is_relative_import(path: str) -> str:
    return f"startswith({path}, '.')"


def import_library(path: str) -> str:
    return f"substring_index({path}, '/', 1)"


def import_extension(path: str) -> str:
    return f"if({extname(path)} <> '', 'explicit', 'implicit')"


def is_internal_import(path: str) -> str:
    return f"(startswith({path}, '@') OR startswith({path}, '.'))"


def is_discouraged_import(path: str) -> str:
    return matches(path, "|".join(DISCOURAGED))


def export_style(content: str) -> str:
    """named / default / mixed, null without exports."""
    found = struct(
        named=f"{contains(content, 'export')} AND {matches(content, NAMED_EXPORT)}",
        default=f"{rx.may_contain(content, ['export', 'default'])} AND {matches(content, DEFAULT_EXPORT)}",
    )
    return let(found, lambda f: case([
        (f"{f}.named AND {f}.default", "'mixed'"), (f"{f}.named", "'named'"), (f"{f}.default", "'default'"),
    ]))


def comment_profile(content: str) -> str:
    """struct<single,multi,jsdoc,lines,level,style>; doc blocks also count as multi-line comments.

    Comments close with ``*/``, so nothing is searched behind the last one: an unclosed opening cannot
    send the lazy patterns through the rest of the file again and again.
    """

    def classify(c):
        density = f"({c}.single + {c}.multi + {c}.jsdoc) / {c}.lines"
        return struct(
            single=f"{c}.single", multi=f"{c}.multi", jsdoc=f"{c}.jsdoc", lines=f"{c}.lines",
            level=let(density, lambda d: case(
                [(f"{d} > 0.2D", "'high'"), (f"{d} > 0.1D", "'medium'"), (f"{d} > 0.05D", "'low'")],
                "'none'",
            )),
            style=case([
                (f"{c}.jsdoc >= {c}.single AND {c}.jsdoc >= {c}.multi", "'jsdoc'"),
                (f"{c}.multi >= {c}.single", "'multi'"),
            ], "'single'"),
        )

    return let(rx.upto_last(content, "*/"), lambda closed: let(struct(
        single=rx.count(content, LINE_COMMENT, contains(content, "//")),
        multi=rx.count(closed, BLOCK_COMMENT, contains(closed, "/*")),
        jsdoc=rx.count(closed, DOC_COMMENT, contains(closed, "/**")),
        lines=line_count(content),
    ), classify))
