"""Review rows parsed from model responses, and the suggestion texts that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.sql import case, let

# Issue types with their suggestion, per review kind.
PRACTICE = [
    ("no-var", "concat('Replace \\'var\\' with \\'let\\' or \\'const\\' on line ', line, ' for better variable scoping.')"),
    ("missing-semicolon", "concat('Add a semicolon at the end of line ', line, '.')"),
    ("long-line", "concat('Break line ', line, ' into shorter lines for readability.')"),
    ("error", "message"),
]
PRACTICE_DEFAULT = "concat('Review: ', message)"
PERFORMANCE = [
    ("loop-inefficiency", "concat('Replace inefficient loop on line ', line, ' with a more optimized structure, such as using \"map\" instead of \"forEach\" if you\\'re transforming arrays.')"),
    ("redundant-recalculation", "concat('Cache the result of expensive calculations performed multiple times on line ', line, '.')"),
    ("error", "message"),
]
PERFORMANCE_DEFAULT = "concat('Review performance issue: ', message)"


def _suggestion(kinds, default: str) -> str:
    return case([(f"type = '{k}'", value) for k, value in kinds], default)


def practice_suggestion() -> str:
    """SQL text over (type, line, message)."""
    return _suggestion(PRACTICE, PRACTICE_DEFAULT)


def performance_suggestion() -> str:
    return _suggestion(PERFORMANCE, PERFORMANCE_DEFAULT)


def reviewable(files: DataFrame) -> DataFrame:
    """Files worth sending to a reviewer: not blank."""
    return files.where(f"NOT ({text.is_blank('content')})")


def practice_issues(responses: DataFrame, keep_cols=("path",)) -> DataFrame:
    """One row per issue; responses that are not a JSON array give none.

    The reviewer's own suggestion is kept as ``model_suggestion``: issues have no type, so the text
    shown is the default one.
    """
    schema = "array<struct<type:string,line:int,message:string,suggestion:string>>"
    lists = responses.where("kind = 'practice' AND startswith(ltrim(response), '[')")
    rows = lists.select(
        *keep_cols, F.posexplode(F.concat(F.from_json("response", schema), F.array().cast(schema)))
        .alias("seq", "i"),
    )
    return rows.selectExpr(
        *keep_cols, "seq", "cast(NULL AS string) AS type", "i.line AS line", "i.message AS message",
        "i.suggestion AS model_suggestion",
    ).selectExpr(
        *keep_cols, "seq", "'AI' AS source", "'info' AS severity", "line", "message",
        f"{practice_suggestion()} AS suggestion", "model_suggestion",
    )


def performance_reviews(responses: DataFrame, keep_cols=("path",)) -> DataFrame:
    """kept columns, metrics map, issues and suggestions arrays.

    The JSON object is whatever lies between the first and the last brace; parts of the wrong type
    become empty.
    """
    start = "locate('{', response)"
    last = "length(response) - length(substring_index(response, '}', -1))"
    body = f"substr(response, {start}, greatest({last} - {start} + 1, 0))"
    parsed = responses.where("kind = 'performance'").selectExpr(
        *keep_cols, f"from_json({body}, 'map<string,string>') AS top"
    )
    issue = (
        "struct<type:string,line:int,message:string,codeSnippet:string,`code snippet`:string,snippet:string>"
    )
    suggestion = "struct<description:string,codeSnippet:string,code:string>"
    snippet = lambda *names: "coalesce(" + ", ".join([f"nullif({n}, '')" for n in names] + ["''"]) + ")"

    def read_issue(raw):
        return let(f"from_json({raw}, '{issue}')", lambda i: (
            f"named_struct('type', {i}.type, 'line', {i}.line, 'message', coalesce({i}.message, "
            f"if(startswith({raw}, '{{'), NULL, {raw})), "
            f"'code_snippet', {snippet(f'{i}.codeSnippet', f'{i}.`code snippet`', f'{i}.snippet')})"
        ))

    def read_suggestion(raw):
        return let(f"from_json({raw}, '{suggestion}')", lambda s: (
            f"named_struct('description', if(startswith({raw}, '{{'), {s}.description, {raw}), "
            f"'code_snippet', if(startswith({raw}, '{{'), {snippet(f'{s}.codeSnippet', f'{s}.code')}, ''))"
        ))

    items = lambda name: (
        f"if(startswith(ltrim(top['{name}']), '['), from_json(top['{name}'], 'array<string>'), "
        "cast(array() AS array<string>))"
    )
    metrics = (
        "if(startswith(ltrim(top['metrics']), '{'), from_json(top['metrics'], 'map<string,string>'), "
        "cast(map() AS map<string,string>))"
    )
    return parsed.selectExpr(
        *keep_cols, f"{metrics} AS metrics",
        f"transform({items('issues')}, r -> {read_issue('r')}) AS issues",
        f"transform({items('suggestions')}, r -> {read_suggestion('r')}) AS suggestions",
    )


def performance_rows(reviews: DataFrame, keep_cols=("path",)) -> DataFrame:
    """Long form: one row per metric, issue and suggestion of a review."""
    entry = "struct<kind:string,seq:int,name:string,line:int,text:string,code_snippet:string>"
    metric = (
        "transform(array_sort(map_entries(metrics)), (m, i) -> named_struct('kind', 'metric', 'seq', i, "
        "'name', m.key, 'line', cast(NULL AS int), 'text', m.value, 'code_snippet', ''))"
    )
    issue = (
        "transform(issues, (x, i) -> named_struct('kind', 'issue', 'seq', i, 'name', x.type, "
        "'line', x.line, 'text', x.message, 'code_snippet', x.code_snippet))"
    )
    suggestion = (
        "transform(suggestions, (x, i) -> named_struct('kind', 'suggestion', 'seq', i, 'name', "
        "cast(NULL AS string), 'line', cast(NULL AS int), 'text', x.description, 'code_snippet', x.code_snippet))"
    )
    rows = reviews.selectExpr(
        *keep_cols, f"inline(cast(concat({metric}, {issue}, {suggestion}) AS array<{entry}>))"
    )
    advised = rows.selectExpr("*", "name AS type", "text AS message")
    return advised.selectExpr(
        *keep_cols, "kind", "seq", "name", "line", "text", "code_snippet",
        f"if(kind = 'issue', {performance_suggestion()}, NULL) AS suggestion",
    )
