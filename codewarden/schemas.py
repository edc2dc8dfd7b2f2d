"""Fixed schemas of the engine's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codewarden.functions.sql import q

RULES = (
    "rule_id string, category string, name string, description string, severity string, "
    "enabled boolean, parameters map<string,string>, ord int"
)
EXCEPTIONS = "file string, rule string, reason string, expires date"
RULES_CONFIG = (
    "struct<metadata:struct<version:string,name:string,description:string,author:string,created:string>,"
    "global:struct<severity:string,autofix:boolean,reportUnusedRules:boolean>,"
    "rules:map<string,struct<enabled:boolean,description:string,rules:map<string,struct<"
    "name:string,description:string,severity:string,enabled:boolean,message:string,"
    "parameters:map<string,string>>>>>,"
    "exceptions:array<struct<file:string,rule:string,reason:string,expires:date>>>"
)
PROFILE = (
    "struct<confidence:string,recommendations:struct<"
    "naming:struct<variables:string,functions:string,constants:string,files:string>,"
    "imports:struct<style:string,extensions:string,popularLibraries:array<string>>,"
    "architecture:struct<exportStyle:string,commonFolders:array<string>>,"
    "testing:struct<fileNaming:string,framework:string>,"
    "comments:struct<style:string,density:string>>>"
)
AI_SECTIONS = "path string, line int, reason string, confidence double"
AI_RESPONSE = (
    "struct<isLikelyAI:boolean,confidence:double,reasons:array<string>,"
    "sections:array<struct<line:int,reason:string>>>"
)
VIOLATION_FIELDS = {
    "source": "string", "rule": "string", "category": "string", "type": "string",
    "severity": "string", "line": "int", "col": "int", "message": "string",
    "expected": "string", "actual": "string", "suggestion": "string", "evidence": "string",
}
VIOLATION = "struct<" + ",".join(f"{k}:{v}" for k, v in VIOLATION_FIELDS.items()) + ">"
LOG_VIOLATIONS = "array<struct<rule:string,category:string,severity:string,message:string,line:int>>"
ANALYSIS_LOG = (
    "event string, file string, ts timestamp, "
    f"violations {LOG_VIOLATIONS}, insights array<string>, "
    "ai struct<isLikelyAI:boolean,confidence:double>, driftScore double, "
    "summary struct<hasViolations:boolean,hasInsights:boolean,totalIssues:int,severity:string>"
)


NO_VIOLATIONS = f"cast(array() AS array<{VIOLATION}>)"


def violation(**fields) -> str:
    """One violation struct as SQL text; plain strings and numbers are literals, left-out fields null.

    Wrap SQL expressions in :class:`Sql`.
    """
    unknown = set(fields) - set(VIOLATION_FIELDS)
    if unknown:
        raise ValueError(f"not violation fields: {sorted(unknown)}")
    parts = []
    for name, kind in VIOLATION_FIELDS.items():
        value = fields.get(name)
        text = value if isinstance(value, Sql) else q(value)
        parts.append(f"'{name}', cast({text} AS {kind})")
    return "named_struct(" + ", ".join(parts) + ")"


class Sql(str):
    """SQL expression text, as opposed to a literal."""


def explode_violations(df: DataFrame, array: str = "violations", keep=("path",)) -> DataFrame:
    """One row per violation, ``seq`` being its position in the file's list."""
    # concat() keeps the generator's input from being a bare column: Spark would otherwise infer a
    # size() filter on it, push that below and evaluate every regular expression twice.
    listed = f"posexplode(concat({array}, {NO_VIOLATIONS})) AS (seq, v)"
    return df.selectExpr(*keep, listed).select(*keep, "seq", "v.*")
