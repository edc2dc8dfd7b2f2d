"""User-defined rules beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from codewarden.functions.sql import q, transform
from codewarden.schemas import RULES, Sql, violation


@dataclass(frozen=True)
class RegisteredRule:
    rule_id: str
    category: str
    severity: str
    build: Callable[[str], str]


_RULES: dict[str, RegisteredRule] = {}


def register_rule(rule_id: str, category: str, severity: str, findings: Callable[[], str]) -> None:
    """Add a rule given as SQL over (path, content, profile): array<struct<line:int, message:string>>.

    It runs when the rule table holds an enabled row of this id, and is subject to exceptions like any
    other rule.
    """

    def build(rule: str) -> str:
        return transform(findings(), lambda f: violation(
            source="rule", rule=rule_id, category=Sql(f"{rule}.category"), type="rule",
            severity=Sql(f"{rule}.severity"), line=Sql(f"{f}.line"), message=Sql(f"{f}.message"),
        ))

    _RULES[rule_id] = RegisteredRule(rule_id, category, severity, build)


def sql_check(spark: SparkSession, name: str, body: str) -> Callable[[], str]:
    """A check as a SQL function of the session's catalog, for :func:`register_rule`.

    ``body`` is an expression over ``path`` and ``content`` that gives array<struct<line:int, message:string>>;
    the optimizer puts it in the place of the call, so it runs with the other rules in the file's row.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(path STRING, content STRING) "
              f"RETURNS ARRAY<STRUCT<line: INT, message: STRING>> RETURN {body}")
    return lambda: f"{name}(path, content)"


def table_check(spark: SparkSession, name: str, handler: type) -> None:
    """A check that no expression covers as a table function of the catalog: ``handler.eval(path, content)``
    yields (line, message)."""
    spark.udtf.register(name, udtf(handler, returnType="line int, message string"))


def table_rule(files: DataFrame, name: str, rule_id: str, category: str, severity: str) -> DataFrame:
    """(path, rule, category, severity, line, message) rows of a registered table function over files."""
    view = f"files_of_{name}"
    files.select("path", "content").createOrReplaceTempView(view)
    return files.sparkSession.sql(
        f"SELECT f.path, {q(rule_id)} AS rule, {q(category)} AS category, {q(severity)} AS severity, t.line, t.message "
        f"FROM {view} f, LATERAL {name}(f.path, f.content) t")


def unregister_rule(rule_id: str) -> None:
    _RULES.pop(rule_id, None)


def registered_rules() -> dict[str, RegisteredRule]:
    return dict(_RULES)


def registered_rule_rows(spark) -> DataFrame | None:
    """Rule-table rows of the registered rules, to union with the configured ones."""
    rows = [
        (r.rule_id, r.category, r.rule_id, "", r.severity, True, {}, 1_000_000 + i)
        for i, r in enumerate(_RULES.values())
    ]
    return spark.createDataFrame(rows, RULES) if rows else None


def python_rule(
    files: DataFrame, rule_id: str, category: str, severity: str,
    check: Callable[[str, str], list[tuple[int, str]]],
) -> DataFrame:
    """Fallback for checks that no SQL expression covers: ``check(path, content)`` per file.

    Runs in Arrow batches over the files' own partitions and yields (path, rule, category, severity,
    line, message) rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, rule_id, category, severity, line, message)
                for path, content in zip(batch["path"], batch["content"], strict=True)
                for line, message in check(path, content)
            ]
            yield pd.DataFrame(
                rows, columns=["path", "rule", "category", "severity", "line", "message"]
            )

    schema = "path string, rule string, category string, severity string, line int, message string"
    return files.select("path", "content").mapInPandas(run, schema)
