"""Rule configuration: seed sets, JSON documents, exceptions, validation, history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions.sql import array
from codewarden.schemas import EXCEPTIONS, RULES, RULES_CONFIG

# Known categories and severities, the default and the initial rule set.
CATEGORIES = ["security", "performance", "architecture", "naming", "imports", "testing", "comments"]
RULE_SEVERITIES = ["low", "medium", "high", "critical"]
DEFAULT_RULES = [
    ("security/no-eval", "No eval() usage", "Prohibits the use of eval() function", "critical", {}),
    ("performance/no-sync-fs", "No synchronous file operations",
     "Prohibits synchronous file system operations", "high", {}),
]
INITIAL_RULES = [
    ("security/no-eval", "Prohibit eval() usage",
     "The eval() function poses security risks and should not be used", "critical", {}),
    ("security/no-dangerous-html", "Avoid dangerous HTML manipulation",
     "Direct innerHTML/outerHTML manipulation can lead to XSS vulnerabilities", "high", {}),
    ("security/require-company-fetch", "Use company fetch wrapper",
     "All API calls must use the company fetch wrapper instead of raw fetch", "medium",
     {"wrapperName": "companyFetch"}),
    ("performance/no-sync-fs", "Avoid synchronous file operations",
     "Synchronous file operations block the event loop", "high", {}),
    ("architecture/feature-folder-structure", "Use feature folder structure",
     "Code should be organized by features, not by file types", "medium", {}),
    ("naming/camelcase-variables", "Use camelCase for variables",
     "Variables should follow camelCase naming convention", "low", {}),
]


def _rows(spark: SparkSession, rules) -> DataFrame:
    rows = [
        (rule_id, rule_id.split("/")[0], name, description, severity, True, parameters, i)
        for i, (rule_id, name, description, severity, parameters) in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES)


def default_rules(spark: SparkSession) -> DataFrame:
    return _rows(spark, DEFAULT_RULES)


def initial_rules(spark: SparkSession) -> DataFrame:
    return _rows(spark, INITIAL_RULES)


def no_exceptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EXCEPTIONS)


def parse_config(texts: DataFrame, column: str = "value", keep_cols=()) -> DataFrame:
    """One config document per row -> column ``config``; null when the text is not JSON."""
    return texts.select(*keep_cols, F.from_json(F.col(column), RULES_CONFIG).alias("config"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return parse_config(spark.read.text(path, wholetext=True))


def rules_of(config: DataFrame, keep_cols=()) -> DataFrame:
    """Rules of enabled categories, with defaults: name = id, severity = medium, enabled unless false.

    A rule's own ``message`` is not used; only ``parameters.message`` is.
    """
    categories = config.selectExpr(*keep_cols, "posexplode(config.rules) AS (c_ord, category, c)")
    rules = categories.where("c.enabled").selectExpr(
        *keep_cols, "c_ord", "category", "posexplode(c.rules) AS (r_ord, id, r)"
    )
    return rules.selectExpr(
        *keep_cols,
        "concat(category, '/', id) AS rule_id",
        "category",
        "coalesce(nullif(r.name, ''), id) AS name",
        "coalesce(r.description, '') AS description",
        "coalesce(nullif(r.severity, ''), 'medium') AS severity",
        "coalesce(r.enabled, true) AS enabled",
        "coalesce(r.parameters, map()) AS parameters",
        "cast(c_ord * 10000 + r_ord AS int) AS ord",
    )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a config file; the default set when the file is missing."""
    try:
        return rules_of(read_config(spark, path))
    except AnalysisException:
        return default_rules(spark)


def exceptions_of(config: DataFrame) -> DataFrame:
    listed = config.selectExpr("posexplode(config.exceptions) AS (pos, e)").select("pos", "e.*")
    return normalise_exceptions(listed)


def normalise_exceptions(exceptions: DataFrame) -> DataFrame:
    """Missing file or rule means '*'; of equal (file, rule) pairs the last (by ``pos``) counts."""
    if "pos" not in exceptions.columns:
        exceptions = exceptions.withColumn("pos", F.lit(0))
    return (
        exceptions.selectExpr(
            "coalesce(nullif(file, ''), '*') AS file", "coalesce(nullif(rule, ''), '*') AS rule",
            "reason", "expires", "pos",
        )
        .groupBy("file", "rule")
        .agg(F.max_by(F.struct("reason", "expires"), "pos").alias("last"))
        .select("file", "rule", "last.reason", "last.expires")
    )


def _missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def validate_config(config: DataFrame, keep_cols=()) -> DataFrame:
    """(rule_id, level, message) for the document: missing parts are errors, unknown categories warnings."""
    checks = F.array(
        F.when(F.expr("config.metadata IS NULL"), "Missing required section: metadata"),
        F.when(F.expr("config.rules IS NULL"), "Missing required section: rules"),
        *[
            F.when(F.expr("config.metadata IS NOT NULL") & _missing(F.col(f"config.metadata.{f}")),
                   f"Missing required metadata field: {f}")
            for f in ("version", "name")
        ],
    )
    none = F.lit(None).cast("string")
    errors = config.select(*keep_cols, F.explode(F.filter(checks, lambda m: m.isNotNull())).alias("message"))
    unknown = config.selectExpr(
        *keep_cols, f"explode(array_except(map_keys(config.rules), {array(CATEGORIES)})) AS category"
    )
    return errors.select(*keep_cols, none.alias("rule_id"), F.lit("error").alias("level"), "message").unionByName(
        unknown.select(
            *keep_cols, none.alias("rule_id"), F.lit("warning").alias("level"),
            F.concat(F.lit("Unknown rule category: "), F.col("category")).alias("message"),
        )
    )


def validate_rules(rules: DataFrame, keep_cols=()) -> DataFrame:
    """(rule_id, level, message): unnamed or undescribed rules are warnings, bad severities errors."""
    warnings = rules.where(_missing(F.col("name")) | _missing(F.col("description"))).selectExpr(
        *keep_cols, "rule_id", "'warning' AS level",
        "concat('Rule ', rule_id, ' is missing name or description') AS message",
    )
    errors = rules.where(~F.col("severity").isin(RULE_SEVERITIES)).selectExpr(
        *keep_cols, "rule_id", "'error' AS level",
        "concat('Rule ', rule_id, ' has invalid severity: ', severity) AS message",
    )
    return warnings.unionByName(errors)


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("rule_id") == rule_id)


def rules_by_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.col("category") == category)


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where("enabled")


def history_entry(config: DataFrame, rules: DataFrame, loaded_at) -> DataFrame:
    """One row to append to the rule history: load time, version, number of rules."""
    n = rules.agg(F.count("*").alias("n")).scalar()
    return config.select(
        F.lit(loaded_at).cast("timestamp").alias("ts"), F.col("config.metadata.version").alias("version"),
        n.alias("rules_count"),
    )
