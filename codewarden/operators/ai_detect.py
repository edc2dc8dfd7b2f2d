"""AI-authorship indicators and the confidence derived from them.

Counting needs no positions, so confidence is a handful of regexp_count calls per file; positions are
worked out only when the indicators themselves are asked for. Lazy patterns get a ``scope``: the part
of the file up to the last place where their closing text occurs, which keeps them linear and exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import regex as rx
from codewarden.functions import scoring, text
from codewarden.functions.regex import js, starting
from codewarden.functions.sql import keep, let, q, struct, transform
from codewarden.schemas import AI_RESPONSE

# Indicator types with description, confidence and weight.
TYPES = {
    "comment_pattern": ("AI-typical comment structure detected", 0.6, 0.7),
    "naming_pattern": ("AI-typical function naming detected", 0.4, 0.4),
    "structure_pattern": ("AI-typical code structure detected", 0.5, 0.6),
    "import_pattern": ("AI-typical import pattern detected", 0.3, 0.3),
    "error_handling_pattern": ("AI-typical error handling detected", 0.7, 0.8),
    "documentation_pattern": ("AI-typical documentation detected", 0.5, 0.5),
    "ai_signature": ("Strong AI code signature detected", 0.8, 1.0),
}
MODEL_WEIGHT = 0.8
MODEL_CONFIDENCE = 0.5
MAX_CONFIDENCE = 0.95
EVIDENCE = {"error_handling_pattern": 150, "import_pattern": None}
EVIDENCE_DEFAULT = 100


@dataclass(frozen=True)
class Pattern:
    """``requires``: literals the match must contain, in lower case where case is ignored;
    ``tail``: the literal its lazy part runs to;
    ``first``: the letters it can start with;
    ``steps``: the pattern with what to skip where it fails. Behind a head without its tail no later head
    up to the end (of the line) has one either, so all of that is skipped and not walked again; a line is skipped
    only up to the last place where a head that ends in another line can begin;
    ``check``: tells what ``steps`` has found from what it has skipped, if the pattern itself is slow at that."""

    regex: str
    ignore_case: bool = False
    requires: tuple = ()
    tail: str | None = None
    extra: int = 0
    closes: bool = False
    first: str = ""
    steps: str = ""
    check: str = ""

    @property
    def rx(self) -> str:
        spelled = js(self.regex, self.ignore_case)
        return starting(self.first, spelled) if self.first else spelled

    def gate(self, lowered: str) -> str:
        """Condition without which the pattern cannot match; ``lowered`` is the lower-cased content."""
        return rx.may_contain(lowered if self.ignore_case else "content", self.requires)

    def spec(self, lowered: str) -> tuple:
        scope = self.scope("content")
        if self.steps:
            return (js(self.steps, self.ignore_case), self.gate(lowered), scope, js(self.check, self.ignore_case) if self.check else self.rx)
        return (self.rx, self.gate(lowered), scope)

    def scope(self, content: str) -> str | None:
        if self.tail is None:
            return None
        return rx.upto_close_after(content, self.tail) if self.closes else rx.upto_last(
            content, self.tail, self.extra)


# Steps of a head and the first tail behind it, and of a head and the last tail on its line ({2}: how a head begins).
LAZY = r"{0}(?:[\s\S]*?{1}|[\s\S]*+)"
LINE = r"{0}(?:.*{1}|.*(?={2})|.*)"

# The detection patterns.
COMMENTS = [
    Pattern(r"/\*\*\s*\n\s*\*\s*.*\s*\n\s*\*\s*@param.*\s*\n\s*\*\s*@returns.*\s*\n\s*\*/",
            requires=("/**", "@param", "@returns")),
    Pattern(r"//\s*TODO:\s*Implement", True, ("todo:", "implement")),
    Pattern(r"//\s*Helper function", True, ("helper function",)),
    Pattern(r"//\s*Main logic", True, ("main logic",)),
    Pattern(r"/\*\*[\s\S]*?This function[\s\S]*?\*/", requires=("/**", "This function"),
            tail="This function", closes=True),
    Pattern(r"//\s*Example usage:", True, ("example usage:",)),
]
NAMING = [
    r"^(helper|util|process|handle|manage|create|get|set|update|delete|validate|format|parse|convert"
    r"|transform|calculate)[A-Z]",
    r"^[a-z]+([A-Z][a-z]+){2,}\z",
    r"^(is|has|can|should|will)[A-Z]",
]
STRUCTURE = [
    Pattern(r"try\s*\{[\s\S]*?\}\s*catch\s*\(\s*error?\s*\)\s*\{\s*console\.(log|error)",
            requires=("try", "catch", "console."), steps=LAZY.format(
                r"try\s*\{", r"\}\s*catch\s*\(\s*error?\s*\)\s*\{\s*console\.(?:log|error)")),
    Pattern(r"(?:let|const|var)\s+(result|data|response|output|input|temp|item|element|value|obj|arr)\s*=",
            first="lcv"),
    Pattern(r"if\s*\(\s*!\s*\w+\s*\)\s*\{[\s\S]*?return", requires=("if", "return"), tail="return"),
    Pattern(r"""if\s*\(\s*typeof\s+\w+\s*===?\s*['"`]undefined['"`]\s*\)""",
            requires=("typeof", "undefined")),
]
IMPORTS = [
    Pattern(r"import\s+\*\s+as\s+\w+\s+from", requires=("import", "from")),
    Pattern(r"""import\s+\{[\s\S]*?\}\s+from\s+['"`][./]*utils""", requires=("import", "utils"),
            steps=LAZY.format(r"import\s+\{", r"""\}\s+from\s+['"`][./]*utils""")),
    Pattern(r"""import.*path.*from\s+['"`]path['"`]""", requires=("import", "path", "from"),
            steps=r"""import(?:(?>.*?path).*from\s+['"`]path['"`]|.*)""",
            check=r"""import(?>.*?path).*from\s+['"`]path['"`]"""),
]
ERROR_HANDLING = [
    Pattern(r"catch\s*\(\s*(?:error?|err?|e)\s*\)\s*\{\s*throw\s+new\s+Error",
            requires=("catch", "throw")),
    Pattern(r"catch\s*\(\s*(?:error?|err?|e)\s*\)\s*\{\s*console\.error.*return",
            requires=("catch", "console.error", "return"), steps=LINE.format(
                r"catch\s*\(\s*(?:error?|err?|e)\s*\)\s*\{\s*console\.error", "return", "catch")),
    Pattern(r"if\s*\(\s*!.*\)\s*throw\s+new\s+Error\(", requires=("if", "throw", "Error("),
            steps=LINE.format(r"if\s*\(\s*!", r"\)\s*throw\s+new\s+Error\(", "if")),
]
DOCUMENTATION = [
    Pattern(r"/\*\*[\s\S]*?@example[\s\S]*?\*/", requires=("/**", "@example"), tail="@example",
            closes=True),
    Pattern(r"/\*\*[\s\S]*?@description[\s\S]*?\*/", requires=("/**", "@description"),
            tail="@description", closes=True),
    Pattern(r"//\s*Usage:", requires=("Usage:",)),
    Pattern(r"//\s*Returns:", requires=("Returns:",)),
]
SIGNATURES = [
    Pattern(r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?//\s*Implementation",
            requires=("function", "Implementation"),
            steps=r"function\s+\w+\s*\([^)]*+(?:\)\s*\{(?:[\s\S]*?//\s*Implementation|[\s\S]*+))?"),
    Pattern(r"//\s*Add your.*here", requires=("Add your",), steps=LINE.format(r"//\s*Add your", "here", "//")),
    Pattern(r"//\s*Your code here", requires=("Your code here",)),
    Pattern(r"//\s*Implementation goes here", requires=("Implementation goes here",)),
    Pattern(r"(?:let|const|var)\s+(config|options|settings|params|args)\s*=\s*\{", first="lcv"),
]
EVERY_MATCH = {
    "structure_pattern": STRUCTURE,
    "import_pattern": IMPORTS,
    "error_handling_pattern": ERROR_HANDLING,
    "documentation_pattern": DOCUMENTATION,
    "ai_signature": SIGNATURES,
}

_INDICATOR = "struct<type:string,description:string,confidence:double,evidence:string,line:int>"
_NO_INDICATORS = f"cast(array() AS array<{_INDICATOR}>)"


def _named_like_ai(name: str) -> str:
    return "(" + " OR ".join(rx.matches(name, p) for p in NAMING) + ")"


def _gated(pattern: Pattern, lowered: str, value: str, empty: str) -> str:
    return f"if({pattern.gate(lowered)}, {value}, {empty})"


def _kind(name: str) -> str:
    """What all indicators of a type share."""
    description, confidence, _ = TYPES[name]
    size = EVIDENCE.get(name, EVIDENCE_DEFAULT)
    return struct(
        type=q(name), description=q(description), confidence=q(confidence),
        size=f"cast({q(size)} AS int)",
    )


def _indicator(kind: str, evidence: str, line: str) -> str:
    return struct(
        type=f"{kind}.type", description=f"{kind}.description", confidence=f"{kind}.confidence",
        evidence=f"left({evidence}, coalesce({kind}.size, length({evidence})))", line=line,
    )


def _first_comments(lowered: str) -> str:
    """At most one hit per comment pattern, without a line."""
    firsts = []
    for p in COMMENTS:
        first = f"regexp_extract({p.scope('content') or 'content'}, {q(p.rx)}, 0)"
        firsts.append(_gated(p, lowered, f"nullif({first}, '')", "NULL"))
    return transform(
        keep(f"array({', '.join(firsts)})", lambda e: f"{e} IS NOT NULL"),
        lambda e: struct(text=e, line="cast(NULL AS int)"),
    )


def _ai_named(hits: str) -> str:
    named = transform(
        hits, lambda h: struct(text=text.function_name(f"{h}.text", "detect"), line=f"{h}.line")
    )
    return keep(named, lambda x: _named_like_ai(f"{x}.text"))


def indicators() -> str:
    """SQL text over ``content``: every indicator of the file in detector order."""
    return let("lower(content)", _indicators)


def _indicators(lowered: str) -> str:
    patterns = [(kind, p) for kind, ps in EVERY_MATCH.items() for p in ps]
    kinds = ["comment_pattern", "naming_pattern", *[kind for kind, _ in patterns]]
    specs = [text.FUNCTIONS["detect"], *[p.spec(lowered) for _, p in patterns]]

    def listed(found):
        plain = transform(
            f"slice({found}, 2, {len(patterns)})",
            lambda hs: transform(hs, lambda h: struct(text=f"{h}.text", line=f"{h}.line")),
        )
        groups = f"concat(array({_first_comments(lowered)}, {_ai_named(f'get({found}, 0)')}), {plain})"
        types = "array(" + ", ".join(_kind(k) for k in kinds) + ")"
        return (
            f"flatten(zip_with({groups}, {types}, "
            f"(hs, kind) -> transform(hs, h -> {_indicator('kind', 'h.text', 'h.line')})))"
        )

    return f"cast({let(rx.all_hits('content', specs), listed)} AS array<{_INDICATOR}>)"


def counts() -> str:
    """SQL text over ``content``: struct with the number of indicators of each type."""
    return let("lower(content)", _counts)


def _counts(lowered: str) -> str:
    fields = {}
    comment = [
        f"if({_gated(p, lowered, rx.matches(p.scope('content') or 'content', p.rx), 'false')}, 1, 0)" for p in COMMENTS
    ]
    fields["comment_pattern"] = " + ".join(comment)
    names = transform(
        f"regexp_extract_all(content, {q(rx.quick(text.FUNCTION['detect']))}, 0)",
        lambda m: text.function_name(m, "detect"),
    )
    fields["naming_pattern"] = f"size({keep(names, _named_like_ai)})"
    for kind, patterns in EVERY_MATCH.items():
        fields[kind] = " + ".join(
            rx.count("content", *p.spec(lowered)) for p in patterns
        )
    return struct(**fields)


def confidence(c: str, model_n: str = "0", model_sum: str = "0.0D") -> str:
    """SQL text: confidence from the counts struct ``c`` and the model's indicators, if any.

    Weighted mean of the indicator confidences, damped for few indicators.
    """
    n = " + ".join([f"{c}.{t}" for t in TYPES] + [model_n])
    weights = " + ".join([f"{c}.{t} * {q(w)}" for t, (_, _, w) in TYPES.items()] + [f"{model_n} * {q(MODEL_WEIGHT)}"])
    scores = " + ".join(
        [f"{c}.{t} * {q(conf * w)}" for t, (_, conf, w) in TYPES.items()]
        + [f"{model_sum} * {q(MODEL_WEIGHT)}"]
    )
    damped = f"({scores}) / ({weights}) * (1 - exp(-({n}) / 3.0D))"
    return f"if({n} = 0, 0.0D, least({damped}, {q(MAX_CONFIDENCE)}))"


def model_answers(responses: DataFrame) -> DataFrame:
    """Parse model answers about authorship; rows that are not JSON objects are dropped."""
    parsed = responses.where("kind = 'ai'").withColumn("a", F.from_json("response", AI_RESPONSE))
    sure = f"coalesce(nullif(a.confidence, 0.0D), {q(MODEL_CONFIDENCE)})"
    return parsed.where("a IS NOT NULL").selectExpr(
        "path", f"{sure} AS confidence", "a.reasons AS reasons", "a.sections AS sections"
    )


def model_sections(responses: DataFrame) -> DataFrame:
    """ai_sections rows named by the model."""
    return model_answers(responses).selectExpr("path", "confidence", "inline(sections)").select(
        "path", "line", "reason", "confidence"
    )


def model_indicators(responses: DataFrame) -> DataFrame:
    """One indicator per reason given by the model."""
    rows = model_answers(responses).selectExpr("path", "confidence", "posexplode(reasons) AS (seq, reason)")
    return rows.selectExpr(
        "path", "seq", "'ai_analysis' AS type", "reason AS description", "confidence",
        "'AI analysis' AS evidence", "cast(NULL AS int) AS line",
    )


def detect(files: DataFrame, responses: DataFrame | None = None, keep_cols=("path",)) -> DataFrame:
    """files(path, content) -> kept columns, n_indicators, confidence, is_likely_ai, recommendation.

    With model responses their indicators join in by path, after the contents have been left behind.
    """
    counted = files.selectExpr(*keep_cols, f"{counts()} AS counts")
    model_n, model_sum = "0", "0.0D"
    if responses is not None:
        model = model_answers(responses).groupBy("path").agg(
            F.sum(F.size("reasons")).alias("model_n"),
            F.sum(F.size("reasons") * F.col("confidence")).alias("model_sum"),
        )
        counted = counted.join(model, "path", "left").fillna({"model_n": 0, "model_sum": 0.0})
        model_n, model_sum = "model_n", "model_sum"
    total = " + ".join([f"counts.{t}" for t in TYPES] + [model_n])
    # a generator: a filter on the verdict stays above it and does not copy the patterns
    verdict = transform(f"array({confidence('counts', model_n, model_sum)})", lambda c: struct(
        n_indicators=f"cast({total} AS int)", confidence=c,
        is_likely_ai=f"{c} >= {q(scoring.LIKELY_AI)}", recommendation=scoring.advice(c)))
    return counted.selectExpr(*keep_cols, f"inline({verdict})")


def indicator_rows(files: DataFrame, first: int | None = None, keep_cols=("path",)) -> DataFrame:
    """One row per indicator in detector order; ``first`` keeps that many per file."""
    listed = f"slice({indicators()}, 1, {first})" if first else f"concat({indicators()}, {_NO_INDICATORS})"
    return files.selectExpr(*keep_cols, f"posexplode({listed}) AS (seq, i)").select(
        *keep_cols, "seq", "i.*"
    )


def above(detected: DataFrame, threshold: float = scoring.LIKELY_AI) -> DataFrame:
    """Files whose confidence reaches a threshold."""
    return detected.where(F.col("confidence") >= threshold)


def report(detected: DataFrame, folder: str | None = None) -> DataFrame:
    """Files by falling confidence (then path).

    A global sort looks at its input twice, for the ranges first. With ``folder`` the results, which are small, are
    written there before, so that the contents are searched once.
    """
    if folder is not None:
        detected.write.mode("overwrite").parquet(folder)
        detected = detected.sparkSession.read.schema(detected.schema).parquet(folder)
    return detected.orderBy(F.desc("confidence"), "path")


def report_summary(detected: DataFrame) -> DataFrame:
    return detected.agg(
        F.count("*").alias("files_analyzed"), F.count_if("is_likely_ai").alias("ai_files")
    )
