"""Audit rules for files that look AI-written.

One pass over the contents yields small candidates: what was found, on which line, and how near an AI
section it must be to count. A file's sections are counted per line and travel to its row as one sorted
array, by an equi-join on the path. The nearest section of a candidate is found by binary search, and the rules
that look at the lines around a section look there only. What follows is done in the row, so no
pairs of candidates and sections are formed. Where the sections are too many to be broadcast, the join moves the candidates,
and the contents of those files alone that look AI-written and in which a rule about lines can apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.functions import naming, scoring, text
from codewarden.functions import regex as rx
from codewarden.functions.regex import js
from codewarden.functions.sql import keep, leading, let, q, struct, transform
from codewarden.operators import ai_detect
from codewarden.operators.ai_detect import LAZY, LINE, Pattern
from codewarden.schemas import VIOLATION, VIOLATION_FIELDS, Sql, violation

# Rules, patterns, radii, messages and suggestions of the audit.
HUMAN_COMMENTS = "require-human-comments"
UNIT_TESTS = "require-unit-tests"
COMPLEXITY_COMMENTS = "require-complexity-comments"
PLACEHOLDERS = "no-ai-placeholders"
CONSISTENT_NAMING = "consistent-naming"
SECURITY_REVIEW = "ai-security-review"
PERFORMANCE_REVIEW = "ai-performance-review"
ERROR_HANDLING = "org/require-error-handling"
RULES = [
    HUMAN_COMMENTS, UNIT_TESTS, COMPLEXITY_COMMENTS, PLACEHOLDERS, CONSISTENT_NAMING, SECURITY_REVIEW,
    PERFORMANCE_REVIEW, ERROR_HANDLING,
]
NEAR = {UNIT_TESTS: 5, CONSISTENT_NAMING: 3, SECURITY_REVIEW: 3, PERFORMANCE_REVIEW: 5}
REVIEWED = [
    Pattern(r"//\s*Reviewed by:", True, ("reviewed by:",)),
    Pattern(r"//\s*Human verified:", True, ("human verified:",)),
    Pattern(r"//\s*@reviewed", True, ("@reviewed",)),
    Pattern(r"/\*\*[\s\S]*?@human-verified[\s\S]*?\*/", requires=("/**", "@human-verified"),
            tail="@human-verified", closes=True),
]
COMPLEX = [
    r"for\s*\([^)]*\)\s*\{[\s\S]*?for\s*\([^)]*\)",
    r"if\s*\([^)]*\)\s*\{[\s\S]*?if\s*\([^)]*\)\s*\{[\s\S]*?if",
    r"\.map\([\s\S]*?\.filter\([\s\S]*?\.reduce",
    r"try\s*\{[\s\S]*?catch[\s\S]*?finally",
]
#: The same as what has to stand in order, each searched in one pass.
COMPLEX_PARTS = [
    [rx.called("for", r"\s*\{"), rx.called("for")],
    [rx.called("if", r"\s*\{"), rx.called("if", r"\s*\{"), "if"],
    [r"\.map\(", r"\.filter\(", r"\.reduce"],
    [r"try\s*\{", "catch", "finally"],
]
EXPLAINED = r"//\s*(?:This|The|Explanation|Logic|Algorithm|Purpose|Why)"
PLACEHOLDER_PATTERNS = [
    Pattern(r"//\s*TODO:", True, ("todo:",)),
    Pattern(r"//\s*FIXME:", True, ("fixme:",)),
    Pattern(r"//\s*Add your.*here", True, ("add your", "here"), steps=LINE.format(r"//\s*Add your", "here", "//")),
    Pattern(r"//\s*Implementation.*here", True, ("implementation", "here"),
            steps=LINE.format(r"//\s*Implementation", "here", "//")),
    Pattern(r"//\s*Your code here", True, ("your code here",)),
    Pattern(r"/\*\s*TODO[\s\S]*?\*/", True, ("/*", "todo"), tail="*/"),
]
RISKS = [
    (Pattern(r"eval\s*\(", requires=("eval",)), "Code execution vulnerability"),
    (Pattern(r"innerHTML\s*=", requires=("innerHTML",)), "XSS vulnerability"),
    (Pattern(r"exec\s*\(", requires=("exec",)), "Command injection vulnerability"),
    (Pattern(r"\.query\s*\(", requires=(".query",)), "SQL injection vulnerability"),
    (Pattern(r"crypto\.createHash", requires=("crypto.createHash",)), "Cryptographic implementation"),
    (Pattern(r"jwt\.sign", requires=("jwt.sign",)), "Authentication token handling"),
    (Pattern(r"password", True, ("password",)), "Password handling"),
]
SLOW = [
    # up to the last parenthesis, so that every inner loop's header has one
    (Pattern(r"for\s*\([^)]*\)\s*\{[\s\S]*?for\s*\([^)]*\)", requires=("for",), tail=")", steps=(
        r"for\s*\([^)]*+(?:\)\s*\{(?:[\s\S]*?for\s*\([^)]*\)|[\s\S]*+))?")), "Nested loops"),
    (Pattern(r"\.forEach\s*\([\s\S]*?\.forEach", requires=(".forEach",), steps=LAZY.format(
        r"\.forEach\s*\(", r"\.forEach")), "Nested forEach operations"),
    (Pattern(r"setTimeout\s*\([\s\S]*?setTimeout", requires=("setTimeout",), steps=LAZY.format(
        r"setTimeout\s*\(", "setTimeout")), "Multiple setTimeout calls"),
    (Pattern(r"new\s+RegExp\s*\(.*\)", requires=("RegExp",), steps=LINE.format(
        r"new\s+RegExp\s*\(", r"\)", "new")), "RegExp construction in loop"),
    (Pattern(r"JSON\.parse\s*\([\s\S]*?JSON\.stringify", requires=("JSON.parse", "JSON.stringify"),
             tail="JSON.stringify"), "Inefficient JSON operations"),
]
HAS_FUNCTION = r"function|const.*=.*=>"
#: The same with one search per line.
FUNCTION_ON_LINE = r"function|(?<!.)(?>.*?const)(?>.*?=).*?=>"
HANDLES_ERRORS = r"(try\s*\{|catch\s*\(|throw\s+new\s+Error)"
SUGGEST = {
    HUMAN_COMMENTS: 'Add comments like "// Reviewed by: [Name]" or "// @human-verified" to indicate '
                    "human oversight",
    UNIT_TESTS: "Create unit tests for AI-generated functions to ensure correctness and maintainability",
    COMPLEXITY_COMMENTS: "Add comments explaining the purpose and logic of complex AI-generated code "
                         "sections",
    PLACEHOLDERS: "Replace placeholder comments with actual implementation or remove if not needed",
    SECURITY_REVIEW: "Have security team review AI-generated security-sensitive code",
    PERFORMANCE_REVIEW: "Review AI-generated code for performance optimization opportunities",
    ERROR_HANDLING: "Add try-catch blocks or proper error validation to AI-generated functions",
}
HUMAN_MESSAGE = "AI-generated code must include human review comments"
COMPLEX_MESSAGE = "Complex AI-generated code needs explanatory comments"
PLACEHOLDER_MESSAGE = "Remove AI placeholder comments and implement proper code"
ERROR_MESSAGE = "AI-generated functions must include proper error handling"
UNIT_MESSAGE = "AI-generated functions need unit tests: "
SECURITY_MESSAGE = "AI-generated code with security implications needs human security review: "
PERFORMANCE_MESSAGE = "AI-generated code may have performance issues: "
ADVICE_HIGH_CONFIDENCE = "High confidence AI-generated code detected. Ensure thorough code review."
ADVICE_HIGH_SEVERITY = "High-severity violations found in AI code. Address before merging."
ADVICE_SECURITY = "Security-related AI code detected. Mandatory security team review required."
ADVICE_TESTS = "Create comprehensive unit tests for AI-generated functions."
ADVICE_COMPLEXITY = "Add explanatory comments to complex AI-generated logic sections."
ADVICE_DEFAULT = "AI-generated code follows basic standards. Consider adding human review comments."

#: Copies of a violation written out at a time.
COPY_BLOCK = 10_000

#: Line keys that are not lines: anywhere in a file that has sections, and no section needed.
IN_FILE = -1
ALWAYS = -2

_CANDIDATE = f"struct<ord:int,at:int,radius:int,name:string,copies:bigint,v:{VIOLATION}>"
_NO_CANDIDATES = f"cast(array() AS array<{_CANDIDATE}>)"
_MARKS = "array<struct<line:int,n:bigint>>"


def _candidate(rule: str, at: str, radius, v: str, name: str = "NULL", copies: str = "1") -> str:
    return struct(
        ord=str(RULES.index(rule) + 1), at=f"cast({at} AS int)", radius=f"cast({q(radius)} AS int)",
        name=f"cast({name} AS string)", copies=f"cast({copies} AS bigint)", v=v,
    )


def _violation(rule, category, severity, message, line="NULL", suggestion=None, **more) -> str:
    return violation(
        source="audit" if rule != ERROR_HANDLING else "org", rule=rule, category=category, type="audit",
        severity=severity, message=Sql(message), line=Sql(line),
        suggestion=suggestion or SUGGEST[rule], **more,
    )


def human_reviewed() -> str:
    """SQL text over ``content``: carries a reviewer's comment."""
    tests = lambda lowered: " OR ".join(
        f"({p.gate(lowered)} AND {rx.matches(p.scope('content') or 'content', p.rx)})"
        for p in REVIEWED
    )
    return let("lower(content)", tests)


def _human_comments() -> str:
    v = _violation(HUMAN_COMMENTS, "documentation", "medium", q(HUMAN_MESSAGE))
    found = f"array({_candidate(HUMAN_COMMENTS, str(IN_FILE), None, v)})"
    return f"if({human_reviewed()}, {_NO_CANDIDATES}, {found})"


def _unit_tests(functions: str) -> str:
    """One candidate per function; they become one violation per file afterwards."""
    v = _violation(UNIT_TESTS, "documentation", "high", q(UNIT_MESSAGE))
    found = transform(functions, lambda h: _candidate(
        UNIT_TESTS, f"{h}.line", NEAR[UNIT_TESTS], v, text.function_name(f"{h}.text", "audit")
    ))
    return f"if({text.is_audit_test('path')}, {_NO_CANDIDATES}, {found})"


def _is_complex(content: str) -> str:
    return "(" + " OR ".join(rx.in_order(content, parts) for parts in COMPLEX_PARTS) + ")"


def _has_function(content: str) -> str:
    return rx.matches(content, js(FUNCTION_ON_LINE))


#: Rules over the five lines before and after a section: what a window, and so the file, must have; what it must not
#: have; the violation at a line.
_AROUND = {
    COMPLEXITY_COMMENTS: (_is_complex, EXPLAINED, lambda n: _violation(
        COMPLEXITY_COMMENTS, "documentation", "medium", q(COMPLEX_MESSAGE), n)),
    ERROR_HANDLING: (_has_function, HANDLES_ERRORS, lambda n: _violation(
        ERROR_HANDLING, "organizational", "medium", q(ERROR_MESSAGE), n)),
}


def _body(rules) -> str:
    """The content of a file in which one of the rules can find something around a section, else null."""
    some = [_AROUND[r][0]("content") for r in rules if r in _AROUND]
    return f"if({' OR '.join(some)}, content, NULL)" if some else "cast(NULL AS string)"


def _around(rules) -> str:
    """Candidates of the section lines in ``marks`` with the lines around them in ``body``, one for each copy of a section."""
    chosen = [r for r in rules if r in _AROUND]

    def window(lines, n):
        return f"array_join(slice({lines}, greatest({n} - 4, 1), {n} + 6 - greatest({n} - 4, 1)), '\\n')"

    def found(rule, w, m):
        needs, lacks, v = _AROUND[rule]
        hit = _candidate(rule, ALWAYS, None, v(f"{m}.line"), copies=f"{m}.n")
        return f"if({needs(w)} AND NOT {rx.matches(w, js(lacks))}, {hit}, NULL)"

    def at_marks(lines):
        inside = keep("marks", lambda m: f"{m}.line BETWEEN 1 AND size({lines}) + 4")
        return transform(inside, lambda m: let(
            window(lines, f"{m}.line"), lambda w: f"array({', '.join(found(r, w, m) for r in chosen)})"))

    if not chosen:
        return _NO_CANDIDATES
    each = let("split(body, '\\n', -1)", at_marks)
    return f"if(body IS NULL OR size(marks) = 0, {_NO_CANDIDATES}, array_compact(flatten({each})))"


def _placeholders(groups: str) -> str:
    return transform(f"flatten({groups})", lambda h: _candidate(
        PLACEHOLDERS, str(ALWAYS), None, _violation(
            PLACEHOLDERS, "quality", "high", q(PLACEHOLDER_MESSAGE), f"{h}.line",
            evidence=Sql(f"{h}.text"),
        )))


def _naming(functions: str) -> str:
    expected = "profile.recommendations.naming.functions"
    styled = transform(functions, lambda h: let(
        text.function_name(f"{h}.text", "audit"),
        lambda n: struct(name=n, style=naming.naming_style(n), line=f"{h}.line"),
    ))
    off = keep(styled, lambda s: f"{s}.style NOT IN ({expected}, 'unknown')")
    found = transform(off, lambda s: _candidate(
        CONSISTENT_NAMING, f"{s}.line", NEAR[CONSISTENT_NAMING], _violation(
            CONSISTENT_NAMING, "quality", "medium",
            f"concat('AI-generated function \\'', {s}.name, '\\' should use ', {expected}, "
            "' naming convention')", f"{s}.line",
            suggestion=Sql("concat('Rename to: ', "
                           + naming.convert_naming_style(f"{s}.name", expected, kebab=False) + ")"),
        )))
    return f"if({expected} IS NULL, {_NO_CANDIDATES}, {found})"


def _reviews(rule, category, severity, message, patterns):
    def build(groups: str) -> str:
        found = _candidate(rule, "h.line", NEAR[rule], _violation(
            rule, category, severity, f"concat({q(message)}, what)", "h.line", evidence=Sql("what"),
        ))
        whats = "array(" + ", ".join(q(what) for _, what in patterns) + ")"
        return f"flatten(zip_with({groups}, {whats}, (hs, what) -> transform(hs, h -> {found})))"

    return build


# Rules over the places of patterns (function declarations, or a group of patterns), and the others.
_FUNCTION_SPECS = lambda lowered: [text.FUNCTIONS["audit"]]
_specs = lambda patterns: lambda lowered: [p.spec(lowered) for p in patterns]
_PLACED = {
    UNIT_TESTS: (_FUNCTION_SPECS, lambda groups: _unit_tests(f"get({groups}, 0)")),
    PLACEHOLDERS: (_specs(PLACEHOLDER_PATTERNS), _placeholders),
    CONSISTENT_NAMING: (_FUNCTION_SPECS, lambda groups: _naming(f"get({groups}, 0)")),
    SECURITY_REVIEW: (
        _specs([p for p, _ in RISKS]), _reviews(SECURITY_REVIEW, "security", "high", SECURITY_MESSAGE, RISKS)),
    PERFORMANCE_REVIEW: (
        _specs([p for p, _ in SLOW]),
        _reviews(PERFORMANCE_REVIEW, "performance", "medium", PERFORMANCE_MESSAGE, SLOW)),
}
_WHOLE = {HUMAN_COMMENTS: _human_comments}


def candidates(rules) -> str:
    """SQL text over (path, content, profile): candidate array of those rules that need no section's lines, in rule order."""
    return let("lower(content)", lambda lowered: _candidates([r for r in rules if r not in _AROUND], lowered))


def _candidates(rules, lowered: str) -> str:
    specs, places = [], {}
    for rule in (r for r in rules if r in _PLACED):
        wanted = _PLACED[rule][0]
        shared = next((places[r] for r in places if _PLACED[r][0] is wanted), None)
        places[rule] = shared or (len(specs) + 1, len(wanted(lowered)))
        if shared is None:
            specs += wanted(lowered)

    def listed(found):
        parts = [
            _PLACED[r][1](f"slice({found}, {places[r][0]}, {places[r][1]})") if r in _PLACED else _WHOLE[r]()
            for r in rules
        ]
        return f"cast(concat({', '.join(parts + [_NO_CANDIDATES])}) AS array<{_CANDIDATE}>)"

    return let(rx.all_hits("content", specs), listed) if specs else listed("NULL")


def section_lines(sections: DataFrame) -> DataFrame:
    """(path, marks): the lines of a file's sections in order, each with its number of sections."""
    return (
        sections.where("line IS NOT NULL").groupBy("path", "line").agg(F.count("*").alias("n"))
        .groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "n"))).alias("marks"))
    )


def _distance(at: str) -> str:
    """How far the nearest section's line is, null without sections."""
    return let(leading("marks", lambda m: f"{m}.line < {at}"), lambda i: (
        f"least(cast(get(marks, {i}).line AS bigint) - {at}, {at} - cast(get(marks, {i} - 1).line AS bigint))"))


def _kept(found: str) -> str:
    """Those of the candidates that sections are near to, as array<struct<idx,c>>; a file's functions without tests as one."""
    near = lambda c: (f"({c}.at = {ALWAYS} OR ({c}.at = {IN_FILE} AND size(marks) > 0) "
                      f"OR coalesce({_distance(f'{c}.at')} <= {c}.radius, false))")
    placed = keep(f"transform({found}, (c, i) -> {struct(idx='i', c='c')})", lambda x: near(f"{x}.c"))
    is_test = f"x.c.v.rule <=> {q(UNIT_TESTS)}"

    def one(tests):
        names = f"array_join(transform({tests}, x -> coalesce(x.c.name, '')), ', ')"
        first = f"get({tests}, 0)"
        fields = {f: f"{first}.c.v.{f}" for f in VIOLATION_FIELDS} | {"message": f"concat({first}.c.v.message, {names})"}
        c = struct(**{f: f"{first}.c.{f}" for f in ("ord", "at", "radius", "name", "copies")}, v=struct(**fields))
        return f"if(size({tests}) = 0, {tests}, array({struct(idx=f'{first}.idx', c=c)}))"

    return let(placed, lambda p: f"concat(filter({p}, x -> NOT ({is_test})), {let(f'filter({p}, x -> {is_test})', one)})")


def _scored(files: DataFrame, responses: DataFrame | None, rules) -> DataFrame:
    """path, confidence, candidates and body of likely-AI files; other files have null candidates."""
    found, body = candidates(rules), _body(rules)
    likely = f"confidence >= {q(scoring.LIKELY_AI)}"
    if responses is None:
        counted = files.selectExpr("path", "content", "profile", f"{ai_detect.counts()} AS counts")
        rated = counted.selectExpr(
            "path", "content", "profile", f"{ai_detect.confidence('counts')} AS confidence"
        )
        # an if() rather than a filter: a filter would be pushed below and count everything twice
        return rated.selectExpr(
            "path", "confidence", f"if({likely}, {found}, NULL) AS found", f"if({likely}, {body}, NULL) AS body")
    model = ai_detect.model_answers(responses).groupBy("path").agg(
        F.sum(F.size("reasons")).alias("model_n"),
        F.sum(F.size("reasons") * F.col("confidence")).alias("model_sum"),
    )
    counted = files.selectExpr("path", f"{ai_detect.counts()} AS counts", f"{found} AS found", f"{body} AS body")
    joined = counted.join(model, "path", "left").fillna({"model_n": 0, "model_sum": 0.0})
    rated = joined.selectExpr(
        "path", "found", "body", f"{ai_detect.confidence('counts', 'model_n', 'model_sum')} AS confidence"
    )
    return rated.selectExpr(
        "path", "confidence", f"if({likely}, found, NULL) AS found", f"if({likely}, body, NULL) AS body")


def findings(
    files: DataFrame, sections: DataFrame | None = None, responses: DataFrame | None = None,
    org_rules: bool = False, only=None,
) -> DataFrame:
    """files(path, content, profile) -> one row per audit violation of likely-AI files, plus one row
    with a null rule for each such file, so that clean ones are not lost.

    Columns: path, confidence, ord, idx, copies, then the violation fields. Without sections only the
    placeholder rule can fire, and no join happens.
    """
    chosen = [r for r in RULES if (only is None or r in only) and (org_rules or r != ERROR_HANDLING)]
    if sections is None:
        chosen = [r for r in chosen if r == PLACEHOLDERS]
    marker = struct(
        ord="0", at=str(ALWAYS), radius="cast(NULL AS int)", name="cast(NULL AS string)", copies="1L",
        v=f"cast(NULL AS {VIOLATION})",
    )
    scored = _scored(files, responses, chosen)
    if sections is None:
        scored = scored.withColumn("marks", F.lit(None))
    else:
        scored = scored.join(section_lines(sections), "path", "left")
    scored = scored.withColumn("marks", F.expr(f"coalesce(cast(marks AS {_MARKS}), cast(array() AS {_MARKS}))"))
    listed = f"cast(concat(array({marker}), found, {_around(chosen)}) AS array<{_CANDIDATE}>)"
    kept = scored.selectExpr(
        "path", "confidence", f"inline(if(found IS NULL, array(), {_kept(listed)}))")
    return kept.selectExpr(
        "path", "confidence", "c.ord", "idx", "c.copies", *[f"c.v.{f} AS {f}" for f in VIOLATION_FIELDS])


def _repeat(rows: DataFrame) -> DataFrame:
    """One row per copy, numbered by ``copy``; in two steps, so no long array is built for many copies."""
    blocks = rows.selectExpr("*", f"explode(sequence(0L, (copies - 1) div {COPY_BLOCK})) AS block")
    size = f"least({COPY_BLOCK}, copies - block * {COPY_BLOCK})"
    return blocks.selectExpr("*", f"posexplode(array_repeat(1, cast({size} AS int))) AS (i, one)").selectExpr(
        "*", f"block * {COPY_BLOCK} + i AS copy"
    )


def violations(found: DataFrame) -> DataFrame:
    """Violation rows with ``seq``, most severe first, otherwise in rule order.

    Numbered before copies are multiplied out, so the window of a file holds its lines, not the copies.
    """
    order = Window.partitionBy("path").orderBy(F.expr(scoring.severity_rank("severity")).desc(), "ord", "idx")
    before = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    numbered = found.where("rule IS NOT NULL").withColumn("before", before)
    return _repeat(numbered).selectExpr("path", "cast(before + copy AS int) AS seq", *VIOLATION_FIELDS)


def _counted(n: str, words: str) -> str:
    return f"concat({n}, {q(words)})"


def report(found: DataFrame) -> DataFrame:
    """One row per likely-AI file: score, counts, recommendations and action plan."""
    n = lambda cond: F.sum(F.expr(f"if({cond}, copies, 0L)"))
    org = f"rule = {q(ERROR_HANDLING)}"
    per_file = found.groupBy("path").agg(
        F.max("confidence").alias("confidence"),
        n("rule IS NOT NULL").alias("n_violations"),
        F.sum(F.expr(f"copies * {scoring.weight('severity', scoring.AUDIT_WEIGHTS)}")).alias("penalty"),
        n(f"severity = 'high' AND NOT {org}").alias("n_high"),
        n("category = 'security'").alias("n_security"),
        n("category = 'quality'").alias("n_quality"),
        n("category = 'documentation'").alias("n_documentation"),
        n(f"rule = {q(UNIT_TESTS)}").alias("n_tests"),
        n(f"rule = {q(COMPLEXITY_COMMENTS)}").alias("n_complex"),
    )
    advice = "filter(array(" + ", ".join([
        f"if(confidence > 0.8D, {q(ADVICE_HIGH_CONFIDENCE)}, NULL)",
        f"if(n_high > 0, {q(ADVICE_HIGH_SEVERITY)}, NULL)",
        f"if(n_security > 0, {q(ADVICE_SECURITY)}, NULL)",
        f"if(n_tests > 0, {q(ADVICE_TESTS)}, NULL)",
        f"if(n_complex > 0, {q(ADVICE_COMPLEXITY)}, NULL)",
    ]) + "), a -> a IS NOT NULL)"
    action = lambda priority, what, reason: struct(priority=q(priority), action=q(what), reason=reason)
    actions = "filter(array(" + ", ".join([
        f"if(n_security > 0, {action('high', 'Schedule security team review', _counted('n_security', ' security-related violations in AI code'))}, NULL)",
        f"if(n_quality > 0, {action('medium', 'Address code quality issues', _counted('n_quality', ' quality violations need attention'))}, NULL)",
        f"if(n_documentation > 0, {action('low', 'Improve documentation', _counted('n_documentation', ' documentation issues found'))}, NULL)",
    ]) + "), a -> a IS NOT NULL)"
    default_action = action(
        "low", "Add human review marker", q("Mark AI code as reviewed by human developer")
    )
    return per_file.selectExpr(
        "path", "confidence", "n_violations", f"cast({scoring.score('penalty')} AS int) AS score",
        f"{let(advice, lambda a: f'if(size({a}) > 0, {a}, array({q(ADVICE_DEFAULT)}))')} AS recommendations",
        f"{let(actions, lambda a: f'if(size({a}) > 0, {a}, array({default_action}))')} AS actions",
    )


def directory_summary(reported: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, AI files, violations, rounded average score of AI files (100 if none)."""
    total = files.agg(F.count("*").alias("n")).scalar()
    return reported.agg(
        F.count("*").alias("ai_files"),
        F.coalesce(F.sum("n_violations"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(100)).alias("average_score"),
    ).withColumn("files_analyzed", total)


def worst_first(reported: DataFrame) -> DataFrame:
    return reported.orderBy("score", "path")
