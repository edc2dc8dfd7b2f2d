"""Sections and first occurrences: against plain Python, and in time that grows with the file."""

import random
import re
import time

from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.sql import leading, transform
from codewarden.operators import ai_audit
from codewarden.operators.org_rules import _first_lines

SECTIONS = "path string, line int, reason string, confidence double"
HEAD = "// Generated by Copilot\n// TODO: Add your code here\n// AI generated\n// This function handles it\n// Implementation goes here\n"


def first_lines(spark, contents):
    lines = _first_lines(text.variables(), lambda h, first: transform(h, lambda x: first(f"{x}.text")))
    rows = spark.createDataFrame(list(enumerate(contents)), "k int, content string").repartition(8)
    return [r.found for r in rows.selectExpr("k", f"{lines} AS found").orderBy("k").collect()]


def test_leading_is_a_binary_search(spark):
    rows = spark.createDataFrame([([], 1), ([1], 1), ([1], 2), ([1, 2, 2, 5], 2), ([1, 2, 2, 5], 9)], "xs array<int>, y int")
    got = [r.n for r in rows.selectExpr(f"{leading('xs', lambda x: f'{x} < y')} AS n").collect()]
    assert got == [0, 0, 1, 1, 4]


def test_first_lines_are_the_first_textual_occurrences(spark):
    draw = random.Random(7)
    pieces = ["let", "const", "var", "a", "ab", "abc", "a$", "outlet", "xvar", "_const", " ", " ", " ", "\n", "\n", "\t", ";", "="]
    contents = ["".join(draw.choices(pieces, k=draw.randrange(60))) for _ in range(1500)]
    declared = re.compile(r"(?:let|const|var)\s+[a-zA-Z_$][a-zA-Z0-9_$]*")
    want = [[c[: c.index(m.group(0))].count("\n") + 1 for m in declared.finditer(c)] for c in contents]
    assert first_lines(spark, contents) == want
    assert sum(len(set(w)) < len(w) for w in want) > 50


def test_first_lines_take_time_by_the_declarations(spark):
    def seconds(n):
        # every text begins a longer one, and a name ends in a keyword
        content = "let outlet\nconst q = 1;\n" + "".join(f"let name_{i % (n // 2)} = {i};\n" for i in range(n))
        best = 1e9
        for _ in range(2):
            begun = time.time()
            (found,) = first_lines(spark, [content])
            best = min(best, time.time() - begun)
        assert len(found) == n + 2 and found[2] == 3
        return best

    seconds(1000)
    assert seconds(32_000) < 2.6 * seconds(16_000) + 1


def audited(spark, content, lines, only, path="s/ai.js"):
    files = spark.createDataFrame([(path, content)], "path string, content string").withColumn("profile", F.lit(None))
    files = files.withColumn("profile", F.expr("cast(NULL AS struct<confidence:string,recommendations:struct<naming:struct<functions:string>>>)"))
    sections = spark.createDataFrame([(path, n, "r", 0.9) for n in lines], SECTIONS)
    answers = spark.createDataFrame([(path, "ai", '{"reasons": ["a","b","c","d","e","f","g","h","i"], "confidence": 0.95}')],
                                    "path string, kind string, response string")
    return ai_audit.findings(files, sections, answers, org_rules=True, only=only)


def test_nearness_equals_all_pairs(spark):
    draw = random.Random(3)
    for size, marked in [(40, 3), (120, 9), (60, 0), (50, 25)]:
        lines = [draw.choice(["x = eval(y)", "password = 1", "a.forEach(b => c.forEach(d))", "", "let q = 1"]) for _ in range(size)]
        marks = [draw.randrange(-4, size + 12) for _ in range(marked)] + [None]
        only = [ai_audit.SECURITY_REVIEW, ai_audit.HUMAN_COMMENTS]
        got = audited(spark, "\n".join(lines), marks, only).where("rule IS NOT NULL").select("rule", "line").collect()
        real = [m for m in marks if m is not None]
        want = [(ai_audit.SECURITY_REVIEW, i + 1) for i, x in enumerate(lines)
                if re.search(r"eval\(|password", x) and any(abs(i + 1 - m) <= 3 for m in real)]
        want += [(ai_audit.HUMAN_COMMENTS, None)] * bool(real)
        assert sorted((r.rule, r.line or 0) for r in got) == sorted((r, n or 0) for r, n in want)


def test_sections_at_the_ends_of_int(spark):
    found = audited(spark, "eval(x)", [2**31 - 1, -(2**31)], [ai_audit.SECURITY_REVIEW])
    assert [r.rule for r in found.collect()] == [None]


def test_untested_functions_of_a_file_are_one_violation(spark):
    content = "\n".join(f"function f{i}() {{}}" for i in range(30))
    rows = audited(spark, content, [4, 4, 20], [ai_audit.UNIT_TESTS]).where("rule IS NOT NULL").collect()
    near = [i for i in range(30) if abs(i + 1 - 4) <= 5 or abs(i + 1 - 20) <= 5]
    assert [(r.message, r.copies) for r in rows] == [(ai_audit.UNIT_MESSAGE + ", ".join(f"f{i}" for i in near), 1)]


def test_windows_only_around_sections(spark):
    """A long file with one section: one window, whatever its lines hold."""
    rules = [ai_audit.ERROR_HANDLING, ai_audit.COMPLEXITY_COMMENTS]

    def seconds(n):
        content = "if (a) { if (b) { if (c) { function f() {\n" * n
        begun = time.time()
        rows = audited(spark, content, [n // 2], rules).where("rule IS NOT NULL").collect()
        assert sorted((r.rule, r.line, r.copies) for r in rows) == sorted((r, n // 2, 1) for r in rules)
        return time.time() - begun

    seconds(100)
    assert seconds(100_000) < 8
