"""Patterns searched in steps find what the patterns themselves find, in time that grows with the text."""

import random
import time

import pytest

from codewarden.functions import regex as rx
from codewarden.functions.regex import js
from codewarden.functions.sql import let
from codewarden.operators import ai_audit, ai_detect

PATTERNS = [p for ps in ai_detect.EVERY_MATCH.values() for p in ps if p.steps]
PATTERNS += [p for p in [*ai_audit.PLACEHOLDER_PATTERNS, *[p for p, _ in ai_audit.SLOW]] if p.steps]
PIECES = [
    "try {", "} catch (erro) {", "}catch(error) { console.log", "console.error", "console.", "catch (e) { console.error", "catch(err){",
    " return", "return ", "import {", "} from './utils", "import", "path", "from 'path'", "from\n\"path\"", "utils", "if (!x", "if (!", "if(",
    ")", ") throw new Error(", ")\nthrow new  Error(", "{", "}", "function f(a", "function g (", ") {", "// Implementation", "//Implementation ",
    "// Add your", "// add your ", "here", "//", "for (", "for(", ".forEach(", "setTimeout (", "new RegExp(", "new", "const", "=", "=>",
    ".map(", ".filter(", ".reduce", "finally", "x", " ", "\n", "\r", " ", "\r\n", "\U0001F600",
]


def texts(n, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        some = draw.sample(PIECES, draw.randrange(2, 9))
        out.append("".join(draw.choices(some + [" "], k=draw.randrange(40))))
    return out


def test_steps_find_the_same(spark):
    df = spark.createDataFrame([(t,) for t in texts(6000, 1)], "content string").repartition(8)
    lowered = "lower(content)"
    for p in PATTERNS:
        plain, stepped = (p.rx, p.gate(lowered), None), p.spec(lowered)
        wrong = df.selectExpr(
            "content", f"get({rx.all_hits('content', [plain])}, 0) AS a", f"get({rx.all_hits('content', [stepped])}, 0) AS b",
            f"{rx.count('content', *plain)} AS n", f"{rx.count('content', *stepped)} AS m",
        ).where("NOT (a <=> b) OR n <> m OR n <> size(a)")
        assert wrong.limit(3).collect() == [], p.regex


def test_parts_in_order_are_the_patterns(spark):
    df = spark.createDataFrame([(t,) for t in texts(8000, 2)], "content string").repartition(8)
    pairs = [(rx.matches("content", js(p)), rx.in_order("content", parts))
             for p, parts in zip(ai_audit.COMPLEX, ai_audit.COMPLEX_PARTS, strict=True)]
    pairs.append((rx.matches("content", js(ai_audit.HAS_FUNCTION)), rx.matches("content", js(ai_audit.FUNCTION_ON_LINE))))
    found = df.selectExpr(*[f"({a}) AS a{k}" for k, (a, _) in enumerate(pairs)], *[f"({b}) AS b{k}" for k, (_, b) in enumerate(pairs)])
    for k in range(len(pairs)):
        assert found.where(f"a{k} <> b{k}").count() == 0
        assert 0 < found.where(f"a{k}").count() < 8000


#: Texts on one line whose heads find no tail, or only a far one.
HOSTILE = [
    "try { console.", "} catch (error) {", "import { utils ", "import path ", "import path from ", "catch(e){console.error ", "if (!x throw Error( ",
    "if (!x) Error(", "function f( ", "function f(){ Implementation ", "// Add your ", "//", "for (x ", "for (x) ", "for(;;){ ", "if(x){ ", "if( ",
    ".forEach(", "setTimeout(", "new RegExp(", "const a = ", "const ", ".map( ", ".filter( ", "try { catch ",
]
REQUIRED = "eval console.error return import { path from utils if throw Error( catch function Implementation // here add your for .forEach setTimeout RegExp"


@pytest.mark.parametrize("behind", [" " + REQUIRED, ")", ""])
def test_time_grows_with_the_text(spark, behind):
    specs = [p.spec("lower(content)") for p in PATTERNS]
    calls = " + ".join(rx.count("content", *s) for s in specs)
    gates = " + ".join(f"if({rx.in_order('content', parts)}, 1, 0)" for parts in ai_audit.COMPLEX_PARTS)
    every = f"{calls} + {gates} + if({rx.matches('content', js(ai_audit.FUNCTION_ON_LINE))}, 1, 0)"

    def seconds(size):
        rows = spark.range(len(HOSTILE)).selectExpr("CAST(id AS INT) AS k").repartition(8)
        listed = "array(" + ", ".join(f"'{h}'" for h in HOSTILE) + ")"
        df = rows.selectExpr(f"concat('{REQUIRED.replace('{', ' ')} ', repeat(get({listed}, k), {size} div length(get({listed}, k))), '{behind}') AS content")
        best = 1e9
        for _ in range(2):
            begun = time.time()
            df.selectExpr(f"sum({let('content', lambda _: every)})").collect()
            best = min(best, time.time() - begun)
        return best

    seconds(10_000)
    one, two = seconds(1_000_000), seconds(2_000_000)
    assert two < 2.6 * one + 1
    assert two < 60
