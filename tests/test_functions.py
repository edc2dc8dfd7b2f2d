import random
import re
import time

import pytest

from codewarden.functions import naming, regex as rx, scoring, text
from codewarden.functions.sql import q
from codewarden.operators import ai_audit, ai_detect
from codewarden.sources.code_files import is_ignored

UNICODE_SPACES = "\u00a0\u1680\u2000\u2028\u2029\u202f\u205f\u3000\ufeff"


def python_hits(pattern, content):
    """Matches with line and column by Python's engine."""
    spelled = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m.group(1).zfill(4), pattern)
    spelled = spelled.replace("(?s:.)", r"[\s\S]")
    out = []
    for m in re.finditer(spelled, content):
        before = content[: m.start()]
        out.append((m.group(0), before.count("\n") + 1, m.start() - (before.rfind("\n") + 1) + 1))
    return out


def test_extension_and_path_parts(evaluate):
    paths = ["a/b/c.test.js", "x.js", ".env", "a/.env.local", "..", "../..", "noext", "a.b/noext", "dir/x."]
    got = evaluate(
        [{"p": p} for p in paths], ext=text.extname("p"), base=text.basename("p"), dir=text.dirname("p"),
        stem=text.stem("p"), test=text.expected_test_path("p"),
    )
    assert [g["ext"] for g in got] == [".js", ".js", "", ".local", "", "", "", "", "."]
    assert [g["dir"] for g in got] == ["a/b", "", "", "a", "", "..", "", "a.b", "dir"]
    assert [g["stem"] for g in got][:4] == ["c.test", "x", ".env", ".env"]
    assert got[0]["test"] == "a/b/c.test.test.js"
    assert got[1]["test"] == "x.test.js"


@pytest.mark.parametrize("name, rule_style, drift_style", [
    ("userName", "camelCase", "camelCase"), ("user", "unknown", "unknown"), ("user_name", "snake_case", "snake_case"),
    ("User", "PascalCase", "PascalCase"), ("API", "PascalCase", "PascalCase"), ("API_KEY", "UPPER_CASE", "UPPER_CASE"),
    ("user-name", "unknown", "kebab-case"), ("_x", "unknown", "unknown"), ("$el", "unknown", "unknown"),
    ("_a_b", "unknown", "unknown"), ("a\n", "unknown", "unknown"),
])
def test_naming_style(evaluate, name, rule_style, drift_style):
    got = evaluate([{"n": name}], a=naming.naming_style("n"), b=naming.naming_style("n", kebab=True))[0]
    assert (got["a"], got["b"]) == (rule_style, drift_style)


@pytest.mark.parametrize("name, camel, snake, pascal, kebab", [
    ("user_name", "userName", "user_name", "UserName", "user-name"),
    ("UserName", "UserName", "_user_name", "UserName", "-user-name"),
    ("__x", "_x", "__x", "_x", "--x"),
    ("a-b", "aB", "a_b", "A-b", "a-b"),
    ("API_KEY", "APIKEY", "_a_p_i__k_e_y", "APIKEY", "-a-p-i--k-e-y"),
    ("x_", "x_", "x_", "X_", "x-"),
])
def test_convert_naming(evaluate, name, camel, snake, pascal, kebab):
    targets = {"camel": "camelCase", "snake": "snake_case", "pascal": "PascalCase", "kebab": "kebab-case"}
    got = evaluate([{"n": name}], **{k: naming.convert_naming_style("n", q(t)) for k, t in targets.items()})[0]
    assert (got["camel"], got["snake"], got["kebab"]) == (camel, snake, kebab)
    if name != "__x":
        assert got["pascal"] == pascal
    assert evaluate([{"n": name}], x=naming.convert_naming_style("n", "'kebab-case'", kebab=False))[0]["x"] == name


def test_lines_of_empty_and_unterminated_files(evaluate):
    got = evaluate([{"c": c} for c in ["", "a", "a\n", "a\r\nb"]], n=text.line_count("c"))
    assert [g["n"] for g in got] == [1, 1, 2, 2]


def test_line_and_column_of_an_offset(evaluate):
    content = "ab\ncd\n\nef"
    for offset in range(len(content) + 1):
        got = evaluate([{"c": content}], line=text.line_number("c", str(offset)), col=text.column_number("c", str(offset)))[0]
        before = content[:offset]
        assert got == {"line": before.count("\n") + 1, "col": offset - (before.rfind("\n") + 1) + 1}


def test_whitespace_is_that_of_the_source_language(evaluate):
    rows = [{"content": f"const{s}x = 1"} for s in UNICODE_SPACES + "\t\n\r\x0b\x0c "]
    assert all(g["h"][0]["text"].endswith("x") for g in evaluate(rows, h=text.variables()))
    assert evaluate([{"content": "const\u0085x = 1"}], h=text.variables())[0]["h"] == []
    # a comment ends at every line terminator
    got = evaluate([{"content": "// a\r// b\u2028// c"}], c=text.comment_profile("content"))[0]["c"]
    assert got["single"] == 3


def test_hits_match_python_on_random_text(evaluate):
    rnd = random.Random(5)
    words = ["const a", "let b_c", "var  D", "\n", "\r\n", " ", "x", "é", "let\n e", "varvar y", "constconst", "𝒳"]
    rows = [{"content": "".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))} for _ in range(150)]
    for r, got in zip(rows, evaluate(rows, h=text.variables()), strict=True):
        want = python_hits(text.VARIABLE, r["content"])
        assert [(h["text"], h["line"], h["col"]) for h in got["h"]] == want


def test_hits_of_a_file_with_many_matches(evaluate):
    content = "".join(f"let v{i} = {i};{'' if i % 3 else chr(10)}" for i in range(3 * rx.BLOCK + 7))
    got = evaluate([{"content": content}], h=text.variables())[0]["h"]
    assert [(h["text"], h["line"], h["col"]) for h in got] == python_hits(text.VARIABLE, content)


ALL_PATTERNS = [
    p for ps in [ai_detect.COMMENTS, *ai_detect.EVERY_MATCH.values(), ai_audit.REVIEWED,
                 ai_audit.PLACEHOLDER_PATTERNS, [p for p, _ in ai_audit.RISKS], [p for p, _ in ai_audit.SLOW]]
    for p in ps
]
PIECES = [
    "/**", "*/", "/*", "@example", "@description", "@human-verified", "This function", "try {", "}", "catch (error) {",
    "catch (e) { throw new Error", "console.error(", "console.log", " return", "if (!x) {", "if (!a) throw new Error(",
    "if (typeof x === 'undefined')", "import { a } from './utils", "import * as x from", "import path from 'path'",
    "function f(a) {", "// Implementation goes here", "// Add your code here", "// Your code here", "// TODO: implement",
    "// todo:", "// FIXME:", "// Usage:", "// Returns:", "// helper Function", "// Main logic", "// Example usage:",
    "const result =", "let config = {", "\n", " ", "x", "eval(", "innerHTML =", "exec (", ".query(", "jwt.sign",
    "PassWord", "crypto.createHash", "for (;;) {", ".forEach(", "setTimeout(", "new RegExp(a)", "JSON.parse(",
    "JSON.stringify", "// Reviewed by:", "// @reviewed", "/* TODO", "utils", "@param a", "@returns b", " * ",
]


def test_gates_and_scopes_change_nothing(evaluate):
    """Cut and gated searches give what the plain pattern gives."""
    rnd = random.Random(11)
    rows = [{"content": "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40)))} for _ in range(400)]
    cut = {f"p{i}": rx.hits("content", *p.spec("lower(content)")) for i, p in enumerate(ALL_PATTERNS)}
    plain = {f"p{i}": rx.hits("content", p.rx) for i, p in enumerate(ALL_PATTERNS)}
    assert evaluate(rows, **cut) == evaluate(rows, **plain)


@pytest.mark.parametrize("content", [
    "/** a */ " * 20_000,
    "/** a " * 20_000,
    "try { a } catch (err) { b }\n" * 3_000,
    "function f(a) { }\n" * 5_000,
    "import { a } from 'x'\n" * 5_000,
])
def test_unfinished_patterns_stay_fast(evaluate, content):
    start = time.time()
    evaluate([{"content": content}], n=ai_detect.counts(), c=text.comment_profile("content"))
    assert time.time() - start < 15


def test_context_is_clipped(evaluate):
    c = "a\nb\nc\nd\ne"
    lines = "split(c, '\\n', -1)"
    got = evaluate([{"c": c}], first=text.line_context(lines, "1"), mid=text.line_context(lines, "3", 1), last=text.line_context(lines, "5"))[0]
    assert got["first"] == {"before": [], "line": "a", "after": ["b", "c", "d"]}
    assert got["mid"] == {"before": ["b"], "line": "c", "after": ["d"]}
    assert got["last"] == {"before": ["b", "c", "d"], "line": "e", "after": []}


@pytest.mark.parametrize("content, expected", [
    ("", ("none", "jsdoc")), ("// a", ("high", "single")), ("/* a */\nx", ("high", "multi")),
    ("/** a */", ("high", "jsdoc")), ("http://x\n" * 10 + "y", ("high", "single")),
    ("/* never closed\n" * 9, ("none", "jsdoc")),
])
def test_comment_profile(evaluate, content, expected):
    got = evaluate([{"c": content}], p=text.comment_profile("c"))[0]["p"]
    assert (got["level"], got["style"]) == expected


def test_import_properties(evaluate):
    paths = ["./retrieval", "react", "@org/x/y", "lodash/fp", "..", "./a.js", "vm"]
    got = evaluate([{"p": p} for p in paths], lib=text.import_library("p"), ext=text.import_extension("p"),
                   internal=text.is_internal_import("p"), bad=text.is_discouraged_import("p"))
    assert [g["lib"] for g in got] == [".", "react", "@org", "lodash", "..", ".", "vm"]
    assert [g["ext"] for g in got] == ["implicit", "implicit", "implicit", "implicit", "implicit", "explicit", "implicit"]
    assert [g["internal"] for g in got] == [True, False, True, False, True, True, False]
    assert [g["bad"] for g in got] == [True, False, False, False, False, False, True]


@pytest.mark.parametrize("path, ignored", [
    ("src/a.js", {"learn": False, "compliance": False, "drift": False, "watch": False}),
    ("my-build-tools/a.js", {"learn": True, "compliance": True, "drift": False, "watch": False}),
    ("x/dist/a.js", {"learn": True, "compliance": True, "drift": True, "watch": True}),
    ("coverage/a.js", {"learn": False, "compliance": False, "drift": True, "watch": True}),
    (".cache/a.js", {"learn": False, "compliance": False, "drift": False, "watch": True}),
    ("dist.js", {"learn": False, "compliance": False, "drift": False, "watch": False}),
])
def test_ignore_policies(evaluate, path, ignored):
    got = evaluate([{"path": path}], **{p: is_ignored("path", p) for p in ignored})[0]
    assert got == ignored


def test_learn_policy_looks_at_the_whole_path(evaluate):
    got = evaluate([{"path": "src/a.js"}, {"path": "a.js"}], x=is_ignored("path", "learn", root="/home/build/app"))
    assert [g["x"] for g in got] == [True, False]


def test_severity_order(evaluate):
    vs = "transform(split(s, ','), x -> named_struct('severity', x))"
    got = evaluate([{"s": "low,critical,high"}, {"s": "odd"}, {"s": "info,medium"}], m=scoring.highest_severity(vs),
                   rule=scoring.rule_score(vs), audit=scoring.audit_score(vs), drift=scoring.drift_score(vs))
    assert [g["m"] for g in got] == ["critical", "info", "medium"]
    assert [g["rule"] for g in got] == [68, 100, 94]
    assert [g["audit"] for g in got] == [68, 100, 95]
    assert [g["drift"] for g in got] == [68.0, 100.0, 93.0]


def test_scores_stay_in_range(evaluate):
    vs = "array_repeat(named_struct('severity', 'critical'), cast(n AS int))"
    got = evaluate([{"n": n} for n in (0, 1, 5, 500)], rule=scoring.rule_score(vs), drift=scoring.drift_score(vs))
    assert [g["rule"] for g in got] == [100, 80, 0, 0]
    assert [g["drift"] for g in got] == [100.0, 80.0, 0.0, 0.0]


def test_searched_patterns_match_what_the_plain_ones_do(evaluate):
    content = ("outlet x; constlet y; vonst a; cet b; lar c; function f(; const const = (; let g = async (a) => 1;\nvar data = {\n"
               "let config = {}\nfunctionfunction h() {}; const k = function () {}")
    for p in [text.VARIABLE, *text.FUNCTION.values(), *[p.rx for p in [ai_detect.STRUCTURE[1], ai_detect.SIGNATURES[-1]]]]:
        assert rx.quick(p) != p and not rx.quick(p).startswith("(?=")
        got = evaluate([{"content": content}], h=rx.hits("content", p), n=rx.count("content", p))[0]
        assert [(h["text"], h["line"], h["col"]) for h in got["h"]] == python_hits(p, content) and got["n"] == len(got["h"])
    assert rx.quick(text.IMPORT) == text.IMPORT


def test_gates_look_for_rare_characters_and_hold_wherever_the_literals_do(evaluate):
    for kind, patterns in {"comment": ai_detect.COMMENTS, **ai_detect.EVERY_MATCH}.items():
        for p in patterns:
            assert evaluate([{"content": " ".join(p.requires)}], g=p.gate("content") or "true")[0]["g"], kind
    assert rx.may_contain("c", ["todo:", "implement"]) == "contains(c, 'plement') AND contains(c, 'do:')"
