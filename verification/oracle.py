"""The same queries as plain SQL for DuckDB, written independently of the Spark plans.

Positions come from the text in front of each match, conventions from ordinary GROUP BYs with a spine of
declared keys, scores from joins to weight tables.
"""

from __future__ import annotations

import re

from codewarden.functions import text
from codewarden.functions.regex import NOT_SPACE, js
from codewarden.functions.scoring import ADVICE, NO_ADVICE
from codewarden.operators import ai_audit, ai_detect, drift, learn, org_rules, review
from codewarden.plans import activity, analysis
from codewarden.sources import corpus, rules as rule_source

AS_OF = "2024-06-01"
GAP = "INTERVAL 30 MINUTE"
ORACLE: dict[str, str] = {}


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern literal; Java's leading look-ahead is only a speed-up and is left out."""
    return s(re.sub(r"^\(\?=\[[a-z]+\]\)", "", pattern))


def lst(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def nl(t: str) -> str:
    return f"(length({t}) - length(replace({t}, chr(10), '')))"


def with_(ctes, body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + body


# --- inputs -------------------------------------------------------------------------------------

_K = "(doc_id - CASE WHEN doc_id % 11 = 0 AND doc_id > 0 THEN 1 ELSE 0 END)"


def path_of(doc_id: str = "doc_id") -> str:
    k = _K.replace("doc_id", doc_id)
    return (
        f"(CASE WHEN {k} % 13 = 0 THEN '' WHEN {k} % 17 = 0 THEN 'node_modules/pkg/' "
        f"WHEN {k} % 19 = 0 THEN 'tools/build-scripts/' WHEN {k} % 23 = 0 THEN '.cache/gen/' "
        f"WHEN {k} % 29 = 0 THEN 'dist/' WHEN {k} % 3 = 0 THEN 'src/feature' || ({k} % 20) || '/parts/' "
        f"ELSE 'src/feature' || ({k} % 20) || '/' END || "
        f"CASE {k} % 5 WHEN 0 THEN 'userPanel' WHEN 1 THEN 'user-panel-' WHEN 2 THEN 'user_panel_' "
        f"WHEN 3 THEN 'UserPanel' ELSE 'panel' END || {k} || "
        f"CASE WHEN {doc_id} % 11 = 0 AND {doc_id} > 0 THEN '.test' WHEN {doc_id} % 11 = 1 THEN '.spec' ELSE '' END || "
        f"CASE WHEN {k} % 31 = 0 THEN '.css' ELSE ['.js', '.ts', '.jsx', '.tsx'][{k} % 4 + 1] END)"
    )


_SNIPPETS = lst(corpus.SNIPPETS)
_BLOCK = (
    "CASE (doc_id // 64) % 4 WHEN 0 THEN '// ' || replace(text, chr(10), chr(10) || '// ') "
    "WHEN 1 THEN '/*' || chr(10) || text || chr(10) || '*/' WHEN 2 THEN 'const notes = `' || text || '`;' "
    "ELSE '/**' || chr(10) || ' * ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || ' */' END"
)
CODE = (
    "code", f"SELECT doc_id, {path_of()} AS path, concat_ws(chr(10), {_SNIPPETS}[doc_id % 8 + 1], "
    f"{_SNIPPETS}[(doc_id // 8) % 8 + 1], {_BLOCK}) AS content FROM documents"
)
PATHS = ("code", f"SELECT doc_id, {path_of()} AS path FROM documents")

_IN_NAMED = " OR ".join(
    f"list_contains(dirs, {s(n)})" for n in
    ["node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage"]
)
_HAS_PART = " OR ".join(f"contains(dir, {s(n)})" for n in ["node_modules", ".git", "dist", "build"])
_POLICY = {
    "learn": _HAS_PART, "compliance": _HAS_PART, "drift": _IN_NAMED,
    "watch": _IN_NAMED + " OR len(list_filter(dirs, lambda x: starts_with(x, '.'))) > 0",
}


def selected(policy: str, columns: str = "path, content") -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, array_to_string(string_split(path, '/')[:-2], '/') AS dir, "
        f"string_split(path, '/')[:-2] AS dirs FROM code) WHERE NOT ({_POLICY[policy]}) "
        "AND regexp_matches(path, '\\.(js|ts|jsx|tsx)$')"
    )


def files(policy: str = "drift"):
    return [CODE, ("files", selected(policy))]


DIR = "array_to_string(string_split(path, '/')[:-2], '/')"
BASE = "string_split(path, '/')[-1]"
EXT = "regexp_extract(string_split({p}, '/')[-1], '^.+(\\.[^.]*)$', 1)"


def ext(p: str = "path") -> str:
    return f"CASE WHEN string_split({p}, '/')[-1] = '..' THEN '' ELSE {EXT.format(p=p)} END"


STEM = f"{BASE}[:length({BASE}) - length({ext()})]"


def hits(source: str, pattern: str, columns: str = "path") -> str:
    """All matches with line and column, from the text before each match."""
    p = rx(pattern)
    return (
        f"SELECT {columns}, i - 1 AS i, m AS text, {nl('pre')} + 1 AS line, "
        "length(string_split(pre, chr(10))[-1]) + 1 AS col FROM ("
        f"SELECT {columns}, i, ms[i] AS m, array_to_string(list_transform(range(1, i + 1), "
        "lambda k: CASE WHEN k > 1 THEN ms[k - 1] ELSE '' END || ps[k]), '') AS pre FROM ("
        f"SELECT {columns}, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM ("
        f"SELECT {columns}, regexp_extract_all(content, {p}) AS ms, string_split_regex(content, {p}) AS ps "
        f"FROM {source})))"
    )


def hits_i(source: str, pattern: str, columns: str = "path") -> str:
    return hits(source, pattern, columns)


def group_of(t: str, pattern: str, *idx: int) -> str:
    parts = [f"nullif(regexp_extract({t}, {rx(pattern)}, {i}), '')" for i in idx]
    return f"coalesce({', '.join(parts)})"


def var_name(t="text"):
    return group_of(t, text.VARIABLE, 1)


def fn_name(dialect, t="text"):
    return group_of(t, text.FUNCTION[dialect], 1, 2)


_STYLE = {
    "camelCase": "regexp_matches({n}, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches({n}, '[A-Z]')",
    "snake_case": "regexp_matches({n}, '^[a-z][a-z0-9_]*$') AND contains({n}, '_')",
    "PascalCase": "regexp_matches({n}, '^[A-Z][a-zA-Z0-9]*$')",
    "kebab-case": "regexp_matches({n}, '^[a-z][a-z0-9-]*$') AND contains({n}, '-')",
    "UPPER_CASE": "regexp_matches({n}, '^[A-Z][A-Z0-9_]*$')",
}


def style(n: str, order=("camelCase", "snake_case", "PascalCase", "UPPER_CASE"), other="'unknown'") -> str:
    return "CASE " + " ".join(f"WHEN {_STYLE[k].format(n=n)} THEN '{k}'" for k in order) + f" ELSE {other} END"


DRIFT_STYLES = ("camelCase", "snake_case", "PascalCase", "kebab-case", "UPPER_CASE")
FILE_STYLES = ("camelCase", "kebab-case", "snake_case", "PascalCase")
NAME_STYLES = ("camelCase", "snake_case", "PascalCase")


def raise_after(n: str, sep: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({n}, '{sep}.'), "
        f"regexp_extract_all({n}, '{sep}(.)', 1)), lambda z: z[1] || upper(coalesce(z[2], ''))), '')"
    )


def convert(n: str, target: str, kebab: bool = True) -> str:
    spaced = lambda by: f"lower(regexp_replace({n}, '([A-Z])', '{by}\\1', 'g'))"
    out = (
        f"CASE WHEN {target} = 'camelCase' THEN {raise_after(raise_after(n, '_'), '-')} "
        f"WHEN {target} = 'snake_case' THEN replace({spaced('_')}, '-', '_') "
        f"WHEN {target} = 'PascalCase' THEN upper({n}[1]) || {raise_after(f'{n}[2:]', '_')} "
    )
    if kebab:
        out += f"WHEN {target} = 'kebab-case' THEN replace({spaced('-')}, '_', '-') "
    return out + f"ELSE {n} END"


COMMENTS = (
    "SELECT path, single, multi, jsdoc, lines, CASE WHEN d > 0.2 THEN 'high' WHEN d > 0.1 THEN 'medium' "
    "WHEN d > 0.05 THEN 'low' ELSE 'none' END AS level, CASE WHEN jsdoc >= single AND jsdoc >= multi "
    "THEN 'jsdoc' WHEN multi >= single THEN 'multi' ELSE 'single' END AS style FROM ("
    "SELECT *, (single + multi + jsdoc) / lines AS d FROM (SELECT path, "
    f"len(regexp_extract_all(content, {rx(text.LINE_COMMENT)}))::INT AS single, "
    f"len(regexp_extract_all(content, {rx(text.BLOCK_COMMENT)}))::INT AS multi, "
    f"len(regexp_extract_all(content, {rx(text.DOC_COMMENT)}))::INT AS jsdoc, "
    f"({nl('content')} + 1)::INT AS lines FROM @@))"
)
IMPORT_ROWS = ("imps", f"SELECT path, i, line, col, {group_of('text', text.IMPORT, 1)} AS p FROM ({hits('files', text.IMPORT)})")
IMP_EXT = f"CASE WHEN {ext('p')} <> '' THEN 'explicit' ELSE 'implicit' END"


# --- scans and configuration --------------------------------------------------------------------

ORACLE["scan_code_files"] = with_([PATHS], " UNION ALL ".join(
    selected(p, f"'{p}' AS policy, path") for p in _POLICY))
ORACLE["scan_js_files"] = with_([PATHS], "SELECT path FROM code WHERE path LIKE '%.js'")
ORACLE["scan_first_files"] = with_([CODE], "SELECT path, length(content)::INT AS n_chars FROM (" + selected("learn") + ") ORDER BY path LIMIT 100")
ORACLE["watched_folders"] = with_([PATHS, ("p", selected("watch", "path"))], f"SELECT DISTINCT {DIR} AS folder FROM p")
ORACLE["registry_checks"] = with_([CODE, ("f", selected("drift")), ("lines", """
SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS k FROM f""")], """
SELECT path, 'custom/long-line' AS rule, k AS line, 'Line has ' || length(line) || ' characters' AS message FROM lines WHERE length(line) > 120
UNION ALL SELECT path, 'custom/trailing-blank', k, 'Line ends in a blank' FROM lines WHERE ends_with(line, ' ')""")
ORACLE["scan_file_cap"] = with_([PATHS], selected("learn", "path") + " ORDER BY path LIMIT 1000")

_SEC = "doc_id % 4 <> 0"
_RULE_ROWS = (
    "flat", f"""SELECT doc_id, 'security/no-eval' AS rule_id, 'security' AS category, 'No eval' AS name,
    'd' AS description, CASE WHEN doc_id % 9 = 2 THEN 'urgent' ELSE 'critical' END AS severity,
    true AS enabled, NULL::VARCHAR AS limit_param FROM documents WHERE {_SEC}
    UNION ALL SELECT doc_id, 'security/no-dangerous-html', 'security', 'no-dangerous-html', '', 'medium',
    false, NULL FROM documents WHERE {_SEC}
    UNION ALL SELECT doc_id, 'performance/no-sync-fs', 'performance', 'fs', 'd', 'high', true,
    (doc_id % 7)::VARCHAR FROM documents"""
)
ORACLE["rules_flatten"] = with_([_RULE_ROWS], "SELECT * FROM flat")
ORACLE["rules_lookup"] = with_([_RULE_ROWS], "SELECT doc_id, rule_id, severity FROM flat WHERE enabled AND category = 'security'")
ORACLE["rule_by_id"] = with_([_RULE_ROWS], "SELECT doc_id, rule_id, severity, enabled FROM flat WHERE rule_id = 'performance/no-sync-fs'")
ORACLE["rules_history"] = with_([_RULE_ROWS], """SELECT TIMESTAMP '2024-01-20 00:00:00' AS ts, '1.' || doc_id % 3 AS version,
(SELECT count(*) FROM flat) AS rules_count FROM documents""")
ORACLE["rules_validate"] = with_([_RULE_ROWS], """
SELECT doc_id, NULL::VARCHAR AS rule_id, 'error' AS level, 'Missing required metadata field: name' AS message
FROM documents WHERE doc_id % 5 = 4
UNION ALL SELECT doc_id, NULL, 'warning', 'Unknown rule category: style' FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, rule_id, 'warning', 'Rule ' || rule_id || ' is missing name or description'
FROM flat WHERE name = '' OR description = ''
UNION ALL SELECT doc_id, rule_id, 'error', 'Rule ' || rule_id || ' has invalid severity: ' || severity
FROM flat WHERE severity NOT IN ('low', 'medium', 'high', 'critical')""")

EXC = [
    ("raw_exc", f"""SELECT coalesce(CASE WHEN doc_id IN (0, 1) THEN NULL ELSE {path_of()} END, '*') AS file,
    coalesce(CASE WHEN doc_id IN (0, 1) THEN 'security/require-company-fetch' WHEN doc_id % 50 = 7 THEN NULL
    WHEN doc_id % 10 = 3 THEN 'security/no-eval' ELSE 'security/no-dangerous-html' END, '*') AS rule,
    'ticket ' || doc_id AS reason, CASE WHEN doc_id % 10 = 5 THEN DATE '2024-01-01' END AS expires, doc_id
    FROM documents WHERE doc_id % 10 IN (3, 5) OR doc_id % 50 = 7 OR doc_id IN (0, 1)"""),
    ("exc", "SELECT file, rule, reason, expires FROM (SELECT *, row_number() OVER (PARTITION BY file, rule "
            "ORDER BY doc_id DESC) AS rn FROM raw_exc) WHERE rn = 1"),
]
ORACLE["exceptions_normalised"] = with_(EXC, "SELECT * FROM exc")

# --- learning -----------------------------------------------------------------------------------


def pattern_count_ctes():
    """lfiles (learn policy) and one CTE of counts per section."""
    fn = fn_name("learn")
    return [
        CODE, ("lfiles", selected("learn")),
        ("lvars", f"SELECT {var_name('m')} AS n FROM (SELECT unnest(regexp_extract_all(content, {rx(text.VARIABLE)})) AS m FROM lfiles)"),
        ("lfns", f"SELECT {fn.replace('(text,', '(m,')} AS n FROM (SELECT unnest(regexp_extract_all(content, {rx(text.FUNCTION['learn'])})) AS m FROM lfiles)"),
        ("limps", f"SELECT {group_of('m', text.IMPORT, 1)} AS p FROM (SELECT unnest(regexp_extract_all(content, {rx(text.IMPORT)})) AS m FROM lfiles)"),
        ("lcom", COMMENTS.replace("@@", "lfiles")),
        ("c_naming", f"""
SELECT 'naming' AS section, 'files' AS field, key, count(*) AS n FROM (SELECT {style(STEM, FILE_STYLES, 'NULL')} AS key FROM lfiles) WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'naming', 'variables', key, count(*) FROM (SELECT {style('n', NAME_STYLES, 'NULL')} AS key FROM lvars) WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'naming', 'functions', key, count(*) FROM (SELECT {style('n', NAME_STYLES, 'NULL')} AS key FROM lfns) WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'naming', 'constants', 'UPPER_CASE', sum(len(regexp_extract_all(content, {rx(text.CONSTANT)})))::BIGINT FROM lfiles HAVING sum(len(regexp_extract_all(content, {rx(text.CONSTANT)}))) > 0"""),
        ("c_imports", f"""
SELECT 'imports' AS section, 'style' AS field, CASE WHEN starts_with(p, '.') THEN 'relative' ELSE 'absolute' END AS key, count(*) AS n FROM limps GROUP BY 3
UNION ALL SELECT 'imports', 'extensions', {IMP_EXT}, count(*) FROM limps GROUP BY 3
UNION ALL SELECT 'imports', 'libraries', string_split(p, '/')[1], count(*) FROM limps WHERE NOT starts_with(p, '.') GROUP BY 3"""),
        ("c_architecture", f"""
SELECT 'architecture' AS section, 'exportStyles' AS field, key, count(*) AS n FROM (SELECT {EXPORT} AS key FROM lfiles) WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'architecture', 'folderStructure', {DIR}, count(*) FROM lfiles WHERE contains(path, '/') GROUP BY 3
UNION ALL SELECT 'architecture', 'fileTypes', {ext()}, count(*) FROM lfiles GROUP BY 3
UNION ALL SELECT 'architecture', 'files', 'all', count(*) FROM lfiles"""),
        ("c_testing", f"""
SELECT section, field, key, count(*) AS n FROM (
SELECT 'testing' AS section, 'fileNaming' AS field, 'spec' AS key FROM lfiles WHERE contains({BASE}, '.spec.')
UNION ALL SELECT 'testing', 'fileNaming', 'test' FROM lfiles WHERE contains({BASE}, '.test.')
UNION ALL SELECT 'testing', 'framework', 'jest/mocha' FROM lfiles WHERE {LEARNER_TEST} AND (contains(content, 'describe(') OR contains(content, 'it('))
UNION ALL SELECT 'testing', 'framework', 'jest' FROM lfiles WHERE {LEARNER_TEST} AND contains(content, 'test(')) GROUP BY ALL"""),
        ("c_comments", """
SELECT 'comments' AS section, 'style' AS field, 'single' AS key, sum(single)::BIGINT AS n FROM lcom HAVING sum(single) > 0
UNION ALL SELECT 'comments', 'style', 'multi', sum(multi)::BIGINT FROM lcom HAVING sum(multi) > 0
UNION ALL SELECT 'comments', 'style', 'jsdoc', sum(jsdoc)::BIGINT FROM lcom HAVING sum(jsdoc) > 0
UNION ALL SELECT 'comments', 'density', level, count(*) FROM lcom GROUP BY level"""),
    ]


_NAMED = f"regexp_matches(content, {rx(text.NAMED_EXPORT)})"
_DEFAULT = f"regexp_matches(content, {rx(text.DEFAULT_EXPORT)})"
EXPORT = f"CASE WHEN {_NAMED} AND {_DEFAULT} THEN 'mixed' WHEN {_NAMED} THEN 'named' WHEN {_DEFAULT} THEN 'default' END"
LEARNER_TEST = (
    f"(contains({BASE}, '.test.') OR contains({BASE}, '.spec.') OR {BASE} LIKE '%Test.js' OR {BASE} LIKE '%Spec.js')"
)
for _section, _name in [("naming", "learn_naming"), ("imports", "learn_imports"),
                        ("architecture", "learn_exports_folders"), ("testing", "learn_testing"),
                        ("comments", "learn_comments")]:
    ORACLE[_name] = with_(pattern_count_ctes(), f"SELECT * FROM c_{_section}")
ORACLE["top_libraries"] = with_(pattern_count_ctes(), "SELECT key, n FROM c_imports WHERE field = 'libraries' ORDER BY n DESC, key LIMIT 10")
ORACLE["top_folders"] = with_(pattern_count_ctes(), "SELECT key, n FROM c_architecture WHERE field = 'folderStructure' ORDER BY n DESC, key LIMIT 10")

_SPINE = " UNION ALL ".join(
    f"SELECT {s(sec)} AS section, {s(field)} AS field, {s(key)} AS key, {i} AS ord"
    for (sec, field), keys in learn.KEYS.items() for i, key in enumerate(keys)
)


def _mode(section: str, field: str) -> str:
    return (
        f"(SELECT sp.key FROM spine sp LEFT JOIN counts c USING (section, field, key) WHERE sp.section = '{section}' "
        f"AND sp.field = '{field}' ORDER BY coalesce(c.n, 0) DESC, sp.ord LIMIT 1)"
    )


def _top(section: str, field: str) -> str:
    return (
        f"(SELECT list(key ORDER BY n DESC, key) FROM (SELECT key, n FROM counts WHERE section = '{section}' "
        f"AND field = '{field}' ORDER BY n DESC, key LIMIT 10))"
    )


_TOTAL = "(SELECT n FROM counts WHERE section = 'architecture' AND field = 'files')"


def profile_ctes():
    return [*pattern_count_ctes(), (
        "counts", "SELECT * FROM c_naming UNION ALL SELECT * FROM c_imports UNION ALL SELECT * FROM c_architecture "
                  "UNION ALL SELECT * FROM c_testing UNION ALL SELECT * FROM c_comments"),
        ("spine", _SPINE),
        ("prof", f"""SELECT CASE WHEN {_TOTAL} < 10 THEN 'low' WHEN {_TOTAL} < 50 THEN 'medium' ELSE 'high' END AS confidence,
{_mode('naming', 'variables')} AS variables, {_mode('naming', 'functions')} AS functions,
{_mode('naming', 'constants')} AS constants, {_mode('naming', 'files')} AS files,
{_mode('imports', 'style')} AS import_style, {_mode('imports', 'extensions')} AS import_extensions,
{_top('imports', 'libraries')} AS libraries, {_mode('architecture', 'exportStyles')} AS export_style,
{_top('architecture', 'folderStructure')} AS folders, {_mode('testing', 'fileNaming')} AS test_naming,
(SELECT key FROM counts WHERE field = 'framework' ORDER BY n DESC, key LIMIT 1) AS framework,
{_mode('comments', 'style')} AS comment_style, {_mode('comments', 'density')} AS comment_density"""),
    ]


ORACLE["learned_profile"] = with_(profile_ctes(), """SELECT * REPLACE (coalesce(array_to_string(libraries, ','), '') AS libraries,
coalesce(array_to_string(folders, ','), '') AS folders) FROM prof""")


ORACLE["profile_roundtrip"] = ORACLE["learned_incremental"] = ORACLE["learned_profile"]

# --- organizational rules -----------------------------------------------------------------------

_RULES = {
    r[0]: (i, r[3]) for i, r in enumerate(rule_source.INITIAL_RULES)
}
_PREFIX = lambda token: f"content[:strpos(content, {s(token)}) - 1]"


def _line(token: str) -> str:
    return f"({nl(_PREFIX(token))} + 1)::INT"


def _rule(rule: str, idx: int, line: str, message: str, where: str, source: str = "rfiles") -> str:
    ord_, severity = _RULES[rule]
    return (
        f"SELECT path, {ord_} AS ord, {idx} AS idx, {s(rule)} AS rule, {s(rule.split('/')[0])} AS category, "
        f"{s(severity)} AS severity, {line} AS line, {message} AS message FROM {source} WHERE {where}"
    )


def _has(token: str) -> str:
    return f"contains(content, {s(token)})"


RULE_SQL = {
    org_rules.NO_EVAL: [_rule(org_rules.NO_EVAL, 0, _line("eval("), s(org_rules.EVAL_MESSAGE), _has("eval("))],
    org_rules.NO_DANGEROUS_HTML: [
        _rule(org_rules.NO_DANGEROUS_HTML, i, _line(t), s(f"Direct {t} manipulation can lead to XSS vulnerabilities"), _has(t))
        for i, t in enumerate(org_rules.HTML_TOKENS)],
    org_rules.COMPANY_FETCH: [_rule(org_rules.COMPANY_FETCH, 0, _line("fetch("), s("Use companyFetch instead of raw fetch()"),
                                    _has("fetch(") + " AND NOT " + _has("companyFetch"))],
    org_rules.NO_SYNC_FS: [
        _rule(org_rules.NO_SYNC_FS, i, _line(t), s(f"Avoid synchronous file operation: {t}"), _has(t))
        for i, t in enumerate(org_rules.SYNC_FS_TOKENS)],
    org_rules.FEATURE_FOLDERS: [_rule(org_rules.FEATURE_FOLDERS, 0, "1", s(org_rules.FOLDER_MESSAGE), "NOT contains(path, '/')")],
}
_CAMEL = (
    f"SELECT path, {_RULES[org_rules.CAMELCASE_VARIABLES][0]} AS ord, i AS idx, {s(org_rules.CAMELCASE_VARIABLES)} AS rule, "
    f"'naming' AS category, 'low' AS severity, ({nl('content[:strpos(content, m) - 1]')} + 1)::INT AS line, "
    "'Variable ''' || name || ''' should use camelCase naming' AS message FROM ("
    f"SELECT path, content, i, m, {var_name('m')} AS name FROM (SELECT path, content, ms[i] AS m, i FROM ("
    "SELECT path, content, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT path, content, "
    f"regexp_extract_all(content, {rx(text.VARIABLE)}) AS ms FROM rfiles)))) "
    f"WHERE (SELECT variables FROM prof) = 'camelCase' AND {style('name')} <> 'camelCase'"
)


def rule_ctes(policy: str = "compliance", with_profile: bool = True, excepted: bool = False, rules=None, as_of: str | None = AS_OF):
    """found: rule violations (path, ord, idx, rule, category, severity, line, message)."""
    ctes = profile_ctes() if with_profile else [CODE]
    ctes = [*ctes, ("rfiles", selected(policy))]
    parts = [q for r, qs in RULE_SQL.items() for q in qs if rules is None or r in rules]
    if with_profile and (rules is None or org_rules.CAMELCASE_VARIABLES in rules):
        parts.append(_CAMEL)
    ctes.append(("all_found", " UNION ALL ".join(parts)))
    if excepted:
        day = "" if as_of is None else f"AND (e.expires IS NULL OR e.expires > DATE '{as_of}') "
        ctes += [*EXC, ("found", "SELECT * FROM all_found f WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE "
                                 f"e.file IN (f.path, '*') AND e.rule IN (f.rule, '*') {day})")]
    else:
        ctes.append(("found", "SELECT * FROM all_found"))
    return ctes


_RULE_OUT = (
    "SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord, idx) - 1)::INT AS seq, rule, category, "
    "severity, line, message FROM found"
)
for _q, _r in [("rule_no_eval", org_rules.NO_EVAL), ("rule_dangerous_html", org_rules.NO_DANGEROUS_HTML),
               ("rule_company_fetch", org_rules.COMPANY_FETCH), ("rule_sync_fs", org_rules.NO_SYNC_FS),
               ("rule_feature_folder", org_rules.FEATURE_FOLDERS)]:
    ORACLE[_q] = with_(rule_ctes(with_profile=False, rules=[_r]), _RULE_OUT)
ORACLE["rule_camelcase_vars"] = with_(rule_ctes(rules=[org_rules.CAMELCASE_VARIABLES]), _RULE_OUT)
ORACLE["exceptions_suppressed"] = with_(
    rule_ctes(with_profile=False, excepted=True), "SELECT path, rule, line, message FROM found")

_SEVS = ["critical", "high", "medium", "low", "info"]


def _per_severity(cast: str = "INT", names=_SEVS) -> str:
    return ", ".join(f"count(f.path) FILTER (WHERE f.severity = '{x}')::{cast} AS {x}" for x in names)


RULE_WEIGHT = "CASE f.severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
SCORED = (
    "scored", f"SELECT r.path, count(f.path)::INT AS n_violations, {_per_severity()}, "
    f"greatest(0, 100 - least(coalesce(sum({RULE_WEIGHT}), 0), 100))::INT AS score "
    "FROM rfiles r LEFT JOIN found f USING (path) GROUP BY r.path"
)
ORACLE["compliance_score"] = with_([*rule_ctes(excepted=True), SCORED], "SELECT * FROM scored")
ORACLE["compliance_summary"] = with_([*rule_ctes(excepted=True), SCORED, ("tot", """
SELECT count(*) AS files, count(*) FILTER (WHERE n_violations > 0) AS files_with_violations,
coalesce(sum(n_violations), 0)::BIGINT AS total_violations FROM scored"""), ("rated", """
SELECT *, floor((files - files_with_violations) / nullif(files, 0) * 100 + 0.5)::BIGINT AS compliance_rate FROM tot""")],
    "SELECT *, CASE WHEN compliance_rate >= 80 THEN 'good' WHEN compliance_rate >= 60 THEN 'fair' "
    "WHEN compliance_rate < 60 THEN 'poor' END AS band FROM rated")
ORACLE["compliance_by_folder"] = with_([*rule_ctes(excepted=True), SCORED],
    f"SELECT {DIR} AS folder, count(*) AS files, sum(n_violations)::BIGINT AS violations, "
    + ", ".join(f"sum({x})::BIGINT AS {x}" for x in _SEVS[:-1])
    + ", round(avg(score), 4) AS mean_score FROM scored GROUP BY 1")
RECS = [
    ("bycat", "SELECT path, category, count(*) AS n, min(ord * 100000 + idx) AS pos FROM found GROUP BY path, category HAVING count(*) > 1"),
    ("recs", "SELECT path, 'Address ' || n || ' ' || category || ' violations for better code quality' AS rec, pos FROM bycat "
             "UNION ALL SELECT DISTINCT path, 'Critical violations must be fixed before deployment', 99999999 FROM found WHERE severity = 'critical'"),
]
ORACLE["rule_recommendations"] = with_([*rule_ctes(excepted=True), *RECS],
    "SELECT r.path, coalesce(string_agg(rec, '; ' ORDER BY pos), '') AS recommendations FROM rfiles r LEFT JOIN recs USING (path) GROUP BY r.path")
_PAGES = "SELECT page_id || ' ' || url AS path, html AS content FROM pages"
ORACLE["rules_on_pages"] = with_([("rfiles", _PAGES), ("found", " UNION ALL ".join(
    q for r in (org_rules.NO_EVAL, org_rules.NO_DANGEROUS_HTML, org_rules.NO_SYNC_FS) for q in RULE_SQL[r]))], _RULE_OUT)
ORACLE["missing_tests"] = with_([PATHS, ("p", selected("drift", "path"))], f"""
SELECT path, t AS expected_test FROM (SELECT path, CASE WHEN contains(path, '/') THEN {DIR} || '/' ELSE '' END
|| {STEM} || '.test' || {ext()} AS t FROM p WHERE NOT {LEARNER_TEST}) WHERE t NOT IN (SELECT path FROM p)""")

# --- functions ----------------------------------------------------------------------------------

ORACLE["path_functions"] = with_([PATHS], f"""
SELECT path, {BASE} AS base, {ext()} AS ext, {DIR} AS folder, {STEM} AS stem,
CASE WHEN contains(path, '/') THEN {DIR} || '/' ELSE '' END || {STEM} || '.test' || {ext()} AS expected_test,
len(string_split(path, '/')) >= 2 AS in_feature, {LEARNER_TEST} AS learner_test,
contains(path, '.test.') OR contains(path, '.spec.') AS audit_test,
CASE WHEN starts_with(path, 'src/') THEN path[5:] ELSE path END AS below_src FROM code""")
ORACLE["naming_style"] = with_([PATHS, ("n", f"SELECT path, {STEM} AS name FROM code")], f"""
SELECT path, name, {style('name', DRIFT_STYLES)} AS drift_style, {style('name')} AS rule_style,
{style('name', FILE_STYLES, 'NULL')} AS file_style FROM n""")
ORACLE["convert_naming"] = with_([*files(), ("n", f"""
SELECT {var_name('m')} AS name FROM (SELECT unnest(regexp_extract_all(content, {rx(text.VARIABLE)})) AS m FROM files)
UNION SELECT {STEM} FROM files""")], "SELECT name, " + ", ".join(
    f"{convert('name', s(t))} AS {c}" for c, t in [("camel", "camelCase"), ("snake", "snake_case"),
    ("pascal", "PascalCase"), ("kebab", "kebab-case")]) + ", name AS upper FROM n")
_HIT_COLS = "i::INT AS i, {name} AS name, line::INT AS line, col::INT AS col"
ORACLE["extract_variables"] = with_(files(), f"SELECT path, {_HIT_COLS.format(name=var_name())} FROM ({hits('files', text.VARIABLE)})")
ORACLE["extract_functions"] = with_(files(), " UNION ALL ".join(
    f"SELECT '{k}' AS dialect, path, {_HIT_COLS.format(name=fn_name(k))} FROM ({hits('files', p)})" for k, p in text.FUNCTION.items()))
ORACLE["extract_constants"] = with_(files(), f"SELECT path, {_HIT_COLS.format(name=group_of('text', text.CONSTANT, 1))} FROM ({hits('files', text.CONSTANT)})")
ORACLE["extract_imports"] = with_([*files(), IMPORT_ROWS], f"""
SELECT path, i::INT AS i, p AS import_path, line::INT AS line, starts_with(p, '.') AS relative,
string_split(p, '/')[1] AS library, {IMP_EXT} AS extension, starts_with(p, '@') OR starts_with(p, '.') AS internal,
contains(p, 'eval') OR contains(p, 'vm') OR contains(p, 'child_process') AS discouraged FROM imps""")
ORACLE["export_styles"] = with_(files(), f"SELECT path, coalesce({EXPORT}, 'none') AS style FROM files")
ORACLE["comment_profile"] = with_(files(), COMMENTS.replace("@@", "files"))
ORACLE["page_variables"] = with_([("files", _PAGES)], f"SELECT path, {_HIT_COLS.format(name=var_name())} FROM ({hits('files', text.VARIABLE)})")
ORACLE["page_comments"] = with_([("files", _PAGES)], COMMENTS.replace("@@", "files"))

# --- drift --------------------------------------------------------------------------------------


def _d(rule, category, kind, severity, message, expected="NULL", actual="NULL", line="1", col="1", suggestion="NULL", source="dfiles", where="true", ord_=0, idx="0"):
    return (
        f"SELECT path, {ord_} AS ord, {idx} AS idx, {s(rule)} AS rule, {s(category)} AS category, {s(kind + '_drift')} AS type, "
        f"{severity} AS severity, ({line})::INT AS line, ({col})::INT AS col, {message} AS message, "
        f"({expected})::VARCHAR AS expected, ({actual})::VARCHAR AS actual, ({suggestion})::VARCHAR AS suggestion "
        f"FROM {source}, prof WHERE {where}"
    )


def _ident(rule, what, column, pattern, name, ord_):
    source = f"(SELECT *, {style('name', DRIFT_STYLES)} AS st FROM (SELECT path, i, line, col, {name} AS name FROM ({hits('dfiles', pattern)})))"
    return _d(rule, f"{what.lower()}_naming", "naming", "'low'",
              f"'{what} ''' || name || ''' uses ''' || st || ''' naming but project standard is ''' || {column} || ''''",
              column, "st", "line", "col", convert("name", column), source, f"st <> {column} AND st <> 'unknown'", ord_, "i")


def drift_parts():
    consts = (
        f"(SELECT *, {style('name', DRIFT_STYLES)} AS st FROM (SELECT path, i, line, col, "
        f"{group_of('text', text.CONSTANT, 1)} AS name FROM ({hits('dfiles', text.CONSTANT)})))"
    )
    imps = f"(SELECT path, i, line, col, {group_of('text', text.IMPORT, 1)} AS p FROM ({hits('dfiles', text.IMPORT)}))"
    com = "(" + COMMENTS.replace("@@", "dfiles") + ")"
    names = f"(SELECT path, {style(STEM, DRIFT_STYLES)} AS st FROM dfiles)"
    return {
        "file_naming": [_d(drift.FILE_NAMING, "file_naming", "naming", "'medium'",
            "'File naming style ''' || st || ''' differs from project standard ''' || files || ''''", "files", "st",
            source=names, where="st <> files AND st <> 'unknown'")],
        "naming": [
            _ident(drift.VARIABLE_NAMING, "Variable", "variables", text.VARIABLE, var_name(), 1),
            _ident(drift.FUNCTION_NAMING, "Function", "functions", text.FUNCTION["drift"], fn_name("drift"), 2),
            _d(drift.CONSTANT_NAMING, "constant_naming", "naming", "'low'",
               "'Constant ''' || name || ''' should use ' || constants || ' naming convention'", "constants", "st", "line", "col",
               source=consts, where="constants = 'UPPER_CASE' AND st <> 'UPPER_CASE'", ord_=3, idx="i"),
        ],
        "imports": [
            _d(drift.IMPORT_STYLE, "import_style", "import", "'low'", "'Relative import detected but project prefers absolute imports'",
               "import_style", "'relative'", "line", "col", source=imps, where="starts_with(p, '.') AND import_style = 'absolute'", ord_=4, idx="i * 4"),
            _d(drift.IMPORT_STYLE, "import_style", "import", "'low'", "'Absolute import for internal module but project prefers relative imports'",
               "import_style", "'absolute'", "line", "col", source=imps, where="starts_with(p, '@') AND import_style = 'relative'", ord_=4, idx="i * 4 + 1"),
            _d(drift.IMPORT_EXTENSIONS, "import_extensions", "import", "'info'",
               f"'Import ' || {IMP_EXT} || ' extensions but project standard is ' || import_extensions", "import_extensions", IMP_EXT, "line", "col",
               source=imps, where=f"{IMP_EXT} <> import_extensions", ord_=4, idx="i * 4 + 2"),
            _d(drift.DISCOURAGED_LIBRARY, "discouraged_library", "import", "'high'",
               "'Import of discouraged library ''' || string_split(p, '/')[1] || ''''", line="line", col="col", source=imps,
               where="contains(p, 'eval') OR contains(p, 'vm') OR contains(p, 'child_process')", ord_=4, idx="i * 4 + 3"),
        ],
        "folders": [_d(drift.FOLDER_STRUCTURE, "folder_structure", "architecture", "'info'",
            "'File location may not follow established folder patterns'", "'One of: ' || array_to_string(folders, ', ')", DIR,
            where="len(folders) > 0 AND len(list_filter(folders, lambda f: contains(path, f))) = 0", ord_=5)],
        "comments": [
            _d(drift.COMMENT_STYLE, "comment_style", "comment", "'info'",
               "'Comment style ''' || style || ''' differs from project standard ''' || comment_style || ''''", "comment_style", "style",
               source=com, where="style <> comment_style", ord_=6),
            _d(drift.COMMENT_DENSITY, "comment_density", "comment",
               "CASE comment_density WHEN 'none' THEN 'high' WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END",
               "'Comment density ''' || level || ''' differs from project standard ''' || comment_density || ''''", "comment_density", "level",
               source=com, where="level <> comment_density", ord_=7),
        ],
    }


def drift_ctes(parts=None, policy="drift"):
    chosen = [q for k, qs in drift_parts().items() if parts is None or k in parts for q in qs]
    return [*profile_ctes(), ("dfiles", selected(policy)), ("dv", " UNION ALL ".join(chosen))]


_DCOLS = "path, rule, category, severity, line, col, message, expected, actual"
ORACLE["drift_file_naming"] = with_(drift_ctes(["file_naming"]), f"SELECT {_DCOLS} FROM dv")
ORACLE["drift_naming"] = with_(drift_ctes(["naming"]), f"""SELECT {_DCOLS}, suggestion FROM dv""")
for _n in ("imports", "folders", "comments"):
    ORACLE[f"drift_{_n}"] = with_(drift_ctes([_n]), f"SELECT {_DCOLS} FROM dv")
DSCORED = ("dscored", """SELECT d.path, greatest(0, 100 - least(2 * coalesce(sum(CASE v.severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0
WHEN 'medium' THEN 3.0 WHEN 'low' THEN 1.0 WHEN 'info' THEN 0.5 END), 0), 100))::DOUBLE AS score,
count(v.path) FILTER (WHERE v.severity <> 'info')::INT AS n_visible FROM dfiles d LEFT JOIN dv v USING (path) GROUP BY d.path""")
ORACLE["drift_score"] = with_([*drift_ctes(), DSCORED], "SELECT * FROM dscored")
ORACLE["drift_below_threshold"] = with_([*drift_ctes(), DSCORED], "SELECT path, score FROM dscored WHERE score / 100 < 0.7")
ORACLE["drift_summary"] = with_([*drift_ctes(), DSCORED], "SELECT (SELECT count(*) FROM dscored) AS files_analyzed, "
    "(SELECT count(*) FROM dv WHERE severity <> 'info') AS total_violations, "
    + ", ".join(f"(SELECT count(*) FROM dv WHERE severity = '{x}') AS {x}_violations" for x in _SEVS[:-1])
    + ", (SELECT coalesce(floor(avg(score) + 0.5), 100)::BIGINT FROM dscored) AS overall_score")
ORACLE["drift_by_folder"] = with_([*drift_ctes(), DSCORED], f"""SELECT folder, count(*) AS files_analyzed, sum(n_visible)::BIGINT AS total_violations,
floor(avg(score) + 0.5)::BIGINT AS overall_score FROM (SELECT {DIR} AS folder, * FROM dscored) GROUP BY ROLLUP (folder)""")
ORACLE["drift_bulk_fix"] = with_(drift_ctes(), """
SELECT path, 'bulk_fix' AS type, k AS category, 'Consider fixing all ' || count(*) || ' ' || regexp_replace(k, '_', ' ') || ' violations' AS message,
string_agg(line, ',' ORDER BY ord, idx) AS affected_lines, arg_min(severity, ord * 1000000 + idx) AS priority
FROM (SELECT *, type || '_' || category AS k FROM dv WHERE severity <> 'info') GROUP BY path, k HAVING count(*) > 1""")
ORACLE["line_context"] = with_([*drift_ctes(["naming"])], f"""
SELECT path, line, coalesce(array_to_string(ls[greatest(line - 3, 1):line - 1], chr(10)), '') AS before, ls[line] AS text,
coalesce(array_to_string(ls[line + 1:line + 3], chr(10)), '') AS after
FROM (SELECT dv.path, dv.line, string_split(content, chr(10)) AS ls FROM dv JOIN dfiles USING (path) WHERE rule = {s(drift.CONSTANT_NAMING)})""")

# --- AI detection -------------------------------------------------------------------------------

_AI_ROWS = []
for _i, _p in enumerate(ai_detect.COMMENTS):
    _AI_ROWS.append(
        f"SELECT path, {_i} AS ord, 0 AS idx, 'comment_pattern' AS type, regexp_extract(content, {rx(_p.rx)})[:100] AS evidence, "
        f"NULL::INT AS line FROM files WHERE regexp_matches(content, {rx(_p.rx)})")
_AI_ROWS.append(
    f"SELECT path, 50 AS ord, i AS idx, 'naming_pattern' AS type, name AS evidence, line::INT AS line FROM (SELECT path, i, line, "
    f"{fn_name('detect')} AS name FROM ({hits('files', text.FUNCTION['detect'])})) WHERE "
    + "(" + " OR ".join(f"regexp_matches(name, {rx(p)})" for p in ai_detect.NAMING) + ")")
_o = 100
for _kind, _ps in ai_detect.EVERY_MATCH.items():
    for _p in _ps:
        _cut = ai_detect.EVIDENCE.get(_kind, 100)
        _ev = "text" if _cut is None else f"text[:{_cut}]"
        _AI_ROWS.append(f"SELECT path, {_o} AS ord, i AS idx, '{_kind}' AS type, {_ev} AS evidence, line::INT AS line FROM ({hits('files', _p.rx)})")
        _o += 1
_WEIGHTS = " UNION ALL ".join(f"SELECT '{k}' AS type, {c}::DOUBLE AS confidence, {w}::DOUBLE AS w" for k, (_, c, w) in ai_detect.TYPES.items())


def ai_ctes(policy="drift", source=None):
    base = files(policy) if source is None else source
    return [
        *base, ("inds", " UNION ALL ".join(_AI_ROWS)), ("weights", _WEIGHTS),
        ("conf", """SELECT f.path, count(i.path)::INT AS n_indicators, CASE WHEN count(i.path) = 0 THEN 0 ELSE
        least(sum(w.confidence * w.w) / sum(w.w) * (1 - exp(-count(i.path) / 3.0)), 0.95) END AS confidence
        FROM files f LEFT JOIN inds i USING (path) LEFT JOIN weights w USING (type) GROUP BY f.path"""),
    ]


ORACLE["ai_indicators"] = with_(ai_ctes(), """
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord, idx) - 1)::INT AS seq, type, confidence, evidence, line
FROM inds JOIN weights USING (type)""")
ORACLE["ai_first_n"] = with_(ai_ctes(), """SELECT path, seq::INT AS seq, type, line FROM (
SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord, idx) - 1 AS seq, type, line FROM inds) WHERE seq < 3""")
_ADVICE = "CASE " + " ".join(f"WHEN confidence >= {b} THEN {s(t)}" for b, t in ADVICE) + f" ELSE {s(NO_ADVICE)} END"
ORACLE["ai_confidence"] = with_(ai_ctes(), f"""SELECT path, n_indicators, round(confidence, 6) AS confidence,
confidence >= 0.6 AS is_likely_ai, {_ADVICE} AS recommendation FROM conf""")
ORACLE["ai_report"] = with_(ai_ctes(), "SELECT count(*) AS files_analyzed, count(*) FILTER (WHERE confidence >= 0.6) AS ai_files FROM conf")
ORACLE["ai_above_threshold"] = with_(ai_ctes(), "SELECT path, round(confidence, 6) AS confidence FROM conf WHERE confidence >= 0.4")
ORACLE["ai_files_ranked"] = with_(ai_ctes(), "SELECT path, round(confidence, 6) AS confidence FROM conf WHERE confidence >= 0.6")
_MODEL = ("model", f"SELECT {path_of()} AS path, (5 + doc_id % 5) / 10.0 AS mc, doc_id % 23 + 1 AS line FROM documents WHERE doc_id % 7 <> 0")
ORACLE["ai_model_indicators"] = with_([_MODEL], """SELECT path, 0 AS seq, 'ai_analysis' AS type, 'generic names' AS description, mc::DOUBLE AS confidence FROM model
UNION ALL SELECT path, 1, 'ai_analysis', 'template structure', mc::DOUBLE FROM model""")
ORACLE["ai_model_sections"] = with_([_MODEL], "SELECT path, line::INT AS line, 'boilerplate' AS reason, mc::DOUBLE AS confidence FROM model")
ORACLE["ai_model_confidence"] = with_([*ai_ctes(), _MODEL, ("every", """SELECT path, w.confidence AS c, w.w FROM inds JOIN weights w USING (type)
UNION ALL SELECT path, mc, 0.8 FROM model, range(2)"""), ("conf2", """SELECT f.path, count(e.path)::INT AS n_indicators,
CASE WHEN count(e.path) = 0 THEN 0 ELSE least(sum(e.c * e.w) / sum(e.w) * (1 - exp(-count(e.path) / 3.0)), 0.95) END AS confidence FROM files f LEFT JOIN every e USING (path) GROUP BY f.path""")],
    "SELECT path, n_indicators, round(confidence, 6) AS confidence, confidence >= 0.6 AS is_likely_ai FROM conf2")

# --- AI audit -----------------------------------------------------------------------------------

SECTIONS = ("sections", f"""SELECT path, unnest([doc_id % 11 + 3, doc_id % 17 + 14]) AS sline FROM (SELECT doc_id, {path_of()} AS path FROM documents WHERE doc_id % 3 <> 2)""")


def audit_ctes(policy="drift", org=True, only=None):
    A = ai_audit
    fn = f"(SELECT path, i, line, {fn_name('audit')} AS name FROM ({hits('afiles', text.FUNCTION['audit'])}))"
    near = lambda k: f"EXISTS (SELECT 1 FROM sections x WHERE x.path = c.path AND abs(x.sline - c.line) <= {k})"
    reviewed = " OR ".join(f"regexp_matches(content, {rx(p.rx)})" for p in A.REVIEWED)
    cx = "(" + " OR ".join(f"regexp_matches(w, {rx(js(p))})" for p in A.COMPLEX) + ")"
    out = lambda rule, ord_, idx, cat, sev, line, msg, sug="NULL", ev="NULL": (
        f"SELECT path, {ord_} AS ord, {idx} AS idx, {s(rule)} AS rule, {s(cat)} AS category, {s(sev)} AS severity, "
        f"({line})::INT AS line, {msg} AS message, ({sug})::VARCHAR AS suggestion, ({ev})::VARCHAR AS evidence ")
    parts = {
        A.HUMAN_COMMENTS: [out(A.HUMAN_COMMENTS, 1, 0, "documentation", "medium", "NULL", s(A.HUMAN_MESSAGE))
            + f"FROM afiles WHERE NOT ({reviewed}) AND path IN (SELECT path FROM sections)"],
        A.UNIT_TESTS: [out(A.UNIT_TESTS, 2, 0, "documentation", "high", "NULL", s(A.UNIT_MESSAGE) + " || string_agg(name, ', ' ORDER BY i)")
            + f"FROM {fn} c WHERE NOT (contains(path, '.test.') OR contains(path, '.spec.')) AND {near(5)} GROUP BY path"],
        A.COMPLEXITY_COMMENTS: [out(A.COMPLEXITY_COMMENTS, 3, "sline", "documentation", "medium", "sline", s(A.COMPLEX_MESSAGE))
            + f"FROM windows WHERE {cx} AND NOT regexp_matches(w, {rx(js(A.EXPLAINED))})"],
        A.PLACEHOLDERS: [out(A.PLACEHOLDERS, 4, f"{j} * 100000 + i", "quality", "high", "line", s(A.PLACEHOLDER_MESSAGE), ev="trim(text)")
            + f"FROM ({hits('afiles', p.rx)})" for j, p in enumerate(A.PLACEHOLDER_PATTERNS)],
        A.CONSISTENT_NAMING: [out(A.CONSISTENT_NAMING, 5, "i", "quality", "medium", "line",
            "'AI-generated function ''' || name || ''' should use ' || functions || ' naming convention'",
            f"'Rename to: ' || {convert('name', 'functions', kebab=False)}")
            + f"FROM {fn} c, prof WHERE {style('name')} NOT IN ('unknown', functions) AND {near(3)}"],
        A.SECURITY_REVIEW: [out(A.SECURITY_REVIEW, 6, f"{j} * 100000 + i", "security", "high", "line", s(A.SECURITY_MESSAGE + what), ev=s(what))
            + f"FROM ({hits('afiles', p.rx)}) c WHERE {near(3)}" for j, (p, what) in enumerate(A.RISKS)],
        A.PERFORMANCE_REVIEW: [out(A.PERFORMANCE_REVIEW, 7, f"{j} * 100000 + i", "performance", "medium", "line", s(A.PERFORMANCE_MESSAGE + what), ev=s(what))
            + f"FROM ({hits('afiles', p.rx)}) c WHERE {near(5)}" for j, (p, what) in enumerate(A.SLOW)],
        A.ERROR_HANDLING: [out(A.ERROR_HANDLING, 8, "sline", "organizational", "medium", "sline", s(A.ERROR_MESSAGE))
            + f"FROM windows WHERE regexp_matches(w, {rx(js(A.HAS_FUNCTION))}) AND NOT regexp_matches(w, {rx(js(A.HANDLES_ERRORS))})"],
    }
    chosen = [q for r, qs in parts.items() for q in qs if (only is None or r in only) and (org or r != A.ERROR_HANDLING)]
    learned_ctes = profile_ctes()
    ai = [c for c in ai_ctes(policy) if c[0] != "code"]
    return [
        *learned_ctes, *ai, ("afiles", "SELECT files.path, files.content, conf.confidence FROM files JOIN conf USING (path) WHERE conf.confidence >= 0.6"),
        SECTIONS,
        ("windows", "SELECT path, sline, coalesce(array_to_string(string_split(content, chr(10))[greatest(sline - 4, 1):sline + 5], chr(10)), '') AS w "
                    "FROM afiles JOIN sections USING (path)"),
        ("av", " UNION ALL ".join(chosen)),
    ]


_ACOLS = "path, rule, category, severity, line, message"
for _q, _r, _more in [("audit_human_comments", ai_audit.HUMAN_COMMENTS, ""), ("audit_unit_tests", ai_audit.UNIT_TESTS, ""),
                      ("audit_complexity", ai_audit.COMPLEXITY_COMMENTS, ""), ("audit_placeholders", ai_audit.PLACEHOLDERS, ", evidence"),
                      ("audit_naming", ai_audit.CONSISTENT_NAMING, ", suggestion"), ("audit_security", ai_audit.SECURITY_REVIEW, ", evidence"),
                      ("audit_performance", ai_audit.PERFORMANCE_REVIEW, ", evidence"), ("org_error_handling", ai_audit.ERROR_HANDLING, "")]:
    ORACLE[_q] = with_(audit_ctes(only=[_r]), f"SELECT {_ACOLS}{_more} FROM av")
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
ORACLE["audit_ordered"] = with_(audit_ctes(), f"""SELECT path, (row_number() OVER (PARTITION BY path ORDER BY {_RANK} DESC, ord, idx) - 1)::INT AS seq,
rule, severity, line FROM av""")
AREP = ("arep", """SELECT a.path, any_value(a.confidence) AS confidence, count(v.path) AS n_violations,
greatest(0, 100 - least(coalesce(sum(CASE v.severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END), 0), 100))::INT AS score,
count(*) FILTER (WHERE v.severity = 'high') AS nh, count(*) FILTER (WHERE v.category = 'security') AS ns,
count(*) FILTER (WHERE v.category = 'quality') AS nq, count(*) FILTER (WHERE v.category = 'documentation') AS nd,
count(*) FILTER (WHERE v.rule = 'require-unit-tests') AS nt, count(*) FILTER (WHERE v.rule = 'require-complexity-comments') AS nc
FROM afiles a LEFT JOIN av v USING (path) GROUP BY a.path""")
ORACLE["audit_score"] = with_([*audit_ctes(), AREP], "SELECT path, round(confidence, 6) AS confidence, n_violations, score FROM arep")
ORACLE["audit_worst"] = with_([*audit_ctes(), AREP], "SELECT path, n_violations, score FROM arep ORDER BY score, path LIMIT 10")
ORACLE["audit_recommendations"] = with_([*audit_ctes(), AREP], f"""SELECT path, coalesce(nullif(concat_ws('; ',
CASE WHEN confidence > 0.8 THEN {s(ai_audit.ADVICE_HIGH_CONFIDENCE)} END, CASE WHEN nh > 0 THEN {s(ai_audit.ADVICE_HIGH_SEVERITY)} END,
CASE WHEN ns > 0 THEN {s(ai_audit.ADVICE_SECURITY)} END, CASE WHEN nt > 0 THEN {s(ai_audit.ADVICE_TESTS)} END,
CASE WHEN nc > 0 THEN {s(ai_audit.ADVICE_COMPLEXITY)} END), ''), {s(ai_audit.ADVICE_DEFAULT)}) AS recommendations FROM arep""")
ORACLE["audit_actions"] = with_([*audit_ctes(), AREP], """
SELECT path, 'high' AS priority, 'Schedule security team review' AS action, ns || ' security-related violations in AI code' AS reason FROM arep WHERE ns > 0
UNION ALL SELECT path, 'medium', 'Address code quality issues', nq || ' quality violations need attention' FROM arep WHERE nq > 0
UNION ALL SELECT path, 'low', 'Improve documentation', nd || ' documentation issues found' FROM arep WHERE nd > 0
UNION ALL SELECT path, 'low', 'Add human review marker', 'Mark AI code as reviewed by human developer' FROM arep WHERE ns + nq + nd = 0""")
ORACLE["audit_directory"] = with_([*audit_ctes(), AREP], """SELECT (SELECT count(*) FROM files) AS files_analyzed, count(*) AS ai_files,
coalesce(sum(n_violations), 0)::BIGINT AS total_violations, coalesce(floor(avg(score) + 0.5), 100)::BIGINT AS average_score FROM arep""")

# --- analysis log and its readers ---------------------------------------------------------------


def merged_ctes(excepted=True, only=(ai_audit.PLACEHOLDERS,), org=False):
    """ana: one row per watched file; mv: its violations in order."""
    ctes = audit_ctes("watch", org=org, only=only)
    ctes += [("dfiles", "SELECT * FROM files"), ("dv", " UNION ALL ".join(q for qs in drift_parts().values() for q in qs)), DSCORED]
    rules = [c for c in rule_ctes("watch", excepted=excepted, as_of=None) if c[0] not in {n for n, _ in profile_ctes()}]
    ctes += rules
    return [*ctes, ("mv", f"""
SELECT path, 'audit' AS source, 0 AS src, row_number() OVER (PARTITION BY path ORDER BY {_RANK} DESC, ord, idx) AS a, 0 AS b, rule, category, severity, line, message FROM av
UNION ALL SELECT path, 'drift', 1, ord, idx, rule, category, severity, line, message FROM dv WHERE severity <> 'info'
UNION ALL SELECT path, 'rule', 2, ord, idx, rule, category, severity, line, message FROM found"""),
        ("ana", f"""SELECT c.path, c.confidence, d.score AS drift_score, count(m.path)::INT AS total_issues,
[ 'info', 'low', 'medium', 'high', 'critical'][coalesce(max({_RANK.replace('severity', 'm.severity')}), 0) + 1] AS severity,
count(m.path) FILTER (WHERE source = 'audit')::INT AS n_audit, count(m.path) FILTER (WHERE source = 'drift')::INT AS n_drift,
count(m.path) FILTER (WHERE source = 'rule')::INT AS n_rule,
concat_ws('; ', CASE WHEN c.confidence >= 0.6 THEN {s(analysis.INSIGHT_AI)} END,
CASE WHEN d.score < 80 THEN 'Code drift detected (' || d.score::INT || '/100 compliance)' END) AS insights
FROM conf c JOIN dscored d USING (path) LEFT JOIN mv m USING (path) GROUP BY c.path, c.confidence, d.score"""),
    ]


ORACLE["analysis_merged"] = with_(merged_ctes(), """SELECT path, insights, round(confidence, 6) AS confidence, drift_score, total_issues, severity,
n_audit, n_drift, n_rule FROM ana WHERE total_issues > 0 OR insights <> ''""")
ORACLE["analysis_toggles"] = with_(merged_ctes(), """SELECT 'ai' AS part, path, n_audit AS n, true AS has_ai, false AS has_drift FROM ana
UNION ALL SELECT 'drift', path, n_drift, false, true FROM ana UNION ALL SELECT 'rules', path, n_rule, false, false FROM ana""")
ORACLE["analysis_with_sections"] = with_(merged_ctes(excepted=False, only=None), "SELECT path, total_issues AS n, severity, n_audit FROM ana")
ORACLE["highest_severity"] = with_(merged_ctes(), "SELECT path, severity FROM ana")
ORACLE["violations_by_severity"] = with_(merged_ctes(), "SELECT a.path, " + ", ".join(
    f"count(m.path) FILTER (WHERE m.severity = '{x}')::INT AS {x}" for x in _SEVS) + " FROM ana a LEFT JOIN mv m USING (path) GROUP BY a.path")

SESSIONS = [
    ("ch", f"SELECT {path_of('user_id')} AS path, ts, event_type FROM events"),
    ("marked", f"SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= {GAP} THEN 0 ELSE 1 END AS st FROM ch"),
    ("numbered", "SELECT *, sum(st) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM marked"),
    ("sess", f"SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + {GAP} AS session_end, count(*) AS n, "
             "arg_max(event_type, (ts, event_type)) AS last_event FROM numbered GROUP BY path, b"),
]
ORACLE["debounce_sessions"] = with_(SESSIONS, "SELECT path, first_ts, last_ts, session_end, n, last_event FROM sess")
ORACLE["stream_debounce"] = with_(SESSIONS, "SELECT path, first_ts, last_ts, session_end, n, last_event FROM sess")
ORACLE["stream_debounce_live"] = ORACLE["stream_debounce"]


def log_ctes():
    return [*merged_ctes(), *SESSIONS, ("an_ev", "SELECT 'file_analyzed' AS event, path AS file, session_end AS ts, * EXCLUDE (path, session_end) FROM sess JOIN ana USING (path)"),
            ("life", "SELECT 'monitor_started' AS event, min(ts) AS ts FROM an_ev UNION ALL SELECT 'monitor_stopped', max(ts) + INTERVAL 1 SECOND FROM an_ev"),
            ("lg", "SELECT * FROM an_ev UNION ALL BY NAME SELECT * FROM life")]


def last_n(n):
    return f"(SELECT * FROM lg ORDER BY ts DESC, file DESC NULLS LAST, event DESC LIMIT {n})"


_RECENT = ("recent", f"SELECT * FROM {last_n(20)} WHERE event = 'file_analyzed' ORDER BY ts DESC, file DESC LIMIT 10")
ORACLE["analysis_log"] = with_(log_ctes(), """SELECT event, file, ts, CASE WHEN file IS NOT NULL THEN total_issues END AS n_violations, insights,
round(confidence, 6) AS confidence, drift_score, total_issues, severity FROM lg""")
ORACLE["log_json_roundtrip"] = with_(log_ctes(), "SELECT event, file, ts, total_issues AS n_violations, severity FROM lg")
ORACLE["slim_log"] = with_(log_ctes(), """SELECT ts AS timestamp, file, total_issues AS n_violations,
(CASE WHEN confidence >= 0.6 THEN 1 ELSE 0 END + CASE WHEN drift_score < 80 THEN 1 ELSE 0 END)::INT AS n_insights,
confidence >= 0.6 AS ai_detected, total_issues > 0 AS has_list FROM lg WHERE event = 'file_analyzed'""")
ORACLE["daily_log"] = with_(log_ctes(), """SELECT ts::DATE AS date, ts, file, strftime(ts, '%H:%M:%S') || ' | ' ||
CASE WHEN length(b) >= 25 THEN b ELSE rpad(b, 25, ' ') END || ' | ' || CASE WHEN total_issues > 99 THEN total_issues::VARCHAR ELSE lpad(total_issues::VARCHAR, 3, ' ') END ||
' violations | ' || rpad(severity, 8, ' ') || ' ' || CASE WHEN insights <> '' THEN '[AI]' ELSE '' END AS line
FROM (SELECT *, string_split(file, '/')[-1] AS b FROM lg WHERE event = 'file_analyzed')""")
ORACLE["text_log_written"] = f"SELECT date, line FROM ({ORACLE['daily_log']})"
ORACLE["log_retention"] = with_(log_ctes(), "SELECT ts::DATE AS date, count(*) AS n FROM lg WHERE ts::DATE >= DATE '2024-01-13' GROUP BY 1")
ORACLE["recent_analysis"] = with_(log_ctes(), f"SELECT file, ts, total_issues FROM {last_n(10)} WHERE event = 'file_analyzed'")
ORACLE["recent_activity"] = with_([*log_ctes(), _RECENT], "SELECT file, ts, total_issues, severity FROM recent")
ORACLE["recent_violations"] = with_([*log_ctes(), _RECENT, ("rv", """SELECT r.file, r.ts, m.rule, m.line, m.message, r.ts AS t, m.src, m.a, m.b
FROM recent r JOIN mv m ON m.path = r.file WHERE m.severity = 'high'""")],
    "SELECT file, ts, rule, line, message, (SELECT count(*) FROM rv) AS total FROM rv ORDER BY t, file, src, a, b LIMIT 10")
ORACLE["file_analysis"] = with_([*log_ctes(), _RECENT], f"""SELECT f.path, r.ts AS last_analyzed, r.total_issues, r.severity,
CASE WHEN r.ts IS NULL THEN {s(activity.NOT_FOUND)} END AS error, CASE WHEN r.ts IS NULL THEN {s(activity.NOT_FOUND_HINT)} END AS suggestion
FROM files f LEFT JOIN (SELECT file, arg_min(total_issues, ts) AS total_issues, arg_min(severity, ts) AS severity, min(ts) AS ts FROM recent GROUP BY file) r ON r.file = f.path""")
ORACLE["monitor_status"] = with_([*log_ctes(), ("l20", f"SELECT * FROM {last_n(20)}")], """
SELECT coalesce((SELECT event FROM l20 WHERE event <> 'file_analyzed' ORDER BY ts DESC LIMIT 1) = 'monitor_started', false) AS is_running,
(SELECT max(ts) FROM l20 WHERE event <> 'file_analyzed') AS last_update, count(*) FILTER (WHERE event = 'file_analyzed') AS files_analyzed,
coalesce(sum(total_issues), 0)::BIGINT AS total_violations, count(*) FILTER (WHERE confidence >= 0.6) AS ai_code_detected FROM l20""")
ORACLE["monitor_status_list"] = with_([*log_ctes(), ("l20", f"SELECT * FROM {last_n(20)}"), ("newest", """
SELECT * FROM l20 WHERE event = 'file_analyzed' ORDER BY ts DESC, file DESC LIMIT 10""")], """
SELECT coalesce((SELECT event FROM l20 WHERE event <> 'file_analyzed' ORDER BY ts DESC LIMIT 1) = 'monitor_started', false) AS is_running,
(row_number() OVER (ORDER BY ts, file) - 1)::INT AS pos, ts, file, total_issues, severity, insights <> '' AS has_insights FROM newest""")
_STATS = """SELECT count(*) FILTER (WHERE event = 'file_analyzed') AS changes_detected, coalesce(sum(total_issues), 0)::BIGINT AS violations_found,
count(*) FILTER (WHERE confidence >= 0.6) AS ai_code_detected,
(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts) FILTER (WHERE event = 'monitor_started'))))::BIGINT AS uptime_seconds FROM lg"""
ORACLE["monitor_stats"] = with_(log_ctes(), _STATS)
ORACLE["summary_report"] = with_([*log_ctes(), ("st", _STATS)], """SELECT array_to_string([repeat('*', 80), '📊 MONITORING SUMMARY', repeat('*', 80),
'📁 Files Watched: 0', '🔄 Changes Detected: ' || changes_detected, '🚨 Violations Found: ' || violations_found, '🤖 AI Code Detected: ' || ai_code_detected,
'⏳ Uptime: ' || uptime_seconds || ' seconds', repeat('*', 80)], chr(10)) AS entry FROM st""")
ORACLE["org_context"] = with_([*log_ctes(), _RECENT], """SELECT prof.confidence, variables, functions, import_style, import_extensions,
'architecture,naming,performance,security' AS categories, (SELECT string_agg(file || ':' || total_issues, ',' ORDER BY ts, file) FROM
(SELECT * FROM recent ORDER BY ts DESC, file DESC LIMIT 5)) AS recent_activity FROM prof""")
ORACLE["suggest_improvements"] = with_([*rule_ctes(), *[c for c in ai_ctes(source=[("files", selected("compliance"))])], *RECS, ("sug", f"""
SELECT path, rec, pos FROM recs
UNION ALL SELECT path, {_ADVICE}, 100000000 FROM conf WHERE confidence >= 0.6
UNION ALL SELECT path, {s(activity.AI_REVIEW_HINT)}, 100000001 FROM conf WHERE confidence >= 0.6
UNION ALL SELECT path, 'Project uses ' || variables || ' for variables and ' || functions || ' for functions', 100000002 FROM rfiles, prof
UNION ALL SELECT path, 'Project prefers ' || import_style || ' imports and ' || import_extensions || ' file extensions', 100000003 FROM rfiles, prof""")],
    "SELECT path, string_agg(rec, '; ' ORDER BY pos) AS suggestions FROM sug GROUP BY path")
_SNIPS = "SELECT 'temp' || conv_id || '_' || turn || '.js' AS path, 'const user_reply = `' || text || '`;' || chr(10) || 'eval(user_reply);' AS content FROM conversations"
ORACLE["snippet_check"] = with_([*[c if c[0] != "rfiles" else ("rfiles", _SNIPS) for c in rule_ctes()], SCORED,
                                 *ai_ctes(source=[("files", _SNIPS)])],
    "SELECT s.path, n_violations, score, n_indicators, round(confidence, 6) AS confidence FROM scored s JOIN conf USING (path)")
ORACLE["violation_trend"] = with_([*log_ctes(), ("daily", """SELECT l.ts::DATE AS date, m.severity, count(*) AS n FROM an_ev l JOIN mv m ON m.path = l.file GROUP BY 1, 2""")],
    """SELECT date, severity, n, n - lag(n) OVER w AS change, round(avg(n) OVER (PARTITION BY severity ORDER BY date ROWS 6 PRECEDING), 6) AS moving_avg
FROM daily WINDOW w AS (PARTITION BY severity ORDER BY date)""")
ORACLE["ai_usage_by_folder"] = with_(ai_ctes(), f"""SELECT folder, count(*) AS files, count(*) FILTER (WHERE ai) AS ai_files, round(avg(ai::INT) * 100, 1) AS ai_percent
FROM (SELECT {DIR} AS folder, confidence >= 0.6 AS ai FROM conf) GROUP BY ROLLUP (folder)""")
ORACLE["org_dashboard"] = with_(merged_ctes(), "SELECT (SELECT count(*) FROM ana) AS files, (SELECT count(*) FROM mv) AS active_violations, "
    + ", ".join(f"(SELECT count(*) FROM mv WHERE severity = '{x}') AS {x}" for x in _SEVS[:-1])
    + ", (SELECT count(*) FROM ana WHERE confidence >= 0.6) AS ai_files, (SELECT round(avg((confidence >= 0.6)::INT) * 100, 1) FROM ana) AS ai_percent")
ORACLE["top_violations"] = with_(merged_ctes(), "SELECT rule, count(*) AS n, count(DISTINCT path) AS files FROM mv GROUP BY rule")
ORACLE["stream_monitor"] = with_([*merged_ctes(excepted=False), *SESSIONS], """SELECT path AS file, session_end AS ts, total_issues AS n_violations,
drift_score, severity FROM sess JOIN ana USING (path)""")

_MARK = "CASE lower(severity) WHEN 'critical' THEN '🔥' WHEN 'high' THEN '🚨' WHEN 'medium' THEN '⚠️' WHEN 'low' THEN '💡' WHEN 'info' THEN 'ℹ️' ELSE '❓' END"
ORACLE["context_log"] = with_([*log_ctes(), ("nv", "SELECT path, rule, severity, line, message, row_number() OVER (PARTITION BY path ORDER BY src, a, b) AS k FROM mv"),
    ("vt", f"""SELECT path, string_agg('   ' || k || '. ' || {_MARK} || ' [' || upper(severity) || '] ' || message || CASE WHEN line IS NULL THEN '' ELSE
chr(10) || '      📍 Line ' || line || ' | Rule: ' || rule END, chr(10) ORDER BY k) AS t FROM nv GROUP BY path""")], """
SELECT ts, file, concat_ws(chr(10), '📅 TIMESTAMP: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), '🎯 EVENT: ' || event, '📁 FILE: ' || file,
CASE WHEN file IS NOT NULL THEN concat_ws(chr(10), '📊 SUMMARY:', '   • Violations: ' || total_issues, '   • Severity: ' || severity,
'   • AI Detected: ' || CASE WHEN insights <> '' THEN 'YES' ELSE 'NO' END) END, '🚨 VIOLATIONS:' || chr(10) || t,
CASE WHEN confidence >= 0.6 THEN '🤖 AI CODE DETECTED:' || chr(10) || '   • Confidence: ' || format('{:.1f}', confidence * 100) || '%' END,
CASE WHEN insights <> '' THEN '💡 INSIGHTS:' || chr(10) || '   1. ' || replace(insights, '; ', chr(10) || '   2. ') END) AS entry
FROM lg LEFT JOIN vt ON vt.path = lg.file""")

_FULL = ("fv", f"""
SELECT path, 0 AS src, row_number() OVER (PARTITION BY path ORDER BY {_RANK} DESC, ord, idx) AS a, 0 AS b, rule, category, severity, line, NULL::INT AS col, message, {s(ai_audit.SUGGEST[ai_audit.PLACEHOLDERS])} AS suggestion FROM av
UNION ALL SELECT path, 1, ord, idx, rule, category, severity, line, col, message, suggestion FROM dv WHERE severity <> 'info'
UNION ALL SELECT path, 2, ord, idx, rule, category, severity, line, NULL, message, NULL FROM found""")
ORACLE["violations_report"] = with_([*merged_ctes(), _FULL,
    ("nv", "SELECT *, row_number() OVER (PARTITION BY path, severity ORDER BY src, a, b) AS k FROM fv"),
    ("gr", f"""SELECT path, severity, count(*) AS n, chr(10) || {_MARK} || ' ' || upper(severity) || ' SEVERITY (' || count(*) || ' issues):' || chr(10) || repeat('-', 50)
|| chr(10) || string_agg(k || '. ' || message || chr(10) || '   📍 Line ' || line || ', Column ' || coalesce(col::VARCHAR, 'N/A') || chr(10) || '   📋 Rule: '
|| rule || ' (' || category || ')' || coalesce(chr(10) || '   💡 Suggestion: ' || suggestion, '') || chr(10), chr(10) ORDER BY k) AS t FROM nv GROUP BY path, severity""")],
    f"""SELECT path, repeat('=', 100) || chr(10) || 'VIOLATIONS REPORT' || chr(10) || 'FILE: ' || path || chr(10) || 'TOTAL VIOLATIONS: ' || sum(n)::BIGINT || chr(10)
|| repeat('=', 100) || chr(10) || string_agg(t, chr(10) ORDER BY {_RANK} DESC) || chr(10) || repeat('=', 100) AS entry FROM gr GROUP BY path""")

# --- review responses ---------------------------------------------------------------------------

ORACLE["review_issues"] = """SELECT 'src/chat' || conv_id || '.js' AS path, turn, 0 AS seq, 'AI' AS source, 'info' AS severity, (turn + 1)::INT AS line,
text AS message, 'Review: ' || text AS suggestion, 'Revisit turn ' || turn AS model_suggestion FROM conversations WHERE role = 'assistant'"""
_PR = f"SELECT doc_id, {path_of()} AS path, n_chars, source FROM documents WHERE doc_id % 6 <> 5"
ORACLE["perf_review"] = with_([("r", _PR)], """
SELECT path, 'metric' AS kind, 0 AS seq, 'functionCount' AS name, NULL::INT AS line, (n_chars % 7)::VARCHAR AS text, '' AS code_snippet, NULL::VARCHAR AS suggestion FROM r WHERE doc_id % 6 <> 1
UNION ALL SELECT path, 'metric', 1, 'loopCount', NULL, (doc_id % 4)::VARCHAR, '', NULL FROM r WHERE doc_id % 6 <> 1
UNION ALL SELECT path, 'issue', 0, 'loop-inefficiency', (doc_id % 40 + 1)::INT, 'slow loop', 'for (;;)', 'Replace inefficient loop on line ' || (doc_id % 40 + 1)
|| ' with a more optimized structure, such as using "map" instead of "forEach" if you''re transforming arrays.' FROM r
UNION ALL SELECT path, 'issue', 1, NULL, 2, 'heavy call in ' || source, '', 'Review performance issue: heavy call in ' || source FROM r
UNION ALL SELECT path, 'suggestion', 0, NULL, NULL, 'cache results', '', NULL FROM r
UNION ALL SELECT path, 'suggestion', 1, NULL, NULL, 'use a map', 'new Map()', NULL FROM r""")
ORACLE["reviewable_files"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, {s(NOT_SPACE)})"
