"""Code files, AI sections, model responses and change events derived from the given tables.

The given ``documents`` hold prose, so each row becomes one source file: two code snippets chosen by
its id and the whole text as comments or as a string literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from codewarden.functions.sql import array, case, let

SNIPPETS = [
    """var user_name = readInput();
let MaxRetries = 3;
const API_TOKEN = 'x';
const API = '/v1';
// TODO: Implement retry
eval(user_name);
document.body.innerHTML = user_name;
document.body.outerHTML = '';""",
    """// Helper function to process input
function processUserInput(data) {
  // Add your validation here
  // Your code here
  // Implementation goes here
  const config = {
    retries: 3
  };
  const result = data;
  try {
    run(result);
  } catch (error) {
    console.error(error); return null;
  }
  try { run(config); } catch (e) { throw new Error('failed'); }
  if (!data) throw new Error('missing data');
  // Example usage: processUserInput(x)
  return result;
}""",
    """import React from 'react';
import { clamp } from './utils';
import * as api from '../api/client.js';
import path from 'path';
import shared from '@org/shared/core';
import vm from 'vm';
import { retrieve } from './retrieval';
import lodash from "lodash/fp";
export { clamp };""",
    """export default class OrderPanel {}
export const orderTotal = (items) => items.length;
export function BuildReport(rows) { return rows; }
const fetch_orders = async (url) => fetch(url);
let pendingOrders = [], x = 1;
const handler = function () { return typeof window; };
if (typeof window === 'undefined') { start(); }""",
    """const raw = fs.readFileSync('./a.txt');
fs.writeFileSync('./b.txt', raw);
const info = fs.statSync('./b.txt');
for (let i = 0; i < 3; i++) {
  for (let j = 0; j < 3; j++) { visit(i, j); }
}
rows.forEach(r => r.cells.forEach(paint));
setTimeout(tick, 10); setTimeout(tock, 20);
const matcher = new RegExp('a+');
const copy = JSON.parse(JSON.stringify(raw));""",
    """const client = companyFetch;
async function loadAccount(id) {
  if (!id) {
    return null;
  }
  const response = await fetch('/accounts/' + id);
  const password = readSecret();
  db.query('select 1');
  const token = jwt.sign({ id }, password);
  return crypto.createHash('sha256').update(token);
}""",
    """/**
 * This function formats a row.
 * @param row the row
 * @returns text
 */
function format_row(row) { return String(row); }
/**
 * @description joins rows
 * @example joinRows([])
 */
const joinRows = (rows) => {
  // This keeps order because callers depend on it
  return rows.map(a => a).filter(b => b).reduce((a, b) => a + b, '');
};
// Usage: joinRows(rows)
// Returns: text
// Reviewed by: Dana""",
    """describe('panel', () => {
  it('opens', () => { expect(open()).toBe(true); });
  test('closes', () => {});
});
/* TODO cover errors */
// FIXME: flaky
function check_state(a) {
  if (a) { if (a.b) { if (a.b.c) { log(a); } } }
  try { open(); } catch (e) { close(); } finally { done(); }
}""",
]


def _pick(values, index: str) -> str:
    return f"get({array(values)}, cast({index} AS int))"


def file_path(doc_id: str) -> str:
    """Path of a document's file: five naming styles, test files, ignored and root folders."""
    is_test = f"({doc_id} % 11 = 0 AND {doc_id} > 0)"

    def build(k):
        base = case([
            (f"{k} % 5 = 0", f"concat('userPanel', {k})"),
            (f"{k} % 5 = 1", f"concat('user-panel-', {k})"),
            (f"{k} % 5 = 2", f"concat('user_panel_', {k})"),
            (f"{k} % 5 = 3", f"concat('UserPanel', {k})"),
        ], f"concat('panel', {k})")
        folder = case([
            (f"{k} % 13 = 0", "''"),
            (f"{k} % 17 = 0", "'node_modules/pkg/'"),
            (f"{k} % 19 = 0", "'tools/build-scripts/'"),
            (f"{k} % 23 = 0", "'.cache/gen/'"),
            (f"{k} % 29 = 0", "'dist/'"),
            (f"{k} % 3 = 0", f"concat('src/feature', {k} % 20, '/parts/')"),
        ], f"concat('src/feature', {k} % 20, '/')")
        kind = case([(is_test, "'.test'"), (f"{doc_id} % 11 = 1", "'.spec'")], "''")
        ext = f"if({k} % 31 = 0, '.css', {_pick(['.js', '.ts', '.jsx', '.tsx'], f'{k} % 4')})"
        return f"concat({folder}, {base}, {kind}, {ext})"

    return let(f"{doc_id} - if({is_test}, 1, 0)", build)


def file_content(doc_id: str, text: str) -> str:
    style = f"({doc_id} div 64) % 4"
    block = case([
        (f"{style} = 0", f"concat('// ', replace({text}, '\\n', '\\n// '))"),
        (f"{style} = 1", f"concat('/*\\n', {text}, '\\n*/')"),
        (f"{style} = 2", f"concat('const notes = `', {text}, '`;')"),
    ], f"concat('/**\\n * ', replace({text}, '\\n', '\\n * '), '\\n */')")
    first, second = _pick(SNIPPETS, f"{doc_id} % 8"), _pick(SNIPPETS, f"({doc_id} div 8) % 8")
    return f"concat_ws('\\n', {first}, {second}, {block})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_files(doc_id, path, content) from all of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.selectExpr(
        "doc_id", f"{file_path('doc_id')} AS path", f"{file_content('doc_id', 'text')} AS content"
    )


def ai_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections a reviewer marked: two per document, for two documents out of three."""
    return table(spark, sf_dir, "documents").where("doc_id % 3 <> 2").selectExpr(
        f"{file_path('doc_id')} AS path",
        "explode(array(cast(doc_id % 11 + 3 AS int), cast(doc_id % 17 + 14 AS int))) AS line",
        "'marked by reviewer' AS reason",
        "0.5D + (doc_id % 5) / 10 AS confidence",
    )


def ai_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers about AI authorship: JSON, and prose (not JSON) for one document in seven."""
    answer = (
        """concat('{"isLikelyAI": true, "confidence": 0.', doc_id % 5 + 5, """
        """', "reasons": ["generic names", "template structure"], "sections": [{"line": ', """
        """doc_id % 23 + 1, ', "reason": "boilerplate"}]}')"""
    )
    return table(spark, sf_dir, "documents").selectExpr(
        f"{file_path('doc_id')} AS path", "'ai' AS kind",
        f"if(doc_id % 7 = 0, concat('no verdict for ', lang), {answer}) AS response",
    )


def practice_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-practice review answers: assistant turns as a JSON issue list, other turns as prose."""
    issue = "named_struct('line', turn + 1, 'message', text, 'suggestion', concat('Revisit turn ', turn))"
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('src/chat', conv_id, '.js') AS path", "turn", "'practice' AS kind",
        f"if(role = 'assistant', to_json(array({issue})), text) AS response",
    )


def performance_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance review answers: a JSON object inside prose, metrics of the wrong type, or no JSON."""
    answer = (
        """concat('Here is the result: {"metrics": ', if(doc_id % 6 = 1, '3', """
        """concat('{"functionCount": ', n_chars % 7, ', "loopCount": ', doc_id % 4, '}')), """
        """', "issues": [{"type": "loop-inefficiency", "line": ', doc_id % 40 + 1, """
        """', "message": "slow loop", "code snippet": "for (;;)"}, """
        """{"line": 2, "message": "heavy call in ', source, '"}], """
        """"suggestions": ["cache results", {"description": "use a map", "code": "new Map()"}]} done')"""
    )
    return table(spark, sf_dir, "documents").selectExpr(
        f"{file_path('doc_id')} AS path", "'performance' AS kind",
        f"if(doc_id % 6 = 5, concat('nothing to report on ', lang), {answer}) AS response",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: the user id stands for the changed document."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS doc_id", f"{file_path('user_id')} AS path",
        "cast(ts AS timestamp) AS ts", "event_type",
    )


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw exception entries: by file and rule, by file, by rule, some expired, some repeated."""
    return table(spark, sf_dir, "documents").where(
        "doc_id % 10 IN (3, 5) OR doc_id % 50 = 7 OR doc_id IN (0, 1)"
    ).selectExpr(
        f"if(doc_id IN (0, 1), NULL, {file_path('doc_id')}) AS file",
        "CASE WHEN doc_id IN (0, 1) THEN 'security/require-company-fetch' WHEN doc_id % 50 = 7 THEN NULL "
        "WHEN doc_id % 10 = 3 THEN 'security/no-eval' ELSE 'security/no-dangerous-html' END AS rule",
        "concat('ticket ', doc_id) AS reason",
        "if(doc_id % 10 = 5, date'2024-01-01', NULL) AS expires",
        "doc_id AS pos",
    )


def rule_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule-configuration document (JSON) per row of ``documents``: owner, value."""
    bad = "if(doc_id % 9 = 2, 'urgent', 'critical')"
    value = (
        """concat('{"metadata": {"version": "1.', doc_id % 3, '"', """
        """if(doc_id % 5 = 4, '', concat(', "name": "', source, '"')), '}, "rules": {"security": {"enabled": ', """
        """if(doc_id % 4 = 0, 'false', 'true'), ', "rules": {"no-eval": {"name": "No eval", "severity": "', """
        + bad + """, '", "description": "d"}, "no-dangerous-html": {"enabled": false}}}, """
        """"performance": {"enabled": true, "rules": {"no-sync-fs": {"severity": "high", "description": "d", """
        """"name": "fs", "parameters": {"limit": "', doc_id % 7, '"}}}}', """
        """if(doc_id % 6 = 0, ', "style": {"enabled": true, "rules": {}}', ''), '}}')"""
    )
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{value} AS value")


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as code files: the whole HTML with its scripts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.selectExpr("page_id", "concat(page_id, ' ', url) AS path", "html AS content")
