"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from codewarden.llm import decontaminate, license_index, quality_hosts

ORACLE = {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WHITE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op6_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, {LOWER.format("trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))")} AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> s.first, false) AS dropped FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLE["op5_positional_decontamination"] = f"""
WITH doc_words AS (SELECT doc_id, {ALNUM} AS words FROM documents),
item_words AS (SELECT DISTINCT item_id, {ALNUM} AS words FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT *, least({decontaminate.WINDOW}, len(words)) AS size FROM item_words WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
doc_windows AS (
  SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS w
  FROM (SELECT d.*, z.size, unnest(range(1, len(words) - z.size + 2)) AS s FROM doc_words d, sizes z)),
hits AS (SELECT d.doc_id, d.s, i.size, i.item_id FROM doc_windows d JOIN item_windows i USING (size, w)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1),
near AS (
  SELECT doc_id, string_agg(i, ',' ORDER BY i) AS near_items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM near_hits) GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(near_items, '') AS near_items
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)"""

# proximity matches: most words of a window in place, found through the rarest term of some window of the item
ORACLE["op5_positional_decontamination"] = ORACLE["op5_positional_decontamination"].replace("near AS (\n", f"""doc_tokens AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM doc_words),
item_tokens AS (
  SELECT item_id, words, size, unnest(words) AS w, generate_subscripts(words, 1) AS q FROM items),
frequency AS (
  SELECT w, count(*) AS n FROM doc_tokens WHERE w IN (SELECT w FROM item_tokens) GROUP BY w),
seeds AS (
  SELECT DISTINCT item_id, words, first(q ORDER BY n, q) AS q
  FROM (SELECT i.item_id, i.words, t.s, i.q, f.n, i.size
        FROM item_tokens i JOIN (SELECT DISTINCT item_id, words, unnest(range(1, len(words) - size + 2)) AS s FROM items) t
          ON i.item_id = t.item_id AND i.words = t.words AND i.q BETWEEN t.s AND t.s + i.size - 1
        JOIN frequency f ON f.w = i.w)
  GROUP BY item_id, words, s, size HAVING count(*) = size),
seeded AS (
  SELECT DISTINCT t.doc_id, s.item_id, s.words, t.p - s.q AS shift
  FROM seeds s JOIN doc_tokens t ON t.w = s.words[s.q]),
placed AS (
  SELECT s.doc_id, s.item_id, s.words, s.shift, i.q, i.size
  FROM seeded s JOIN item_tokens i ON i.item_id = s.item_id AND i.words = s.words
  JOIN doc_tokens t ON t.doc_id = s.doc_id AND t.p = s.shift + i.q AND t.w = i.w),
near_hits AS (
  SELECT p.doc_id, p.item_id
  FROM placed p JOIN (SELECT DISTINCT item_id, words, unnest(range(1, len(words) - size + 2)) AS s FROM items) t
    ON p.item_id = t.item_id AND p.words = t.words AND p.q BETWEEN t.s AND t.s + p.size - 1
  GROUP BY p.doc_id, p.item_id, p.words, p.shift, t.s, p.size
  HAVING count(*) >= {decontaminate.NEAR} AND count(*) < p.size),
near AS (
""")

_Q = quality_hosts
_BASE = f"(n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PERCENT} * n_words)"
_MILD = (f"(100 * n_symbols > {_Q.MAX_SYMBOL_PERCENT} * n_words "
         f"OR 100 * n_dup_lines > {_Q.MAX_DUP_LINE_PERCENT} * n_text_lines)")
QUALITY = f"""
texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WHITE} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + {_Q.WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {_Q.WINDOW} + 2)) AS s FROM texts)),
repeated AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(s, s + {_Q.WINDOW})) AS p FROM windows JOIN repeated USING (doc_id, w))
  GROUP BY doc_id),
figures AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_text_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)),
hosts AS (
  SELECT source AS host, count(*) AS n, count(*) FILTER ({_BASE} OR {_MILD}) AS k FROM figures GROUP BY source),
moments AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1 / n) AS i FROM hosts),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * i, 1e-9) - 1, 1), 1e6) AS s FROM moments),
rejected AS (SELECT host FROM hosts, prior WHERE (k + m * s) / (n + s) >= {_Q.MAX_HOST_RATE}),
judged AS (
  SELECT f.*, {_BASE} AS base_failed,
         NOT ({_BASE} OR ({_MILD} AND EXISTS (SELECT 1 FROM rejected r WHERE r.host IS NOT DISTINCT FROM f.source))) AS kept
  FROM figures f)"""
ORACLE["op9_host_quality"] = f"""
WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def _licenses() -> str:
    templates = license_index.MENTIONS + license_index.NOTICES
    rows = []
    for k, t in enumerate(templates):
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows += [f"({k}, '{t.label}', {t.percent}, {p}, '{w}', {at <= p < at + len(key)})" for p, w in enumerate(words)]
    return f"""
WITH templates(tpl, label, percent, place, w, needed) AS (VALUES {", ".join(rows)}),
doc_words AS (SELECT doc_id, {ALNUM} AS words FROM documents),
tokens AS (
  SELECT doc_id, w, p FROM (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM doc_words)
  WHERE w IN (SELECT w FROM templates)),
weights AS (
  SELECT t.w, 1 + floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT d.doc_id) + 1)) + 0.5)::BIGINT AS weight
  FROM (SELECT DISTINCT w FROM templates) t LEFT JOIN tokens d USING (w) GROUP BY t.w),
weighted AS (SELECT t.*, weight FROM templates t JOIN weights USING (w)),
totals AS (SELECT tpl, sum(weight) AS total, count(*) FILTER (needed) AS n_needed FROM weighted GROUP BY tpl),
found AS (
  SELECT d.doc_id, t.tpl, t.label, t.percent, d.p - t.place AS start, sum(weight) AS gained, count(*) FILTER (needed) AS n
  FROM tokens d JOIN weighted t USING (w) GROUP BY ALL),
full_matches AS (
  SELECT f.*, round(gained / total, 6) AS score FROM found f JOIN totals USING (tpl)
  WHERE n = n_needed AND gained * 100 >= total * percent),
summed AS (
  SELECT doc_id, count(*) FILTER (tpl < {len(license_index.MENTIONS)}) AS n_base,
         min(start) FILTER (tpl < {len(license_index.MENTIONS)}) AS first_word,
         max(start) FILTER (tpl < {len(license_index.MENTIONS)}) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (tpl < {len(license_index.MENTIONS)}))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
  FROM full_matches GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM doc_words d LEFT JOIN summed USING (doc_id)"""


ORACLE["op10_license_scan"] = _licenses()

ORACLE["op13_exact_dedup"] = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept
  FROM keyed WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked"""
