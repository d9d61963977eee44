"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, line, pos, low IS NOT NULL AND keyed.doc_id <> low AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = "regexp_extract_all({}, '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"
_DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (
  SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, w[s:s + least(10, len(w)) - 1] AS x
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(s) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM win),
runs AS (
  SELECT doc_id, s, width, w[s:s + width - 1] AS x
  FROM d, widths, unnest(generate_series(1, len(w) - width + 1)) AS t(s)),
hit AS (
  SELECT doc_id, s, runs.width AS width, item_id FROM runs JOIN win ON runs.x = win.x),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hit, unnest(generate_series(s, s + width - 1)) AS t(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

_PLAIN = "[^\\x{20}\\x{09}-\\x{0D}]+"
_QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '{_PLAIN}') AS w FROM d)),
per AS (SELECT r, count(*) AS n_words, sum(length(x)) AS word_chars FROM words GROUP BY r),
win AS (
  SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' '
         || lead(x, 4) OVER o AS k
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win WHERE k IS NOT NULL) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM twice, unnest(generate_series(i, i + 4)) AS t(p) GROUP BY r),
lines AS (
  SELECT r, source, text, x, i, regexp_extract_all(x, '{_PLAIN}') AS w
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
full_lines AS (
  SELECT *, {_LOWER.format("array_to_string(w, ' ')")} AS k FROM lines WHERE len(w) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM full_lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
frequent AS (
  SELECT f.source, k FROM full_lines f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, k, h.n HAVING count(DISTINCT text) >= 10 AND count(DISTINCT text) * 100.0 > h.n * 5.0),
lost AS (
  SELECT r, count(*) AS n, sum(len(w)) AS words
  FROM full_lines f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.k = q.k GROUP BY r),
told AS (
  SELECT doc_id, coalesce(per.n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_frequent_lines,
         (coalesce(per.n_words, 0) - coalesce(lost.words, 0))::BIGINT AS n_left_words
  FROM d LEFT JOIN per USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_left_words < 10 OR n_left_words * 100.0 < n_words * 50.0 AS depleted FROM told)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

_HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT pos.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
       row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other) AS rank
FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

_TERMS = "regexp_extract_all({}, '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"
_DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
FROM told QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP, "op2_decontamination": _DECONTAMINATION, "op11_quality_rules": _QUALITY,
    "op12_hard_negatives": _HARD_NEGATIVES, "op13_divergence_audit": _DIVERGENCE}
