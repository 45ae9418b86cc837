"""SQL, for DuckDB, of the operators that SQL can express on whole tables."""

from __future__ import annotations

#: Words of a text in the order of the text.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _sha(text: str) -> str:
    return f"sha256({text})"


OP3 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS words FROM documents),
 g AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
 rw AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(3) t(j) GROUP BY doc_id),
 ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 ls AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines FROM ln GROUP BY doc_id),
 s AS (SELECT w.doc_id, lang, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN ls ON ls.doc_id = w.doc_id),
 m AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars * 10 // n_words ELSE 0 END AS word_length FROM s),
 v AS (SELECT doc_id, lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'word_length']) AS metric, unnest([symbol_share, dup_line_share, repeat_share, word_length]) AS value FROM m),
 q AS (SELECT lang, source, metric, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM v GROUP BY ALL),
 bad AS (SELECT DISTINCT doc_id FROM v JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.metric = q.metric WHERE value > q3 + 6 * greatest(q3 - q1, 30) OR value < q1 - 6 * greatest(q3 - q1, 30))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
 g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS i) WHERE len(words) > 0),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 90 * (x.n + y.n - nb)),
 e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) k ON k.node = w.doc_id
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents),
 g AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 11)) AS i)),
 f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
 h AS (SELECT DISTINCT doc_id, i + j AS pos FROM g JOIN f USING (gram), range(13) t(j) WHERE first_doc < doc_id),
 x AS (SELECT doc_id, count(*) AS n_removed FROM h GROUP BY doc_id),
 p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
 k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN h ON h.doc_id = p.doc_id AND h.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, {_sha("coalesce(kept, '')")} AS kept_sha256 FROM w LEFT JOIN x ON x.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, text, len({_WORDS.format('text')}) AS size FROM documents),
 u AS (SELECT *, (CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM d),
 k AS (SELECT *, -ln(u) / (CASE WHEN length(text) / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END) AS key FROM u),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 a AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
 b AS (SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM a WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
 l AS (SELECT min(pos) AS level FROM b WHERE left_size * weight <= cap * left_weight),
 t AS (SELECT b.source, b.source_size, CASE WHEN level IS NULL OR b.pos < level THEN b.cap::DOUBLE ELSE (q.left_size * b.weight)::DOUBLE / q.left_weight END AS target FROM b CROSS JOIN l LEFT JOIN b q ON q.pos = level),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
 r AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, target - epochs * p.source_size AS budget, sum(k.size) OVER (PARTITION BY k.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS after FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN size > 0 AND (after <= budget OR (after - size < budget AND after - budget < budget - (after - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

SQL = {"op3_quality_rules": OP3, "op6_ngram_jaccard": OP6, "op7_substring_dedup": OP7, "op9_mixing": OP9}
