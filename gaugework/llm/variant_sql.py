"""SQL, for DuckDB, of op12 and op13."""

from __future__ import annotations

#: One row with ``t``, the 256 entries of the table of crc32.
_TABLE = """k AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || [b::BIGINT for b in range(8)], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """crc32, unsigned, of the UTF-8 bytes of ``text``, beside a table that has ``t``."""
    octets = f"[('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT for i in range(strlen({text}))]"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP12 = rf"""
WITH {_TABLE},
 d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS original, {_crc("doc_id::VARCHAR")} AS h FROM documents, k),
 e AS (SELECT *, len(original) AS n, h // 10 AS g FROM d),
 f AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
 w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [original[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(n)] ELSE original END AS words FROM f),
 u AS (SELECT doc_id, n, words, unnest(range(1, n // 4 + 1)) AS q FROM w WHERE n >= 6),
 s AS (SELECT doc_id, n, words, q, unnest(range(0, n - 3 * q, q)) AS i FROM u),
 c AS (SELECT DISTINCT doc_id, q FROM s WHERE words[i + 1] = words[i + q + 1] AND words[i + 1] = words[i + 2 * q + 1] AND (q = 1 OR words[i + 2] = words[i + q + 2])),
 m AS (SELECT w.doc_id, q, unnest(range(n - q)) AS i, words FROM c JOIN w USING (doc_id)),
 o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m WHERE words[i + 1] = words[i + q + 1]),
 b AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
 r AS (SELECT doc_id, start, length, min(q) AS period FROM b GROUP BY ALL),
 t AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown FROM r GROUP BY doc_id),
 x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
 p AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM w),
 l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)
"""

OP13 = rf"""
WITH RECURSIVE {_TABLE},
 o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
 a AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY ALL),
 h AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM a, k),
 c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
 v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 p AS (SELECT x.word, y.word AS other, y.n FROM g x JOIN g y ON x.hole = y.hole AND x.word <> y.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = replace(hole, chr(1), '')
  UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = replace(hole, chr(1), '')),
 b AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM p GROUP BY word),
 f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
 r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.n, n_near, form, form_n, r.at AS root FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""
