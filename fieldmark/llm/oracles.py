"""DuckDB counterparts of the numbered queries that SQL can express."""

from __future__ import annotations

from fieldmark.llm.secrets import ASSIGN_PATTERN

JWT = "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
    FROM documents
),
places AS (
    SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3
),
wins AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win FROM places),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) o(d) WHERE c > 1 GROUP BY doc_id
),
measured AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
    FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
),
bits AS (
    SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
               + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 20 * n_words)::INT
               + 16 * (100 * n_symbols > 40 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT)::BIGINT AS bits
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       bits & 3 <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits
FROM bits
"""


def _found(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + length(whole) AS stop FROM (
        SELECT doc_id, whole, value,
               sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) - length(whole) AS start
        FROM (
            SELECT doc_id, i, gaps[i] AS gap, wholes[i] AS whole, vals[i] AS value FROM (
                SELECT doc_id, gaps, wholes, vals, unnest(generate_series(1, len(wholes))) AS i FROM (
                    SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS gaps,
                           regexp_extract_all(text, '{quoted}') AS wholes,
                           regexp_extract_all(text, '{quoted}', {group}) AS vals
                    FROM documents WHERE regexp_matches(text, '{quoted}')
                )
            )
        )
    ) WHERE length(value) >= {least}"""


SECRETS = f"""
WITH spans AS (
    {_found('assign', 0, ASSIGN_PATTERN, 2, 12)}
    UNION ALL {_found('access', 1, 'AKIA[A-Z0-9]+', 0, 18)}
    UNION ALL {_found('hex', 2, '[0-9a-f]+', 0, 16)}
    UNION ALL {_found('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1)}
    UNION ALL {_found('jwt', 4, JWT, 0, 1)}
),
listed AS (
    SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
           count(*) FILTER (place = 2) AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
                    FILTER (place < 3), '') AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
),
s AS (
    SELECT DISTINCT doc_id, md5_number(array_to_string(words[i : i + 4], ' ')) AS g FROM (
        SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0
    )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id
"""

LINES = rf"""
WITH l AS (
    SELECT doc_id, i, line, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(w)) END AS words
    FROM (
        SELECT doc_id, i, parts[i] AS line, regexp_extract_all(parts[i], '{WORD}') AS w FROM (
            SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
        )
    )
),
c AS (
    SELECT words, len(words) AS n, min((doc_id, i)) AS first, row_number() OVER (ORDER BY words) AS id
    FROM l WHERE words IS NOT NULL GROUP BY words
),
t AS (SELECT id, n, unnest(words) AS word FROM c),
shared AS (
    SELECT a.id AS a, b.id AS b, count(*) AS o FROM t a
    JOIN t b ON a.word = b.word AND a.id <> b.id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
    GROUP BY ALL
),
later AS (
    SELECT DISTINCT x.words FROM shared JOIN c x ON x.id = a JOIN c y ON y.id = b
    WHERE 100 * o >= 90 * (x.n + y.n - o) AND y.first < x.first
),
fate AS (
    SELECT l.doc_id, l.i, l.line,
           c.words IS NOT NULL AND ((l.doc_id, l.i) <> c.first OR later.words IS NOT NULL) AS gone
    FROM l LEFT JOIN c ON c.words = l.words LEFT JOIN later ON later.words = l.words
),
kept AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM fate GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

SQL: dict[str, str] = {
    "op6_quality_rules": QUALITY,
    "op7_secret_scan": SECRETS,
    "op8_ngram_jaccard": JACCARD,
    "op9_line_dedup": LINES,
}
