"""DuckDB SQL twins of the training-data queries that SQL can express, stated from the queries' definitions."""

from __future__ import annotations

from lastmile.llm import minhash, substring_dedup
from lastmile.llm.license_scan import INDEX_WORDS, LEAST_SHARE, NOTICES, PHRASES


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


def license_scan() -> str:
    notices = values([(k, notice.label, notice.text) for k, notice in enumerate(NOTICES)])
    musts = values([(k, phrase) for k, notice in enumerate(NOTICES) for phrase in notice.phrases])
    phrases = values(list(PHRASES.items()))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents),
spaced AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS body FROM docs),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
phrase(phrase, label) AS (VALUES {phrases}),
phrase_word AS (SELECT label, len(str_split(phrase, ' ')) AS size, unnest(str_split(phrase, ' ')) AS word, generate_subscripts(str_split(phrase, ' '), 1) - 1 AS j FROM phrase),
places AS (SELECT r, label, i - j AS place FROM tokens JOIN phrase_word USING (word) GROUP BY r, label, i - j, size HAVING count(*) = size),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY r),
notice(number, label, text) AS (VALUES {notices}),
must(number, phrase) AS (VALUES {musts}),
notice_word AS (SELECT number, unnest(str_split(text, ' ')) AS word, generate_subscripts(str_split(text, ' '), 1) - 1 AS place FROM notice),
held AS (SELECT word, count(DISTINCT r) AS n FROM tokens WHERE word IN (SELECT word FROM notice_word) GROUP BY word),
ranked AS (
  SELECT number, word, row_number() OVER (PARTITION BY number ORDER BY coalesce(n, 0), word) AS k
  FROM (SELECT DISTINCT number, word FROM notice_word) LEFT JOIN held USING (word)),
rare AS (SELECT number, word, place, count(*) OVER (PARTITION BY number) AS size FROM notice_word JOIN ranked USING (number, word) WHERE k <= {INDEX_WORDS}),
agreed AS (SELECT r, number, i - place AS start, count(*) / size AS share FROM tokens JOIN rare USING (word) GROUP BY r, number, i - place, size),
verified AS (
  SELECT r, number FROM spaced JOIN must ON contains(body, ' ' || phrase || ' ')
  GROUP BY r, number HAVING count(*) = (SELECT count(*) FROM must AS m WHERE m.number = must.number)),
found AS (SELECT r, number, max(share) AS share FROM agreed JOIN verified USING (r, number) WHERE share >= {LEAST_SHARE} GROUP BY r, number),
labelled AS (SELECT r, label, 0.0::DOUBLE AS share, true AS is_base FROM places UNION ALL SELECT r, label, share, false FROM found JOIN notice USING (number)),
per_doc AS (
  SELECT r, array_to_string(list_sort(coalesce(list_distinct(list(label) FILTER (WHERE is_base)), [])), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM labelled GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN per_doc USING (r)
"""


def near_duplicates() -> str:
    """Shingle sets, links of every two sets that share a shingle, and what can be reached over links."""
    k = minhash.SHINGLE
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS shingle FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= {minhash.PERCENT} * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def repeated_windows() -> str:
    """Windows that stand at two places or more, and the words that none of them covers."""
    n = substring_dedup.WINDOW
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM docs),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + {n} - 1], ' ')) AS seen FROM places),
often AS (SELECT seen FROM windows GROUP BY seen HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM windows WHERE seen IN (SELECT seen FROM often)),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM tokens ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
