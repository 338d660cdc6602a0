"""DuckDB SQL of the operators that SQL can express, for small tables: pairs are compared one by one."""

from __future__ import annotations

#: Links of equal labels at a cosine of 0.93 or more, and their closure.
OP2_SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u
), roots AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n_links FROM pairs GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""

#: Letters beyond ASCII and the control characters that stand for them, as distances are counted in bytes.
_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍàáúâ"
_MARKS = " || ".join(f"chr({k})" for k in range(1, 32) if k not in (9, 10, 11, 12, 13))

#: Lines within two edits, one for every eight characters at most. The counts of letters only leave out pairs that can't be that near.
OP3_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), bare AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM raw),
firsts AS (SELECT s, min({{'d': doc_id, 'a': pos}}) AS f, row_number() OVER (ORDER BY s) AS node FROM bare WHERE s <> '' GROUP BY s),
plain AS (SELECT node, f, translate(s, '{_LETTERS}', {_MARKS}) AS s, length(s) AS n, {", ".join(f"length(s) - length(replace(s, '{c}', '')) AS c{k}" for k, c in enumerate("enatirs "))} FROM firsts),
near AS (
  SELECT a.node AS u, b.node AS v FROM plain a JOIN plain b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.node <> b.node AND least(a.n, b.n) >= 8
    AND {" AND ".join(f"abs(a.c{k} - b.c{k}) <= 2" for k in range(8))}
  WHERE levenshtein(a.s, b.s) <= least(2, least(a.n, b.n) // 8)
), reach AS (
  SELECT node AS u, node AS v FROM plain UNION SELECT r.u, p.v FROM reach r JOIN near p ON r.v = p.u
), kept AS (SELECT r.u AS node, min(f.f) AS f FROM reach r JOIN firsts f ON f.node = r.v GROUP BY r.u),
fate AS (SELECT b.doc_id, b.pos, b.line, b.s = '' OR (k.f.d = b.doc_id AND k.f.a = b.pos) AS stays FROM bare b LEFT JOIN firsts f USING (s) LEFT JOIN kept k USING (node)),
found AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS text FROM fate GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(f.text, '')) AS kept_sha256
FROM documents d LEFT JOIN found f USING (doc_id)
"""

#: Windows of 50 words that also start in a document of a smaller id.
OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words),
windows AS (SELECT doc_id, k, CASE WHEN k + 49 <= len(w) THEN md5(array_to_string(list_slice(w, k, k + 49), ' ')) END AS h, w[k] AS word FROM places),
firsts AS (SELECT h, min(doc_id) AS first FROM windows WHERE h IS NOT NULL GROUP BY h),
judged AS (
  SELECT doc_id, k, word, max(coalesce(CAST(first < doc_id AS INTEGER), 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (h)
), kept AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS text FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
