"""Checking SQL for DuckDB, where SQL can say what an operator returns."""

from __future__ import annotations

from slotledger.llm import collocations, filter_audit, licenses, vector_dedup

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: Every pair of documents that share a shingle is counted out, then links are followed.
NGRAM_JACCARD = f"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, {_WORDS.format(text='''translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')''')} AS w
      FROM documents),
    shingled AS (
      SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END))
        AS s
      FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    near AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * k >= 80 * (x.n + y.n - k)),
    links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reached AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

#: Every window is compared as text; the first by document and place stays.
SUBSTRING_DEDUP = f"""
    WITH worded AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    windows AS (
      SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM worded)),
    later AS (
      SELECT doc_id, s FROM windows
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
    every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
      FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM worded LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": NGRAM_JACCARD,
        "op3_substring_dedup": SUBSTRING_DEDUP,
        "op7_license_scan": licenses.scan_sql(),
        "op11_vector_dedup": vector_dedup.near_groups_sql(),
        "op12_collocations": collocations.phrases_sql(),
        "op13_filter_audit": filter_audit.audit_sql(),
    }
