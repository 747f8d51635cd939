"""Queries of the operators that remove or join documents."""

from __future__ import annotations

from graphloom.llm.common import table
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.ngram_join import ngram_join
from graphloom.llm.substring_dedup import repeated_passages


def op1_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_ngram_join": op2_ngram_join, "op5_exact_dedup": op5_exact_dedup}

ORACLE_SQL = {
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))) END AS shingles FROM w),
        c AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS rep, shingles FROM s),
        u AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM c WHERE doc_id = rep),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o WHERE 100 * k >= 85 * (na + nb - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
        m AS (SELECT rep, count(*) AS copies FROM c WHERE n > 0 GROUP BY ALL),
        k AS (SELECT e.a, sum(copies)::BIGINT AS links FROM e JOIN m ON m.rep = e.b GROUP BY ALL)
        SELECT doc_id, n AS n_shingles, least(c.rep, coalesce((SELECT min(b) FROM reach WHERE a = c.rep), c.rep)) AS component_id, c.rep AS class_id, (coalesce(links, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links
        FROM c LEFT JOIN k ON k.a = c.rep LEFT JOIN m ON m.rep = c.rep
    """,
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bytes FROM documents WHERE doc_id IS NOT NULL),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bytes ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bytes) AS group_size,
                row_number() OVER (PARTITION BY bytes, doc_id ORDER BY length(text) DESC) AS nth FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AND nth = 1 AS kept, sha256(bytes) AS text_sha256, length(text)::BIGINT AS n_chars FROM r
    """,
}
