"""Queries of search, licences, chats, pages and toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm.chat_format import Template, chat_segments, read_back
from graphloom.llm.common import table
from graphloom.llm.html_text import extract_text
from graphloom.llm.licenses import TEMPLATES, THRESHOLD, license_scan
from graphloom.llm.topk import exact_top_k, whole_vectors
from graphloom.llm.toxicity import toxicity

MARKED = "</s>[INST] ok [/INST]"


def op4_exact_top_k(spark, sf_dir):
    return exact_top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op6_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return read_back(chat_segments(rows.unionByName(own)))


def op8_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_exact_top_k": op4_exact_top_k, "op6_license_scan": op6_license_scan, "op7_chat_format": op7_chat_format, "op8_html_text": op8_html_text, "op9_toxicity": op9_toxicity}


def _chat_sql() -> str:
    t = Template()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    around = "CASE role" + "".join(f" WHEN {quoted(r)} THEN {len(t.open[r]) + len(t.close[r])}" for r in t.open) + f" ELSE {len(t.other_open[0]) + len(t.other_open[1]) + len(t.other_close)} + length(role) END"
    controls = "|".join("".join("\\" + c if c in "[](){}|.*+?^$\\" else c for c in m) for m in t.controls)
    allowed = " OR ".join(f"(coalesce(before, '') = {quoted(b)} AND role IN ({', '.join(map(quoted, sorted(r)))}))" for b, r in t.next_roles.items())
    return rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
                   UNION ALL VALUES (-7, 0, 'user', {quoted(MARKED)}), (-7, 1, 'assistant', {quoted(MARKED)})),
        p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
              {around} + length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, {quoted(controls)})) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, bool_and({allowed}) AS valid
        FROM p GROUP BY conv_id
    """


def _license_sql() -> str:
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    given = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())
    part = THRESHOLD / (2 - THRESHOLD)
    return rf"""
        WITH t AS (SELECT name, list_distinct({pairs}) AS b FROM (SELECT name, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {given}) v(name, text))),
        d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '\n[ \t\r\f\v]*\n\s*') AS blocks FROM documents WHERE doc_id IS NOT NULL),
        u AS (SELECT n, unnest(string_split(text, chr(10))) AS unit FROM d
              UNION ALL SELECT n, unnest(list_filter(blocks, lambda x: contains(x, chr(10)))) FROM d
              UNION ALL SELECT n, text FROM d WHERE len(blocks) > 1),
        b AS (SELECT row_number() OVER () AS unit_no, n, list_distinct({pairs}) AS b FROM (SELECT n, regexp_extract_all(lower(unit), '[\p{{L}}\p{{N}}]+') AS w FROM u) WHERE len(w) > 1),
        m AS (SELECT unit_no, n, name, 2 * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice FROM b JOIN t ON len(b.b) >= len(t.b) * 0.66 AND len(b.b) <= len(t.b) * 1.51),
        units AS (SELECT n, name, dice FROM m WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit_no ORDER BY dice DESC, name) = 1),
        p AS (SELECT n, {pairs} AS p FROM (SELECT n, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM d) WHERE len(w) > 1),
        hits AS (SELECT n, name, place, row_number() OVER (PARTITION BY n, name ORDER BY place) AS k FROM (SELECT n, unnest(p) AS pair, generate_subscripts(p, 1) AS place FROM p) JOIN (SELECT name, unnest(b) AS pair FROM t) USING (pair)),
        spans AS (SELECT x.n, x.name, x.place AS low, y.place AS high FROM hits x JOIN t ON t.name = x.name JOIN hits y ON y.n = x.n AND y.name = x.name AND y.k >= x.k + ceil(len(t.b) * {part} - 1e-9) - 1 AND y.place < x.place + floor(len(t.b) / {part} + 1e-9)),
        w AS (SELECT n, name, low, high, 2 * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice FROM (SELECT s.n, s.name, low, high, t.b, list_distinct(list_slice(p.p, low, high)) AS own FROM spans s JOIN p USING (n) JOIN t USING (name))),
        inside AS (SELECT *, max(high) OVER (PARTITION BY n, name ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w WHERE dice >= {THRESHOLD}),
        found AS (SELECT n, name, dice, 1 AS unit, 0 AS passage FROM units UNION ALL SELECT n, name, dice, 0, CASE WHEN before IS NULL OR low > before + 1 THEN 1 ELSE 0 END FROM inside)
        SELECT d.doc_id, coalesce(sum(unit), 0)::BIGINT AS n_matches, coalesce(sum(passage), 0)::BIGINT AS n_passages, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, arg_min(name, (-dice, name)) AS best_license, max(dice) AS best_dice
        FROM d LEFT JOIN found USING (n) GROUP BY d.n, d.doc_id
    """


ORACLE_SQL = {
    "op6_license_scan": _license_sql(),
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_chat_format": _chat_sql(),
}
