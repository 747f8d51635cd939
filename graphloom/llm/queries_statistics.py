"""Queries of resampling, whitening and secrets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.resampling import importance_resample
from graphloom.llm.secret_scan import BASE, RULES, BlobLedger, ledger_folder, secrets_of
from graphloom.llm.whitening import whiten


def op11_importance_resample(spark, sf_dir):
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark, sf_dir):
    rows = whiten(table(spark, sf_dir, "embeddings"))
    # null where no long holds it, from some 10**9 vectors on
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_secret_scan(spark, sf_dir):
    return secrets_of(BlobLedger(spark, ledger_folder(spark, f"ledger-{uuid.uuid4().hex}")), table(spark, sf_dir, "documents"))


QUERIES = {"op11_importance_resample": op11_importance_resample, "op12_whitening": op12_whitening, "op13_secret_scan": op13_secret_scan}


def _secret_sql() -> str:
    """Starts are lengths of the pieces between matches and of the matches before."""
    either = lambda p: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in p)

    def pattern(rule):
        if rule.any_case:  # its words are spelled out, as RE2 would fold letters beyond ASCII as well
            words, rest = rule.pattern.split(")", 1)
            return either(words) + ")" + rest
        return rule.pattern

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = " UNION ALL ".join(f"SELECT n, '{r.kind}' AS kind, {i} AS place, {r.least} AS least, regexp_extract_all(text, {quoted(pattern(r))}) AS ms, regexp_extract_all(text, {quoted(pattern(r))}, {r.group}) AS gs, string_split_regex(text, {quoted(pattern(r))}) AS ps FROM d" for i, r in enumerate(RULES))
    text = "string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, place)"
    base = f"place < {len(BASE)}"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({one}),
        f AS (SELECT n, kind, place, least, ms, ps, length(gs[i]) AS long, length(ms[i]) AS size, i FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
        s AS (SELECT n, kind, place, size, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM f WHERE long >= least)
        SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, sha256(coalesce({text} FILTER ({base}), '')) AS base_sha256, coalesce({text} FILTER (kind IS NOT NULL), '') AS spans, sha256(any_value(d.text)) AS blob
        FROM d LEFT JOIN s USING (n) GROUP BY d.n, d.doc_id
    """


#: crc32 over the bytes of each distinct run of words, by a table of 256 entries made from the polynomial.
ORACLE_SQL = {
    "op11_importance_resample": r"""
        WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        texts AS (SELECT row_number() OVER () AS n, true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT row_number() OVER (), false, NULL, coalesce(text, '') FROM benchmark),
        w AS (SELECT n, own, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS (SELECT n, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature FROM w),
        c AS (SELECT n, own, feature, count(*) AS k FROM f GROUP BY ALL),
        h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM c)),
        b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
        fb AS (SELECT n, own, bucket, sum(k)::BIGINT AS k FROM c JOIN b USING (feature) GROUP BY ALL),
        st AS (SELECT bucket, coalesce(sum(k) FILTER (own), 0) AS s, coalesce(sum(k) FILTER (NOT own), 0) AS t FROM fb GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM st) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM st) + 10000)::DOUBLE)))::BIGINT AS gain FROM st),
        d AS (SELECT n, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM fb JOIN g USING (bucket) WHERE own GROUP BY n),
        p AS (SELECT w.n, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (n) WHERE own),
        q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= 20 AND doc_id IS NOT NULL AS ranked FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY ranked ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (ranked) OVER () AS total FROM q)
        SELECT doc_id, n_features, weight, score, CASE WHEN ranked AND place <= 5 * total // 100 THEN place END AS rank FROM r
    """,
    "op13_secret_scan": _secret_sql(),
}
