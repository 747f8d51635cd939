"""Queries of mixing and tokenising."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.common import table
from graphloom.llm.mixing import mix

#: What op3 and the pipeline ask of the mixture.
WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary's file."""
    return str(public_tokenizers.path(name))


def op3_mix_sources(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"), share=(1, 2), max_epochs=2, seed=7, weights=WEIGHTS)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), "leaf_budget", "copies")


def op10_bpe_round_trip(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op3_mix_sources": op3_mix_sources, "op10_bpe_round_trip": op10_bpe_round_trip}


def _shares(nodes: str, parent: str, budget: str, out: str) -> str:
    """CTE bodies that fill siblings to capacity in order of capacity / weight."""
    return f"""
        (WITH s AS (SELECT *, {budget} - coalesce(sum(capacity) OVER b, 0) AS ob, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS ow FROM {nodes}
                    WINDOW b AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, min(CASE WHEN capacity::HUGEINT * ow <= weight::HUGEINT * ob THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM s),
        g AS (SELECT *, {budget} - sum(CASE WHEN is_full = 1 THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS lb, sum(CASE WHEN is_full = 0 THEN weight ELSE 0 END) OVER (PARTITION BY {parent}) AS lw FROM f)
        SELECT * EXCLUDE (ob, ow, is_full, lb, lw), CASE WHEN is_full = 1 THEN capacity ELSE ((weight::HUGEINT * lb) // lw) END::BIGINT AS {out} FROM g)"""


def _weight(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


ORACLE_SQL = {
    "op3_mix_sources": rf"""
        WITH d AS (SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents WHERE doc_id IS NOT NULL),
        r AS (SELECT * FROM d WHERE n_tokens > 0),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS capacity, {_weight("domain")} AS wd, {_weight("lang")} AS wl, {_weight("source")} AS ws FROM r GROUP BY ALL),
        total AS (SELECT sum(tokens)::BIGINT * 1 // 2 AS budget FROM leaves),
        n1 AS (SELECT l.*, budget FROM (SELECT domain, domain AS node, sum(capacity)::BIGINT AS capacity, max(wd) AS weight FROM leaves GROUP BY ALL) l, total),
        s1 AS {_shares("n1", "1", "budget", "domain_budget")},
        n2 AS (SELECT l.*, domain_budget FROM (SELECT domain, lang, lang AS node, sum(capacity)::BIGINT AS capacity, max(wl) AS weight FROM leaves GROUP BY ALL) l JOIN s1 USING (domain)),
        s2 AS {_shares("n2", "domain", "domain_budget", "lang_budget")},
        n3 AS (SELECT l.*, source AS node, ws AS weight, lang_budget FROM leaves l JOIN s2 USING (domain, lang)),
        s3 AS {_shares("n3", "domain, lang", "lang_budget", "leaf_budget")},
        p AS (SELECT r.*, leaf_budget, leaf_budget // tokens AS epochs, leaf_budget % tokens AS rest, md5('7:' || (leaf_budget // tokens) || ':' || r.doc_id) AS place FROM r JOIN s3 USING (domain, lang, source)),
        q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS sum_before FROM p)
        SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, (epochs + CASE WHEN sum_before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM q WHERE epochs + CASE WHEN sum_before < rest THEN 1 ELSE 0 END > 0
    """,
}
