"""Listings: filters, sorting, pages, term counts and full-text search."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """What a listing asks for; None and empty mean no restriction. Time ranges are exclusive."""

    locate: str | None = None
    schema: str | None = None
    deprecated: bool | None = None
    rev: int | None = None
    created_by: str | None = None
    updated_by: str | None = None
    created_at: tuple[str | None, str | None] = (None, None)
    updated_at: tuple[str | None, str | None] = (None, None)
    tag: str | None = None
    types: list[str] = field(default_factory=list)
    all_types: bool = False
    not_types: list[str] = field(default_factory=list)
    projects: list[tuple[str, str]] = field(default_factory=list)


def in_range(column: str, bounds: tuple[str | None, str | None]) -> Column:
    low, high = bounds
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) > F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        out = out & (F.col(column) < F.lit(high).cast("timestamp_ntz"))
    return out


def parse_range(text: str) -> tuple[str | None, str | None]:
    """a..b with * for an open end."""
    low, _, high = text.partition("..")
    if not _ or (low == high == "*"):
        if text != "*..*" and not _:
            raise ValueError(text)
        return None, None
    return (None if low == "*" else low), (None if high == "*" else high)


def _has(types: list[str], every: bool) -> Column:
    one = [F.array_contains("types", t) for t in types]
    return reduce(Column.__and__ if every else Column.__or__, one)


def search(rows: DataFrame, s: Search) -> DataFrame:
    """The conjunction of all that is asked; excluded types use the opposite operator of included ones."""
    conditions = [F.col(c) == v for c, v in (("schema", s.schema), ("deprecated", s.deprecated), ("rev", s.rev), ("created_by", s.created_by), ("updated_by", s.updated_by), ("tag", s.tag), ("id", s.locate)) if v is not None]
    conditions += [in_range("created_at", s.created_at), in_range("updated_at", s.updated_at)]
    if s.types:
        conditions.append(_has(s.types, s.all_types))
    if s.not_types:
        conditions.append(~_has(s.not_types, not s.all_types))
    if s.projects:
        conditions.append(reduce(Column.__or__, ((F.col("org") == o) & (F.col("project") == p) for o, p in s.projects)))
    return rows.filter(reduce(Column.__and__, conditions))


def sort_keys(*fields: str) -> list[Column]:
    """-field descends, field and +field ascend; missing values last."""
    return [F.col(f[1:]).desc_nulls_last() if f.startswith("-") else F.col(f.removeprefix("+")).asc_nulls_last() for f in fields]


def page(rows: DataFrame, start: int, size: int, *fields: str, total: bool = False) -> DataFrame:
    """Rows start to start + size of a total order; total: each with the number of all rows."""
    own = rows.orderBy(*sort_keys(*fields)).offset(start).limit(size)
    return own.withColumn("total", F.lit(rows.count()).cast("long")) if total else own


def search_after(rows: DataFrame, token: dict[str, object], size: int) -> DataFrame:
    """The page after a token of ascending sort keys, without an offset's cost."""
    beyond, equal = F.lit(False), F.lit(True)
    for c, v in token.items():
        beyond = beyond | (equal & (F.col(c) > F.lit(v)))
        equal = equal & (F.col(c) == F.lit(v))
    return rows.filter(beyond).orderBy(*token).limit(size)


def terms(rows: DataFrame, key: Column, buckets: int = 500) -> DataFrame:
    """key, n, other: the largest buckets (ties by key), and how many rows are in others."""
    counts = rows.select(key.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(buckets)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return top.withColumn("other", total.scalar() - F.sum("n").over(Window.partitionBy()))


def type_terms(rows: DataFrame, buckets: int = 500) -> DataFrame:
    return terms(rows, F.explode(F.array_distinct("types")), buckets)


#: Fixed values of the ranking: saturation and length weight.
K1, B = 1.2, 0.75
TOKEN = r"[^\p{L}\p{N}]+"


def full_text(rows: DataFrame, query: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: BM25 of the query's words; documents without any aren't returned.

    The number and mean length of documents come from one pass; only matching tokens are counted per document.
    """
    wanted = sorted({w for w in query.lower().split() if w})
    words = rows.select(F.col(key).alias("key"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda x: x != "").alias("words"))
    words = words.select("key", F.size("words").alias("length"), F.filter("words", lambda x: x.isin(wanted)).alias("hits"))
    size = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = words.filter(F.size("hits") > 0).select("key", "length", F.explode("hits").alias("word")).groupBy("key", "length", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    # one word of the query per row: len(wanted) rows at most
    both = tf.join(F.broadcast(df), "word").withColumn("n", size.select("n").scalar()).withColumn("mean", size.select("mean").scalar())
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return both.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n_words")).withColumnRenamed("key", key)
