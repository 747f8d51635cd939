"""The stored inverted index against a scan."""

import uuid

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from graphloom.operators import deps, listing
from graphloom.operators.search_index import Field, SearchIndex, _term_counts, build_index


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def index(spark, docs):
    path = f"{deps.shared_folder(spark).rstrip('/')}/s-{uuid.uuid4().hex}"
    build_index(docs, [Field("text")], path, docs_per_range=1)
    return SearchIndex(spark, path)


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "score", "n_words").collect()]


def test_the_index_scores_as_the_scan(index, docs):
    for query in ("thing worthless reation", "the token", "nowhere"):
        assert sorted(rows(index.scores(query))) == sorted(rows(listing.full_text(docs, query)))


def test_the_best_without_all_ranges(index, docs):
    query = "worthless token thing"
    want = sorted(rows(listing.full_text(docs, query)), key=lambda r: (-r[1], r[0]))
    got = rows(index.top(query, 3))
    assert got == want[:3]
    bounds = index.bounds(query)
    assert 0 < bounds.filter(F.col("bound") >= index.threshold).count() < bounds.count()
    assert rows(index.top(query, 10_000)) == want and rows(index.top("nowhere", 5)) == []


def test_iris_are_found_by_the_parts_of_their_path(spark):
    path = f"{deps.shared_folder(spark).rstrip('/')}/s-{uuid.uuid4().hex}"
    pages = spark.createDataFrame([("p1", "https://x.org/Cells/a#b", "red"), ("p2", "https://x.org/cells", None), ("p3", None, "cells")], "id string, url string, text string")
    build_index(pages, [Field("url", "iri", 3.0), Field("text")], path, key="id")
    got = {r.id: r.score for r in SearchIndex(spark, path).scores("cells").collect()}
    assert got.keys() == {"p1", "p2", "p3"} and got["p2"] > got["p1"]
    assert [r.id for r in SearchIndex(spark, path).top("b", 5).collect()] == ["p1"]


def test_words_are_counted_within_the_row(spark):
    docs = spark.createDataFrame([("a", 0, ["x", "x", "y", "z", "z", "z"]), ("b", 1, []), ("c", 2, ["x"]), ("a", 0, ["y"])], "key string, doc_range int, words array<string>")
    got = _term_counts(docs, "words")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", 0, 1, "y", 1), ("a", 0, 6, "x", 2), ("a", 0, 6, "y", 1), ("a", 0, 6, "z", 3), ("c", 2, 1, "x", 1)]


def test_postings_are_shuffled_once(spark, docs, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda out, path: plans.append(out._df._jdf.queryExecution().executedPlan().toString()) or write(out, path))
    build_index(docs, [Field("text"), Field("source", "iri")], f"{deps.shared_folder(spark).rstrip('/')}/s-{uuid.uuid4().hex}")
    assert plans[0].count("Exchange") == 1
