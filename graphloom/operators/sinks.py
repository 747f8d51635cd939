"""What sinks are given: resources with their graphs, and bundles of references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph


def graph_resources(triples: DataFrame) -> DataFrame:
    """org, project, id, types, graph: one row per resource; a resource's graph is bounded by its document."""
    kinds = F.array_sort(F.collect_set(F.when((F.col("p") == "type") & (F.col("s") == F.col("resource")), F.col("o"))))
    return triples.groupBy("org", "project", F.col("resource").alias("id")).agg(kinds.alias("types"), F.collect_set(F.struct("s", "p", "o")).alias("graph"))


def bundle(requests: DataFrame, found: DataFrame, path: Column, *, strict: bool = False) -> DataFrame:
    """Requests (with id) that exist, with their path in the bundle; strict: all, with a null path for missing ones."""
    rows = requests.join(found.select("id", F.lit(True).alias("found")).distinct(), "id", "left")
    rows = rows.withColumn("path", F.when(F.col("found"), path)).drop("found")
    return rows if strict else rows.filter("path is not null")


def bundle_contents(bundled: DataFrame, found: DataFrame, representations: list[str]) -> DataFrame:
    """Entries of a bundle (id, path, representation) with their content: the column of found that the representation names.

    An unknown representation has a null content.
    """
    content = F.coalesce(*(F.when(F.col("representation") == r, F.col(r)) for r in representations))
    return bundled.join(found.select("id", *representations), "id", "left").withColumn("content", content).drop(*representations)


def composite(elements: DataFrame, triples: DataFrame, patterns: list[graph.Pattern], template: list[graph.Pattern], to_document: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Elements (id, status) with the document that a view's query (patterns on ?id, template) and transformation give.

    All elements, one or a chunk, are answered by one join with the common triples. A Success element without a
    result is Dropped; other elements pass without a document.
    """
    term = lambda t: F.col(t[1:]).cast("string") if t.startswith("?") else F.lit(t)
    made = F.array(*(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template))
    bound = graph.match(triples, patterns, ids=elements.filter("status = 'Success'").select("id").distinct())
    rows = bound.select(F.col("id").alias("resource"), F.explode(made).alias("t")).select("resource", "t.s", "t.p", "t.o").dropna().distinct()
    docs = to_document(rows).select(F.col("resource").alias("id"), "document")
    out = elements.join(docs, "id", "left")
    return out.withColumn("status", F.when((F.col("status") == "Success") & F.col("document").isNull(), "Dropped").otherwise(F.col("status")))
