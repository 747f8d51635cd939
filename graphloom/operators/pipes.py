"""Pipes: filters and transformations of a feed of resources, by name and in chains.

A pipe takes the feed (with status, types, schema, deprecated) and sets the
status of what it filters out to Dropped; only Success elements are touched.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import merge

Pipe = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Callable[..., Pipe]] = {}


class UnknownPipe(KeyError):
    """No pipe has this name."""


class MismatchedPipe(ValueError):
    """A pipe needs columns that the one before it doesn't give."""


def pipe(name: str, needs: set[str]):
    """Register a pipe's factory, with the columns that it needs."""

    def add(make: Callable[..., Pipe]):
        def checked(**config) -> Pipe:
            inner = make(**config)

            def run(feed: DataFrame) -> DataFrame:
                if missing := needs - set(feed.columns):
                    raise MismatchedPipe(f"{name} needs {sorted(missing)}")
                return inner(feed)

            return run

        REGISTRY[name] = checked
        return checked

    return add


def lookup(name: str, **config) -> Pipe:
    if name not in REGISTRY:
        raise UnknownPipe(name)
    return REGISTRY[name](**config)


def validate(feed: DataFrame, settings: list[tuple[str, dict]]) -> str | None:
    """Why a chain of named pipes doesn't fit a feed, by the feed's columns alone; None if it does."""
    try:
        for name, config in settings:
            feed = feed.transform(lookup(name, **config))
    except (UnknownPipe, MismatchedPipe) as e:
        return f"{type(e).__name__}: {e}"
    return None


def chain(*pipes: Pipe) -> Pipe:
    """Pipes one after the other; Catalyst sees one plan."""

    def run(feed: DataFrame) -> DataFrame:
        for p in pipes:
            feed = feed.transform(p)
        return feed

    return run


def dropped_if(condition: Column) -> Pipe:
    return lambda feed: feed.withColumn("status", F.when((F.col("status") == "Success") & F.coalesce(condition, F.lit(False)), "Dropped").otherwise(F.col("status")))


@pipe("filterDeprecated", {"status", "deprecated"})
def filter_deprecated() -> Pipe:
    return dropped_if(F.col("deprecated"))


@pipe("filterByType", {"status", "types"})
def filter_by_type(types: list[str] | None = None) -> Pipe:
    if not types:
        return lambda feed: feed
    return dropped_if(~F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, types))), F.lit(False)))


@pipe("filterBySchema", {"status", "schema"})
def filter_by_schema(schemas: list[str] | None = None) -> Pipe:
    """The schema's reference counts without ?rev= or ?tag=."""
    if not schemas:
        return lambda feed: feed
    return dropped_if(~F.coalesce(F.regexp_replace("schema", r"\?(rev|tag)=.*$", "").isin(schemas), F.lit(False)))


@pipe("discardMetadata", {"status", "metadata"})
def discard_metadata() -> Pipe:
    return lambda feed: feed.withColumn("metadata", F.lit(None).cast(feed.schema["metadata"].dataType))


@pipe("sourceAsText", {"status", "payload"})
def source_as_text() -> Pipe:
    """The payload moves, as one text, into original_source."""
    return lambda feed: feed.withColumn("original_source", F.col("payload")).withColumn("payload", F.lit(None).cast("string"))


def generic_pipe(fn: Column, name: str = "value") -> Pipe:
    """A user's expression; where it gives null for a Success element, that becomes Failed and the feed goes on."""

    def run(feed: DataFrame) -> DataFrame:
        out = feed.withColumn(name, F.when(F.col("status") == "Success", fn))
        return out.withColumn("status", F.when((F.col("status") == "Success") & F.col(name).isNull(), "Failed").otherwise(F.col("status")))

    return run


def function_pipe(fn: Callable[[dict], object], columns: list[str], kind: str, name: str = "value") -> Pipe:
    """A user's Python function from an element's columns (a dict) to a value of a SQL kind.

    It is given Success elements only, in Arrow batches.  An element for which it raises becomes Failed, with
    the exception's name in <name>_error; the others go on.  None is a value.
    """
    passed, failed = f"{name}: {kind}", f"{name}_error: string"

    @F.pandas_udf(f"struct<{passed},{failed}>")
    def each(status: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for state, row in zip(status, rows.to_dict("records"), strict=True):
            value = error = None
            if state == "Success":
                try:
                    value = fn(row)
                except Exception as e:  # noqa: BLE001 - whatever a user's function raises is its element's failure
                    error = type(e).__name__
            values.append(value)
            errors.append(error)
        return pd.DataFrame({name: pd.Series(values, dtype=object), f"{name}_error": pd.Series(errors, dtype=object)})

    def run(feed: DataFrame) -> DataFrame:
        out = feed.withColumn("_done", each("status", F.struct(*columns)))
        out = out.withColumns({name: F.col(f"_done.{name}"), f"{name}_error": F.col(f"_done.{name}_error")}).drop("_done")
        return out.withColumn("status", F.when(F.col(f"{name}_error").isNotNull(), "Failed").otherwise(F.col("status")))

    return run


def compile_chain(schemas: list[str] | None = None, types: list[str] | None = None, include_metadata: bool = False, include_deprecated: bool = False) -> Pipe:
    """The chain of a view's settings: schema, type, deprecated, metadata."""
    pipes = []
    if schemas:
        pipes.append(lookup("filterBySchema", schemas=schemas))
    if types:
        pipes.append(lookup("filterByType", types=types))
    if not include_deprecated:
        pipes.append(lookup("filterDeprecated"))
    if not include_metadata:
        pipes.append(lookup("discardMetadata"))
    return chain(*pipes)


def select_predicates(triples: DataFrame, predicates: list[str], pass_through: list[str] | None = None) -> DataFrame:
    """Triples of a resource's own node with listed predicates; resources of a pass-through type keep all."""
    own = (F.col("s") == F.col("resource")) & F.col("p").isin(predicates)
    if not pass_through:
        return triples.filter(own)
    passing = triples.filter((F.col("s") == F.col("resource")) & (F.col("p") == "type") & F.col("o").isin(pass_through)).select("resource", F.lit(True).alias("passes")).distinct()
    return triples.join(passing, "resource", "left").filter(own | F.col("passes")).drop("passes")


#: The predicates that the default preset keeps, and the type that passes through.
LABEL_PREDICATES = ["prefLabel", "type", "label", "name", "description", "keywords"]
LABEL_PASS = ["File"]


def default_label_predicates(triples: DataFrame) -> DataFrame:
    return select_predicates(triples, LABEL_PREDICATES, LABEL_PASS)


def types_of(triples: DataFrame) -> DataFrame:
    """resource, types: what rdf types are left, sorted."""
    kinds = triples.filter((F.col("s") == F.col("resource")) & (F.col("p") == "type"))
    return kinds.groupBy("resource").agg(F.array_sort(F.collect_set("o")).alias("types"))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """resource, ntriples: a resource's distinct triples as lines, sorted."""
    o = F.when(F.col("kind") == "iri", F.format_string("<%s>", "o")).when(F.col("datatype") == "string", F.format_string('"%s"', F.regexp_replace("o", r'(["\\])', r"\\$1"))).otherwise(F.format_string('"%s"^^<%s>', "o", "datatype"))
    line = F.format_string("<%s> <%s> %s .", F.col("s"), F.col("p"), o)
    return triples.select("resource", line.alias("line")).groupBy("resource").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("ntriples"))


def to_documents(triples: DataFrame) -> DataFrame:
    """resource, document: predicates and their objects as a JSON object; a single object isn't in an array."""
    per = triples.filter(F.col("s") == F.col("resource")).groupBy("resource", "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
    value = F.when(F.size("os") == 1, F.regexp_extract(F.to_json("os"), r"^\[(.*)\]$", 1)).otherwise(F.to_json("os"))
    pair = F.concat(F.lit('"'), F.col("p"), F.lit('":'), value)
    return per.groupBy("resource").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("body")).select("resource", F.concat(F.lit('{"@id":"'), "resource", F.lit('",'), "body", F.lit("}")).alias("document"))


def resource_documents(elements: DataFrame, graphs: DataFrame, *, context: str | None = None) -> DataFrame:
    """Elements (id, status, source) with their document: the source merged with the compact document of their graph.

    graphs: id, document, typed (the compact graph without and with its root's types).  With a source, types and id are the
    source's (the id the element's, if it names none) and the graph wins elsewhere; without one the graph is the document, types
    included.  Contexts are removed, or replaced by the given one.  A Success element whose document is empty is Dropped; others
    pass without a document.
    """
    rows = elements.join(graphs.select("id", "document", "typed"), "id", "left")
    source = F.try_parse_json("source")
    empty = merge.is_blank(source)
    named = F.coalesce(F.try_variant_get(source, '$["@id"]', "string"), F.col("id"))
    whole = F.when(empty, F.col("typed")).otherwise(merge.deep_merge(F.col("source"), F.col("document")))
    rows = rows.withColumns({"whole": whole, "named": F.when(~empty, named)})
    bare = F.when(F.contains("whole", F.lit('"@context"')), merge.without_key(F.try_parse_json("whole"), "@context")).otherwise(F.col("whole"))
    rows = rows.withColumn("whole", bare)
    marked = F.when(F.col("named").isNull() | merge.is_blank(F.try_parse_json("whole")), F.col("whole")).otherwise(merge.deep_merge(F.col("whole"), F.to_json(F.struct(F.col("named").alias("@id")))))
    rows = rows.withColumn("whole", marked)
    if context is not None:
        rows = rows.withColumn("whole", F.when(~merge.is_blank(F.try_parse_json("whole")), merge.deep_merge(F.col("whole"), F.lit(context))))
    done = (F.col("status") == "Success") & ~merge.is_blank(F.try_parse_json("whole"))
    out = rows.withColumns({"document": F.when(done, F.col("whole")), "status": F.when((F.col("status") == "Success") & ~done, "Dropped").otherwise(F.col("status"))})
    return out.select(*elements.columns, "document")


#: Datatypes whose literals are written without quotes.
BARE = ["integer", "decimal", "double", "boolean"]


def nested_documents(triples: DataFrame, depth: int = 2) -> DataFrame:
    """resource, document: a resource's own node as a JSON object with the blank nodes below it, to a depth.

    References are objects with an @id, numbers and booleans stay what they are, several objects of a predicate are a
    sorted array.  Blank nodes beyond the depth stay references.  Each level is one aggregation and one join; it's a merge
    join, as the planner takes the size of nodes from that of the files behind them, which is far too small, and would broadcast them.
    """
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    nodes = None
    for _ in range(depth):
        rows = triples
        if nodes is None:
            rows = rows.withColumn("child", F.lit(None).cast("string"))
        else:
            rows = rows.join(nodes.select("resource", F.col("s").alias("o"), F.lit("blank").alias("kind"), F.col("node").alias("child")).hint("merge"), ["resource", "o", "kind"], "left")
        bare = (F.col("kind") == "literal") & F.col("datatype").isin(BARE)
        value = F.when(F.col("child").isNotNull(), F.col("child")).when((F.col("kind") == "literal") & bare, F.col("o")).when((F.col("kind") == "literal") | (F.col("p") == "type"), text("o")).otherwise(F.concat(F.lit('{"@id":'), text("o"), F.lit("}")))
        per = rows.groupBy("resource", "s", "p").agg(F.array_sort(F.collect_list(value)).alias("v"))
        values = F.when(F.size("v") == 1, F.col("v")[0]).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]")))
        pair = F.concat(text(F.when(F.col("p") == "type", "@type").otherwise(F.col("p"))), F.lit(":"), values)
        nodes = per.groupBy("resource", "s").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
        own = F.when(F.col("s").startswith("_:"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit('"@id":'), text("s"))))
        nodes = nodes.select("resource", "s", F.concat(F.lit("{"), F.array_join(F.concat(own, "pairs"), ","), F.lit("}")).alias("node"))
    return nodes.filter(F.col("s") == F.col("resource")).select("resource", F.col("node").alias("document"))
