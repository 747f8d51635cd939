"""Graph analytics: flattened documents, references, relationships and property statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "id string, project string, deprecated boolean, types array<string>, path string, in_array boolean, data_type string, ref string, ref_types array<string>, lang string, literal_type string"
SEPARATOR = " / "


def _entries(doc: dict) -> Iterator[tuple]:
    """(path, in_array, data_type, @id, @type, lang, literal type) of everything below a node.

    An array of one element is unwrapped and doesn't count as an array; below an array everything is in it.
    """
    stack = [(k, v, False) for k, v in doc.items() if not k.startswith("@")]
    while stack:
        path, value, within = stack.pop()
        if isinstance(value, list):
            if len(value) != 1:
                within = True
            stack += [(path, v, within) for v in value]
        elif isinstance(value, dict):
            if "@value" in value:
                x = value["@value"]
                kind = "boolean" if isinstance(x, bool) else "numeric" if isinstance(x, int | float) else "string"
                yield path, within, kind, None, None, value.get("@language"), value.get("@type")
            else:
                kinds = value.get("@type") or []
                yield path, within, "object", value.get("@id"), [kinds] if isinstance(kinds, str) else kinds, None, None
                stack += [(f"{path}{SEPARATOR}{k}", v, within) for k, v in value.items() if not k.startswith("@")]


def flatten_documents(docs: DataFrame, *, references: bool = False) -> DataFrame:
    """Entries of expanded documents (id, project, deprecated, doc), a set per document; references: those with a ref alone.

    A document that isn't a JSON object gives no entries; a deprecated one gives none but keeps its types elsewhere.
    """
    names = [f.split()[0] for f in ENTRY.split(", ")]
    kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            # what all entries of a document share is built once per document, and dealt to them by its place
            rows, place, types = [], [], []
            for i, (deprecated, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                types.append(None)
                try:
                    doc = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                if not isinstance(doc, dict) or deprecated:
                    continue
                own = doc.get("@type") or []
                types[i] = [own] if isinstance(own, str) else own
                seen = {(p, a, d, r, None if t is None else tuple(t), g, x) for p, a, d, r, t, g, x in _entries(doc) if r is not None or not references}
                rows += seen
                place += [i] * len(seen)
            if rows:
                at = pa.array(place, pa.int32())
                shared = [c.take(at) for c in (*(c.cast(k) for c, k in zip(batch.columns, (pa.string(), pa.string(), pa.bool_()))), pa.array(types, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*shared, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select("id", "project", "deprecated", "doc").mapInArrow(run, ENTRY)


def documents_to_triples(docs: DataFrame) -> DataFrame:
    """(resource, s, p, o) of the top level of expanded documents: types, references."""
    rows = flatten_documents(docs)
    own = rows.filter("ref is not null").select(F.col("id").alias("resource"), F.col("id").alias("s"), F.col("path").alias("p"), F.col("ref").alias("o"))
    kinds = rows.select(F.col("id").alias("resource"), F.col("id").alias("s"), F.lit("type").alias("p"), F.explode("types").alias("o"))
    return own.unionByName(kinds).distinct()


GRAPH = "resource string, s string, p string, o string, kind string, datatype string"


def _values(place: str, values: list) -> Iterator[tuple[str, object]]:
    """The values of an array and of arrays in it, with the place of each."""
    stack = [(f"{place}/{i}", v) for i, v in reversed([*enumerate(values)])]
    while stack:
        at, v = stack.pop()
        if isinstance(v, list):
            stack += [(f"{at}/{i}", x) for i, x in reversed([*enumerate(v)])]
        else:
            yield at, v


def _graph(id: str, doc: dict) -> Iterator[tuple]:
    """(s, p, o, kind, datatype) of a node and all nodes below it; one without an @id is a blank node, named by its place."""
    stack = [(doc.get("@id") or id, "_:" + id, doc)]
    while stack:
        s, place, node = stack.pop()
        kinds = node.get("@type") or []
        for t in [kinds] if isinstance(kinds, str) else kinds:
            yield s, "type", t, "iri", ""
        for p, values in node.items():
            if p.startswith("@"):
                continue
            for at, v in _values(f"{place}/{p}", values if isinstance(values, list) else [values]):
                literal = v.get("@value") if isinstance(v, dict) and "@value" in v else v
                if isinstance(literal, dict):
                    o = literal.get("@id")
                    yield (s, p, o, "iri", "") if o else (s, p, at, "blank", "")
                    stack.append((o or at, at, literal))
                elif isinstance(literal, list):
                    yield s, p, json.dumps(literal), "literal", "json"
                elif literal is not None:
                    kind = "boolean" if isinstance(literal, bool) else "integer" if isinstance(literal, int) else "double" if isinstance(literal, float) else "string"
                    text = literal if isinstance(literal, str) else json.dumps(literal)
                    yield s, p, text, "literal", (v.get("@type") if isinstance(v, dict) else None) or kind


def document_graph(docs: DataFrame) -> DataFrame:
    """(resource, s, p, o, kind, datatype): the whole graph of expanded documents (id, doc), literals and nested nodes too.

    A blank node's name is its place: the key and its number in the array, in arrays of arrays the number in each.

    A text that isn't a JSON object, or is nested too deep to be read, gives no triple; a repeated triple comes once.
    """
    names = [f.split()[0] for f in GRAPH.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    doc = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                if isinstance(doc, dict):
                    rows += [(id, *t) for t in dict.fromkeys(_graph(id or "", doc))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    return docs.select("id", "doc").mapInArrow(run, GRAPH)


def expand_terms(triples: DataFrame, context: DataFrame, *columns: str) -> DataFrame:
    """Terms of compact triples as IRIs, by a context table (project, term, iri): a whole term first, else the prefix before its colon.

    The term @vocab is the prefix of terms without a colon; linked ids are expanded by prefix alone, types as terms.  A term that the
    context doesn't have, and one with // after its colon, stays as it is.  Each column is one equi-join on (project, term), whatever the number of terms.
    """
    known = context.groupBy("project", "term").agg(F.min("iri").alias("iri"))
    for c in columns or ("p", "o"):
        term = F.when(F.col(c) != "type", F.col(c)) if c == "p" else F.col(c)  # type is our own keyword
        colon = F.instr(c, ":") > 0
        if c == "o":  # literals aren't terms; of links only types may be without a prefix
            term = F.when((F.col("kind") == "iri") & (colon | (F.col("p") == "type")), F.col(c))
        prefix = F.when(term.isNull(), None).when(colon & ~F.substring_index(term, ":", -1).startswith("//"), F.substring_index(term, ":", 1)).when(~colon, F.lit("@vocab"))
        rows = triples.withColumns({"whole_term": term, "prefix_term": prefix})
        rows = rows.join(known.select("project", F.col("term").alias("whole_term"), F.col("iri").alias("whole_iri")), ["project", "whole_term"], "left")
        rows = rows.join(known.select("project", F.col("term").alias("prefix_term"), F.col("iri").alias("prefix_iri")), ["project", "prefix_term"], "left")
        rest = F.when(colon, F.expr(f"substring(`{c}`, instr(`{c}`, ':') + 1)")).otherwise(F.col(c))
        rows = rows.withColumn(c, F.coalesce("whole_iri", F.concat("prefix_iri", rest), F.col(c)))
        triples = rows.select(*triples.columns)
    return triples


def compact_iris(rows: DataFrame, context: DataFrame, column: str) -> DataFrame:
    """IRIs of a column as prefix:rest by the longest prefix of the context (project, term, iri) that they begin with.

    Candidates are an IRI's beginnings that end in /, # or :, so it's an equi-join, not a comparison with every prefix.
    An IRI that is a term's whole is that term; ties between terms go to the smallest.
    """
    wanted = rows.select("project", F.col(column).alias("whole")).dropna().distinct()
    end = lambda i: F.substr(F.col("whole"), i, F.lit(1)).isin("/", "#", ":") | (i == F.length("whole"))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length("whole"), F.lit(1))), end)
    tried = wanted.select("project", "whole", F.explode(F.transform(ends, lambda i: F.substr(F.col("whole"), F.lit(1), i))).alias("iri"))
    found = tried.join(context.select("project", "term", "iri"), ["project", "iri"])
    best = found.groupBy("project", "whole").agg(F.min(F.struct((-F.length("iri")).alias("size"), "term")).alias("b"))
    rest = F.expr("substring(whole, 1 - b.size)")
    short = F.when(rest == "", F.col("b.term")).when(F.col("b.term") == "@vocab", rest).otherwise(F.concat("b.term", F.lit(":"), rest))
    best = best.select("project", F.col("whole").alias(column), short.alias("short_iri"))
    return rows.join(best, ["project", column], "left").withColumn(column, F.coalesce("short_iri", F.col(column))).select(*rows.columns)


def resolve_references(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries that refer to an id, with the types of that id's latest state in the project (null: only a reference)."""
    refs = entries.filter("ref is not null").select("project", "id", "types", "path", "in_array", "ref")
    known = nodes.select("project", F.col("id").alias("ref"), F.col("types").alias("found_types")).dropDuplicates(["project", "ref"])
    return refs.join(known, ["project", "ref"], "left")


def refresh_references(resolved: DataFrame, changed: DataFrame) -> DataFrame:
    """Resolved references after types changed: changed (project, id, types)."""
    new = changed.select("project", F.col("id").alias("ref"), F.col("types").alias("new_types"))
    return resolved.join(new, ["project", "ref"], "left").withColumn("found_types", F.coalesce("new_types", "found_types")).drop("new_types")


def relationship_nodes(nodes: DataFrame, limit: int = 200) -> DataFrame:
    """Types with their number of documents, the largest first."""
    counts = nodes.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "type").limit(limit)


def relationship_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, path, target, n) between types that are nodes; entries inside arrays don't count."""
    pairs = resolved.filter("not in_array and found_types is not null").select("path", F.explode("types").alias("source"), "found_types")
    pairs = pairs.select("source", "path", F.explode("found_types").alias("target"))
    counts = pairs.groupBy("source", "path", "target").agg(F.count("*").alias("n"))
    kinds = nodes.select("type")
    return counts.join(kinds.withColumnRenamed("type", "source"), "source", "left_semi").join(kinds.withColumnRenamed("type", "target"), "target", "left_semi")


def property_statistics(entries: DataFrame, type: str) -> DataFrame:
    """(path, parent, name, n) of entries outside arrays of one type's documents: a tree by parent path."""
    rows = entries.filter(F.array_contains("types", type) & ~F.col("in_array")).groupBy("path").agg(F.count("*").alias("n"))
    parts = F.split("path", SEPARATOR)
    return rows.select("path", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), SEPARATOR).alias("parent"), F.element_at(parts, -1).alias("name"), "n")
