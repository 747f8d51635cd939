"""Graph patterns over a triple table (resource, s, p, o, ...): matching, construction, links, set operations.

Patterns are tuples (subject, predicate, object); a text that starts with ? is a
variable. Each pattern is one scan of the triples, and patterns are joined on
their common variables, so Catalyst sees filters and equi-joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def _one(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern."""
    rows, names = triples, {}
    for column, term in zip(("s", "p", "o"), pattern, strict=True):
        if not term.startswith("?"):
            rows = rows.filter(F.col(column) == term)
        elif term[1:] in names:
            rows = rows.filter(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return rows.select(*(F.col(c).alias(v) for v, c in names.items()))


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        raise ValueError("patterns must share a variable with those before them")
    return left.join(right, shared, how)


def match(triples: DataFrame, patterns: list[Pattern], *, optional: list[list[Pattern]] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Bindings, a column per variable. optional groups are left joins; ids, a column named as a variable, restricts it."""
    first, *rest = patterns
    out = _one(triples, first)
    for p in rest:
        out = _join(out, _one(triples, p), "inner")
    if ids is not None:
        out = out.join(ids, ids.columns, "left_semi")
    for group in optional or []:
        side = match(triples, group)
        out = _join(out, side, "left")
    return out


def path(triples: DataFrame, steps: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(start, end) along a sequence of predicates; ^ before one walks it backwards."""
    out = None
    for i, step in enumerate(steps):
        a, b = ("o", "s") if step.startswith("^") else ("s", "o")
        rows = triples.filter(F.col("p") == step.lstrip("^")).select(F.col(a).alias(f"n{i}"), F.col(b).alias(f"n{i + 1}"))
        out = rows if out is None else out.join(rows, f"n{i}")
    return out.select(F.col("n0").alias(start), F.col(f"n{len(steps)}").alias(end))


def construct(bindings: DataFrame, template: list[Pattern]) -> DataFrame:
    """A set of triples (s, p, o): the template filled in by every row; rows without a value give no triple."""
    term = lambda t: F.col(t[1:]).cast("string") if t.startswith("?") else F.lit(t)
    made = F.array(*(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template))
    rows = bindings.select(F.explode(made).alias("t")).select("t.s", "t.p", "t.o")
    return rows.dropna().distinct()


def filter_triples(triples: DataFrame, patterns: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """Triples that meet any pattern; None is a wildcard."""
    hit = F.lit(False)
    for pattern in patterns:
        one = F.lit(True)
        for column, value in zip(("s", "p", "o"), pattern, strict=True):
            one = one if value is None else one & (F.col(column) == value)
        hit = hit | one
    return triples.filter(hit)


def partition(triples: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Triples that pass, and the others."""
    sure = F.coalesce(test, F.lit(False))
    return triples.filter(sure), triples.filter(~sure)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["s", "p", "o"], "left_anti")


def replace_node(triples: DataFrame, current: str, other: str) -> DataFrame:
    """Rename a node where it is a subject or an object; only triples of either node are compared for repetition."""
    touched = F.coalesce(F.col("s").isin(current, other) | F.col("o").isin(current, other), F.lit(False))
    new = lambda c: F.when(F.col(c) == current, other).otherwise(F.col(c)).alias(c)
    changed = triples.filter(touched).select(*(new(c) if c in ("s", "o") else F.col(c) for c in triples.columns)).distinct()
    return triples.filter(~touched).unionByName(changed)


def find(triples: DataFrame, predicate: str) -> DataFrame:
    """s, o: one object of a predicate for each subject, the smallest."""
    return triples.filter(F.col("p") == predicate).groupBy("s").agg(F.min("o").alias("o"))


def root_types(triples: DataFrame) -> DataFrame:
    kinds = triples.filter((F.col("p") == "type") & (F.col("s") == F.col("resource")) & (F.col("kind") == "iri"))
    return kinds.groupBy("resource").agg(F.array_sort(F.collect_set("o")).alias("types"))


def patch(triples: DataFrame, graph: str, new: DataFrame, predicates: list[str], *, keep: bool) -> DataFrame:
    """In one named graph delete triples with these predicates (keep: with all others), then insert new ones."""
    listed = F.col("p").isin(predicates)
    own = F.coalesce(F.col("resource") == graph, F.lit(False))
    return triples.filter(~own).unionByName(union(triples.filter(own & ~(~listed if keep else listed)), new))


def replace_graphs(triples: DataFrame, batch: DataFrame, new: DataFrame) -> DataFrame:
    """batch (id, status): Success replaces the graph of the id by its new triples, Dropped deletes it."""
    done = batch.filter(F.col("status").isin("Success", "Dropped")).select(F.col("id").alias("resource")).distinct()
    good = batch.filter("status = 'Success'").select(F.col("id").alias("resource")).distinct()
    return triples.join(done, "resource", "left_anti").unionByName(new.join(good, "resource", "left_semi"))


def links_incoming(triples: DataFrame, id: str) -> DataFrame:
    """Resources that point to an id from their own node, with the predicates and their types."""
    found = triples.filter((F.col("o") == id) & (F.col("kind") == "iri") & (F.col("resource") != id)).groupBy("resource").agg(F.array_sort(F.collect_set("p")).alias("paths"))
    return found.join(root_types(triples), "resource")


def links_outgoing(triples: DataFrame, id: str, *, external: bool = True) -> DataFrame:
    """What an id points to; external ones, which are no resources here, have null types."""
    out = triples.filter((F.col("resource") == id) & (F.col("s") == id) & (F.col("kind") == "iri") & (F.col("p") != "type")).groupBy(F.col("o").alias("target")).agg(F.array_sort(F.collect_set("p")).alias("paths"))
    kinds = root_types(triples).withColumnRenamed("resource", "target")
    return out.join(kinds, "target", "left" if external else "inner")


def concat_bindings(*results: DataFrame) -> DataFrame:
    """Result sets of several graphs, over all their variables."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def triples_per_view(triples: DataFrame, views: DataFrame) -> DataFrame:
    """namespace, n, view: triples per namespace, with the view (namespace, view) it is assigned to, or null."""
    counts = triples.groupBy(F.concat_ws("/", "org", "project").alias("namespace")).count().withColumnRenamed("count", "n")
    return counts.join(views, "namespace", "left")
