"""Dependencies, resolution of references, and access lists."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["org", "project", "id"]
TARGET = ["target_org", "target_project", "target_id"]
#: Steps whose results are read as they are; more are put together first.
MOST_PARTS = 16
#: monotonically_increasing_id() has the task above these bits and the row's place in it below.
PLACE_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in local mode, where none need be set, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, *columns: str, name: str = "position") -> DataFrame:
    """Rows with their number, from 1, in the order of columns over all rows; nulls come last.

    Two passes: ranges of the order are sorted apart, however many rows share a first column, and stored with each row's
    place in its range; the sizes of the ranges before give the rest.  Rows that are equal in all columns share a range.
    """
    order = [F.col(c).asc_nulls_last() for c in columns]
    runs = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run_place", F.monotonically_increasing_id()))
    run, place = F.shiftright("run_place", PLACE_BITS), F.col("run_place").bitwiseAND((1 << PLACE_BITS) - 1)
    before = Window.orderBy("run_number").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy(run.alias("run_number")).agg(F.count("*").alias("n"))
    starts = sizes.select("run_number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))  # a row per range, not per row
    return runs.join(F.broadcast(starts), run == F.col("run_number")).select(*rows.columns, (F.col("rows_before") + place + 1).alias(name))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start key, org, project, id): all that each start reaches; a start on a cycle reaches itself.

    Semi-naive: each step joins only what the step before found, and drops what is known.
    Cycles end it, as nothing new is found; chains may be of any length.  Each step stores
    what it found alone.
    """
    roots = [F.col(c).alias(f"start_{c}") for c in KEY]
    edges = edges.select(*KEY, *TARGET).distinct()
    ids = [f"start_{c}" for c in KEY]
    frontier = cut(starts.select(*roots, *KEY).join(edges, KEY).select(*ids, *(F.col(f"target_{c}").alias(c) for c in KEY)).distinct())
    parts = [frontier]
    while not frontier.isEmpty():
        seen = reduce(DataFrame.unionByName, parts)
        frontier = cut(frontier.join(edges, KEY).select(*ids, *(F.col(f"target_{c}").alias(c) for c in KEY)).distinct().join(seen, [*ids, *KEY], "left_anti"))
        parts.append(frontier)
        if len(parts) > MOST_PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def direct(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return edges.join(starts.select(*KEY), KEY, "left_semi").select(*(F.col(c).alias(c.removeprefix("target_")) for c in TARGET)).distinct()


def with_states(keys: DataFrame, states: DataFrame) -> DataFrame:
    """Keys joined with their latest states; keys without one drop out."""
    return keys.join(states.filter("tag = 'latest'"), KEY)


def external_references(edges: DataFrame, org: str, project: str) -> DataFrame:
    """Edges from other projects into this one."""
    into = (F.col("target_org") == org) & (F.col("target_project") == project)
    own = (F.col("org") == org) & (F.col("project") == project)
    return edges.filter(into & ~own)


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """For every source in new, its edges become those in new; self-edges are left out."""
    itself = (F.col("org") == F.col("target_org")) & (F.col("project") == F.col("target_project")) & (F.col("id") == F.col("target_id"))
    return edges.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new.filter(~itself)).distinct()


def missing_or_deprecated(refs: DataFrame, states: DataFrame) -> DataFrame:
    """References that don't exist, undeprecated, at latest."""
    return refs.join(states.filter("tag = 'latest' and not deprecated").select(*KEY), KEY, "left_anti")


def ancestors(address: Column) -> Column:
    """An address (/, /org or /org/project) and those above it."""
    parts = F.filter(F.split(address, "/"), lambda x: x != "")
    return F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def granted(rows: DataFrame, acls: DataFrame, identities: list[str], *, address: str = "address", permission: str = "permission", how: str = "left_semi") -> DataFrame:
    """Rows whose permission some identity holds on the address or above it (how left_anti: the others).

    Distinct pairs of address and permission are resolved first, by an equi-join.
    """
    held = acls.filter(F.col("identity").isin(identities)).select(F.col("address").alias("held_address"), F.col("permission").alias("held_permission")).distinct()
    asked = rows.select(F.col(address).alias("asked_address"), F.col(permission).alias("asked_permission")).distinct().withColumn("above", F.explode(F.array_distinct(ancestors(F.col("asked_address")))))
    good = asked.join(held, (F.col("above") == F.col("held_address")) & (F.col("asked_permission") == F.col("held_permission")), "left_semi").select("asked_address", "asked_permission").distinct()
    return rows.join(good, (rows[address] == good["asked_address"]) & (rows[permission] == good["asked_permission"]), how)


def not_granted(rows: DataFrame, acls: DataFrame, identities: list[str], **columns) -> DataFrame:
    """Distinct rows that aren't granted."""
    return granted(rows.distinct(), acls, identities, how="left_anti", **columns)


def acl_addresses(acls: DataFrame, identities: list[str], permission: str, address: str = "/") -> DataFrame:
    """Addresses where the identities hold a permission: all from the root, an organisation's and the root, or a project's line."""
    rows = acls.filter(F.col("identity").isin(identities) & (F.col("permission") == permission))
    depth = len([x for x in address.split("/") if x])
    if depth == 1:
        rows = rows.filter((F.col("address") == "/") | (F.col("address") == address) | F.col("address").startswith(f"{address}/"))
    elif depth == 2:
        rows = rows.filter(F.col("address").isin("/", address, address.rsplit("/", 1)[0]))
    return rows.select("address").distinct()


def readable_projects(projects: DataFrame, acls: DataFrame, identities: list[str], permission: str = "read") -> DataFrame:
    rows = projects.select("org", "project", F.concat(F.lit("/"), "org", F.lit("/"), "project").alias("address"), F.lit(permission).alias("permission"))
    return granted(rows, acls, identities).select("org", "project")


def multi_fetch(requests: DataFrame, states: DataFrame, acls: DataFrame, identities: list[str]) -> DataFrame:
    """requests (position, org, project, id) with status Found, NotFound or AuthorizationFailed, and rev."""
    open_ones = readable_projects(requests.select("org", "project").distinct(), acls, identities).withColumn("open", F.lit(True))
    found = requests.join(open_ones, ["org", "project"], "left").join(states.filter("tag = 'latest'").select(*KEY, "rev"), KEY, "left")
    status = F.when(F.col("open").isNull(), "AuthorizationFailed").when(F.col("rev").isNull(), "NotFound").otherwise("Found")
    return found.select("position", *KEY, status.alias("status"), F.when(status == "Found", F.col("rev")).alias("rev"))


def resolve_in_project(refs: DataFrame, states: DataFrame, *, allow_deprecated: bool = False) -> DataFrame:
    """References within their own project: Resolved, NotFound or Deprecated."""
    found = refs.join(states.filter("tag = 'latest'").select(*KEY, "rev", "deprecated"), KEY, "left")
    verdict = F.when(F.col("rev").isNull(), "NotFound").when(F.col("deprecated") & F.lit(not allow_deprecated), "Deprecated").otherwise("Resolved")
    return found.select(*KEY, verdict.alias("verdict"))


def resolve_across(refs: DataFrame, resolvers: DataFrame, states: DataFrame, *, allow_deprecated: bool = False) -> DataFrame:
    """Walk resolvers by (priority, resolver) and each one's projects in order; the first that has the id wins.

    refs (id); resolvers (resolver, priority, place, org, project, types). History lists the
    rejections before the winner, or all of them.
    """
    steps = F.array_sort(F.collect_list(F.struct("priority", "resolver", "place", "org", "project", "types")))
    # resolvers are settings of one project, a handful; each reference gets them as one array
    tries = refs.select("id", F.explode(_settings(resolvers.agg(steps.alias("steps")))).alias("r")).select("id", "r.*")
    found = tries.join(states.filter("tag = 'latest'").select(*KEY, "types", "deprecated", "rev").withColumnRenamed("types", "own"), KEY, "left")
    verdict = F.when(F.col("rev").isNull(), "NotFound").when(F.col("types").isNotNull() & ~F.arrays_overlap("own", "types"), "TypeMismatch").when(F.col("deprecated") & F.lit(not allow_deprecated), "Deprecated").otherwise("Resolved")
    ranked = found.withColumn("verdict", verdict).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("priority", "resolver", "place")))
    first = ranked.groupBy("id").agg(F.min(F.when(F.col("verdict") == "Resolved", F.col("n"))).alias("winner"))
    both = ranked.join(first, "id")
    upto = both.filter(F.col("winner").isNull() | (F.col("n") <= F.col("winner")))
    return upto.groupBy("id").agg(
        F.max(F.when(F.col("n") == F.col("winner"), F.col("resolver"))).alias("resolver"),
        F.max(F.when(F.col("n") == F.col("winner"), F.concat_ws("/", "org", "project"))).alias("found_in"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") != "Resolved", F.struct("n", "resolver", "verdict")))), lambda x: F.concat_ws(":", x["resolver"], x["verdict"])), ",").alias("history"),
    )


def _settings(one_row: DataFrame) -> Column:
    """A single row's only column as a scalar subquery."""
    return one_row.scalar()


def priority_conflicts(resolvers: DataFrame) -> DataFrame:
    """(org, project, priority) that more than one live resolver has."""
    return resolvers.filter("not deprecated").groupBy("org", "project", "priority").agg(F.count("*").alias("n")).filter("n > 1")


def id_resolution(states: DataFrame, ids: DataFrame, open_projects: DataFrame) -> DataFrame:
    """id, n, verdict: in how many readable projects an id is found at latest."""
    own = states.filter("tag = 'latest'").join(open_projects, ["org", "project"], "left_semi").select("id", F.lit(1).alias("hit"))
    n = F.count("hit")
    return ids.join(own, "id", "left").groupBy("id").agg(n.alias("n"), F.when(n == 0, "NotFound").when(n == 1, "SingleResult").otherwise("MultipleResults").alias("verdict"))


def import_closure(imports: DataFrame, schemas: DataFrame, resources: DataFrame, ontology: str = "Ontology") -> DataFrame:
    """id, source, rejection: where each import is found, schemas first, then resources.

    A resource must have the ontology's type: else the import is rejected as NotAnOntology; what is nowhere is NotFound.
    """
    known = resources.groupBy("id").agg(F.max(F.coalesce(F.array_contains("types", ontology), F.lit(False))).alias("is_ontology"))
    found = imports.join(schemas.select("id", F.lit(True).alias("in_schemas")).distinct(), "id", "left").join(known, "id", "left")
    source = F.when(F.col("in_schemas"), "schema").when(F.col("is_ontology").isNotNull(), "resource")
    rejection = F.when(source.isNull(), "NotFound").when((source == "resource") & ~F.col("is_ontology"), "NotAnOntology")
    return found.select("id", source.alias("source"), rejection.alias("rejection"))


def acl_self(acls: DataFrame, addresses: DataFrame, identities: list[str]) -> DataFrame:
    """asked, address, identity, permission: what identities hold at each address and at those above it."""
    asked = addresses.select(F.col("address").alias("asked"), F.explode(F.array_distinct(ancestors(F.col("address")))).alias("address")).distinct()
    return asked.join(acls.filter(F.col("identity").isin(identities)), "address").select("asked", "address", "identity", "permission")


def acl_add(acls: DataFrame, more: DataFrame) -> DataFrame:
    """Entries of both, each once."""
    return acls.unionByName(more).distinct()


def acl_subtract(acls: DataFrame, less: DataFrame) -> DataFrame:
    """Entries without those of less; an address that is left without any has none."""
    return acls.join(less, ["address", "identity", "permission"], "left_anti")


def expand_views(views: DataFrame, members: DataFrame, acls: DataFrame, identities: list[str]) -> DataFrame:
    """Aggregate views to the usable indexing views below them that the caller may query.

    views (org, project, id, aggregate, deprecated, permission); members: edges between views.
    """
    tops = views.filter("aggregate and not deprecated")
    reach = closure(members, tops).join(views, KEY).filter("not aggregate and not deprecated")
    rows = reach.withColumn("address", F.concat(F.lit("/"), "org", F.lit("/"), "project"))
    return granted(rows, acls, identities).select("start_org", "start_project", "start_id", *KEY)
