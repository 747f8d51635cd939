"""Event sourcing: folding the log into states, tags, tombstones, deletion and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["org", "project", "id"]
#: Events that set the payload and types, the schema, and the deprecation flag.
PAYLOAD = ["Created", "Updated", "Refreshed"]
SCHEMA = ["Created", "Updated", "SchemaUpdated"]
FLAG = ["Created", "Deprecated", "Undeprecated"]
KINDS = ["Created", "Updated", "Refreshed", "TagAdded", "TagDeleted", "SchemaUpdated", "Deprecated", "Undeprecated"]


def _last(column: str | Column, kinds: list[str]) -> Column:
    """The value at the highest revision among events of these kinds; partial aggregates merge."""
    return F.max_by(column, F.when(F.col("kind").isin(kinds), F.col("rev")))


def fold_tags(log: DataFrame) -> DataFrame:
    """(key, tag, target_rev) of the tags that hold: the last action of each tag, if it isn't a deletion."""
    last = log.filter(F.col("tag").isNotNull()).groupBy(*KEY, "tag").agg(F.max_by(F.struct("kind", "target_rev", "ordering"), "rev").alias("a"))
    return last.filter("a.kind = 'TagAdded'").select(*KEY, "tag", "a.target_rev", F.col("a.ordering").alias("ordering"))


def fold_states(log: DataFrame) -> DataFrame:
    """One state per resource from all its events, by aggregation alone; valid tells whether the transitions were."""
    state = log.groupBy(*KEY).agg(
        F.max_by("type", "rev").alias("type"),
        F.max("rev").alias("rev"),
        F.max("ordering").alias("ordering"),
        _last("types", PAYLOAD).alias("types"),
        _last("schema", SCHEMA).alias("schema"),
        _last("payload", PAYLOAD).alias("payload"),
        _last(F.col("kind") == "Deprecated", FLAG).alias("deprecated"),
        F.min_by("instant", "rev").alias("created_at"),
        F.min_by("subject", "rev").alias("created_by"),
        F.max_by("instant", "rev").alias("updated_at"),
        F.max_by("subject", "rev").alias("updated_by"),
        ((F.min_by("kind", "rev") == "Created") & (F.count_if(F.col("kind") == "Created") == 1) & (F.count("*") == F.max("rev")) & (F.count_if(~F.col("kind").isin(KINDS)) == 0)).alias("valid"),
    )
    tags = fold_tags(log).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "target_rev")))).alias("tags"))
    return state.join(tags, KEY, "left")


def running_states(log: DataFrame) -> DataFrame:
    """The state after every revision."""
    upto = Window.partitionBy(*KEY).orderBy("rev").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, kinds: F.last(F.when(F.col("kind").isin(kinds), c), ignorenulls=True).over(upto)
    return log.select(
        *KEY,
        "type",
        "rev",
        "ordering",
        "instant",
        "subject",
        "kind",
        last(F.col("types"), PAYLOAD).alias("types"),
        last(F.col("schema"), SCHEMA).alias("schema"),
        last(F.col("payload"), PAYLOAD).alias("payload"),
        last(F.col("kind") == "Deprecated", FLAG).alias("deprecated"),
    )


def history(log: DataFrame, id: str, upto: int | None = None) -> DataFrame:
    """The events of one resource up to a revision, by revision."""
    rows = log.filter(F.col("id") == id)
    return (rows if upto is None else rows.filter(F.col("rev") <= upto)).orderBy("rev")


def state_at_rev(log: DataFrame, rev: int) -> DataFrame:
    """The state at exactly this revision; resources that haven't reached it get status InvalidRevision."""
    state = fold_states(log.filter(F.col("rev") <= rev))
    return state.withColumn("status", F.when(F.col("rev") == rev, "Found").otherwise("InvalidRevision"))


def tag_snapshots(log: DataFrame) -> DataFrame:
    """The states that tags hold: a copy, under the tag, of the state at the tagged revision."""
    at = running_states(log).drop("ordering", "kind")
    return fold_tags(log).withColumnRenamed("target_rev", "rev").join(at, [*KEY, "rev"])


def latest_states(log: DataFrame) -> DataFrame:
    """The newest state of each resource under the tag latest: one aggregation, whose partial results merge before the shuffle."""
    known = lambda c, kinds: F.max_by(c, F.when(F.col("kind").isin(kinds) & F.col(c).isNotNull(), F.col("rev"))).alias(c)
    newest = [F.max_by(c, "rev").alias(c) for c in ("type", "ordering", "instant", "subject")]
    state = log.groupBy(*KEY).agg(F.max("rev").alias("rev"), *newest, known("types", PAYLOAD), known("schema", SCHEMA), known("payload", PAYLOAD), _last(F.col("kind") == "Deprecated", FLAG).alias("deprecated"))
    return state.select(*KEY, "type", "rev", "ordering", "instant", "subject", "types", "schema", "payload", "deprecated", F.lit("latest").alias("tag"))


def states(log: DataFrame) -> DataFrame:
    """The state table: latest states and tagged ones."""
    return latest_states(log).unionByName(tag_snapshots(log))


def state_at_tag(states: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key, tag): Found with its rev, TagNotFound, or NotFound if there is no such resource at all."""
    own = states.select(*KEY, "tag", "rev")
    known = own.filter("tag = 'latest'").select(*KEY, F.lit(True).alias("known"))
    found = requests.join(own, [*KEY, "tag"], "left").join(known, KEY, "left")
    return found.withColumn("status", F.when(F.col("rev").isNotNull(), "Found").when(F.col("known"), "TagNotFound").otherwise("NotFound")).drop("known")


def type_tombstones(log: DataFrame) -> DataFrame:
    """Types lost between consecutive revisions, where any were."""
    before = F.lag("types").over(Window.partitionBy(*KEY).orderBy("rev"))
    lost = running_states(log).withColumn("lost", F.array_except(before, "types"))
    return lost.filter(F.size("lost") > 0).select(*KEY, "type", F.lit("latest").alias("tag"), F.lit(False).alias("deleted"), F.col("lost").alias("types"), "schema", "instant", "ordering")


def tag_tombstones(log: DataFrame) -> DataFrame:
    """Deletions of tags that held at that moment."""
    before = F.lag("kind").over(Window.partitionBy(*KEY, "tag").orderBy("rev"))
    gone = log.filter(F.col("tag").isNotNull()).withColumn("before", before).filter("kind = 'TagDeleted' and before = 'TagAdded'")
    return gone.select(*KEY, "type", "tag", F.lit(True).alias("deleted"), F.array().cast("array<string>").alias("types"), F.lit(None).cast("string").alias("schema"), "instant", "ordering")


def tombstones(log: DataFrame) -> DataFrame:
    return type_tombstones(log).unionByName(tag_tombstones(log))


def change_detection(log: DataFrame) -> DataFrame:
    """Whether each payload event differs from the payload event before it in types, schema or payload."""
    order = Window.partitionBy(*KEY).orderBy("rev")
    rows = log.filter(F.col("kind").isin(PAYLOAD))
    changed = F.lit(False)
    for c in ("types", "payload"):
        changed = changed | ~F.lag(c).over(order).eqNullSafe(F.col(c))
    return rows.withColumn("changed", (F.row_number().over(order) == 1) | changed)


def delete_resources(states: DataFrame, ids: DataFrame, ordering: Column, instant: Column) -> tuple[DataFrame, DataFrame]:
    """What is left of states, and a tombstone for every tag of the deleted resources."""
    left = states.join(ids, KEY, "left_anti")
    gone = states.join(ids, KEY, "left_semi").select(*KEY, "type", "tag", F.lit(True).alias("deleted"), F.array().cast("array<string>").alias("types"), F.col("schema"), instant.alias("instant"), ordering.alias("ordering"))
    return left, gone


def expire(rows: DataFrame, column: str, now: Column, ttl: Column | None = None) -> DataFrame:
    """Rows that haven't expired: column (plus ttl) lies after now."""
    end = F.col(column) if ttl is None else F.col(column) + ttl
    return rows.filter(end > now)


def delete_project(rows: DataFrame, org: str, project: str) -> DataFrame:
    """Rows of all other projects; a partition filter where the table is partitioned by org."""
    return rows.filter(~((F.col("org") == org) & (F.col("project") == project)))


def projects_to_delete(projects: DataFrame, *, include: str, exclude: str | None = None, delete_deprecated: bool = False, idle_before: Column | None = None) -> DataFrame:
    """projects (org, project, deprecated, marked, updated_at, last_event): those to delete by name, state and idleness."""
    name = F.concat_ws("/", "org", "project")
    chosen = projects.filter(name.rlike(f"^(?:{include})$") & ~F.col("marked"))
    if exclude is not None:
        chosen = chosen.filter(~name.rlike(f"^(?:{exclude})$"))
    why = F.col("deprecated") & F.lit(delete_deprecated)
    if idle_before is not None:
        why = why | ((F.col("updated_at") < idle_before) & (F.coalesce("last_event", "updated_at") < idle_before))
    return chosen.filter(why)
