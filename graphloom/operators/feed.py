"""The change feed: states and tombstones in order, with scope, offset, tag and type filters; progress over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["org", "project", "id"]
FEED = ["type", *KEY, "tag", "rev", "instant", "ordering", "status"]


def scope(org: str | None = None, project: str | None = None) -> Column:
    """Everything, one organisation, or one project."""
    parts = [F.col(c) == v for c, v in (("org", org), ("project", project)) if v is not None]
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def after(offset: int | None) -> Column:
    """ordering > offset; no offset means from the start."""
    return F.lit(True) if offset is None else F.col("ordering") > offset


def of_types(types: list[str] | None) -> Column:
    """Whether any of a row's types is wanted; no list means no restriction."""
    return F.arrays_overlap("types", F.array(*map(F.lit, types))) if types else F.lit(True)


def of_entities(kinds: list[str] | None) -> Column:
    return F.col("type").isin(kinds) if kinds else F.lit(True)


def state_changes(states: DataFrame, tombstones: DataFrame, *, offset: int | None = None, where: Column | None = None, tag: str = "latest", types: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """States as Success and tombstones as Dropped (rev -1), after an offset; order by ordering to read it as a feed.

    A tombstone passes if it deletes, or if it takes away a wanted type. extra: further columns of states, null for tombstones.
    """
    where = F.lit(True) if where is None else where
    alive = states.filter(where & after(offset) & (F.col("tag") == tag) & of_types(types)).withColumn("status", F.lit("Success"))
    lost = F.arrays_overlap("types", F.array(*map(F.lit, types))) if types else F.lit(False)
    gone = tombstones.filter(where & after(offset) & (F.col("tag") == tag) & (F.col("deleted") | lost)).withColumns({"rev": F.lit(-1), "status": F.lit("Dropped")})
    return alive.select(*FEED, *extra).unionByName(gone.select(*FEED, *(F.lit(None).cast(states.schema[c].dataType).alias(c) for c in extra)))


def state_values(states: DataFrame, tombstones: DataFrame, schema: str, **filters) -> DataFrame:
    """The feed with the payload decoded; a payload that can't be decoded makes the element Failed, none at all is a null value."""
    feed = state_changes(states, tombstones, extra=("payload",), **filters)
    broken = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    rows = feed.withColumn("value", F.when(~broken, F.from_json("payload", schema)))
    return rows.withColumn("status", F.when((F.col("status") == "Success") & broken, "Failed").otherwise(F.col("status"))).drop("payload")


def event_feed(log: DataFrame, tombstones: DataFrame, *, offset: int | None = None, where: Column | None = None, entities: list[str] | None = None) -> DataFrame:
    """Events and event tombstones after an offset, as a set; events whose payload can't be decoded are Dropped."""
    where = F.lit(True) if where is None else where
    cols = ["type", *KEY, "rev", "instant", "ordering"]
    broken = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    events = log.filter(where & after(offset) & of_entities(entities)).select(*cols, F.when(broken, "Dropped").otherwise("Success").alias("status"))
    gone = tombstones.filter(where & after(offset) & of_entities(entities) & F.col("deleted")).select("type", *KEY, F.lit(-1).alias("rev"), "instant", "ordering", F.lit("Dropped").alias("status"))
    return events.union(gone).distinct()


def last_per_key(feed: DataFrame) -> DataFrame:
    """The last element of each (org, project, id)."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("ordering"), "status", "tag")
    return feed.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def remaining(states: DataFrame, *, offset: int | None = None, where: Column | None = None, tag: str = "latest", types: list[str] | None = None) -> DataFrame:
    """How many states, and the last instant, after an offset; no row if there are none. Tombstones don't count."""
    where = F.lit(True) if where is None else where
    rows = states.filter(where & after(offset) & (F.col("tag") == tag) & of_types(types))
    return rows.agg(F.count("*").alias("n"), F.max("instant").alias("last_instant")).filter("n > 0")


def projection_progress(feed: DataFrame, *keys: str) -> DataFrame:
    """Elements processed, discarded and failed, and the last offset and instant, per key."""
    counts = [F.count("*").alias("processed"), F.count_if(F.col("status") == "Dropped").alias("discarded"), F.count_if(F.col("status") == "Failed").alias("failed"), F.max("ordering").alias("offset"), F.max("instant").alias("instant")]
    return feed.groupBy(*keys).agg(*counts)


def delay_seconds(last: Column, before: Column) -> Column:
    """Whole seconds between two instants, floored."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(last) - micros(before)) / 1_000_000)


def progress_statistics(progress: DataFrame, total: DataFrame, *keys: str) -> DataFrame:
    """progress (processed, discarded, failed, instant) against what is there (n, last_instant), per key.

    remaining = total - processed; delay in whole seconds between the last instants; either side may be missing.
    """
    both = progress.withColumnRenamed("instant", "processed_instant").join(total, list(keys), "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("processed", "discarded", "failed", "n")}
    both = both.withColumns(zero)
    return both.select(
        *keys,
        "processed",
        "discarded",
        "failed",
        (F.col("processed") - F.col("discarded") - F.col("failed")).alias("evaluated"),
        (F.col("n") - F.col("processed")).alias("remaining"),
        F.col("n").alias("total"),
        delay_seconds(F.col("last_instant"), F.col("processed_instant")).alias("delay_seconds"),
    )


def last_updates(feed: DataFrame) -> DataFrame:
    """The last instant and offset seen of each project."""
    return feed.groupBy("org", "project").agg(F.max_by("instant", "ordering").alias("last_instant"), F.max("ordering").alias("last_ordering"))


def mark_outcomes(batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A batch against a sink's answers (org, project, id, error): missing answers and errors make elements Failed.

    Of several answers to an element an error counts.
    """
    key = ["org", "project", "id"]
    answers = outcomes.groupBy(*key).agg(F.max("error").alias("error"), F.lit(True).alias("answered"))
    marked = batch.join(answers, key, "left")
    reason = F.when(F.col("status") != "Success", F.lit(None)).when(F.col("answered").isNull(), "MissingInResponse").when(F.col("error").isNotNull(), "IndexingFailure")
    return marked.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "Failed").otherwise(F.col("status"))).drop("answered", "error")


def feed_records(feed: DataFrame) -> DataFrame:
    """(event, id, data): the feed encoded for any sink, with a JSON text as data."""
    data = F.to_json(F.struct("org", "project", F.col("id").alias("resource"), "rev"))
    return feed.select(F.when(F.col("status") == "Dropped", "Deleted").when(F.col("status") == "Success", "Indexed").otherwise("Failed").alias("event"), F.col("ordering").alias("id"), F.when(F.col("status") == "Dropped", "Dropped").otherwise(data).alias("data"))
