"""Statistics of projects, storages, events, views and composite projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_statistics(states: DataFrame) -> DataFrame:
    """Per project at tag latest: resources, events (the sum of revisions), last instant."""
    rows = states.filter("tag = 'latest'") if "tag" in states.columns else states
    return rows.groupBy("org", "project").agg(F.count("*").alias("resources"), F.sum("rev").alias("events"), F.max("instant").alias("last_instant"))


def event_metrics(log: DataFrame, types: DataFrame) -> DataFrame:
    """A row per event with its actions: a creating event that also tags is Created and Tagged."""
    base = F.when(F.col("kind") == "TagAdded", "Tagged").otherwise(F.col("kind"))
    also = F.when(F.col("tag").isNotNull() & ~F.col("kind").isin("TagAdded", "TagDeleted"), "Tagged")
    rows = log.select("org", "project", "id", "rev", "instant", "subject", F.array_compact(F.array(base, also)).alias("action"))
    return rows.join(types.select("org", "project", "id", "rev", "types"), ["org", "project", "id", "rev"], "left")


def append_metrics(metrics: DataFrame, batch: DataFrame, dropped: DataFrame) -> DataFrame:
    """Metrics keyed by (project, id, rev), written twice without effect; those of dropped resources go."""
    both = metrics.unionByName(batch).dropDuplicates(["org", "project", "id", "rev"])
    return both.join(dropped.select("org", "project", "id"), ["org", "project", "id"], "left_anti")


def storage_statistics(metrics: DataFrame, storages: DataFrame) -> DataFrame:
    """storages (project, storage) with files and bytes; 0 and 0 for one without files."""
    sums = metrics.groupBy("project", "storage").agg(F.sum("new_file").alias("files"), F.sum("bytes").alias("bytes"))
    out = storages.join(sums, ["project", "storage"], "left")
    return out.select("project", "storage", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def composite_source_offsets(branches: DataFrame) -> DataFrame:
    """The offset of a source and run: the smallest of its branches."""
    return branches.groupBy("source", "run").agg(F.min("offset").alias("offset"))


def rebuild_condition(branches: DataFrame, checked: DataFrame, remaining: DataFrame, *, every: bool = False) -> DataFrame:
    """rebuild: some source (every: all) moved since the last check or rebuild, and all that moved have nothing remaining.

    branches (source, run, offset) with runs main and rebuild; checked (source, offset); remaining (source, n).
    """
    runs = branches.groupBy("source").agg(F.min(F.when(F.col("run") == "main", F.col("offset"))).alias("main"), F.min(F.when(F.col("run") == "rebuild", F.col("offset"))).alias("rebuild"))
    rows = runs.join(checked.withColumnRenamed("offset", "checked"), "source", "left").join(remaining, "source", "left")
    moved = F.col("main").isNotNull() & ((F.coalesce("checked", F.lit(-1)) != F.col("main")) | (F.coalesce("rebuild", F.lit(-1)) != F.col("main")))
    rows = rows.withColumn("moved", moved).withColumn("done", F.coalesce("n", F.lit(0)) == 0)
    some = F.bool_and("moved") if every else F.bool_or("moved")
    return rows.agg((some & F.bool_and("done")).alias("rebuild"))


def restart_branches(progress: DataFrame, run: str | None = None, target: str | None = None) -> DataFrame:
    """Counters back to zero: all branches, those of a run, or those of a run and one target."""
    hit = F.lit(True)
    hit = hit if run is None else hit & (F.col("run") == run)
    hit = hit if target is None else hit & (F.col("target") == target)
    zero = {c: F.when(hit, F.lit(0)).otherwise(F.col(c)) for c in ("offset", "processed", "discarded", "failed")}
    return progress.withColumns(zero)
