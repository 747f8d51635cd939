"""Running projections with Structured Streaming.

Every sink writes a batch into a directory named by its batch_id and overwrites it, so
a batch that is tried again after a failure leaves one copy. Readers fold the
batches: the last write of an id wins, a Dropped element deletes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.feed import last_updates, projection_progress
from graphloom.sources import files
from graphloom.sources.named_files import Bundle, NamedFiles

Pipe = Callable[[DataFrame], DataFrame]


def log_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    """An append-only log as a stream; micro-batches are bounded by files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_projection(stream: DataFrame, pipe: Pipe, out: str, *, name: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Elements of a stream through a pipe into out/elements; progress, failures and last updates beside it.

    Without ``continuous`` (a trigger interval) it processes what is there and ends.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        done = df.transform(pipe).persist()
        try:
            _write(done, f"{out}/elements", batch_id)
            _write(done.filter("status = 'Failed'"), f"{out}/failures", batch_id)
            _write(projection_progress(done).withColumn("projection", F.lit(name)), f"{out}/progress", batch_id)
            _write(last_updates(done), f"{out}/updates", batch_id)
        finally:
            done.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def run_composite(stream: DataFrame, source_pipe: Pipe, targets: dict[str, Pipe], out: str, *, source: str, checkpoint: str) -> StreamingQuery:
    """One source into several targets: the common elements are computed once per batch, progress is kept per branch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        common = df.transform(source_pipe).persist()
        try:
            for target, pipe in targets.items():
                done = common.transform(pipe)
                _write(done, f"{out}/{target}/elements", batch_id)
                _write(projection_progress(done).withColumns({"source": F.lit(source), "target": F.lit(target)}), f"{out}/{target}/progress", batch_id)
        finally:
            common.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reset(spark: SparkSession, *folders: str) -> None:
    """Delete a projection's progress, results and checkpoint: it then starts from the beginning."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """A projection's counters over all batches."""
    rows = spark.read.parquet(f"{out}/progress").filter("processed > 0")
    return rows.groupBy("projection").agg(F.sum("processed").alias("processed"), F.sum("discarded").alias("discarded"), F.sum("failed").alias("failed"), F.max("offset").alias("offset"), F.max("instant").alias("instant"))


def read_updates(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/updates")
    return rows.groupBy("org", "project").agg(F.max_by("last_instant", "last_ordering").alias("last_instant"), F.max("last_ordering").alias("last_ordering"))


def project_activity(updates: DataFrame, now, interval) -> DataFrame:
    """org, project, active: whether the last update is after now minus interval."""
    return updates.select("org", "project", (F.col("last_instant") > now - interval).alias("active"))


def export_events(log: DataFrame, path: str, *, offset: int = 0, projects: list[tuple[str, str]] | None = None, lines: int = 10_000) -> None:
    """Events after an offset as JSON lines, in order, in files of exactly so many lines (the last one of what is left).

    A file is named by its first offset, 12 digits; _SUCCESS holds the query and the totals.  Global numbers come from two
    passes: rows are counted in ranges of the offset, and a row's number is that of its range's beginning plus its own there.
    A range is so wide that about one file's rows are in it, so tasks grow with the data; offsets are unique.
    """
    rows = log.filter(F.col("ordering") > offset)
    if projects:
        hit = F.lit(False)
        for org, project in projects:
            hit = hit | ((F.col("org") == org) & (F.col("project") == project))
        rows = rows.filter(hit)
    spark = log.sparkSession
    spark.dataSource.register(NamedFiles)
    n, low, high = rows.agg(F.count("*"), F.min("ordering"), F.max("ordering")).first()
    width = max(1, (high - low + 1) * lines // n) if n else 1
    placed = rows.withColumn("export_range", F.floor((F.col("ordering") - (low or 0)) / width))
    counts = placed.groupBy("export_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("export_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row per range, not per event
    inside = Window.partitionBy("export_range").orderBy("ordering")
    numbered = placed.withColumn("export_number", F.row_number().over(inside)).join(starts, "export_range")
    file = F.floor((F.col("rows_before") + F.col("export_number") - 1) / lines)
    whole = numbered.select(file.alias("export_file"), "ordering", F.to_json(F.struct(*log.columns)).alias("line"))
    first = F.min("ordering").over(Window.partitionBy("export_file"))
    named = whole.withColumn("name", F.concat(F.lpad(first.cast("string"), 12, "0"), F.lit(".json")))
    marker = json.dumps({"offset": offset, "projects": [f"{o}/{p}" for o, p in projects or []], "lines": lines})
    named.sortWithinPartitions("export_file", "ordering").select("name", "line").write.format(NamedFiles.name()).mode("append").option("path", path).option("marker", marker).save()


def write_bundle(entries: DataFrame, path: str, *, strict: bool = False) -> None:
    """Entries (path, content) of a bundle as parts and a manifest; strict: a missing content fails before anything is visible."""
    spark = entries.sparkSession
    spark.dataSource.register(Bundle)
    entries.select("path", "content").write.format(Bundle.name()).mode("append").option("path", path).option("strict", str(strict).lower()).save()


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the parts that the manifest names."""
    parts = json.loads(files.read_text(spark, f"{path}/manifest.json"))["parts"]
    kind = "path string, content string"
    return spark.read.schema(kind).json([f"{path}/{p['name']}" for p in parts]) if parts else spark.createDataFrame([], kind)
