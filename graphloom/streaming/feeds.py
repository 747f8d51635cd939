"""Streams over an append-only log by position: bounded batches, saved offsets, and sinks that take a batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.clock import LogClock
from graphloom.streaming.index import KeyedIndex

Pipe = Callable[[DataFrame], DataFrame]
Handler = Callable[[DataFrame, int], None]


#: The column that tells the batches of a trigger apart, where it takes several at once.
BATCH = "feed_batch"


def run_feed(spark: SparkSession, path: str, column: str, elements: Pipe, handle: Handler, *, checkpoint: str, max_elements: int = 10_000, at_once: int = 1, start: int = -1, interval: str = "0 seconds") -> StreamingQuery:
    """Batches of a Parquet log, in order of a column of unique whole numbers, through elements() into handle(batch, batch_id).

    A batch ends after max_elements positions, or with what is there when the interval (a trigger) is over.  The offset is
    the last position, kept in the checkpoint: a restart goes on behind it, and a batch that failed comes again as it was.
    start is the position after which a new stream begins.

    at_once: where the log is ahead, a trigger takes up to so many of these batches, and handle gets them in one DataFrame, with
    the last one's number; the column feed_batch, which elements() has to keep, tells them apart.  A trigger has a cost of its
    own, so a log of many small batches is caught up with in far less time.
    """
    spark.dataSource.register(LogClock)
    options = {"path": path, "column": column, "max_elements": max_elements, "at_once": at_once, "start": start}
    ranges = spark.readStream.format(LogClock.name()).options(**options).load()
    schema, position = spark.read.parquet(path).schema, F.col(column)

    def several(log: DataFrame, runs: list) -> None:
        inside, number = F.lit(False), F.lit(None).cast("long")
        for r in runs:
            # plain comparisons with literals: they reach the files' statistics
            hit = (position > r["after"]) & (position <= r["upto"])
            inside = inside | hit
            number = F.when(hit, r["batch"] + F.floor((position - r["after"] - 1) / max_elements)).otherwise(number)
        handle(log.filter(inside).withColumn(BATCH, number).transform(elements), runs[-1]["batch"] + (runs[-1]["upto"] - runs[-1]["after"] - 1) // max_elements)

    def trigger(rows: DataFrame, _: int) -> None:
        runs = sorted(rows.collect(), key=lambda r: r["batch"])  # a few rows
        log = spark.read.schema(schema).parquet(path)
        if at_once > 1 and runs:
            return several(log, runs)
        for r in runs:
            handle(log.filter((position > r["after"]) & (position <= r["upto"])).transform(elements), r["batch"])

    return ranges.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def finish(query: StreamingQuery) -> None:
    """Process what is there, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def into_index(index: KeyedIndex, pipe: Pipe, *, compact_every: int = 8) -> Handler:
    """A sink: each trigger's batches, one unless several are taken at once, as a delta of the index; once they hold so many batches, open deltas are folded into its base."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        index.write_batch(batch.transform(pipe).withColumnRenamed(BATCH, "index_batch"), batch_id)
        if batch_id - index.manifest().folded >= compact_every:
            index.compact()

    return handle


def into_batches(path: str, pipe: Pipe) -> Handler:
    """A sink: each batch in a folder of its own; a repeated one overwrites it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = batch.transform(pipe)
        if BATCH not in done.columns:
            return done.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        # one file for a batch, whose size is bounded
        dealt = done.withColumnRenamed(BATCH, "batch_id").repartition(done.sparkSession.sparkContext.defaultParallelism, "batch_id")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return handle
