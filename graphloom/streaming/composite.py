"""Composite views: several sources into several targets, with an offset for every branch, and runs beside one another.

A branch is a (source, target) pair of a run: main, or a rebuild that leaves main alone.  Its progress is written with its
elements, in a folder named by the position that it has reached, so what a branch has done is known from its own results.
A source starts again behind the least offset of its branches; a branch that is further on passes over what it has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import pipes
from graphloom.operators.feed import projection_progress
from graphloom.sources import files
from graphloom.streaming.feeds import BATCH, finish, run_feed

Pipe = Callable[[DataFrame], DataFrame]
PROGRESS = "source string, target string, processed long, discarded long, failed long, offset long"


@dataclass(frozen=True)
class Source:
    """A Parquet log with a column of unique positions; elements() maps its rows, and gives that position as ordering.

    Where several batches are taken at once, elements() and the pipes keep the column feed_batch.
    """

    path: str
    column: str
    elements: Pipe
    pipe: Pipe = pipes.chain()


class CompositeView:
    def __init__(self, spark: SparkSession, out: str, sources: dict[str, Source], targets: dict[str, Pipe]):
        self.spark, self.out, self.sources, self.targets = spark, out.rstrip("/"), sources, targets

    def _branch(self, run: str, source: str, target: str) -> str:
        return f"{self.out}/{run}/{source}/{target}"

    def offset(self, run: str, source: str, target: str) -> int:
        """The position that a branch has reached; -1 before its first batch."""
        done = [n for n in files.names(self.spark, f"{self._branch(run, source, target)}/progress") if n.startswith("upto=")]
        whole = [int(n.removeprefix("upto=")) for n in done if files.exists(self.spark, f"{self._branch(run, source, target)}/progress/{n}/_SUCCESS")]
        return max(whole, default=-1)

    def start(self, run: str, source: str) -> int:
        """Where a source begins: the least offset of its branches."""
        return min(self.offset(run, source, t) for t in self.targets)

    def run_source(self, source: str, *, run: str = "main", max_elements: int = 10_000, at_once: int = 1) -> None:
        """Process what is there of one source, from its branches' least offset on.

        at_once: batches of a trigger at most. A branch has all of them or none; its progress has a row for each.
        """
        s, start = self.sources[source], self.start(run, source)
        reached = {t: self.offset(run, source, t) for t in self.targets}

        def handle(batch: DataFrame, batch_id: int) -> None:
            numbered = batch if BATCH in batch.columns else batch.withColumn(BATCH, F.lit(batch_id))
            common = numbered.transform(s.pipe).persist()
            try:
                upto = common.agg(F.max("ordering")).first()[0]
                for target, pipe in self.targets.items():
                    if upto is None or upto <= reached[target]:
                        continue
                    done = common.filter(F.col("ordering") > reached[target]).transform(pipe)
                    at = self._branch(run, source, target)
                    done.drop(BATCH).write.mode("overwrite").parquet(f"{at}/elements/upto={upto}")
                    # last: with it the branch has the batch
                    progress = projection_progress(done, BATCH).select(F.lit(source).alias("source"), F.lit(target).alias("target"), "processed", "discarded", "failed", "offset")
                    progress.write.mode("overwrite").parquet(f"{at}/progress/upto={upto}")
                    reached[target] = upto
            finally:
                common.unpersist()

        # a checkpoint of its own for each beginning: the offsets that count are the branches'
        finish(run_feed(self.spark, s.path, s.column, s.elements, handle, checkpoint=f"{self.out}/{run}/{source}/from={start}-{len(files.names(self.spark, f'{self.out}/{run}/{source}'))}", max_elements=max_elements, at_once=at_once, start=start))

    def run(self, *, run: str = "main", max_elements: int = 10_000, at_once: int = 1) -> None:
        for source in self.sources:
            self.run_source(source, run=run, max_elements=max_elements, at_once=at_once)

    def elements(self, target: str, *, run: str = "main") -> DataFrame:
        """What a target holds of all sources."""
        rows = None
        for source in self.sources:
            path = f"{self._branch(run, source, target)}/elements"
            done = [f"{path}/{n}" for n in files.names(self.spark, path) if n.startswith("upto=") and int(n.removeprefix("upto=")) <= self.offset(run, source, target)]
            if done:
                one = self.spark.read.parquet(*done).withColumn("source", F.lit(source))
                rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return rows

    def progress(self, *, run: str = "main") -> DataFrame:
        """source, target, processed, discarded, failed, offset of every branch that has begun."""
        paths = [f"{self._branch(run, s, t)}/progress" for s in self.sources for t in self.targets]
        paths = [f"{p}/{n}" for p in paths for n in files.names(self.spark, p) if n.startswith("upto=")]
        rows = self.spark.read.schema(PROGRESS).parquet(*paths) if paths else self.spark.createDataFrame([], PROGRESS)
        return rows.groupBy("source", "target").agg(*(F.sum(c).alias(c) for c in ("processed", "discarded", "failed")), F.max("offset").alias("offset"))
