"""Helpers shared by the operators: reading tables, cutting lineage, joins on ids without moving texts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a few batches at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: The bound of what ``maybe_in`` broadcasts: so many bucket numbers.
ID_BUCKETS = 1 << 20
_PREFIX = "graphloom-"
_stored: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Let Python workers get texts in batches of BATCH_ROWS and about BATCH_BYTES at most.

    Spark reads the setting when a result is computed, so it stays in the session; one below these bounds is left alone.
    """
    conf = df.sparkSession.conf
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _number(conf.get(key, None)) <= bound:
            conf.set(key, str(bound))


def _number(setting: str | None) -> int:
    return int(setting) if setting and setting.lstrip("-").isdigit() else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none need be configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a result to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{_PREFIX}{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> frozenset[str]:
    """The tables that stored() has written: a caller's mark, what is written later is its own."""
    return frozenset(_stored)


def clear_stored(spark: SparkSession, keep: DataFrame | None = None, before: frozenset[str] = frozenset()) -> None:
    """Delete what stored() has written since a mark, but for the files that keep reads: for callers that have written their results.

    What others stored before the mark stays: their results may not have been computed yet.
    """
    kept = {k for f in (keep.inputFiles() if keep is not None else ()) for k in re.findall(f"{_PREFIX}[0-9a-f]+", f)}
    left = [p for p in _stored if p in before or p.rsplit("/", 1)[1] in kept]
    jvm = spark.sparkContext._jvm
    for path in set(_stored).difference(left):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _stored[:] = left


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(column) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS))


def maybe_in(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key may be among ids (left_semi: a superset) or surely isn't (left_anti).

    Only bucket numbers are broadcast, ID_BUCKETS at most, so that wide rows
    whose ids don't matter needn't be shuffled; an exact join follows.
    """
    buckets = ids.select(id_bucket(F.col(key)).alias("id_bucket")).distinct()
    return rows.join(F.broadcast(buckets), id_bucket(rows[key]) == buckets["id_bucket"], how)


def rows_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Exactly the rows whose key is among ids."""
    return maybe_in(rows, ids, key).join(ids.select(key).distinct(), key, "left_semi")


def rows_not_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Exactly the rows whose key isn't among ids; rows with a null key stay."""
    some = maybe_in(rows, ids, key).join(ids.select(key).distinct(), key, "left_anti")
    return maybe_in(rows, ids, key, "left_anti").unionByName(some)
