"""Small files and folders in any store that Spark reads, for the driver: manifests, markers, listings."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Exists(FileExistsError):
    """Another writer made the file first."""


def _at(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _at(spark, path)
    if not fs.rename(p, _at(spark, to)[1]):
        raise OSError(f"{path} can't be renamed to {to}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole under a name that must be free: it's written aside and renamed."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        raise Exists(path)
    aside, q = _at(spark, f"{path}.tmp")
    stream = fs.create(q, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(q, p):
        raise Exists(path)
