"""Checks of resources against shapes, and of reserved names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def constraint_check(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """resource, type, path, n, violation: every targeted node against every shape of its type.

    shapes (type, path, min_count, max_count, datatype), null for no bound. A shape list is
    a schema's, a few rows, and joins on the type.
    """
    # predicates that no shape names needn't be shuffled
    paths = F.broadcast(shapes.select(F.col("path").alias("p")).distinct())
    targets = triples.filter("p = 'type'").select(F.col("s").alias("resource"), F.col("o").alias("type")).join(shapes, "type")
    own = triples.join(paths, "p", "left_semi").select(F.col("s").alias("resource"), F.col("p").alias("path"), F.col("datatype").alias("own_type"), F.lit(1).alias("hit"))
    rows = targets.join(own, ["resource", "path"], "left").groupBy("resource", "type", "path", "min_count", "max_count", "datatype")
    rows = rows.agg(F.count("hit").alias("n"), F.count_if(F.col("own_type") != F.col("datatype")).alias("wrong"))
    why = F.when(F.col("n") < F.col("min_count"), "minCount").when(F.col("n") > F.col("max_count"), "maxCount").when(F.col("wrong") > 0, "datatype")
    return rows.select("resource", "type", "path", "n", why.alias("violation"))


def conforms(report: DataFrame) -> DataFrame:
    """targeted and violations; without a targeted node the check itself is an error."""
    n = F.countDistinct("resource")
    return report.agg(n.alias("targeted"), F.count("violation").alias("violations")).withColumn("verdict", F.when(F.col("targeted") == 0, "NoTargetedNode").when(F.col("violations") > 0, "Invalid").otherwise("Valid"))


def validate(resources: DataFrame, report: DataFrame) -> DataFrame:
    """resources (id, deprecated, ...) with status and violations: Dropped if deprecated or without a shape, Failed with
    its violations (path:kind, sorted), else Success. Failed elements go to a projection's failures."""
    found = F.concat_ws(":", "path", "violation")
    per = report.groupBy(F.col("resource").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("violation").isNotNull(), found))).alias("violations"))
    rows = resources.join(per, "id", "left")
    skipped = F.coalesce("deprecated", F.lit(False)) | F.col("violations").isNull()
    rows = rows.withColumn("status", F.when(skipped, "Dropped").when(F.size("violations") > 0, "Failed").otherwise("Success"))
    return rows.withColumn("violations", F.when(F.col("status") == "Failed", F.array_join("violations", ",")))


def reserved_checks(resources: DataFrame, base: str, types: list[str]) -> DataFrame:
    """resources (id, types, payload) with a rejection, or null: reserved id, reserved type, payload keys that start with _."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    why = F.when(F.col("id").startswith(base), "ReservedId").when(F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, types))), F.lit(False)), "ReservedType").when(F.exists(keys, lambda k: k.startswith("_")), "ReservedKey")
    return resources.withColumn("rejection", why)
