"""N-Quads as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?)\s*(?:<([^>]*)>)?\s*\.\s*$'


def parse_nquads(lines: DataFrame) -> DataFrame:
    """s, p, o, kind, datatype, lang, g of every line of a column value (as spark.read.text gives it); other lines drop out."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    either = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    kind = F.when(part(4) != "", "iri").when(part(5) != "", "blank").otherwise("literal")
    o = F.when(kind == "iri", part(4)).when(kind == "blank", part(5)).otherwise(part(6))
    return lines.filter(F.col("value").rlike(LINE)).select(either(1, 2).alias("s"), part(3).alias("p"), o.alias("o"), kind.alias("kind"), part(7).alias("datatype"), part(8).alias("lang"), part(9).alias("g"))


def resources_of(quads: DataFrame, *, schema: str, deprecated: str) -> DataFrame:
    """id, status, schema, deprecated, n_data: metadata and data told apart by predicate; without either metadata an element is Failed."""
    meta = F.col("p").isin(schema, deprecated)
    rows = quads.groupBy(F.col("s").alias("id")).agg(
        F.max(F.when(F.col("p") == schema, F.col("o"))).alias("schema"),
        F.max(F.when(F.col("p") == deprecated, F.col("o"))).alias("flag"),
        F.count_if(~meta).alias("n_data"),
    )
    good = F.col("schema").isNotNull() & F.col("flag").isNotNull()
    return rows.select("id", F.when(good, "Success").otherwise("Failed").alias("status"), F.when(good, F.col("schema")).alias("schema"), F.when(good, F.col("flag") == "true").alias("deprecated"), "n_data")
