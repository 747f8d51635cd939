"""A sink of graph analytics: documents with the types of what they refer to, kept right as those types change.

Three keyed indexes stand beside one another: documents, types of all resources seen, and referrers, the inverse of the
documents' references.  When the types of a resource change, referrers tells whose documents show them, and only their
buckets and those of the resource are opened.  A target's referrers are dealt to several buckets, as one resource may be
what a third of all documents refer to.

A batch is handled in this order: types, referrers, documents.  Each write takes a batch once, so a batch that is tried again
after any of them ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.analytics import flatten_documents
from graphloom.streaming.index import KeyedIndex

NODE = ["project", "id"]


class ReferenceIndex:
    """handle() takes batches of (project, id, ordering, action, types, deprecated, doc).

    action: index stores the document and passes the types on, update passes the types on alone, others do nothing.  Of several
    elements of a resource in a batch the last counts.  A reference to what hasn't been seen has null found_types.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 16, parts: int = 4, compact_every: int = 8):
        self.parts, self.compact_every = parts, compact_every
        self.documents = KeyedIndex(spark, f"{path}/documents", NODE, buckets=buckets)
        self.types = KeyedIndex(spark, f"{path}/types", NODE, buckets=buckets)
        self.referrers = KeyedIndex(spark, f"{path}/referrers", ["project", "target", "part", "id"], buckets=buckets, bucket_by=["project", "target", "part"])

    def _part(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy(*NODE).orderBy(F.desc("ordering"))
        last = batch.filter(F.col("action").isin("index", "update")).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n").persist()
        try:
            docs = last.filter("action = 'index'")
            changed = last.select(*NODE, "types", "ordering", F.lit("Success").alias("status"))
            self.types.write_batch(changed, batch_id, unique=True)
            refs = flatten_documents(docs, references=True).select(*NODE, "path", "in_array", "ref").persist()
            try:
                self._write_referrers(docs, refs, batch_id)
                fresh = self._resolved(docs, refs)
                hit = self._hit(changed, docs, batch_id)
                self.documents.write_batch(fresh if hit is None else fresh.unionByName(self._refreshed(changed, hit)), batch_id, unique=True)
                if hit is not None:
                    hit.unpersist()
            finally:
                refs.unpersist()
        finally:
            last.unpersist()
        for index in (self.types, self.referrers, self.documents):
            if len(index.manifest().deltas) >= self.compact_every:
                index.compact()

    def _write_referrers(self, docs: DataFrame, refs: DataFrame, batch_id: int) -> None:
        """New references come in, those that a document doesn't have any more go."""
        now = refs.select("project", F.col("ref").alias("target"), "id")  # the index takes each key once
        marks = now.withColumns({"status": F.lit("Success"), "rank": F.lit(1)})
        if self.documents.manifest().schema is not None:
            old = self.documents.lookup(docs.select(*NODE))
            old = old.select("project", "id", F.explode("references.ref").alias("target"))
            gone = old.join(now, ["project", "target", "id"], "left_anti").withColumns({"status": F.lit("Dropped"), "rank": F.lit(1)})
            marks = marks.unionByName(gone.select(*marks.columns))
        self.referrers.write_batch(marks.withColumn("part", self._part()), batch_id, ordering="rank")

    def _resolved(self, docs: DataFrame, refs: DataFrame) -> DataFrame:
        """Documents with their references and the types known for each."""
        known = self.types.near(refs.select("project", F.col("ref").alias("id"))).select("project", F.col("id").alias("ref"), F.col("types").alias("found_types"))
        # by merge: packed files of types are far smaller than what a broadcast would hold
        whole = refs.join(known.hint("merge"), ["project", "ref"], "left")
        per = whole.groupBy(*NODE).agg(F.sort_array(F.collect_list(F.struct("path", "in_array", "ref", "found_types"))).alias("references"))
        empty = F.array().cast(per.schema["references"].dataType)
        rows = docs.join(per, NODE, "left")
        return rows.select(*NODE, "ordering", F.lit("Success").alias("status"), "types", "deprecated", F.coalesce("references", empty).alias("references"))

    def _hit(self, changed: DataFrame, docs: DataFrame, batch_id: int) -> DataFrame | None:
        """Keys of documents that this batch doesn't hold and that show a type which it changes, kept as they're read twice."""
        m = self.documents.manifest()
        if m.schema is None or batch_id in m.deltas or batch_id <= m.folded:
            return None
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        hit = self.referrers.lookup(changed.select("project", F.col("id").alias("target"), parts)).select(*NODE).distinct()
        return hit.join(docs.select(*NODE), NODE, "left_anti").persist()

    def _refreshed(self, changed: DataFrame, hit: DataFrame) -> DataFrame:
        """Documents with the types that this batch changes; each has a reference, so none is lost with its references apart."""
        stale = self.documents.lookup(hit)
        rest = [c for c in stale.columns if c not in (*NODE, "references")]
        new = changed.select("project", F.col("id").alias("ref"), F.col("types").alias("new_types"))
        one = stale.select(*NODE, F.struct(*rest).alias("rest"), F.explode("references").alias("r")).select(*NODE, "rest", "r.*").join(new, ["project", "ref"], "left")
        one = one.withColumn("found_types", F.coalesce("new_types", "found_types"))
        per = one.groupBy(*NODE).agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("path", "in_array", "ref", "found_types"))).alias("references"))
        return per.select(*NODE, "rest.*", "references").select(*stale.columns)

    def read(self) -> DataFrame:
        """project, id, ordering, status, types, deprecated, references (path, in_array, ref, found_types)."""
        return self.documents.read()
