"""An index of documents by key: a bucketed base table, open deltas, and a manifest that says which of them count.

A micro-batch becomes one delta, the last element per key; compaction folds the open deltas into the base and rewrites the
buckets that they touch, no others.  Reading costs the base plus the open deltas, however many batches there have been.

    <path>/manifest/000000000007.json   the state after the seventh commit; the newest counts
    <path>/delta/b000000000012/bucket=3  what batch 12 changed
    <path>/base/g000000000005/bucket=3   bucket 3 as the fifth commit wrote it

A commit is a new manifest under a name that must be free.  A batch that is tried again finds its number among the open
deltas or below what is folded, and changes nothing; what a writer left behind before it could commit is overwritten or never
read.  One writer at a time: a second one fails at its commit.

Defined cases: elements without a whole key change nothing; of elements of a key the one with the highest ordering counts,
later batches before earlier ones; Success stores, Dropped deletes, Failed changes nothing; an index without documents reads
as no rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from graphloom.sources import files

#: Names that the stored tables use beside the documents' columns.
OWN = ("bucket", "index_deleted", "index_batch", "index_order")


@dataclass(frozen=True)
class Manifest:
    """version, number of buckets, schema of the documents, generation of each bucket's base, open deltas, and the last batch that is folded."""

    version: int = 0
    buckets: int = 0
    schema: str | None = None
    base: dict[str, int] = field(default_factory=dict)
    deltas: list[int] = field(default_factory=list)
    folded: int = -1


class KeyedIndex:
    """buckets is fixed by the first commit's writer; choose it so that a bucket fits a task with room to spill."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = 64, bucket_by: list[str] | None = None):
        """bucket_by: the keys that decide about the bucket, all of them unless given."""
        self.spark, self.path, self.keys, self.buckets, self.bucket_by = spark, path.rstrip("/"), keys, buckets, bucket_by or keys

    # state

    def manifest(self) -> Manifest:
        found = [n for n in files.names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not found:
            return Manifest(buckets=self.buckets)
        m = Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/manifest/{found[-1]}")))
        if m.buckets != self.buckets:
            raise ValueError(f"{self.path} has {m.buckets} buckets")
        return m

    def _commit(self, m: Manifest) -> None:
        files.create_text(self.spark, f"{self.path}/manifest/{m.version:012d}.json", json.dumps(asdict(m)))

    def _delta(self, batch_id: int) -> str:
        return f"{self.path}/delta/b{batch_id:012d}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    # writing

    def write_batch(self, elements: DataFrame, batch_id: int, *, ordering: str = "ordering", unique: bool = False) -> bool:
        """One batch of elements (keys, ordering, status and the document's columns) as a delta; False if it counts already.

        Several batches at once are one delta under the last one's number; the column index_batch then tells which is later.
        unique: there is one element per key already.
        """
        m = self.manifest()
        if batch_id <= m.folded or batch_id in m.deltas:
            return False
        documents = [c for c in elements.columns if c not in OWN]
        schema = elements.select(*documents).schema
        rows = elements.filter("status <> 'Failed'").dropna(subset=self.keys).select(F.struct(*documents).alias("doc"), *self.keys, F.struct(*(c for c in elements.columns if c == "index_batch"), ordering, "status").alias("index_order"))
        last = rows if unique else rows.groupBy(*self.keys).agg(F.max_by("doc", "index_order").alias("doc"), F.max("index_order").alias("index_order"))
        stored = last.select("doc.*", (F.col("index_order.status") == "Dropped").alias("index_deleted"), self.bucket().alias("bucket"))
        stored.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._delta(batch_id))
        if files.names(self.spark, self._delta(batch_id)) == ["_SUCCESS"]:
            return False
        self._commit(Manifest(m.version + 1, m.buckets, m.schema or schema.json(), m.base, sorted([*m.deltas, batch_id]), m.folded))
        return True

    def compact(self, *, splits: int = 1) -> list[int]:
        """Fold the open deltas into the base; the buckets that were rewritten. splits: files of a bucket."""
        m = self.manifest()
        if not m.deltas:
            return []
        touched = sorted({int(n.removeprefix("bucket=")) for d in m.deltas for n in files.names(self.spark, self._delta(d)) if n.startswith("bucket=")})
        generation = m.version + 1
        folder = f"{self.path}/base/g{generation:012d}"
        rows = self._merged(m, touched)
        spread = rows.repartition("bucket", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(splits))) if splits > 1 else rows.repartition("bucket")
        spread.sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        left = {n.removeprefix("bucket=") for n in files.names(self.spark, folder) if n.startswith("bucket=")}
        base = {b: g for b, g in m.base.items() if int(b) not in touched} | {b: generation for b in left}
        self._commit(Manifest(generation, m.buckets, m.schema, base, [], max(m.deltas)))
        return touched

    def vacuum(self) -> None:
        """Delete what the newest manifest doesn't name: for times when nobody reads an older state."""
        m = self.manifest()
        live = {f"{self.path}/base/g{g:012d}/bucket={b}" for b, g in m.base.items()}
        for g in files.names(self.spark, f"{self.path}/base"):
            for n in files.names(self.spark, f"{self.path}/base/{g}"):
                if n.startswith("bucket=") and f"{self.path}/base/{g}/{n}" not in live:
                    files.delete(self.spark, f"{self.path}/base/{g}/{n}")
        for n in files.names(self.spark, f"{self.path}/delta"):
            if int(n.removeprefix("b")) not in m.deltas:
                files.delete(self.spark, f"{self.path}/delta/{n}")
        for n in files.names(self.spark, f"{self.path}/manifest"):
            if n < f"{m.version:012d}":
                files.delete(self.spark, f"{self.path}/manifest/{n}")

    # reading

    def _schema(self, m: Manifest) -> StructType:
        return StructType.fromJson(json.loads(m.schema)).add("index_deleted", "boolean")

    def _base(self, m: Manifest, buckets: list[int] | None) -> DataFrame:
        schema = self._schema(m).add("bucket", IntegerType())
        paths = [f"{self.path}/base/g{g:012d}/bucket={b}" for b, g in sorted(m.base.items()) if buckets is None or int(b) in buckets]
        rows = None
        if paths:
            # a generation is a level of folders above bucket=, so each path tells its bucket itself
            rows = self.spark.read.schema(self._schema(m)).parquet(*paths)
            rows = rows.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/[^/]*$", 1).cast("int"))
        return rows if rows is not None else self.spark.createDataFrame([], schema)

    def _deltas(self, m: Manifest, buckets: list[int] | None) -> DataFrame:
        """The newest change per key among the open deltas."""
        paths = [f"{self._delta(d)}/{n}" for d in m.deltas for n in files.names(self.spark, self._delta(d)) if n.startswith("bucket=") and (buckets is None or int(n.removeprefix("bucket=")) in buckets)]
        schema = self._schema(m)
        if not paths:
            return self.spark.createDataFrame([], schema.add("bucket", IntegerType()))
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn("at", F.col("_metadata.file_path"))
        whole = rows.select(*self.keys, F.struct(*schema.names).alias("doc"), F.regexp_extract("at", r"/delta/b(\d+)/", 1).cast("long").alias("index_batch"))
        # a delta holds a key once
        last = whole if len(m.deltas) == 1 else whole.groupBy(*self.keys).agg(F.max_by("doc", "index_batch").alias("doc"))
        return last.select("doc.*").withColumn("bucket", self.bucket())

    def _merged(self, m: Manifest, buckets: list[int] | None) -> DataFrame:
        changes = self._deltas(m, buckets)
        if not any(buckets is None or int(b) in buckets for b in m.base):
            return changes.filter("not index_deleted")  # the deltas are read once
        base = self._base(m, buckets)
        kept = base.join(changes.select("bucket", *self.keys), ["bucket", *self.keys], "left_anti")
        return kept.unionByName(changes.filter("not index_deleted"))

    def read(self, *, buckets: list[int] | None = None) -> DataFrame:
        """The documents of all buckets, or of some."""
        m = self.manifest()
        if m.schema is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        rows = self._merged(m, buckets) if m.deltas else self._base(m, buckets)
        return rows.drop("bucket", "index_deleted")

    def near(self, wanted: DataFrame) -> DataFrame:
        """The documents of the buckets of some keys: for joins that do without those that aren't wanted."""
        hit = sorted(r["bucket"] for r in wanted.select(self.bucket().alias("bucket")).distinct().collect())  # as many as buckets at most
        return self.read(buckets=hit)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The documents of some keys, or of what decides about buckets; opens their buckets only. wanted is computed twice."""
        on = [k for k in self.keys if k in wanted.columns]
        return self.near(wanted).join(wanted.select(*on), on, "left_semi")
