"""A stored inverted index over several fields, and the k best documents of a query without reading all postings.

Documents are dealt to ranges of similar length, so many documents each.  A block holds a term's postings in one range of a
field, with the greatest impact (the part of BM25 that depends on the document) of any of them.  A search

1. adds up, for each range, the blocks' greatest impacts times the terms' weights: no document there can score more;
   this reads one number per block, no postings;
2. scores the most promising ranges exactly; the k-th best score found is the threshold;
3. scores the ranges that may reach the threshold, and no others.

Files are sorted by field and term, so a term's blocks are found by the files' statistics.  Statistics of the fields and the
document frequencies of a query's words are what the driver sees.

Defined cases: a null field is empty; documents without any of the words aren't returned; equal scores (to six decimals) rank by
key; fewer matching documents than k are all returned.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.listing import K1, TOKEN, B
from graphloom.sources import files

#: Documents of a range, buckets of terms, ranges in a shard of a bucket, and ranges that are scored first.
RANGE, BUCKETS, RANGES, FIRST = 256, 16, 4096, 4


@dataclass(frozen=True)
class Field:
    """text: words; iri: the parts of a path, without the scheme. boost multiplies the field's score."""

    name: str
    kind: str = "text"
    boost: float = 1.0

    def words(self) -> Column:
        text = F.lower(F.coalesce(F.col(self.name).cast("string"), F.lit("")))
        parts = F.split(text, TOKEN) if self.kind == "text" else F.split(F.regexp_replace(text, "^[a-z][a-z0-9+.-]*://", ""), "[/#?&=:]+")
        return F.filter(parts, lambda x: x != "")


def _term_counts(rows: DataFrame, words: str) -> DataFrame:
    """key, doc_range, length, term, tf of each distinct word, within the row: words is a sorted array, where equal ones are a run."""
    size, word = F.size(words), lambda i: F.get(F.col(words), i)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(places, lambda i: (i == size - 1) | (word(i) != word(i + 1)))
    counts = F.transform("ends", lambda end, i: F.struct(word(end).alias("term"), (end - F.coalesce(F.get(F.col("ends"), i - 1), F.lit(-1))).alias("tf")))
    # outer: else the array would be made once more, to see whether it's empty
    each = rows.withColumn("ends", ends).select("key", "doc_range", size.alias("length"), F.explode_outer(counts).alias("t"))
    return each.filter("t is not null").select("key", "doc_range", "length", "t.*")


def build_index(rows: DataFrame, fields: list[Field], path: str, *, key: str = "doc_id", docs_per_range: int = RANGE) -> None:
    """Write postings, document frequencies and statistics; rows have one row per key."""
    spark = rows.sparkSession
    words = rows.select(F.col(key).alias("key"), *(f.words().alias(f"words_{i}") for i, f in enumerate(fields)))
    lengths = [F.size(f"words_{i}") for i in range(len(fields))]
    stats = words.agg(F.count("*").alias("n"), *(F.avg(n).alias(f"mean_{i}") for i, n in enumerate(lengths)), F.percentile_approx(sum(lengths[1:], lengths[0]), [i / 64 for i in range(1, 64)]).alias("cuts")).first()
    n = stats["n"]
    cuts = sorted(set(stats["cuts"] or []))
    each = max(1, math.ceil(n / ((len(cuts) + 1) * docs_per_range)))
    level = F.size(F.filter(F.lit(cuts or [0]), lambda c: c < sum(lengths[1:], lengths[0])))
    placed = words.withColumn("doc_range", level * each + F.pmod(F.xxhash64("key"), F.lit(each)).cast("int"))
    placed = placed.withColumns({f"words_{i}": F.sort_array(f"words_{i}") for i in range(len(fields))})
    tf = None
    for i, f in enumerate(fields):
        one = _term_counts(placed, f"words_{i}").select("key", "doc_range", F.lit(f.name).alias("field"), "length", F.lit(stats[f"mean_{i}"] or 1.0).alias("mean"), "term", "tf")
        tf = one if tf is None else tf.unionByName(one)
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # shards by range, so that a word of most documents isn't in one task
    shards = max(1, (len(cuts) + 1) * each // RANGES)
    bucket = F.pmod(F.xxhash64("field", "term"), F.lit(BUCKETS)).alias("bucket")
    postings = tf.select(bucket, F.pmod("doc_range", F.lit(shards)).alias("shard"), "field", "term", "doc_range", "key", impact.alias("impact"))
    # the only shuffle: postings are dealt as the files are, and put together where they are
    dealt = postings.repartition("bucket", "shard").groupBy("bucket", "shard", "field", "term", "doc_range")
    blocks = dealt.agg(F.max("impact").alias("max_impact"), F.count("*").alias("df"), F.collect_list(F.struct("key", "impact")).alias("postings"))
    blocks.sortWithinPartitions("bucket", "field", "term", "doc_range").drop("shard").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("field", "term").agg(F.sum("df").alias("df")).sort("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
    files.create_text(spark, f"{path}/statistics.json", json.dumps({"n": n, "key": key, "fields": [[f.name, f.kind, f.boost] for f in fields]}))


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(files.read_text(spark, f"{path}/statistics.json"))
        self.n, self.key, self.fields = about["n"], about["key"], [Field(*f) for f in about["fields"]]

    def blocks(self, query: str) -> DataFrame:
        """The blocks of a query's words, with the weight of each: idf times boost."""
        wanted = sorted({w for w in query.lower().split() if w})
        df = self.spark.read.parquet(f"{self.path}/terms").filter(F.col("term").isin(wanted)).collect()  # words times fields at most
        boost = {f.name: f.boost for f in self.fields}
        weights = [(r["field"], r["term"], boost[r["field"]] * math.log(1 + (self.n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in df]
        rows = self.spark.read.parquet(f"{self.path}/blocks")
        if not weights:
            return rows.limit(0).withColumn("weight", F.lit(0.0))
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(BUCKETS))
        hit = {r[0] for r in self.spark.createDataFrame(weights, "field string, term string, weight double").select(bucket).collect()}
        weight = F.lit(None).cast("double")
        for field, term, w in weights:
            weight = F.when((F.col("field") == field) & (F.col("term") == term), w).otherwise(weight)
        return rows.filter(F.col("bucket").isin(*hit) & F.col("term").isin(*{t for _, t, _ in weights})).withColumn("weight", weight)

    @staticmethod
    def _scored(blocks: DataFrame) -> DataFrame:
        each = blocks.select("weight", F.explode("postings").alias("p"))
        return each.groupBy(F.col("p.key").alias("key")).agg(F.round(F.sum(F.col("weight") * F.col("p.impact")), 6).alias("score"), F.count("*").alias("n_words"))

    def scores(self, query: str) -> DataFrame:
        """key, score, n_words of all documents with any of the words."""
        return self._scored(self.blocks(query)).withColumnRenamed("key", self.key)

    def bounds(self, query: str) -> DataFrame:
        """doc_range, bound: what no document of the range can surpass."""
        return self.blocks(query).groupBy("doc_range").agg(F.sum(F.col("weight") * F.col("max_impact")).alias("bound"))

    def top(self, query: str, k: int) -> DataFrame:
        """key, score, n_words of the k best documents."""
        blocks, bounds = self.blocks(query), self.bounds(query)
        best = lambda rows: rows.orderBy(F.desc("score"), "key").limit(k)
        first = bounds.orderBy(F.desc("bound"), "doc_range").limit(FIRST).select("doc_range")
        found = best(self._scored(blocks.join(F.broadcast(first), "doc_range", "left_semi"))).collect()
        least = found[-1]["score"] - 1e-6 if len(found) == k else 0.0
        self.threshold = least
        near = bounds.filter(F.col("bound") >= least).select("doc_range")
        return best(self._scored(blocks.join(near, "doc_range", "left_semi"))).withColumnRenamed("key", self.key)
