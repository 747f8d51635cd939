"""Importance resampling towards a target distribution, over hashed n-grams.

Every text is scored with an array of gains, one for each bucket: the logarithm of how much likelier the target's texts
are to use the bucket's n-grams than the documents are.  A seeded Gumbel term is added to a document's weight, so the
highest scores are a sample without replacement in proportion to exp(weight / 1000).  Exact ranks of the highest scores
come from parallel sorting by regular sampling:

1. each task of the scoring pass sorts its rows locally: a run, stored with every row's place in it;
2. rows at regular gaps of every run are the sample (its size is bounded), and regular places of the sorted sample are the splitters;
3. the splitters cut all runs into segments; segments that reach into what is drawn are exchanged and merged locally;
4. prefix counts of the segments, plus a row's number in its segment, are exact ranks.

Places make all keys distinct, so no segment is larger for ties, repeated rows or a document id that many rows share.

Defined cases: a null text is empty; documents without words have n_features and weight 0; a row with a null doc_id
counts in the statistics and has a null score and no rank; equal scores rank by doc_id, then n_features; a repeated row is
one document each time; without rows the result is empty; without target texts all gains follow from the documents alone;
columns other than doc_id and text are ignored, whatever their names; very long texts are read in pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, partitions, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Segments of what is drawn (and of the rest) at most, and sample rows for each of them: the driver gets 65,536 sample rows at most.
SEGMENTS, OVERSAMPLE = 1024, 64
#: monotonically_increasing_id() has the task above these bits and the row's place in it below.
PLACE_BITS = 33


def _words(text: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(text):
        cut = GAP.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield WORD.findall(text, start, end)
        start = end


def feature_buckets(text: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs of 1 to 3 words that end in them), piece by piece of a UTF-8 text.

    A checksum goes on from that of the run's words but the last, so each run costs its last word only.
    """
    last: list[list[int]] = [[], []]  # checksum of the last word, and of the last two
    for words in _words(text.lower()):  # bytes.lower() changes A-Z alone
        if not words:
            continue
        tails = [b" " + w for w in words]
        ones = list(map(crc32, words))
        before = last[0] + ones[:-1]
        twos = list(map(crc32, tails[len(words) - len(before) :], before))
        before = last[1] + twos[:-1] if twos else []
        threes = list(map(crc32, tails[len(words) - len(before) :], before))
        last = [ones[-1:], twos[-1:]]
        yield len(words), np.array(ones + twos + threes, dtype=np.int64) % buckets


def bucket_counts(rows: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; a task sends one row per bucket at most."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    bounded_batches(rows)
    parts = rows.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of add-one estimates) of each bucket, in doubles."""
    s_all, t_all, n = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                n = features = weight = 0
                for words, found in feature_buckets(text.as_py(), len(gain)):
                    n, features, weight = n + words, features + len(found), weight + int(gain[found].sum())
                out.append((n, features, weight))
            columns = zip(*out, strict=True) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _sorted_keys(score, doc_id, n_features, place) -> np.ndarray:
    """The order of the ranking: high scores, small ids, few features, place."""
    return np.lexsort((place, n_features, doc_id, -score))


KEYS = ["score", "doc_id", "n_features", "place"]


def _splitters(sample: dict[str, np.ndarray], drawn: float, gap: int, segments: int) -> dict[str, np.ndarray]:
    """Regular places of the sorted sample: so many in what is drawn (and a little more), and as many in the rest."""
    order = _sorted_keys(*(sample[k] for k in KEYS))
    inner = min(len(order), int(1.1 * drawn / gap) + OVERSAMPLE)
    places = np.unique(np.concatenate([np.linspace(0, inner, segments + 1)[1:], np.linspace(inner, len(order), segments + 1)[1:]]).astype(np.int64))
    at = order[places[places < len(order)]]
    return {k: sample[k][at] for k in KEYS}


def _in_segments(rows: DataFrame, splitters: dict[str, np.ndarray]) -> DataFrame:
    """Every ranked row's segment: the number of splitters at or before it; -1 for rows that aren't ranked."""
    n = len(splitters["place"])

    def run(batches):
        for batch in batches:
            own = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in KEYS if k not in ("doc_id", "score")}
            ranked = batch.column("ranked").to_numpy(zero_copy_only=False)
            own |= {k: batch.column(k).fill_null(0).to_numpy() for k in ("doc_id", "score")}
            merged = {k: np.concatenate([splitters[k], own[k]]) for k in KEYS}
            order = _sorted_keys(*(merged[k] for k in KEYS))
            before = np.empty(len(order), dtype=np.int32)
            before[order] = np.cumsum(order < n)
            segment = np.where(ranked, before[n:], -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", segment int")


def ranked_by_sampling(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """rows (score, doc_id, n_features, ranked, ...) with the exact rank of the share of ranked rows that comes first, null for others."""
    local = rows.sortWithinPartitions(F.desc("ranked"), F.desc("score"), "doc_id", "n_features")
    runs = stored(local.withColumn("place", F.monotonically_increasing_id()))
    some = runs.filter("ranked")
    n = some.count()
    drawn = share[0] * n // share[1]
    segments = min(SEGMENTS, partitions(rows.sparkSession))
    gap = max(1, math.ceil(n / (segments * OVERSAMPLE)))
    run, place = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    sample = some.filter((place + F.pmod(F.xxhash64(run), F.lit(gap))) % gap == 0).select(*KEYS).toArrow()
    cut = _in_segments(runs, _splitters({k: sample.column(k).to_numpy() for k in KEYS}, drawn, gap, segments))
    counts = sorted((r["segment"], r["count"]) for r in cut.filter("ranked").groupBy("segment").count().collect())
    offsets, total = [], 0
    for segment, count in counts:
        if total < drawn:
            offsets.append((segment, total))
        total += count
    last = offsets[-1][0] if offsets else -1
    before = rows.sparkSession.createDataFrame(offsets, "segment int, rows_before long")
    merge = Window.partitionBy("segment").orderBy(F.desc("score"), "doc_id", "n_features", "place")
    inner = cut.filter(f"ranked and segment <= {last}").withColumn("number", F.row_number().over(merge))
    # one row per segment that is exchanged: 2 * SEGMENTS rows at most
    inner = inner.join(F.broadcast(before), "segment").withColumn("rank", F.col("rows_before") + F.col("number"))
    inner = inner.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    outer = cut.filter(f"not ranked or segment > {last}").withColumn("rank", F.lit(None).cast("long"))
    return inner.select(*rows.columns, "rank").unionByName(outer.select(*rows.columns, "rank"))


def importance_resample(docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = (5, 100), min_words: int = 20, buckets: int = 10_000, seed: str = "42") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that aren't drawn.

    Of the documents with min_words words or more, share[0] / share[1] (rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = weigh(docs, gain).withColumn("score", F.col("weight") + noise)
    rows = rows.withColumn("ranked", (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    return ranked_by_sampling(rows, share).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all their columns and draw_rank; rows that share a doc_id come together, at the best rank of them."""
    drawn = importance_resample(docs, target, **settings).filter("rank is not null")
    best = drawn.groupBy("doc_id").agg(F.min("rank").alias("draw_rank"))
    return docs.join(best.withColumnRenamed("doc_id", "draw_key"), F.col("doc_id").cast("long") == F.col("draw_key")).drop("draw_key")
