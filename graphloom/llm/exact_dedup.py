"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each input partition hashes its normalised texts, sorts the distinct
   fingerprints and sends them, Rice-coded, to the owners of their ranges.
2. An owner decodes the lists, finds fingerprints that occur twice, and returns
   a bitmap for every list.
3. Only texts behind a set bit, the suspects, are shuffled; they are grouped by
   their bytes, so a fingerprint collision can't merge different texts.

Defined cases: null text counts as empty; rows with a null doc_id take no part
and aren't returned; of repeated rows with one doc_id and equal texts each is
returned and counted, and one is kept; rows with one doc_id and different texts are
rows of their own groups, and none is lost; an empty table gives an empty result;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, partitions, rows_in, rows_not_in, stored

WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a fingerprint beyond log2 of the number of rows: about one text in 2**12 is suspected falsely.
SPARE_BITS = 12
#: Fingerprints that an owner holds at once, about: the number of owners grows with the rows.
OWNED = 1 << 20


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers as gaps: quotients in unary, then remainders of k bits each."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(math.log2(max(1.0, float(values[-1]) / len(values)))))
    ones = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(ones.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(ones + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(gaps), len(unary), k], dtype=np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    n, length, k = np.frombuffer(blob, dtype=np.int64, count=3)
    body = np.frombuffer(blob, dtype=np.uint8, offset=24)
    cut = -(-int(length) // 8)
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=int(length)) == 0)
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(body[cut:], count=int(n * k)).reshape(int(n), int(k)).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def _fingerprints(bits: int, owners: int):
    """Rows of documents (list is null) and, for each owner, one coded list."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("mapper", pa.int64()), ("owner", pa.int32()), ("place", pa.int32()), ("list", pa.binary()), ("twice", pa.binary())])
    width = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = TaskContext.get().partitionId()
        ids, lengths, digests, marks = [], [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            for text in batch.column(1):
                text = text.as_py()
                digest = hashlib.sha256(normalised(text)).digest()
                lengths.append(len(text or ""))
                digests.append(digest.hex())
                marks.append(int.from_bytes(digest[:8], "little") >> (64 - bits))
        if not digests:
            return
        prints, inverse, counts = np.unique(np.array(marks, dtype=np.uint64), return_inverse=True, return_counts=True)
        owner = (prints // np.uint64(width)).astype(np.int32)
        starts = np.searchsorted(owner, np.arange(owners + 1))
        place = (np.arange(len(prints)) - starts[owner]).astype(np.int32)
        n = len(digests)
        columns = [pa.array(np.concatenate(ids)), pa.array(lengths, pa.int64()), pa.array(digests), pa.array(np.full(n, mapper)), pa.array(owner[inverse]), pa.array(place[inverse]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)
        for o in np.unique(owner):
            own = slice(starts[o], starts[o + 1])
            row = {"mapper": [mapper], "owner": [int(o)], "list": [rice_encode(prints[own] - np.uint64(int(o) * width))], "twice": [np.packbits(counts[own] > 1).tobytes()]}
            yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) if f.name in row else pa.nulls(1, f.type) for f in schema], schema=schema)

    return run, "doc_id long, n_chars long, text_sha256 string, mapper long, owner int, place int, list binary, twice binary"


def _answer(lists: pa.Table) -> pa.Table:
    """An owner's answer: for each list the bitmap of fingerprints that occur twice in all."""
    decoded = [rice_decode(x.as_py()) for x in lists["list"]]
    _, inverse, counts = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(x) for x in decoded])
    bitmaps = []
    for twice, end, own in zip(lists["twice"], ends, decoded, strict=True):
        local = np.unpackbits(np.frombuffer(twice.as_py(), dtype=np.uint8), count=len(own)).astype(bool)
        bitmaps.append(np.packbits(local | (counts[inverse[end - len(own) : end]] > 1)).tobytes())
    return pa.table({"mapper": lists["mapper"], "owner": lists["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars (code points) of every row of documents.

    Texts are equal when identical without white space; of equal texts the row
    with most code points, then the smallest doc_id, stays.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    n = docs.count()
    owners = max(partitions(spark), -(-n // OWNED))
    bits = min(60, max(16, math.ceil(math.log2(n + 1)) + SPARE_BITS))
    run, schema = _fingerprints(bits, owners)
    sent = stored(docs.mapInArrow(run, schema))
    prints = sent.filter("list is null").drop("list", "twice")
    answers = sent.filter("list is not null").select("mapper", "owner", "list", "twice").groupBy("owner").applyInArrow(_answer, "mapper long, owner int, bitmap binary")
    bit = F.expr("shiftright(cast(conv(hex(substring(bitmap, cast(place div 8 as int) + 1, 1)), 16, 10) as int), 7 - place % 8) & 1")
    suspects = stored(prints.join(answers, ["mapper", "owner"]).filter(bit == 1).select("doc_id"))

    texts = rows_in(docs, suspects, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # most code points, then the smallest id, as one number, which hash aggregation can hold
    rank = F.expr("cast(length(text) as decimal(10,0)) * cast(18446744073709551616 as decimal(20,0)) + (cast(9223372036854775807 as decimal(19,0)) - doc_id)")
    groups = (
        texts.select(F.translate("text", " \t\n\x0b\x0c\r", "").alias("bytes"), rank.alias("rank"))
        .groupBy("bytes")
        .agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
        .filter("group_size > 1")
        .select(F.sha2("bytes", 256).alias("text_sha256"), "group_size", F.expr("cast(cast(9223372036854775807 as decimal(19,0)) - rank % cast(18446744073709551616 as decimal(20,0)) as long)").alias("keep_id"))
    )
    out = prints.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        "n_chars",
    )
    # of repeated rows the first is kept; by doc_id alone, as a text's copies may be a third of all rows
    same = F.lag("text_sha256").over(Window.partitionBy("doc_id").orderBy("text_sha256", F.desc("n_chars")))
    return out.withColumn("kept", (F.col("doc_id") == F.col("keep_id")) & ~same.eqNullSafe(F.col("text_sha256"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Rows with a null doc_id stay as they are.

    A row is told by its doc_id and its text without white space, so rows that share a doc_id
    but not their texts don't touch each other; of equal rows one stays.
    """
    found = exact_dedup(docs).filter("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max("n_chars").alias("most"), F.max("kept").alias("kept"))
    found = stored(found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"), F.col("most").alias("__most"), F.col("kept").alias("__kept")))
    ids = found.select(F.col("__id").alias("doc_id"))
    text = F.coalesce("text", F.lit(""))
    touched = rows_in(docs, ids, "doc_id").withColumns({"__digest_of": F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256), "__length": F.length(text)})
    touched = touched.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("__digest_of") == F.col("__digest")), "left")
    alone = touched.filter("__id is null").select(*docs.columns)
    kept = touched.filter("__kept and __length = __most").dropDuplicates(["__id", "__digest"]).select(*docs.columns)
    return rows_not_in(docs, ids, "doc_id").unionByName(alone).unionByName(kept)
