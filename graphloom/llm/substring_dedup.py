"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of paragraphs are compared.  Natural ones are lines of at least WIDTH words, and
runs of shorter lines without a blank or long line between them, as hard-wrapped text has.
As a repeated passage may stand inside longer lines, the others are windows
of WIDTH words that start at anchors: shingles that are the smallest of REACH
neighbours.  Anchors depend on the text around them alone, so two copies of
a passage of WIDTH + REACH - 1 words or more share a window wherever they stand.

1. Windows are joined by the hash of all their words (a band of every shingle), paragraphs by
   BANDS bands of ROWS min-hashes over their shingles of five words: at a similarity
   of 0.8 a pair meets in one of them with odds of 0.998.
2. Paragraphs that meet are verified by their exact Jaccard similarity: all pairs of a band's
   small group; in a larger one pairs with leaders first, then in blocks of bounded
   size those that aren't connected yet, so that no similar pair of a group stays apart.
3. Verified pairs, and windows that overlap in a document, make components, the clusters.
4. In each cluster the first document keeps its paragraphs; those of other
   documents are to be removed.  Overlapping paragraphs of a document become one span.

Defined cases: null and empty texts, and texts without a repeated paragraph, give no
row; what repeats within one document only isn't reported; rows with a null doc_id
take no part; repeated rows count as one document; ties go to the smallest doc_id; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, checkpointed, rows_in, rows_not_in, stored
from graphloom.llm.components import connected_components
from graphloom.llm.ngram_join import BLOCK, block_links, in_blocks
from graphloom.llm.shingles import chunks, mix, shingles_of, word_hashes

SHINGLE, WIDTH, REACH = 5, 32, 16
BANDS, ROWS = 9, 3
#: A group of a band of up to so many members gives all pairs; a larger one pairs with so many leaders first.
SMALL_GROUP, LEADERS = 16, 3

_RANDOM = np.random.default_rng(5)
_SEEDS = _RANDOM.integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, equal for equal runs."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(_STEP, len(hashes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_BACK, len(hashes) + 1)[starts] + (ends - starts).astype(np.uint64))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of width values; width a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        step *= 2
    return values


def anchors(shingles: np.ndarray) -> np.ndarray:
    """Places of shingles that are the smallest of some run of REACH."""
    low = _slide(shingles, REACH, np.minimum)
    if not len(low):
        return np.empty(0, dtype=np.int64)
    pad = np.zeros(REACH - 1, dtype=np.uint64)
    best = _slide(np.concatenate((pad, low, pad)), REACH, np.maximum)
    return np.flatnonzero(best == shingles)


def _words(column):
    """Per chunk: number of its first text and of texts, word hashes, each word's text, first word of each text, lines' first words and ends."""
    for first, last, data, breaks in chunks(column):
        # folding has turned line ends into spaces; they are found in the original bytes by the caller
        hashes, starts, _ = word_hashes(data, breaks)
        text = np.searchsorted(breaks, starts, side="right") - 1
        begins = np.searchsorted(starts, breaks)
        yield first, last, hashes, starts, text, begins, breaks


def _line_ends(column: pa.Array, first: int, last: int) -> np.ndarray:
    """Places of line feeds in the bytes of texts first to last."""
    body = b"".join((x.as_py() or "").encode("utf-8", "surrogatepass") for x in column[first:last])
    return np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 10)


def _lines(starts: np.ndarray, text: np.ndarray, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every line with words."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    line = np.searchsorted(feeds, starts)
    new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1]))))
    return new, np.concatenate((new[1:], [len(starts)]))


def _paragraph_ends(starts: np.ndarray, text: np.ndarray, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of lines of WIDTH words or more, and of runs of shorter lines that have as many together."""
    a, b = _lines(starts, text, feeds)
    if not len(a):
        return a, b
    line, long = np.searchsorted(feeds, starts[a]), b - a >= WIDTH
    new = np.flatnonzero(np.concatenate(([True], (text[a[1:]] != text[a[:-1]]) | (line[1:] - line[:-1] > 1) | long[1:] | long[:-1])))
    a, b = a[new], np.concatenate((a[new[1:]], [len(starts)]))
    return a[b - a >= WIDTH], b[b - a >= WIDTH]


def _windows(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, hashes, starts, text, begins, _ in _words(batch.column(1)):
            shingles, places = shingles_of(hashes, text, SHINGLE, last - first)
            at = places[anchors(shingles)]
            at = at[at + WIDTH <= begins[text[at] + 1]] if len(at) else at
            keys = span_hashes(hashes, at, at + WIDTH)
            own = text[at]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[first:last][own].astype(np.int64)), pa.array((at - begins[own]).astype(np.int32))], ["key", "doc_id", "start"])


def _paragraphs(batches):
    """doc_id, start, n_words, digest of all words, and bands of every natural paragraph."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, hashes, starts, text, begins, _ in _words(batch.column(1)):
            a, b = _paragraph_ends(starts, text, _line_ends(batch.column(1), first, last))
            if not len(a):
                continue
            shingles, places = shingles_of(hashes, text, SHINGLE, last - first)
            # reduceat over [lo, hi), [hi, next lo), ...: every other result is a paragraph's
            cuts = np.stack((np.searchsorted(places, a), np.searchsorted(places, b - SHINGLE + 1)), axis=1).ravel()
            shingles = np.concatenate((shingles, np.zeros(1, dtype=np.uint64)))
            bands = np.zeros((len(a), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i, seed in enumerate(_SEEDS):
                low = np.minimum.reduceat(mix(shingles * seed), cuts)[::2]
                bands[:, i // ROWS] = mix(bands[:, i // ROWS] * np.uint64(31) + low + np.uint64(i + 1))
            own = text[a]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][own].astype(np.int64)), pa.array((a - begins[own]).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(span_hashes(hashes, a, b).view(np.int64)), flat], ["doc_id", "start", "n_words", "digest", "bands"])


def _paragraph_sets(batches):
    """Shingle sets of the natural paragraphs: doc_id, start, n_words, shingles."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, hashes, starts, text, begins, _ in _words(batch.column(1)):
            a, b = _paragraph_ends(starts, text, _line_ends(batch.column(1), first, last))
            if not len(a):
                continue
            shingles, places = shingles_of(hashes, text, SHINGLE, last - first)
            sets = [np.unique(shingles[x:y]).tobytes() for x, y in zip(np.searchsorted(places, a), np.searchsorted(places, b - SHINGLE + 1), strict=True)]
            own = text[a]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][own].astype(np.int64)), pa.array((a - begins[own]).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(sets, pa.binary())], ["doc_id", "start", "n_words", "shingles"])


def _similar(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("seta").to_pylist(), batch.column("setb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def paragraph_links(docs: DataFrame, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """paragraphs (doc_id, start, n_words, digest), and links (a, b) between digests of those that are similar enough."""
    lines = stored(docs.mapInArrow(_paragraphs, "doc_id long, start int, n_words int, digest long, bands array<long>"))
    # equal paragraphs have equal bands; a band's number is mixed into its key
    met = lines.groupBy("digest").agg(F.first("bands").alias("bands")).select("digest", F.explode("bands").alias("key"))
    groups = met.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(met.join(groups, "key"))
    small = met.filter(F.col("members") <= SMALL_GROUP).select("key", "digest")
    all_pairs = small.withColumnRenamed("digest", "a").join(small.withColumnRenamed("digest", "b"), "key").filter("a < b").select("a", "b")
    large = met.filter(F.col("members") > SMALL_GROUP).select("key", "digest")
    leaders = stored(large.groupBy("key").agg(F.array(*(F.min(F.struct(F.xxhash64("digest", "key", F.lit(s)).alias("place"), F.col("digest").alias("digest"))) for s in range(LEADERS))).alias("leaders")))
    led = large.join(leaders, "key").select("digest", F.explode("leaders.digest").alias("leader")).filter("digest <> leader")
    pairs = stored(all_pairs.union(led.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b"))).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    where = stored(lines.join(ends, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("at")).select("digest", "at.*"))
    sets = stored(rows_in(docs, where, "doc_id").mapInArrow(_paragraph_sets, "doc_id long, start int, n_words int, shingles binary").join(where, ["doc_id", "start", "n_words"]).select("digest", "shingles").dropDuplicates(["digest"]))
    side = lambda x: sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"set{x}"))
    links = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "seta", "setb").mapInArrow(_similar(num, den), "a long, b long"))
    if leaders.limit(1).count():
        links = links.unionByName(stored(_group_links(large, links, sets, num, den)))
    return lines.drop("bands"), links


def _group_links(large: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is similar in large groups (key, digest) and isn't connected by links yet."""
    # paragraphs with the same smallest neighbour are surely connected
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("doc_id", "b")
    found = ends.groupBy("doc_id").agg(F.min("b").alias("low")).select("doc_id", F.least("doc_id", "low").alias("component"))
    sets = sets.select(F.col("digest").alias("doc_id"), "shingles")
    members = large.withColumnRenamed("digest", "doc_id").join(found, "doc_id", "left").join(sets.select("doc_id", (F.length("shingles") / 8).cast("long").alias("n")), "doc_id")
    members = checkpointed(members.select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"), F.lit(0).alias("cls"), F.lit(False).alias("visitor")))
    sizes = members.groupBy("key", "cls").agg(F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = checkpointed(sizes.filter("low < high").select("key", "cls", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    blocks = in_blocks(members, sizes, ["key", "cls"], sets, ["component"])
    return blocks.groupBy("key", "cls", "i", "j").applyInPandas(block_links(num, den), "a long, b long").distinct()


def _repeated(found: DataFrame, key: str) -> DataFrame:
    """Paragraphs whose key occurs in two documents or more, and whether theirs is the first."""
    ends = checkpointed(found.groupBy(key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(key, "low"))
    return found.join(ends, key).withColumn("kept", F.col("doc_id") == F.col("low")).drop("low")


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping paragraphs (doc_id, kept, start, end, cluster) as spans."""
    order = Window.partitionBy("doc_id", "kept").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return marked.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, cluster_id, kept of every span that repeats in another document."""
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    windows = docs.mapInArrow(_windows, "key long, doc_id long, start int")
    windows = _repeated(windows, "key").select("doc_id", "start", (F.col("start") + WIDTH).alias("end"), "key", "kept")
    lines, links = paragraph_links(docs)
    near = checkpointed(connected_components(links)).toDF("digest", "component")
    lines = lines.join(near, "digest", "left").withColumn("key", F.coalesce("component", "digest")).select("doc_id", "start", (F.col("start") + F.col("n_words")).alias("end"), "key")
    lines = _repeated(stored(lines), "key").select("doc_id", "start", "end", "key", "kept")
    found = stored(_merged(windows.unionByName(lines)))
    # a span's paragraphs belong together: each is linked with the span's smallest key
    spans = found.groupBy("doc_id", "kept", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("key").alias("low"))
    spans = stored(spans)
    edges = found.join(spans.select("doc_id", "kept", "span", "low"), ["doc_id", "kept", "span"]).select(F.col("key").alias("a"), F.col("low").alias("b"))
    clusters = checkpointed(connected_components(edges)).toDF("low", "cluster")
    out = spans.join(clusters, "low", "left")
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.coalesce("cluster", "low").alias("cluster_id"), "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of documents, with the words of spans to be removed cut out of text."""
    spans = stored(repeated_passages(docs).filter("not kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        word = re.compile(r"[^\x20\x09-\x0D]+")

        def one(t, own):
            if t is None or own is None:
                return t
            places = [m.span() for m in word.finditer(t)]
            out, at = [], 0
            for s in own:
                out.append(t[at : places[s["start_word"]][0]])
                at = places[s["end_word"] - 1][1]
            return "".join([*out, t[at:]])

        return text.combine(spans, one)

    touched = rows_in(docs, spans, "doc_id").join(spans.withColumnRenamed("spans", "__spans"), "doc_id")
    changed = touched.withColumn("text", cut("text", "__spans")).select(*docs.columns)
    return rows_not_in(docs, spans, "doc_id").unionByName(changed)
