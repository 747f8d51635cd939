"""N-gram Jaccard join by T-occurrence search over inverted lists.

Two documents are linked when their sets of word shingles overlap in at least
T shingles, T following from the threshold and both sizes.  As in DivideSkip,
the inverted lists are divided: short lists are merged, long ones are only
probed.  In numbers: if shingles are ordered with those of long lists last (the
others by hash), two linked documents share one of the first
n - ceil(threshold * n) + 1 shingles of either, so only these are indexed.

1. Equal sets are one class; its smallest doc_id stands for it.
2. Shingles with long lists are found by counting; the bounded set of the longest
   is broadcast and put last in every document's order.
3. Lists are merged by their shingle.  A list of up to SHORT_LIST members gives its
   pairs; a longer one (a group of near copies) gives pairs with a few leaders first.
4. Candidates are verified by binary probes of the sorted sets.  Sizes and parity bitmaps,
   which never exclude a true pair, go before each verification.
5. The members of a longer list that the leaders haven't connected meet list by list in
   blocks of bounded size, where only what isn't connected yet is compared, and links come
   out as a forest: however large a group, its links are no more than its members.
6. Links make components.  Links are counted where lists are long by comparing all members
   of one component, again in blocks, of which only the sums of each member come out.

Defined cases: null and empty texts have no shingles and are linked with nothing;
a text with fewer words than k is one shingle; rows with a null doc_id take no
part and aren't returned; repeated rows are each returned, in one component; of rows
that share a doc_id but not their sets the one with the smallest fingerprint stands for
the doc_id, the others are returned unlinked, and drop_near_copies drops no row of such
a doc_id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, checkpointed, rows_in, rows_not_in, stored
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import fold_bits, parity_bits, shingle_sets

#: A shingle in the prefix of more documents has a long list.
LONG_FROM = 16
#: The bound of the broadcast set of long lists' shingles (8 bytes each); others keep their place, which stays exact.
MOST_LONG = 200_000
#: Lists of up to so many members give all pairs.
SHORT_LIST = 64
#: Leaders of each longer list, and shingles of a block of documents.
LEADERS, BLOCK = 4, 500_000


def needed(n, num: int, den: int):
    """The overlap that a set of n needs with any linked set."""
    return -(-num * n // den)


def _ordered(own: np.ndarray, long_ones: np.ndarray | None) -> np.ndarray:
    if long_ones is None or not len(long_ones):
        return own
    place = np.searchsorted(long_ones, own)
    late = long_ones[np.minimum(place, len(long_ones) - 1)] == own
    return np.concatenate((own[~late], own[late]))


def _bitmap_size(n: int) -> int:
    """Bits of a set's parity bitmap: a power of two, at least twice its members."""
    return max(64, 1 << int(2 * n - 1).bit_length()) if n else 64


def _sets(docs: DataFrame, k: int, num: int, den: int, what: str, long_ones=None) -> DataFrame:
    """Per document: classes (size and fingerprint of its set), prefix (first shingles), marks (and bitmap) or whole sets."""

    def run(batches):
        late = long_ones.value if long_ones is not None else None
        for batch in batches:
            ids, rows = batch.column(0), []
            for own in shingle_sets(batch.column(1), k):
                n = len(own)
                prefix = _ordered(own, late)[: n - needed(n, num, den) + 1] if n else own
                if what == "classes":
                    rows.append((n, *_fingerprint(own)))
                elif what == "prefix":
                    rows.append((prefix.view(np.int64),))
                elif what == "marks":
                    rows.append((n, prefix.view(np.int64), parity_bits(own, _bitmap_size(n)).tobytes()))
                else:
                    rows.append((n, own.tobytes()))
            kinds = {"classes": (pa.int64(), pa.int64(), pa.int64()), "prefix": (pa.list_(pa.int64()),), "marks": (pa.int64(), pa.list_(pa.int64()), pa.binary()), "sets": (pa.int64(), pa.binary())}[what]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(str(i) for i in range(len(columns)))])

    schema = {"classes": "doc_id long, n long, f1 long, f2 long", "prefix": "doc_id long, prefix array<long>", "marks": "doc_id long, n long, prefix array<long>, bits binary", "sets": "doc_id long, n long, shingles binary"}[what]
    return docs.mapInArrow(lambda b: (pa.RecordBatch.from_arrays(x.columns, [f.split()[0] for f in schema.split(", ")]) for x in run(b)), schema)


def _fits(a, b, num: int, den: int):
    """Whether sizes alone allow a link."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _most_apart(n, m, num: int, den: int):
    """The largest symmetric difference of linked sets of n and m members."""
    return (n + m) - 2 * (-(-num * (n + m) // (num + den)))


def _bitmap_filter(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs whose parity bitmaps differ in more bits than linked sets can differ in members."""
    side = lambda x: marks.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb")), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
                size = min(len(x), len(y)) * 8
                keep.append(int(np.bitwise_count(fold_bits(x, size) ^ fold_bits(y, size)).sum()) <= _most_apart(n, m, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked: every shingle of the smaller set is looked up in the larger by binary search."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = _sets(rows_in(docs, ids, "doc_id"), k, num, den, "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set{x}"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("seta").to_pylist(), batch.column("setb").to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "seta", "setb").mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, sizes: DataFrame, keys: list[str], sets: DataFrame, more: list[str]) -> DataFrame:
    """Members (keys, doc_id, n, side, visitor, more) with their sets, once for each pair (i, j) of blocks that they are in."""
    dealt = members.join(sizes, keys).withColumn("side", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "doc_id")
    return dealt.select(*keys, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "visitor", "doc_id", "n", *more, "shingles")


def by_size(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members in classes (cls) by size: linked sets are in one class or in neighbouring ones, where the larger ones are visitors."""
    members = members.withColumn("cls", F.floor(F.log("n") / math.log(den / num * 1.001)).cast("int"))
    return members.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("visitor")).withColumn("cls", F.col("cls") - F.col("visitor").cast("int"))


def _bitmaps(sets: list[np.ndarray], most: int) -> np.ndarray:
    return np.stack([parity_bits(x, _bitmap_size(most)) for x in sets]).view(np.uint64)


def block_links(num: int, den: int):
    """Links within one block pair that connect what isn't connected yet: a forest, however many pairs are linked."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("n", kind="stable").reset_index(drop=True)
        n, doc, side, visitor = (members[c].to_numpy() for c in ("n", "doc_id", "side", "visitor"))
        label = np.unique(members["component"].to_numpy(), return_inverse=True)[1]
        within = members["i"].iat[0] == members["j"].iat[0]
        a, b = [], []
        sets = [np.frombuffer(x, dtype=np.uint64) for x in members["shingles"]]
        bits = _bitmaps(sets, int(n[-1]))
        for row in range(len(members) - 1):
            upto = int(np.searchsorted(n, n[row] * den // num, side="right"))
            open_ones = (label[row + 1 : upto] != label[row]) & ~(visitor[row + 1 : upto] & visitor[row])
            if not within:
                open_ones &= side[row + 1 : upto] != side[row]
            other = np.flatnonzero(open_ones) + row + 1
            if not len(other):
                continue
            apart = np.bitwise_count(bits[other] ^ bits[row]).sum(axis=1, dtype=np.int64)
            for o in other[apart <= _most_apart(n[row], n[other], num, den)].tolist():
                if label[o] != label[row]:
                    both = int((sets[o][np.minimum(np.searchsorted(sets[o], sets[row]), len(sets[o]) - 1)] == sets[row]).sum())
                    if den * both >= num * (int(n[row]) + int(n[o]) - both):
                        label[label == label[o]] = label[row]
                        a.append(min(doc[row], doc[o]))
                        b.append(max(doc[row], doc[o]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _block_counts(num: int, den: int):
    """For each member of one block pair the number of rows (copies) that it is linked with."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("n", kind="stable").reset_index(drop=True)
        n, side, visitor, copies = (members[c].to_numpy() for c in ("n", "side", "visitor", "copies"))
        within = members["i"].iat[0] == members["j"].iat[0]
        # each member's shingles as numbers, and the members that hold a number
        sets = [np.frombuffer(x, dtype=np.uint64) for x in members["shingles"]]
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum([len(x) for x in sets])
        holder = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[np.argsort(number, kind="stable")]
        begins = np.concatenate(([0], np.cumsum(np.bincount(number))))
        found = np.zeros(len(sets), dtype=np.int64)
        for row in range(len(sets) - 1):
            upto = int(np.searchsorted(n, n[row] * den // num, side="right"))
            if upto <= row + 1:
                continue
            own = number[ends[row] - len(sets[row]) : ends[row]]
            both = np.bincount(np.concatenate([holder[begins[t] : begins[t + 1]] for t in own]), minlength=len(sets))[row + 1 : upto]
            linked = (den * both >= num * (n[row] + n[row + 1 : upto] - both)) & ~(visitor[row + 1 : upto] & visitor[row])
            if not within:
                linked &= side[row + 1 : upto] != side[row]
            found[row] += int(copies[row + 1 : upto][linked].sum())
            found[row + 1 : upto][linked] += copies[row]
        return pd.DataFrame({"doc_id": members["doc_id"], "links": found})[found > 0]

    return run


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _one_row_each(docs: DataFrame, kinds: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with one row, and kinds with one set, for each doc_id; and the other rows of kinds, whose doc_id has a smaller fingerprint."""
    mark = F.struct("f1", "f2")
    odd_ids = kinds.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("rows")).filter("low <> high or rows > 1")
    odd_ids = stored(odd_ids.select("doc_id", F.col("low.f1").alias("f1"), F.col("low.f2").alias("f2")))
    if odd_ids.limit(1).count() == 0:
        return docs, kinds, kinds.limit(0)

    def run(batches):
        for batch in batches:
            marks = [_fingerprint(own) for own in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in marks], pa.int64()) for i in range(2))], ["doc_id", "text", "f1", "f2"])

    keys = ["doc_id", "f1", "f2"]
    own = rows_in(docs, odd_ids, "doc_id").mapInArrow(run, "doc_id long, text string, f1 long, f2 long").join(odd_ids, keys, "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    odd = stored(rows_in(kinds, odd_ids, "doc_id"))
    same = rows_not_in(kinds, odd_ids, "doc_id").unionByName(odd.join(odd_ids, keys, "left_semi"))
    return rows_not_in(docs, odd_ids, "doc_id").unionByName(stored(own)), stored(same), stored(odd.join(odd_ids, keys, "left_anti"))


def ngram_links(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100, counts: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """classes (doc_id, n, rep, copies), links (a, b) between representatives, counts, and rows left out.

    The links connect all that is linked: within a large group of near copies not
    every linked pair is listed, but every linked pair is connected.  counts (doc_id,
    links): with how many rows of other sets a representative is linked, over all linked pairs.
    Rows left out (doc_id, n) are those whose doc_id another set stands for.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    kinds = stored(_sets(docs, k, num, den, "classes"))
    docs, kinds, others = _one_row_each(docs, kinds, k)
    groups = stored(kinds.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"))
    classes = stored(kinds.join(groups, ["f1", "f2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")))
    reps = rows_not_in(docs, classes.filter("doc_id <> rep or n = 0").select("doc_id"), "doc_id")

    counted = _sets(docs, k, num, den, "prefix").select(F.explode("prefix").alias("shingle")).groupBy("shingle").count()
    long_ones = [r[0] for r in counted.filter(F.col("count") > LONG_FROM).orderBy(F.desc("count"), "shingle").limit(MOST_LONG).select("shingle").collect()]
    late = spark.sparkContext.broadcast(np.sort(np.array(long_ones, dtype=np.int64).view(np.uint64)))

    marks = stored(_sets(reps, k, num, den, "marks", late))
    lead = [F.min(F.struct(F.xxhash64("doc_id", F.lit(s)).alias("place"), F.col("doc_id").alias("id"), F.col("n").alias("n"))) for s in range(LEADERS)]
    places = marks.select("doc_id", "n", F.explode("prefix").alias("shingle"))
    lists = stored(places.groupBy("shingle").agg(F.count("*").alias("members"), F.array(*lead).alias("leaders")).filter("members > 1").withColumn("leaders", F.when(F.col("members") > SHORT_LIST, F.col("leaders"))))
    lists = stored(places.join(lists, "shingle"))

    short = lists.filter(F.col("members") <= SHORT_LIST).select("shingle", "doc_id", "n")
    left, right = short.toDF("shingle", "a", "na"), short.toDF("shingle", "b", "nb")
    pairs = left.join(right, "shingle").filter("a < b").filter(_fits(F.col("na"), F.col("nb"), num, den)).select("a", "b")
    longer = lists.filter(F.col("members") > SHORT_LIST)
    led = longer.select("doc_id", "n", F.explode("leaders").alias("leader")).filter("doc_id <> leader.id").filter(_fits(F.col("n"), F.col("leader.n"), num, den))
    led = led.select(F.least("doc_id", "leader.id").alias("a"), F.greatest("doc_id", "leader.id").alias("b"))
    links = stored(_verified(stored(_bitmap_filter(pairs.union(led).distinct(), marks, num, den)), docs, k, num, den))
    weights = classes.filter("doc_id = rep and n > 0").select("doc_id", "n", "copies").dropDuplicates(["doc_id"])
    some_longer = longer.limit(1).count() > 0
    if some_longer:
        # members of a list that the leaders haven't connected
        found = checkpointed(connected_components(links)).toDF("doc_id", "component")
        members = by_size(longer.select("shingle", "doc_id", "n").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), num, den)
        members = checkpointed(members)
        sizes = members.groupBy("shingle", "cls").agg(F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        sizes = checkpointed(sizes.filter("low < high").select("shingle", "cls", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        wanted = stored(members.join(sizes, ["shingle", "cls"], "left_semi").select("doc_id").distinct())
        sets = _sets(rows_in(docs, wanted, "doc_id"), k, num, den, "sets").select("doc_id", "shingles")
        blocks = in_blocks(members, sizes, ["shingle", "cls"], sets, ["component"])
        more = blocks.groupBy("shingle", "cls", "i", "j").applyInPandas(block_links(num, den), "a long, b long").distinct()
        links = stored(links.unionByName(more))
    if not counts:
        return classes, links, None, others

    if not some_longer:
        return classes, links, _pair_counts(links, weights), others
    # where lists are long, links are a forest: all pairs of such a component are counted, in blocks
    found = checkpointed(connected_components(links)).toDF("doc_id", "component")
    crowded = stored(found.join(longer.select("doc_id").distinct(), "doc_id", "left_semi").select("component").distinct())
    found = found.join(crowded, "component", "left_semi")
    members = checkpointed(by_size(found.join(weights, "doc_id"), num, den))
    sizes = checkpointed(members.groupBy("component", "cls").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")))
    sets = _sets(rows_in(docs, found, "doc_id"), k, num, den, "sets").select("doc_id", "shingles")
    blocks = in_blocks(members, sizes, ["component", "cls"], sets, ["copies"])
    inside = blocks.groupBy("component", "cls", "i", "j").applyInPandas(_block_counts(num, den), "doc_id long, links long")
    sparse = links.join(found.select(F.col("doc_id").alias("a")), "a", "left_anti")
    return classes, links, inside.unionByName(_pair_counts(sparse, weights)).groupBy("doc_id").agg(F.sum("links").alias("links")), others


def _pair_counts(links: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id and links: the rows that stand behind the other ends of a document's links."""
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("own", "doc_id")
    return ends.join(weights, "doc_id").groupBy("own").agg(F.sum("copies").alias("links")).toDF("doc_id", "links")


def ngram_join(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (of equal sets) and n_links (linked rows, copies too) of every row."""
    classes, links, counts, others = ngram_links(docs, k=k, num=num, den=den)
    found = checkpointed(connected_components(links))
    out = classes.join(found.toDF("rep", "component"), "rep", "left").join(stored(counts).withColumnRenamed("doc_id", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return out.unionByName(others.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near_copies(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The documents of which the smallest doc_id of each component stays, with all columns; null doc_ids stay."""
    classes, links, _, others = ngram_links(docs, k=k, num=num, den=den, counts=False)
    found = checkpointed(connected_components(links)).toDF("rep", "component")
    dropped = classes.join(found, "rep", "left").filter(F.col("doc_id") != F.coalesce("component", "rep")).select("doc_id")
    return rows_not_in(docs, stored(dropped.join(others.select("doc_id").distinct(), "doc_id", "left_anti")), "doc_id")
