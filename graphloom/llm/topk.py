"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions of the vectors are dealt to nodes; a node's list for a query holds the
partial scores of all candidates over its dimensions.

1. Every node gathers its k highest partial scores, and its lowest, for each query.
   What the nodes sent is scored exactly; the k-th highest score is a safe cutoff.
2. The cutoff, shared equally by the nodes above their lowest scores, is sent back.
   Each node collects all entries that reach its share and, with the highest scores of
   the other nodes, the cutoff: one list per query and block of candidates.  A candidate
   below its share everywhere can't reach the cutoff.
3. The lists of a block's nodes meet the block's vectors: scores that some node didn't
   send are resolved exactly, and a block gives its k best.

Queries and candidates meet in blocks: (query block, candidate block, node) is the
grouping key, so no task holds more than one block of each, and every block's size is
bounded.  Of candidates with one and the same vector, whose scores are equal, only the
k + 1 smallest ids can be in an answer, so others aren't sent.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null
vec_id take no part; nor do vectors whose squared length in whole numbers reaches 9.2e18, as
their scores may not fit into a long (all others' do, and are exact); repeated rows count once; of different vectors with one vec_id the
smallest (as an array) counts; vectors of another length than the query's are no candidates of it; a
query with fewer candidates than k gets them all; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: Rows of a block of candidates and of queries, and queries multiplied at once.
CANDIDATE_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 4096, 256
#: Squared lengths from here on are refused: by Cauchy and Schwarz, scores of shorter vectors are below 2**63.
MOST_SQUARED = 9.2e18


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as whole numbers; rows that take part only."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    squared = F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x.cast("double") * scale) + 1) * (F.abs(x.cast("double") * scale) + 1))
    rows = rows.filter(squared < MOST_SQUARED)
    rows = rows.select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series, wide: bool) -> np.ndarray:
    """Float64 holds products of whole numbers exactly below 2**53; beyond, sums of int64 are exact as they end below 2**63."""
    return np.array(column.tolist(), dtype=np.int64 if wide else np.float64).reshape(len(column), -1)


def _phase_one(k: int, wide: bool):
    schema = {"query_id": "int64", "node": "int32", "vec_id": "int64", "part": "int64", "lowest": "int64"}

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, all_rows = rows["vec_id"].to_numpy(), _matrix(rows["v"], wide).T
            for start in range(0, len(queries), AT_ONCE):
                some = queries.iloc[start : start + AT_ONCE]
                own = some["vec_id"].to_numpy()
                scores = (_matrix(some["v"], wide) @ all_rows).astype(np.int64)
                lowest = scores.min(axis=1)
                order = np.argsort(~scores, axis=1, kind="stable")[:, : k + 1]
                good = own[:, None] != ids[order]
                good &= np.cumsum(good, axis=1) <= k
                part = np.take_along_axis(scores, order, axis=1)
                n = good.sum(axis=1)
                out.append(pd.DataFrame({"query_id": np.repeat(own, n), "node": np.int32(key[2]), "vec_id": ids[order][good], "part": part[good], "lowest": np.repeat(lowest, n)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in schema}).astype(schema)

    return run


def _phase_two(wide: bool):
    """One row per query: what this node's block holds at its least score or above, and the query's slice."""

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, all_rows = rows["vec_id"].to_numpy(), _matrix(rows["v"], wide).T
            for start in range(0, len(queries), AT_ONCE):
                some = queries.iloc[start : start + AT_ONCE]
                scores = (_matrix(some["v"], wide) @ all_rows).astype(np.int64)
                reached = (scores >= some["least"].to_numpy()[:, None]) & (some["vec_id"].to_numpy()[:, None] != ids[None, :])
                out += [(int(key[0]), int(key[1]), int(key[3]), q, int(key[2]), v, least, cutoff, ids[x], s[x]) for q, v, least, cutoff, x, s in zip(some["vec_id"], some["v"], some["least"], some["cutoff"], reached, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_block", "block", "dims", "query_id", "node", "v", "least", "cutoff", "ids", "parts"])

    return run


def _phase_three(k: int, wide: bool):
    """Each query's k best of a block: parts that nodes sent are added up, the others resolved from the vectors."""

    def run(key, lists: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(lists) and len(rows):
            slices = {}
            for node, own in rows.groupby("node"):
                own = own.sort_values("vec_id", kind="stable")
                slices[node] = (own["vec_id"].to_numpy(), _matrix(own["v"], wide))
            for query, own in lists.groupby("query_id"):
                ids = np.unique(np.concatenate(own["ids"].tolist()))
                if not len(ids):
                    continue
                known = {n: (np.asarray(i), np.asarray(p)) for n, i, p in zip(own["node"], own["ids"], own["parts"], strict=True)}
                parts, open_ones = {}, {}
                most = np.zeros(len(ids), dtype=np.float64)
                for node, least in zip(own["node"], own["least"], strict=True):
                    part, open_one = np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
                    at = np.searchsorted(ids, known[node][0])
                    part[at], open_one[at] = known[node][1], False
                    parts[node], open_ones[node] = part, open_one
                    # a node not heard of has less than its least
                    most += np.where(open_one, float(least), part)
                may = most >= float(own["cutoff"].iat[0]) - 1e-6 * (1 + abs(float(own["cutoff"].iat[0])))
                score = np.zeros(len(ids), dtype=np.int64)
                for node, v in zip(own["node"], own["v"], strict=True):
                    names, vectors = slices[node]
                    todo = may & open_ones[node]
                    parts[node][todo] = (vectors[np.searchsorted(names, ids[todo])] @ np.asarray(v, dtype=vectors.dtype)).astype(np.int64)
                    score += parts[node]
                ids, score = ids[may], score[may]
                best = np.lexsort((ids, ~score))[:k]
                out.append(pd.DataFrame({"query_id": np.int64(query), "vec_id": ids[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def _slices(rows: DataFrame, nodes: int) -> DataFrame:
    """A row's vector cut into one slice per node."""
    step = F.ceil(F.size("v") / nodes).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda i: F.slice("v", i.cast("int") * step + 1, step))
    return rows.select("*", F.posexplode(cut).alias("node", "own")).drop("v").withColumnRenamed("own", "v").filter(F.size("v") > 0)


def exact_top_k(rows: DataFrame, is_query: Column, *, k: int = 5, nodes: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products; rows: vec_id, v."""
    rows = rows.filter(F.size("v") > 0).select("vec_id", "v", F.size("v").alias("dims"))
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    asked = stored(rows.filter("is_query").drop("is_query"))
    # equal vectors have equal scores: the first k are enough, and one more for a query among them
    rows = stored(rows.select("vec_id", "v", "dims", F.row_number().over(same).alias("copy")).filter(F.col("copy") <= k + 1).drop("copy"))
    size = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    n, peak, dims = rows.agg(F.count("*"), F.coalesce(size, F.lit(0)), F.coalesce(F.max("dims"), F.lit(0))).first()
    blocks = max(1, -(-n // CANDIDATE_BLOCK))
    n_asked, asked_peak = asked.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    wide = dims * peak * max(1, asked_peak) >= 1 << 53

    place = lambda number, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(number)).cast("int")
    candidates = _slices(rows, nodes).withColumn("block", place(blocks, 1)).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    candidates = candidates.select("query_block", "block", "node", "dims", "vec_id", "v").toDF("query_block", "block", "node", "dims", "vec_id", "v")
    slices = _slices(asked, nodes).withColumn("query_block", place(query_blocks, 2))
    keys = ["query_block", "block", "node", "dims"]

    def meet(queries: DataFrame, run, schema: str) -> DataFrame:
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return queries.toDF(*queries.columns).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(run, schema)

    # phase 1: each node's k best and its lowest score
    first = meet(slices, _phase_one(k, wide), "query_id long, node int, vec_id long, part long, lowest long")
    of_node = Window.partitionBy("query_id", "node")
    first = stored(first.withColumn("lowest", F.min("lowest").over(of_node)).withColumn("place", F.row_number().over(of_node.orderBy(F.desc("part"), "vec_id"))).filter(F.col("place") <= k))
    floors = first.groupBy("query_id", "node").agg(F.min("lowest").alias("lowest"), F.max("part").alias("highest"))
    sums = floors.groupBy("query_id").agg(F.sum(F.col("lowest").cast("decimal(38,0)")).alias("floor_sum"), F.sum(F.col("highest").cast("decimal(38,0)")).alias("high_sum"), F.count("*").alias("n_nodes"))
    # the exact scores of what the nodes sent: the k-th highest can't exceed the answer's k-th
    heard = first.select("query_id", "vec_id").distinct().join(rows.select("vec_id", "v"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    sure = heard.select("query_id", product.alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    cutoff = sums.join(sure.filter(F.col("place") == k).select("query_id", F.col("score").cast("decimal(38,0)").alias("cutoff")), "query_id", "left")
    # fewer than k candidates heard of: the cutoff is the lowest sum there is
    cutoff = cutoff.withColumn("cutoff", F.coalesce("cutoff", "floor_sum"))
    share = floors.join(cutoff, "query_id").select(
        F.col("query_id").alias("vec_id"),
        "node",
        F.greatest(F.col("lowest") + F.floor((F.col("cutoff") - F.col("floor_sum")) / F.col("n_nodes")), F.col("cutoff") - (F.col("high_sum") - F.col("highest"))).cast("long").alias("least"),
        F.col("cutoff").cast("double").alias("cutoff"),
    )

    # phase 2: all entries of a node that reach its least
    told = slices.join(stored(share), ["vec_id", "node"])
    lists = meet(told, _phase_two(wide), "query_block int, block int, dims int, query_id long, node int, v array<long>, least long, cutoff double, ids array<long>, parts array<long>")

    # phase 3: exact scores of what is left, block by block
    keys = ["query_block", "block", "dims"]
    scored = lists.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(_phase_three(k, wide), "query_id long, vec_id long, score long")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
