"""Mixing sources to target weights with DataFrame functions alone.

The tree is domain > language > source.  A budget of tokens goes down the tree by
weight; a child that can't use its share (its capacity is max_epochs times its
tokens) leaves the rest to its siblings, and only what a whole subtree can't
use reaches the siblings of its parent, as a parent's capacity is the sum
below it.  All shares are integers.

A leaf takes whole epochs, then a token-prefix of the next epoch's order, which
is the md5 of seed, epoch and doc_id.  Prefix sums go over 4,096 ranges of that
order first, so a leaf with a third of all rows is never sorted in one task;
only the range in which the prefix ends is summed row by row.

Defined cases: null lang, source or text count as empty strings; texts without
words have 0 tokens and are never chosen; rows with a null doc_id take no
part; rows of a leaf that share a doc_id stand or fall together; a leaf
without weight gets the default weight 1; an empty table gives an empty result;
other columns stay as they are: where one has the name of an added column, the added
one's name gets underscores at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

TOKENS = "[^\\x20\\x09-\\x0D]+"


def source_domain() -> Column:
    """Where no domain is given: one of four, by the number at the source's end."""
    return F.concat(F.lit("domain"), F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as long) % 4").cast("string"))


def _share(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Fill siblings to capacity in order of capacity / weight; the others share what is left by weight.

    In that order a child is filled exactly if capacity * open weight <= weight * open budget,
    both after the children before it.
    """
    big = "decimal(38,0)"
    before = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "node").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    step = nodes.withColumns(
        {
            "open_budget": (F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast("decimal(19,0)"),
            "open_weight": (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("decimal(19,0)"),
        }
    )
    full = (F.col("capacity").cast("decimal(19,0)") * F.col("open_weight")).cast(big) <= (F.col("weight").cast("decimal(19,0)") * F.col("open_budget")).cast(big)
    step = step.withColumn("full", F.min(F.when(full, 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col(budget) - F.sum(F.when(F.col("full") == 1, F.col("capacity")).otherwise(0)).over(whole)
    weight = F.sum(F.when(F.col("full") == 0, F.col("weight")).otherwise(0)).over(whole)
    step = step.withColumns({"left": left.cast("decimal(19,0)"), "left_weight": weight})
    part = F.expr("cast((cast(weight as decimal(19,0)) * left) div cast(left_weight as decimal(19,0)) as long)")
    return step.withColumn(out, F.when(F.col("full") == 1, F.col("capacity")).otherwise(part)).drop("open_budget", "open_weight", "full", "left", "left_weight")


def leaf_budgets(leaves: DataFrame, share: tuple[int, int]) -> DataFrame:
    """leaves: domain, lang, source, tokens, capacity, weights w_domain, w_lang, w_source; share: the budget's part of all tokens."""
    sums = lambda *keys: leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"), F.max(f"w_{keys[-1]}").alias("weight")).withColumn("node", F.col(keys[-1]))
    # a row per domain
    budget = F.expr(f"sum(tokens) over (partition by `all`) * {share[0]} div {share[1]}")
    top = _share(sums("domain").withColumn("all", F.lit(1)).withColumn("budget", budget), ["all"], "budget", "domain_budget").select("domain", "domain_budget")
    mid = _share(sums("domain", "lang").drop("tokens").join(top, "domain"), ["domain"], "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    low = leaves.withColumns({"weight": F.col("w_source"), "node": F.col("source")}).join(mid, ["domain", "lang"])
    return _share(low, ["domain", "lang"], "lang_budget", "leaf_budget").select("domain", "lang", "source", "tokens", "leaf_budget")


def mix(docs: DataFrame, *, share: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 7, domain: Column | None = None, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The rows that the mixture takes, with copies (how often) and leaf_budget.

    share: the budget as a fraction (numerator, denominator) of all tokens.
    weights: whole numbers by "domain", "lang" and "source"; 1 where none is given.
    """
    weights = weights or {}

    def weight(level: str) -> Column:
        given = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(int(v)))]
        return F.coalesce(F.create_map(*given)[F.col(level)], F.lit(1)).cast("long") if given else F.lit(1).cast("long")

    keys = {"mix_domain": domain if domain is not None else source_domain(), "mix_lang": F.col("lang"), "mix_source": F.col("source")}
    leaf = list(keys)
    # the document goes along as one column, so that its columns' names can't meet ours
    own = {k: F.coalesce(v, F.lit("")) for k, v in keys.items()} | {"mix_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long")}
    rows = docs.filter("doc_id is not null").select(F.struct(*docs.columns).alias("doc"), "doc_id", *(v.alias(k) for k, v in own.items())).filter("mix_tokens > 0")
    slim = stored(rows.drop("doc"))
    sums = stored(slim.groupBy(*leaf).agg(F.sum("mix_tokens").alias("tokens")).toDF("domain", "lang", "source", "tokens"))
    leaves = sums.withColumns({"capacity": F.col("tokens") * max_epochs} | {f"w_{x}": weight(x) for x in ("domain", "lang", "source")})
    plan = leaf_budgets(leaves, share).withColumns({"epochs": F.expr("leaf_budget div tokens"), "rest": F.expr("leaf_budget % tokens")})
    plan = stored(plan.select(*(F.col(x).alias(f"mix_{x}") for x in ("domain", "lang", "source")), "leaf_budget", "epochs", "rest"))

    # the order of a leaf's next epoch; its first 12 bits give a row's range
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))
    placed = slim.join(plan, leaf).withColumn("mix_order", order).withColumn("mix_range", F.conv(F.substring("mix_order", 1, 3), 16, 10).cast("int"))
    ranges = placed.groupBy(*leaf, "mix_range").agg(F.sum("mix_tokens").alias("range_tokens"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*leaf).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("tokens_before", F.sum("range_tokens").over(upto) - F.col("range_tokens"))
    last = stored(ranges.filter("tokens_before < rest and tokens_before + range_tokens >= rest").select(*leaf, "mix_range", "tokens_before"))
    edge = placed.join(last, [*leaf, "mix_range"]).groupBy(*leaf, "mix_order", "rest", "tokens_before").agg(F.sum("mix_tokens").alias("own"))
    upto = Window.partitionBy(*leaf).orderBy("mix_order").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("sum_before", F.col("tokens_before") + F.sum("own").over(upto) - F.col("own")).filter("sum_before < rest")
    cuts = edge.groupBy(*leaf).agg(F.max("mix_order").alias("cut"))
    plan = stored(plan.join(cuts, leaf, "left"))

    chosen = rows.join(plan, leaf).withColumn("mix_order", order)
    chosen = chosen.withColumn("copies", F.col("epochs") + F.when(F.col("mix_order") <= F.col("cut"), 1).otherwise(0)).filter("copies > 0")
    added = {}
    for name in (*leaf, "mix_tokens", "leaf_budget", "copies"):
        free = name
        while free in docs.columns:
            free += "_"
        added[name] = F.col(name).alias(free)
    return chosen.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), *added.values())
