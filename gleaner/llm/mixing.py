"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a tree: domain, then language, then source. A
token budget is handed down from the root. Each node shares its budget among its
children by integer weights; a child that can't use its share (its leaves hold
too few tokens, over all `epochs`) keeps what it can use, and the rest goes to
its siblings by their weights. As a node's own limit is what its usable leaves hold (a
leaf is usable if no weight on its path is 0 or less),
siblings are filled before anything is left to an ancestor's other children. The
shares are closed-form (a sort by tokens per weight and running sums), integers
rounded down, so that at most one token per child is lost.

Each leaf takes the longest prefix of its seeded order whose tokens stay within
its budget: all documents in the order of epoch 0, then all in that of epoch 1,
and so on. The order is by a digest of seed, epoch and id. Running sums are taken
in two steps, over slices of the digest and inside slices, so that no task sees a
whole leaf.

Rules: null domains, languages and sources are children named ''; a missing or
null weight is `default_weight`, weight 0 and below takes nothing; null texts have no
tokens. Documents with no tokens take no budget and are chosen with their
neighbours in the order. Rows with equal ids are ordered by their text's digest,
then are ties that are chosen or left together. Tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.sources.tables import written

LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHT = 100


def word_tokens(text: Column) -> Column:
    """Number of words, the token measure when no other is given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parents: list[str], budget: str, out: str) -> DataFrame:
    """Budget `out` of each row of `nodes` (capacity, weight, the parent's `budget`).

    With children in the order of capacity / weight, those up to some place are
    full, and the rest divide what remains by weight. A child is full if its
    capacity is no more than its share of what the fuller ones leave.
    """
    # capacity / weight is compared as a double, ties by name: children of equal ratio fill together
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("weight")), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = nodes.withColumns({
        "_left": F.greatest(F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0)).cast("decimal(38,0)"),
        "_weights": F.sum("weight").over(after).cast("decimal(20,0)"),
    })
    full = F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight")
    # fullness goes over to all earlier children: the first that isn't full fixes the rate
    rows = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_full", full)
    everyone = Window.partitionBy(*parents)
    rows = rows.withColumn("_first", F.min(F.when(~F.col("_full"), F.struct("_rank", "_left", "_weights"))).over(everyone))
    share = F.expr("cast((_first._left * weight) div _first._weights as bigint)")
    return rows.withColumn(out, F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("capacity")).otherwise(F.least("capacity", share))).drop("_left", "_weights", "_rank", "_full", "_first")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, total: int | Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget of every leaf. `leaves`: domain, lang,
    source, tokens. `weights`: level (name of a column), name, weight."""
    known = weights.select("level", F.coalesce("name", F.lit("")).alias("name"), F.col("weight").cast("long").alias("w"))
    known = known.groupBy("level", "name").agg(F.max("w").alias("w"))
    # a leaf whose own path has a weight of 0 or less takes nothing, and is no capacity of the nodes above
    for level in LEVELS:
        own = known.filter(F.col("level") == level).select(F.col("name").alias(level), F.col("w").alias(f"_w_{level}"))
        weight = F.coalesce(f"_w_{level}", F.lit(DEFAULT_WEIGHT))
        leaves = leaves.join(own, level, "left").withColumn(f"_w_{level}", weight).filter(F.col(f"_w_{level}") > 0)
    out, budget = None, F.lit(total) if isinstance(total, int) else total
    for depth, level in enumerate(LEVELS):
        parents, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("capacity"), F.first(f"_w_{level}").alias("weight"))
        nodes = nodes.withColumn("name", F.col(level)).filter("capacity > 0")
        if out is None:
            nodes = nodes.crossJoin(budget) if isinstance(budget, DataFrame) else nodes.withColumn("_budget", budget.cast("long"))
        else:
            nodes = nodes.join(out.select(*parents, F.col("budget").alias("_budget")), parents)
        out = share_out(nodes, parents, "_budget", "budget").drop("_budget")
    return out.select(*LEVELS, "capacity", "budget")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    domain: Column,
    share: float = 0.6,
    epochs: int = 1,
    seed: str = "mix",
    tokens: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    slices: int = 256,
) -> DataFrame:
    """_id, _sum, epoch, n_tokens, domain, lang, source of the chosen documents.

    The budget is `share` of all tokens. `slices`: parts of a leaf's order in
    which running sums are taken; a leaf's largest task has about its rows /
    slices, so it should grow with the largest leaf.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_sum"),
        named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"),
        (word_tokens(F.col(text)) if tokens is None else tokens).alias("n_tokens"),
    )
    rows = written(rows, "mix-rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budgets = written(leaf_budgets(leaves, weights, int(total * share), epochs).select(*LEVELS, "budget"), "mix-budgets")

    turns = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))
    turns = turns.join(F.broadcast(budgets), list(LEVELS)) if leaves.count() <= 100_000 else turns.join(budgets, list(LEVELS))
    turns = turns.withColumn("_digest", digest)
    slice_of = F.expr(f"cast(conv(substr(_digest, 1, 6), 16, 10) as bigint) * {slices} div 16777216")
    turns = turns.withColumn("_slice", slice_of)
    parts = turns.groupBy(*LEVELS, "epoch", "_slice").agg(F.sum("n_tokens").alias("_sum_of"))
    earlier = Window.partitionBy(*LEVELS).orderBy("epoch", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum_of").over(earlier), F.lit(0))).drop("_sum_of")
    turns = turns.join(parts, [*LEVELS, "epoch", "_slice"]).filter(F.col("_before") <= F.col("budget"))
    inside = Window.partitionBy(*LEVELS, "epoch", "_slice").orderBy("_digest", "_sum").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    return turns.filter(F.col("_upto") <= F.col("budget")).select("_id", "_sum", "epoch", "n_tokens", *LEVELS)
