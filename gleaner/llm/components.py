"""Connected components of a table of links, by alternating star contraction.

Each step is a grouped minimum and a join, so that nodes with very many links are
pre-aggregated and their joins can be split. Tables of few edges are kept in few
partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.sources.tables import written

EDGES = 250_000


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them and the node: all
    larger neighbours (large), or all smaller ones and the node itself (small)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    hung = (hung.filter(F.col("b") > F.col("a")) if large else hung).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung if large else hung.union(least.select("a", F.col("m").alias("b")))


def _edges(pairs: DataFrame, n: int) -> DataFrame:
    """Distinct edges from larger to smaller nodes, `n` at most, written."""
    pairs = pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return written(pairs.distinct().coalesce(1 + n // EDGES), "edges")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of `links` (a, b)."""
    edges, before = _edges(links, links.count()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        # every edge hangs one node on one other, so their number never grows much
        edges = _edges(_hung(_edges(_hung(edges, True), 2 * state[0]), False), 2 * state[0])
