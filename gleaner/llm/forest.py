"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes vectors to long bit strings (the sides of random hyperplanes) and
keeps them as a sorted array, in which a prefix is a range. A query descends in
all trees to its longest matching prefixes, then all trees ascend together, a bit
at a time, until their ranges hold a `SHARE` of the rows each, on average; these rows are
compared exactly.

Rows are dealt by a hash of their ids to shards of about `SHARD` rows, and each
shard has a forest of its own; queries come in blocks of about `QUERIES`. One task
sees one shard and one block, whatever the vectors look like, so that a large
group of equal or close vectors is spread like any other. The best of all shards
are merged by rank. Candidates are a share of a shard, so that recall doesn't
depend on the number of rows; the work per query grows with it.

Rules: vectors that are null, zero or hold null or non-finite components take no
part. Vectors are compared with those of their own length. Rows with null ids take
no part; rows with equal ids are candidates of their own but never of a query with
that id. Fewer candidates than `k` give fewer rows. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TREES, BITS, SHARE, LEAST = 24, 32, 0.04, 64
SHARD, QUERIES = 16384, 2048


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5):
        planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits))
        self.bits, self.trees, self.planes = bits, trees, planes
        strings = self._strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """Trees x vectors, the bit strings as integers."""
        sides = (vectors @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        return (sides << np.arange(self.bits - 1, -1, -1, dtype=np.int64)).sum(axis=2).T

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows found by the time all trees hold `enough` entries."""
        strings = self._strings(queries)
        first = np.zeros((self.bits + 1, self.trees, len(queries)), np.int64)
        last = np.zeros_like(first)
        for depth in range(self.bits + 1):
            low = strings >> (self.bits - depth) << (self.bits - depth)
            for t in range(self.trees):
                first[depth, t] = np.searchsorted(self.sorted[t], low[t])
                last[depth, t] = np.searchsorted(self.sorted[t], low[t] + (1 << (self.bits - depth)))
        held = (last - first).sum(axis=1)
        depth = self.bits - np.argmax(held[::-1] >= min(enough, self.trees * self.sorted.shape[1]), axis=0)
        for q, d in enumerate(depth.tolist()):
            yield np.unique(np.concatenate([self.order[t, first[d, t, q] : last[d, t, q]] for t in range(self.trees)]))


def usable(vectors: Column) -> Column:
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.isNotNull() & finite & F.exists(vectors, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row that `queries` selects."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), values.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("length", F.size("v"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, parts = max(1, -(-n // shard)), max(1, -(-asking // block))
    to_all = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    spread = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    index = rows.select("id", "v", "length", spread(shards, 0).alias("shard")).withColumn("block", to_all(parts))
    asked = rows.filter("asks").select("id", "v", "length", spread(parts, 1).alias("block")).withColumn("shard", to_all(shards))

    def search(own: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and other.num_rows:
            x, q = _matrix(own["v"]), _matrix(other["v"])
            ids, asks = own["id"].to_numpy(), other["id"].to_numpy()
            norms = np.sqrt((x * x).sum(axis=1))
            forest = Forest(x / norms[:, None])
            units = q / np.sqrt((q * q).sum(axis=1))[:, None]
            enough = TREES * max(LEAST, int(share * len(ids)))
            for i, found in enumerate(forest.candidates(units, enough)):
                found = found[ids[found] != asks[i]]
                score = (x[found] * q[i]).sum(axis=1) / (norms[found] * np.sqrt((q[i] * q[i]).sum()))
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), asks[i]), ids[found][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    by = ["length", "shard", "block"]
    found = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
