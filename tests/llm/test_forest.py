"""Recall against all cosines, exact scores, and vectors that take no part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import forest

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id INT, v INT"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in vectors], SCHEMA)


def exact(vectors, query, k):
    v = {i: np.array(x, np.float32).astype(float) for i, x in vectors}
    q = v[query]
    score = {i: float(q @ x / np.sqrt((q @ q) * (x @ x))) for i, x in v.items() if i != query}
    return sorted(score.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]


@pytest.mark.parametrize("shard", [300, 16384])
def test_recall_and_scores(spark, shard):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 24))
    vectors = [(i, (centres[i % 6] * 0.6 + rng.standard_normal(24)).tolist()) for i in range(2000)]
    vectors += [(3000 + i, (np.ones(24) + 0.01 * rng.standard_normal(24)).tolist()) for i in range(700)]
    rows = forest.nearest(table(spark, vectors), F.col("vec_id") % 50 == 0, shard=shard, block=30).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.rank] = r
    found, total = 0, 0
    for query, ranks in got.items():
        want = exact(vectors, query, 5)
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        found += len({r.vec_id for r in ranks.values()} & {i for i, _ in want})
        total += 5
        near = dict(exact(vectors, query, 10**6))
        assert all(abs(r.score - near[r.vec_id]) < 1e-12 for r in ranks.values())
        assert [r.score for _, r in sorted(ranks.items())] == sorted((r.score for r in ranks.values()), reverse=True)
    assert len(got) == sum(i % 50 == 0 for i, _ in vectors) and found / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1, 0]), (1, [1, 1]), (2, [2, 0]), (3, [3, 0]), (50, [0, 1]), (100, None), (150, [0, 0]), (200, [nan, 1]), (7, [inf, 1]), (8, [None, 1]), (9, [1, 0, 0])]
    df = table(spark, vectors).union(table(spark, [(3, [3, 0])])).union(table(spark, []).select(F.lit(None).cast("bigint"), F.array(F.lit(1.0)), F.lit(0), F.lit(0), F.lit(0)))
    rows = sorted(map(tuple, forest.nearest(df, F.col("vec_id") % 50 == 0).collect()))
    # ties go to the smaller id, a repeated row is a candidate of its own
    assert [(q, r, i) for q, r, i, _ in rows] == [(0, 1, 2), (0, 2, 3), (0, 3, 3), (0, 4, 1), (0, 5, 50), (50, 1, 1), (50, 2, 0), (50, 3, 2), (50, 4, 3), (50, 5, 3)]
    assert rows[0][3] == 1.0
    assert forest.nearest(table(spark, vectors[5:9]), F.col("vec_id") % 50 == 0).count() == 0
    assert forest.nearest(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_many_equal_vectors(spark):
    vectors = [(i, [1.0, 2.0, 3.0]) for i in random.Random(1).sample(range(1000), 400)] + [(5000, [1.0, 2.0, 3.0])]
    rows = sorted(map(tuple, forest.nearest(table(spark, vectors), F.col("vec_id") == 5000, shard=64).collect()))
    assert [r[2] for r in rows] == sorted(i for i, _ in vectors)[:5]
