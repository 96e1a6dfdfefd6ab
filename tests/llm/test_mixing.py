"""Budgets against filling step by step; the SQL twin is held against the sample tables."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing

WEIGHTS = [("domain", "a", 3), ("domain", "b", 1), ("lang", "x", 2), ("lang", "y", 1), ("source", "s0", 5), ("source", "off", 0)]


def slow_share(budget, children):
    """children: name -> (capacity, weight); whole tokens, rest lost."""
    out, open_ = {}, {k: v for k, v in children.items() if v[1] > 0 and v[0] > 0}
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * total <= budget * w]
        if not full:
            return out | {k: min(c, budget * w // total) for k, (c, w) in open_.items()}
        least = min(full, key=lambda k: open_[k][0] / open_[k][1])
        out[least] = open_.pop(least)[0]
        budget -= out[least]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, g, s, rng.choice([0, 1, 7, 50, 400, 3000])) for d in "abc" for g in "xyz" for s in ("s0", "s1", "off") if rng.random() < 0.8]
    total = sum(t for *_, t in leaves) * rng.choice([1, 5, 9]) // 10
    weight = {(lv, n): w for lv, n, w in WEIGHTS}
    got = mixing.leaf_budgets(
        spark.createDataFrame(leaves, "domain STRING, lang STRING, source STRING, tokens BIGINT"),
        spark.createDataFrame(WEIGHTS, "level STRING, name STRING, weight BIGINT"), total, 1,
    )
    got = {(r.domain, r.lang, r.source): r.budget for r in got.collect()}

    want = {}
    # by the contract: what a node can use lies in leaves whose whole path may take tokens
    usable = lambda p: all(weight.get((lv, n), mixing.DEFAULT_WEIGHT) > 0 for lv, n in zip(mixing.LEVELS, p, strict=True))
    capacity = lambda path: sum(t for *p, t in leaves if tuple(p[: len(path)]) == path and usable(p))

    def hand_down(path, budget):
        if len(path) == 3:
            want[path] = budget
            return
        level = mixing.LEVELS[len(path)]
        names = {p[len(path)] for p in leaves if tuple(p[: len(path)]) == path}
        children = {n: (capacity((*path, n)), weight.get((level, n), mixing.DEFAULT_WEIGHT)) for n in names}
        for n, b in slow_share(budget, children).items():
            hand_down((*path, n), b)

    hand_down((), total)
    assert got == want


def test_budget_of_unusable_leaves_goes_to_siblings(spark):
    leaves = [("A", "x", "s", 1000), ("A", "y", "s", 100), ("B", "y", "s", 1000)]
    weights = [("lang", "x", 0)]
    got = mixing.leaf_budgets(
        spark.createDataFrame(leaves, "domain STRING, lang STRING, source STRING, tokens BIGINT"),
        spark.createDataFrame(weights, "level STRING, name STRING, weight BIGINT"), 1000, 1,
    )
    assert {(r.domain, r.lang): r.budget for r in got.collect()} == {("A", "y"): 100, ("B", "y"): 900}


def test_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (1 + i % 5), "x", "s0" if i < 40 else "s1") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    weights = spark.createDataFrame([("source", "s0", 1), ("source", "s1", 9)], "level STRING, name STRING, weight BIGINT")
    mix = lambda **k: mixing.mix(docs, weights, F.lit("a"), share=1.0, epochs=3, **k).collect()
    got = mix()
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("s0", "s1")}
    assert tokens["s1"] > tokens["s0"] and sum(tokens.values()) <= 180
    s1 = [(r.epoch, r._id) for r in got if r.source == "s1"]
    # earlier epochs are whole before a later one starts
    assert {e for e, _ in s1} == {0, 1, 2} and sum(e == 0 for e, _ in s1) == sum(e == 1 for e, _ in s1) == 20
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(slices=1)))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mix(seed="other")))


def test_odd_rows(spark, odd, nothing):
    weights = spark.createDataFrame([("lang", "en", 1), ("lang", None, 5)], "level STRING, name STRING, weight BIGINT")
    domain = F.when(F.col("source") == "src0", "big")
    every = mixing.mix(odd, weights, domain, share=1.0)
    assert every.filter("n_tokens > 0").count() == odd.filter("text rlike '[^ \\\\s]'").count()
    assert mixing.mix(odd, weights.limit(0), domain, share=0.0).filter("n_tokens > 0").count() == 0
    assert mixing.mix(nothing, weights, domain).count() == 0
