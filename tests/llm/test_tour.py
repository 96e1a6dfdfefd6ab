"""The prefix trie against plain Python; the SQL twin is held against the sample tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import tour

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, node STRING, _at BIGINT"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in children[p]) or 1, saved + sum(below[k][1] for k in children[p]))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p],
          hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str,
    )


def fast(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r[c] for c in COLUMNS) for r in tour.prefix_trie(df, **parameters).collect()), key=str)


def talk(rng, n, longest):
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hé", "yes", "no"])) for t in range(rng.randrange(1, longest))]
    # turns of one conversation differ, so that their order is fixed
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("stretch", [tour.STRETCH, 40, 1])
def test_against_plain_python(spark, stretch):
    rng = random.Random(stretch)
    rows = talk(rng, 60 if stretch > 1 else 6, 14)
    assert fast(spark, rows, stretch=stretch) == slow(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    rng = random.Random(2)
    rows = [(0, t, "user", rng.choice("ab")) for t in range(3000)]
    rows += [(5 * c + 1, t, "user", "same") for c in range(1, 400) for t in range(3)]
    rows += [(10**12 + c, None, None, None) for c in range(30)]
    assert fast(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (3, None, None, None), (3, 0, "user", "x" * 200_000), (4, 1, "a", "b")]
    assert fast(spark, rows) == slow(rows)
    # repeated rows are turns of their own
    assert fast(spark, rows + rows) == slow(rows + rows)
    assert fast(spark, []) == [] and fast(spark, [(None, 1, "user", "no id")]) == []


@pytest.mark.parametrize("rank", [tour.doubled, lambda arcs: tour.ranked(arcs, 7), lambda arcs: tour.ranked(arcs, 1000)])
def test_list_ranking(spark, rank):
    rng = random.Random(8)
    order = rng.sample(range(10**15), 120)
    weights = [(rng.randrange(3), rng.randrange(10**9)) for _ in order]
    arcs = spark.createDataFrame([(a, n, *w) for a, n, w in zip(order, [*order[1:], None], weights, strict=True)], "arc BIGINT, next BIGINT, w1 BIGINT, w2 BIGINT")
    want, s, t = {}, 0, 0
    for a, (x, y) in zip(order, weights, strict=True):
        s, t = s + x, t + y
        want[a] = (s, t)
    assert {r.arc: (r.w1, r.w2) for r in rank(arcs).collect()} == want


def test_runs_across_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(-(2**63), 2**63), 10 * i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k BIGINT, o BIGINT, v BIGINT, u BIGINT").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.o: r for r in tour.runs(df, ["k"], [F.col("o")], sums=("v",), lag="u").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for key in (1, 2, 9):
        total, at, last = 0, 0, None
        mine = [r for r in rows if r[0] == key]
        for k, o, v, u in mine:
            at += 1
            r = got[o]
            assert (r.k, r._at, r._before_v, r.v, r._lag, r._ends) == (k, at, wrap(total), wrap(total + v), last, o == mine[-1][1])
            total, last = total + v, u
