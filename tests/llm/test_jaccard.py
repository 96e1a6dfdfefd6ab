"""Against comparing all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import jaccard
from gleaner.llm.blocks import blocks
from gleaner.llm.components import components
from gleaner.llm.rtree import CountTree, count_vector, least_overlap, vector_of
from gleaner.llm.shingles import shingle_sets
from tests.llm.conftest import prose


def sets_of(texts):
    out = []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def slow(rows):
    sets = dict(zip([i for i, _ in rows], sets_of([t for _, t in rows])))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 2)] = [f"new{rng.randrange(99)}"]
    return " ".join(words)


def documents():
    rng = random.Random(21)
    texts, passage = [], prose(rng, 60)
    for size in (6, 12, 40, 150, 600):
        base = prose(rng, size).split(" ")
        texts += [edited(rng, base, rng.randint(0, max(1, size // 25))) for _ in range(40)]
        texts += [" ".join(base).upper(), " ".join(base)]
    texts += [passage + " " + prose(rng, rng.randint(5, 80)) for _ in range(60)]
    texts += [prose(rng, rng.randint(1, 7)) for _ in range(40)] + ["one two", "ONE  two\n", "", "  ", "one two three four five"]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rounds, block_rows", [(4, 1024), (1, 7)])
def test_components_against_brute_force(spark, monkeypatch, rounds, block_rows):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect()}
    want = slow(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_repeated_rows_and_ids_with_several_texts(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(12):
        base = prose(rng, 120).split(" ")
        pairs += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, 1))]
    df = spark.createDataFrame(pairs + pairs, "doc_id BIGINT, text STRING")
    got = [(r.doc_id, r.component_id) for r in jaccard.join_components(df).collect()]
    want = {i: c for i, (_, c) in slow(pairs).items()}
    assert len(got) == 48 and dict(got) == want and set(want.values()) == set(range(0, 24, 2))

    # 100 has a copy of 0's text and a near copy of 3's pair: it links both
    several = pairs + [(100, pairs[0][1]), (100, edited(rng, pairs[3][1].split(" "), 1))]
    got = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(several, df.schema)).collect()}
    assert got[100] == got[0] == got[1] == got[2] == got[3] == 0 and got[5] == 4


def test_shingle_hashes_tell_the_same_sets_apart():
    texts = [t for _, t in documents()]
    found = [s for b in blocks(pa.array(texts), 2000) for s in shingle_sets(b)]
    want = sets_of(texts)
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 11):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_tree_loses_no_link():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (30, 300, 3000)]
    sets = []
    for k in range(150):
        b = base[k % 3]
        keep = b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.4])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, len(b) // 20).astype(np.uint64)])))
    tree = CountTree(np.stack([vector_of(count_vector(s)) for s in sets]), np.array([len(s) for s in sets]))
    found = {(min(x, y), max(x, y)) for i, j in tree.pairs() for x, y in zip(*(k.tolist() for k in tree.fine(i, j)))}
    links = {(i, j) for i in range(150) for j in range(i + 1, 150) if 5 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - c)}
    assert links and links <= found and len(found) < 150 * 149 / 2
    assert all(100 * least_overlap(a, b) >= 80 * (a + b - least_overlap(a, b)) for a in range(1, 60) for b in range(1, 60))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


def test_odd_rows(spark, odd, nothing):
    rows = jaccard.join_components(odd).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and (by[3].n_shingles, by[3].component_id) == (0, 3)
    assert by[7].component_id == 5 and by[None].component_id is None and by[4].n_shingles == 1
    assert jaccard.join_components(nothing).count() == 0
