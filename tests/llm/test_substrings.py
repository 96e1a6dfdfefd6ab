"""Against marking every repeated window of bytes."""

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import substrings
from gleaner.llm.induced import BatchQueue, suffix_order
from tests.llm.conftest import prose


def slow(rows, length):
    """rows: (id, bytes) -> id: (n_bytes, n_removed, n_spans, digest)."""
    seen, out = set(), {}
    for i, raw in sorted(rows):
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("memory", [16, 4 << 20])
def test_suffix_order(memory):
    rng = np.random.default_rng(memory)
    samples = [rng.integers(0, a, n) for n in (64, 200, 1500) for a in (1, 2, 4, 26, 250)]
    samples += [np.array(([7] * 300 + [3] * 200) * 2), np.repeat(rng.integers(0, 3, 80), rng.integers(1, 25, 80)), np.arange(300), np.arange(300)[::-1]]
    for x in samples:
        t = np.append(x + 1, 0)
        words = t.tolist()
        assert suffix_order(t, memory).tolist() == sorted(range(len(words)), key=lambda i: words[i:])


def test_queue_keeps_arrival_order_on_disk():
    rng, queue, want = np.random.default_rng(1), BatchQueue(memory=2000), []
    for k in range(60):
        keys = rng.integers(0, 50, 500)
        queue.push(keys, np.arange(500) + 500 * k)
        want += list(zip(keys.tolist(), range(500 * k, 500 * k + 500)))
    assert any(not r[3] for r in queue.runs)
    got = [pair for below in (10, 30, 50) for pair in zip(*(x.tolist() for x in queue.pop(below)))]
    assert got == sorted(want, key=lambda x: x[0])


def rows_with_repeats():
    rng = random.Random(9)
    passage = prose(rng, 40)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = prose(rng, rng.randint(1, 150))
        elif kind == 1:  # near copies
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
            text = " ".join(words)
        elif kind == 2:
            text = prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 5)
        elif kind == 3:
            text = "ha" * rng.randint(20, 200) + prose(rng, 5)  # repeats itself
        elif kind == 4:
            text = passage[: rng.randint(80, 130)]
        else:
            text = "é漢" * 30 + prose(rng, 30) + "é漢" * 30
        rows.append((rng.randrange(10**6) if i else 0, text))
    rows += [(2 * 10**6, rows[7][1]), (3 * 10**6, rows[7][1])]
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("shard_bytes", [500, 3 << 20])
@pytest.mark.parametrize("length", [100, 40])
def test_against_brute_force(spark, shard_bytes, length):
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in substrings.digests(df, length=length, shard_bytes=shard_bytes).collect()}
    want = slow([(i, t.encode()) for i, t in rows], length)
    assert got == want
    assert sum(w[1] for w in want.values()) > 3000


def test_odd_rows(spark, odd, nothing):
    rows = substrings.digests(odd).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].n_removed == by[7].n_bytes and by[7].n_spans == 1  # equals document 5
    assert [r.n_removed for r in rows if r.doc_id == 5] == [0, 0]
    assert by[None].n_removed == 0
    assert substrings.digests(nothing).count() == 0
    clash = spark.createDataFrame([(1, "x" * 300), (1, "y" * 300), (2, "x" * 300)], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.digests(clash).collect()) == [(1, 299), (1, 299), (2, 300)]


def test_several_texts_of_an_id_and_repeated_rows(spark):
    rng, rows = random.Random(21), [r for r in rows_with_repeats() if r[1]]
    rows = [(i % 20, t) for i, t in rows] + [(3, rows[4][1] + " and more"), (3, rows[4][1]), (None, rows[1][1])]
    rows += rng.sample(rows, 15)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in substrings.digests(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)).collect())
    order = sorted({(i, hashlib.md5(t.encode()).digest(), t.encode()) for i, t in rows if i is not None})
    want = slow([((i, digest), raw) for i, digest, raw in order], 100)
    none = lambda t: (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted((str(i), *(none(t) if i is None else want[i, hashlib.md5(t.encode()).digest()])) for i, t in rows)
