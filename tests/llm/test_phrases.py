"""Collocations against plain Python; the SQL twin is held against the sample tables."""

import random
import re
from collections import Counter

import pytest

from gleaner.llm import phrases


def slow(rows, least, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    longer = {key: n for key, n in f.items() if len(key[1]) == 3 and n >= least}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(g == lang and p in (q[:2], q[1:]) and 100 * n >= 50 * a for (g, q), n in longer.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in total:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, n + 1, *r[1:]) for n, r in enumerate(best)]
    return sorted(ranked)


def texts(rng, n):
    words = [w + "é" * (i % 3 == 0) for i, w in enumerate("aa ab ba bb ca cb dd ee".split())]
    for _ in range(n):
        out = " ".join(rng.choice(words) if rng.random() < 0.7 else "New york  CITY" for _ in range(rng.randrange(40)))
        yield re.sub(" ", lambda m: rng.choice([" "] * 6 + [", ", "\t", "\n", ". ", " ?", "\r\n"]), out)


def fast(df, **parameters):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **parameters).collect())


@pytest.mark.parametrize("limits", [{}, {"room": 20}, {"most_words": 3, "room": 1}])
def test_against_plain_python(spark, limits):
    rng = random.Random(13)
    rows = [(t, rng.choice(["en", "en", "de", None])) for t in texts(rng, 300)] + [(None, "en"), ("", "fr"), (" \n", None), ("one. two", "fr")]
    df = spark.createDataFrame(rows, "text STRING, lang STRING").repartition(3)
    assert fast(df, least=5, **limits) == slow(rows, 5)
    assert fast(df, least=5, top=7) == slow(rows, 5, 7)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert fast(odd) == slow(rows, 10)
    assert phrases.collocations(nothing).count() == 0


def test_trie_bursts_and_spills():
    import numpy as np

    rng = random.Random(1)
    rows = [(rng.randrange(3), (rng.randrange(20) << 32) | rng.randrange(51)) for _ in range(6000)]
    trie, got = phrases.PhraseTrie(burst=40, room=500), Counter()

    def take(runs):
        for first, suffix, count in runs:
            assert (np.diff(suffix) > 0).all() and len(set(first.tolist())) == 1
            for f, s, c in zip(first.tolist(), suffix.tolist(), count.tolist(), strict=True):
                got[f, s] += c

    for i in range(0, 6000, 300):
        trie.add(np.array([f for f, _ in rows[i : i + 300]]), np.array([s for _, s in rows[i : i + 300]]))
        burst = any(type(below) is dict for below in trie.root.values())
        take(trie.spill())
        assert trie.size <= 500
    assert burst
    take(trie.drain())
    assert got == Counter(rows) and trie.size == 0


def test_sieve_keeps_all_frequent_pairs(spark):
    import numpy as np
    import pyarrow as pa

    hashes = lambda values: phrases.binary_hashes(pa.array([v.encode() for v in values], pa.large_binary()))
    rows = [("en", f"é{i}") for i in range(3000)]
    held = phrases.word_filter(spark.createDataFrame(rows, "lang STRING, w1 STRING"))
    of = lambda rows: phrases.passes(held, phrases.phrase_hashes(hashes([r[0] for r in rows]), [hashes([r[1] for r in rows])]))
    assert of(rows).all() and np.mean(of([("de", w) for _, w in rows])) < 0.02

    rng, words = random.Random(6), "a b c d e f g".split()
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(40)]
    known = phrases.word_filter(spark.createDataFrame([("en", w) for w in words], "lang STRING, w1 STRING"))
    docs = spark.createDataFrame([(t, "en") for t in texts], "text STRING, lang STRING").repartition(4)
    pairs = Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    for cut, n_words in ((phrases.SIEVE_CUT, 100), (phrases.SIEVE_CUT, 9 * phrases.SIEVE_CUT)):
        got = {r.h for r in phrases.sieved_pairs(docs, known, n_words, 40).collect()}
        first, second = zip(*[p for p, n in pairs.items() if n >= 40], strict=True)
        assert got == set(phrases.phrase_hashes(np.repeat(hashes(["en"]), len(first)), [hashes(first), hashes(second)]).view(np.int64).tolist())


def test_rare_triples_are_not_counted():
    import numpy as np
    import pyarrow as pa

    rng, words = random.Random(8), "a b c d e f g h".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) + ". x y z" for _ in range(40)]
    every = Counter(p for t in texts for piece in t.split(". ") for p in zip(piece.split(), piece.split()[1:], piece.split()[2:], strict=False))
    known = np.full(1 << 10, ~np.uint64(0))  # all pairs pass
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 40)], ["text", "lang"])
    found = Counter()
    for runs in phrases.sieve_runs(known, 1, 255, size=3)(iter([batch])):
        for hashes, counts in zip(runs["hashes"].to_pylist(), runs["counts"].to_pylist(), strict=True):
            found.update(dict(zip(np.frombuffer(hashes, np.uint64).tolist(), counts, strict=True)))
    assert sorted(found.values()) == sorted(every.values())

    held = np.zeros(1 << 10, np.uint64)
    for at in phrases.probes(np.array([h for h, n in found.items() if n >= 10], np.uint64), len(held) * 64):
        np.bitwise_or.at(held, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    counts = Counter()
    for rows in phrases.run_counter(known, triples=held)(iter([batch])):
        for r in rows.to_pylist():
            counts[r["w1"], r["w2"], r["w3"]] += r["n"]
    triples = {p: n for p, n in counts.items() if p[2] is not None}
    frequent = {p: n for p, n in every.items() if n >= 10}
    assert frequent.items() <= triples.items() and triples.items() <= every.items()
    assert len(triples) < len(frequent) + 0.1 * (len(every) - len(frequent)) and len(every) > 2 * len(frequent)


def test_scores_are_exact(spark):
    a, l, r = 10**12 + 7, 3 * 10**12 + 1, 10**12 + 9
    df = spark.createDataFrame([(a, l, r)], "a BIGINT, l BIGINT, r BIGINT")
    assert df.select(phrases.cut_score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (l * r)
