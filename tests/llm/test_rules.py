"""Base numbers against counting one by one; verdicts on planted texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gleaner.llm import rules
from gleaner.llm.blocks import blocks
from tests.llm.conftest import prose


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_numbers():
    rng = random.Random(8)
    letters = ["a", "b", " ", " ", "\n", "#", "é", "漢", "\t", "\r", "\x0b", "&"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + [None, "", "\n", "a b c a b c", "x\r\nx\r\n"]
    for limit in (50, 1 << 20):
        got = []
        for b in blocks(pa.array(texts, pa.string()), limit):
            counts = rules.base_counts(b)
            got += list(zip(*(counts[k].tolist() for k in rules.NUMBERS)))
        assert got == [slow(t) for t in texts]


def test_verdicts(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 120) + ". The end of it, and more.", "en") for i in range(80)]
    bad = [(100, "### $$$ %%% &&& " * 30, None), (101, "WORD! " + "CAPS! ".join(str(k) for k in range(90)), None), (102, "same again " * 60, "en"), (103, "short", "en")]
    docs = spark.createDataFrame(good + bad, "doc_id BIGINT, text STRING, lang STRING")
    got = {r.doc_id: r for r in rules.judge(docs, rules.references(docs)).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in bad)
    assert got[102].base_failed and got[103].base_failed and not got[101].base_failed


def slow_distance(p, q):
    total = lambda c: sum(c.values()) or 1
    out = 0.0
    for k in set(p) | set(q):
        a, b = p[k] / total(p), q[k] / total(q)
        out += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
    return math.sqrt(max(0.0, min(1.0, out)))


def slow_verdicts(rows):
    """Verdicts from texts alone; words are told apart by the operator's own buckets."""
    kinds = [" \t\n\r\x0b\x0c", "aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-", "#*$%&|<>"]

    def chars(text):
        return Counter(next((k for k, c in enumerate(kinds) if x in c), 8 if ord(x) > 127 else 7) for x in text)

    def words(text):
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        found = [w[:-1] if len(w) > 1 and w[-1] in ".," else w for w in found]
        raw = [np.frombuffer(w.encode(), np.uint8) for w in found]
        return Counter(int(rules.span_hashes(r, np.array([0]), np.array([len(r)]))[0] % rules.BUCKETS) for r in raw)

    def failed(text):
        n, _, _, _, repeats = slow(text)
        return n < 50 or 100 * repeats > 50 * n

    references = {}
    for lang in {lang for _, lang in rows if lang}:
        good = [t for t, own in rows if own == lang and not failed(t)]
        c, w = sum(map(chars, good), Counter()), sum(map(words, good), Counter())
        if sum(w.values()) >= rules.MIN_REFERENCE:
            common = set(sorted(w, key=lambda b: (-w[b], b))[: rules.COMMON])
            references[lang] = (c, common, Counter({b if b in common else "rest": 0 for b in w}) + sum((Counter({b if b in common else "rest": n}) for b, n in w.items()), Counter()))
    out = []
    for text, lang in rows:
        c, w = chars(text), words(text)
        fits = not references or (lang is not None and lang not in references)
        for classes, common, shares in references.values():
            own = sum((Counter({b if b in common else "rest": n}) for b, n in w.items()), Counter())
            fits |= (sum(c.values()) < rules.MIN_CHARS or slow_distance(c, classes) <= rules.MAX_CHARS) and (
                sum(w.values()) < rules.MIN_WORDS or slow_distance(own, shares) <= rules.MAX_WORDS
            )
        out.append(not failed(text) and fits)
    return out


def test_verdicts_against_plain_python(spark):
    rng = random.Random(31)
    other = [f"{a}{b}ung" for a in "bdfgkl" for b in "aeiou"]
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(prose(rng, rng.choice([20, 60, 150])), "en") for _ in range(60)] + [(text(other, rng.choice([55, 200])), "de") for _ in range(40)]
    rows += [(text([f"rare{i}x" for i in range(300)], 90), "xx") for _ in range(5)]  # a language without a reference
    rows += [(text([f"Q#{i}" for i in range(90)], 80), rng.choice(["en", None])) for _ in range(10)] + [("É" * 300 + " " + prose(rng, 60), "de"), ("", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING, lang STRING").repartition(3)
    got = {r.doc_id: r.kept for r in rules.judge(docs, rules.references(docs)).collect()}
    want = slow_verdicts(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert 20 < sum(want) < len(rows) - 10 and all(k for k, (_, lang) in zip(want, rows, strict=True) if lang == "xx")


def test_self_similar_lines_differ():
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    for text, want in ((f"{one}\n{two}", 0), (f"{one}\n{one}", 1), (f"ab\nab\na\na\n{two}", 2)):
        for b in blocks(pa.array([text], pa.string()), 1 << 20):
            assert rules.base_counts(b)["n_dup_lines"].tolist() == [want]


def test_odd_rows(spark, odd, nothing):
    rows = rules.judge(odd, rules.references(odd)).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].base_failed and not by[1].kept and by[8].n_dup_lines == 2
    assert rules.judge(nothing, rules.references(nothing)).count() == 0
    assert rules.judge(odd, rules.references(nothing)).filter("kept <> (not base_failed)").count() == 0
