"""Sketches against plain Python with the same hash function."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from gleaner.llm import sketches
from tests.llm.conftest import prose

TOP = (1 << 63) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed=seed)
    return signed(seed)


def slow_sketch(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
    if 0 < len(words) < 5:
        h = 0
        for w in words:
            h = chain([h, w])
        return [h]
    every = sorted({chain(words[i : i + 5]) for i in range(len(words) - 4)})
    low = [h for h in every if h <= sketches.bound()]
    return low if len(low) >= sketches.LEAST else every[: sketches.LEAST]


def upto(s):
    return TOP if len(s) < sketches.LEAST else max(s[-1], sketches.bound())


def slow_shares(a, b):
    t = min(upto(a), upto(b))
    x, y = {h for h in a if h <= t}, {h for h in b if h <= t}
    return (len(x & y) / len(x | y) if x | y else 1.0), (len(x & y) / len(x) if x else float(not a))


def slow_digests(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    out = []
    for at, (i, text) in enumerate(rows):
        other = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, changed = slow_sketch(text), slow_sketch(edited)
        (near, inside), (near_next, inside_next) = slow_shares(own, changed), slow_shares(own, slow_sketch(other))
        spell = lambda s: "".join(f"{h & ((1 << 64) - 1):016x}" for h in s)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(own), spell(changed), near, near_next, inside, inside_next))
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next")


def order(rows):
    return sorted(rows, key=str)


def fast_digests(df):
    return [(r.doc_id, *[r[c] for c in COLUMNS]) for r in sketches.digests(df).collect()]


def test_digests_against_plain_python(spark):
    rng = random.Random(12)
    base = prose(rng, 400)
    texts = [prose(rng, rng.choice([0, 1, 4, 5, 6, 20, 21, 60, 900])) for _ in range(60)]
    texts += [base, base, base + " " + prose(rng, 30), base[: len(base) // 3], "é漢🎉 " * 40, "\n\t ", "A b C d E"]
    rows = [(rng.randrange(10**9), t) for t in texts] + [(7, None), (7, "two texts"), (7, "of one id"), (None, "no id"), (11, base), (11, base), (11, base)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    assert order(fast_digests(df)) == order(slow_digests(rows))


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert order(fast_digests(odd)) == order(slow_digests(rows))
    assert sketches.digests(nothing).count() == 0
    one = sketches.digests(odd.filter("doc_id = 10")).first()
    assert one.near_next == one.contained_next == 1.0


def test_merge_and_unequal_lengths(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in rng.sample(range(10**6), 20000)]
    long, short, other = " ".join(words), " ".join(words[500:1100]), " ".join(f"x{i}" for i in range(600))
    df = spark.createDataFrame([(long, short, other)], "long STRING, short STRING, other STRING").select(*[sketches.sketch(F.col(c)).alias(c) for c in ("long", "short", "other")])
    got = df.select(
        sketches.containment(F.col("short"), F.col("long")).alias("all"), sketches.containment(F.col("other"), F.col("long")).alias("none"),
        sketches.likeness(F.col("short"), F.col("long")).alias("like"), sketches.merge(F.col("short"), F.col("other")).alias("merged"), F.size("long").alias("n"),
    ).first()
    assert got["all"] == 1.0 and got.none == 0.0 and abs(got.like - 596 / 19996) < 0.02
    assert abs(got.n - 19996 / sketches.SCALE) < 200
    # the union of sketches is the sketch of all shingles
    both = sorted(set(slow_all(short)) | set(slow_all(other)))
    low = [h for h in both if h <= sketches.bound()]
    assert list(got.merged) == (low if len(low) >= sketches.LEAST else both[: sketches.LEAST])


def slow_all(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in text.split(" ")]
    return {chain(words[i : i + 5]) for i in range(len(words) - 4)}


def test_no_python_in_the_plan(spark, odd):
    plan = sketches.digests(odd)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
