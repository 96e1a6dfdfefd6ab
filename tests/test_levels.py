"""The store that keeps itself small."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import levels, store
from gleaner.sources.tables import new_dir


def commit(spark, path, run, now, keys, days=50, fanout=4):
    listed = F.array(*map(F.lit, keys)).cast("array<string>")
    new = spark.range(1).select(F.explode(listed).alias("link_key"))
    store.commit_run(new, path, run, now, days, fanout)


def content(spark, path, before_run=None):
    return sorted(map(tuple, store.read_seen(spark, path, before_run).select("link_key", "seen_at").collect()))


def files(path):
    return sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(path))


def test_files_are_bounded(spark):
    path = new_dir(spark, "seen")
    want, start = {}, datetime(2024, 1, 1)
    for run in range(18):
        now = start + timedelta(days=run)
        want = {k: t for k, t in want.items() if t > now - timedelta(days=7)}
        keys = [f"k{run * 7 % 10}", f"run {run}"]
        new = [k for k in keys if k not in want]
        commit(spark, path, run, now, new, days=7, fanout=2)
        levels.vacuum(spark, path, run)
        want |= {k: now for k in new}
    live = store.alive(store.read_seen(spark, path), now, 7)
    assert {r.link_key: r.seen_at for r in live.collect()} == want
    found = levels.segments(spark, path)
    assert len({s.level for s in found}) == len(found)
    # two manifests, and the keys and bitmaps of the segments that they name
    assert len(os.listdir(f"{path}/_levels/manifests")) == 2
    assert files(path) <= 2 + 2 * 2 * 4


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_segments_stay_few_over_2000_runs(fanout):
    found = []
    for run in range(2000):
        found.append(levels.Segment(f"{run}", 0, 1, 1, run, run))
        kept, gone, level = levels.merges(found, fanout)
        assert sorted(s.n_keys for s in kept + gone) == sorted(s.n_keys for s in found)
        if gone:
            n = sum(s.n_keys for s in gone)
            kept.append(levels.Segment(f"m{run}", level, n, 1, 0, run))
        found = kept
        assert all(sum(s.level == k for s in found) < fanout for k in range(12))
    assert sum(s.n_keys for s in found) == 2000
    # a key is written once a level
    assert max(s.level for s in found) <= 11 and len(found) <= 11 * (fanout - 1)


def test_a_repeated_run_gives_the_same_store(spark):
    path = new_dir(spark, "seen")
    for run in range(4):
        commit(spark, path, run, f"2024-01-0{run + 1}", [f"a{run}", f"b{run}"], fanout=2)
        levels.vacuum(spark, path, run)
        once = content(spark, path)
        assert content(spark, path, before_run=run) == [k for k in once if k[0][1:] != str(run)]
        commit(spark, path, run, f"2024-01-0{run + 1}", [f"a{run}", f"b{run}"], fanout=2)
        levels.vacuum(spark, path, run)
        assert content(spark, path) == once and len(once) == 2 * (run + 1)


def test_a_run_that_dies_before_its_manifest_changes_nothing(spark):
    path = new_dir(spark, "seen")
    commit(spark, path, 0, "2024-01-01", ["a"])
    before = content(spark, path)
    levels.write_segment(spark.createDataFrame([("lost",)], "link_key STRING").withColumn(
        "seen_at", F.lit("2024-01-02").cast("timestamp")), path, 1, 0)
    assert content(spark, path) == before
    levels.vacuum(spark, path, 1)
    assert content(spark, path) == before
    assert len(os.listdir(f"{path}/_levels/segments")) == 1


def test_empty_runs_and_expired_segments(spark):
    path = new_dir(spark, "seen")
    assert content(spark, path) == []
    commit(spark, path, 0, "2024-01-01", [])
    assert content(spark, path) == [] and levels.segments(spark, path) == []
    commit(spark, path, 1, "2024-01-02", ["a"])
    commit(spark, path, 2, "2024-02-01", [])
    assert [k for k, _ in content(spark, path)] == ["a"]
    commit(spark, path, 3, "2024-02-21", [])  # fifty days on
    assert content(spark, path) == []


def test_an_appended_store_is_taken_over(spark):
    path = new_dir(spark, "seen")
    for run, day in enumerate(["2023-01-01", "2024-01-01"]):
        store.append_seen(spark.createDataFrame([(f"k{run}",)], "link_key STRING"), path, run, day)
    assert len(content(spark, path)) == 2
    commit(spark, path, 2, "2024-01-03", ["k2"])
    assert [k for k, _ in content(spark, path)] == ["k1", "k2"]


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_only_segments_that_may_hold_a_key_are_read(spark, max_bytes):
    path = new_dir(spark, "seen")
    for run in range(3):
        commit(spark, path, run, f"2024-01-0{run + 1}", [f"{run}-{i}" for i in range(3000)])
    keys = spark.createDataFrame([("1-17",), ("1-2999",), ("none",)], "link_key STRING")
    found = levels.segments(spark, path)
    assert sorted(s.n_buckets for s in found) == [2, 2, 2]
    # a bit may stand for another key too, but here it doesn't
    met = levels.meeting(spark, path, found, keys)
    assert len(met) == 1 and met[0].segment.startswith("1-")
    seen = store.seen_before(spark, path, keys, "2024-01-05", 50, max_bytes=max_bytes)
    assert seen.count() == (9000 if max_bytes == 0 else 2)
    read = {f.split("/_levels/segments/")[1].split("/")[0] for f in seen.inputFiles()}
    assert read == {s.segment for s in (found if max_bytes == 0 else met)}
    none = spark.createDataFrame([], "link_key STRING")
    assert store.seen_before(spark, path, none, "2024-01-05", 50).count() == 0
