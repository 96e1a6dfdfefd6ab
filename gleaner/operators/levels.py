"""A seen store that keeps itself small.

Keys lie in immutable segments, each a parquet table of `link_key, seen_at` in a
folder of its own, and a manifest lists those that make up the store after a run:

    <path>/_levels/segments/<run>-<id>/    keys, and beside them their filter
    <path>/_levels/manifests/run=<run>/    one row for each segment

A run adds its keys as a segment of level 0. Where `FANOUT` segments of a level come
together they are merged into one of the next level, without expired keys; segments
whose newest key has expired are left out unread. So each key is rewritten once a
level, and the store has at most `FANOUT - 1` segments a level: files and the cost of
a run grow with the logarithm of the number of runs, and with the keys alive.

A run is committed by its manifest alone, one file that Spark's committer puts in its
place at the end. A run that dies before leaves segments that no manifest names, and
a repeated run starts from the manifest before it, so it gives the same store.
`vacuum` deletes what neither the last run nor the one before it needs. There is one
writer at a time.

Each segment has a bitmap of its keys' hashes, some bits a key. `meeting` sends the
keys of a run, where they are few, to the bitmaps first, and only segments in which
one of them may be are read.

`operators.store` is the store as runs see it, and says which keys are alive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schemas

FANOUT = 8
# bits of a segment's bitmap for each of its keys, at least
BITS_PER_KEY = 16
# of one row of `bitmap_construct_agg`
_BUCKET_BITS = 32768

MANIFEST = (
    "segment STRING, level INT, n_keys BIGINT, n_buckets BIGINT, first_us BIGINT, last_us BIGINT"
)
FILTER = "bucket BIGINT, bits BINARY"


@dataclass(frozen=True)
class Segment:
    """One line of a manifest; times in microseconds since 1970."""

    segment: str
    level: int
    n_keys: int
    n_buckets: int
    first_us: int
    last_us: int


def manifests(spark: SparkSession, path: str) -> dict[int, list[Segment]]:
    """The segments after each run whose manifest is still there. They are few: fewer
    than `FANOUT` a level and run, and `vacuum` leaves two runs."""
    schema = f"{MANIFEST}, run BIGINT"
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/_levels/manifests").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[int, list[Segment]] = {}
    for *line, run in sorted(rows, key=str):
        # a manifest without segments holds one row of nulls
        found.setdefault(run, []).extend([Segment(*line)] if line[0] is not None else [])
    return found


def segments(
    spark: SparkSession, path: str, before_run: int | None = None
) -> list[Segment] | None:
    """The segments of the store after its last run, or as it was before a run; None
    where it has no manifest at all."""
    found = manifests(spark, path)
    if not found:
        return None
    runs = [run for run in found if before_run is None or run < before_run]
    return found[max(runs)] if runs else []


def _segment_path(path: str, name: str) -> str:
    return f"{path}/_levels/segments/{name}"


def read_segments(spark: SparkSession, path: str, chosen: list[Segment]) -> DataFrame:
    """Keys of some segments, `link_key, seen_at`."""
    if not chosen:
        return spark.createDataFrame([], schemas.SEEN)
    keys = [f"{_segment_path(path, s.segment)}/keys" for s in chosen]
    return spark.read.schema(schemas.SEEN).parquet(*keys)


def _bucket(key: Column, n_buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_buckets)


def _position(key: Column) -> Column:
    # another hash than that of the bucket
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_BUCKET_BITS))


def write_segment(keys: DataFrame, path: str, run: int, level: int) -> list[Segment]:
    """Write keys, one row each, with their bitmap; no segment where there are none."""
    spark = keys.sparkSession
    name = f"{run}-{uuid.uuid4().hex}"
    place = _segment_path(path, name)
    rows = keys.select("link_key", "seen_at").hint("rebalance")
    rows.sortWithinPartitions("seen_at").write.parquet(f"{place}/keys")
    done = spark.read.schema(schemas.SEEN).parquet(f"{place}/keys")
    n, first, last = done.agg(
        F.count("*"), F.min(F.unix_micros("seen_at")), F.max(F.unix_micros("seen_at"))
    ).first()
    if n == 0:
        return []
    n_buckets = -(-n * BITS_PER_KEY // _BUCKET_BITS)
    bits = done.groupBy(_bucket(F.col("link_key"), F.lit(n_buckets)).alias("bucket")).agg(
        F.bitmap_construct_agg(_position(F.col("link_key"))).alias("bits")
    )
    bits.hint("rebalance").write.parquet(f"{place}/filter")
    return [Segment(name, level, n, n_buckets, first, last)]


def merges(found: list[Segment], fanout: int) -> tuple[list[Segment], list[Segment], int]:
    """Which segments stay, which become one, and its level. A merge that fills the
    next level takes that level along, so that no key is written twice in one run."""
    gone: list[Segment] = []
    level = 0
    while True:
        here = [s for s in found if s.level == level]
        if len(here) + bool(gone) < fanout:
            break
        gone += here
        level += 1
    return [s for s in found if s not in gone], gone, level


def commit(
    new: DataFrame,
    path: str,
    run: int,
    before: list[Segment],
    since: Column,
    fanout: int = FANOUT,
) -> list[Segment]:
    """Add `new` (`link_key, seen_at`, one row a key, none of them alive in the store)
    as run number `run` to the segments of the run `before`; runs are committed in the
    order of their numbers. Keys seen at `since` (a constant) or before have expired.
    Returns the segments of the store afterwards."""
    spark = new.sparkSession
    limit = spark.sql("SELECT 1").select(F.unix_micros(since)).first()[0]
    live = [s for s in before if s.last_us > limit]
    kept, gone, level = merges(live + write_segment(new, path, run, 0), fanout)
    if gone:
        merged = read_segments(spark, path, gone).filter(F.col("seen_at") > since)
        kept += write_segment(merged, path, run, level)
    lines = [F.struct(*[F.lit(x) for x in vars(s).values()]) for s in kept] or [F.struct(*[F.lit(None)] * 6)]
    kind = f"ARRAY<STRUCT<{MANIFEST.replace(' ', ': ').replace(',:', ',')}>>"
    listed = spark.sql("SELECT 1").select(F.inline(F.array(*lines).cast(kind)))
    listed.write.mode("overwrite").parquet(f"{path}/_levels/manifests/run={run}")
    return kept


def meeting(
    spark: SparkSession, path: str, chosen: list[Segment], keys: DataFrame
) -> list[Segment]:
    """The segments in which one of `keys` may be. The keys are few, or at least small
    enough to be broadcast; the bitmaps stay where they are read."""
    if not chosen:
        return []
    filters = None
    for s in chosen:
        one = spark.read.schema(FILTER).parquet(f"{_segment_path(path, s.segment)}/filter").select(
            F.lit(s.segment).alias("segment"), "bucket", "bits"
        )
        filters = one if filters is None else filters.unionByName(one)
    # one row a key with its place in each segment, which are fewer than FANOUT a level
    places = F.array(*[
        F.struct(
            F.lit(s.segment).alias("segment"),
            _bucket(F.col("link_key"), F.lit(s.n_buckets)).alias("bucket"),
            _position(F.col("link_key")).alias("position"),
        )
        for s in chosen
    ])
    asked = keys.select(F.inline(places)).distinct()
    byte = F.col("bits").substr((F.col("position") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    on = F.getbit(value, (F.col("position") % 8).cast("int")) == 1
    hits = filters.join(F.broadcast(asked), ["segment", "bucket"]).filter(on)
    names = {row.segment for row in hits.select("segment").distinct().collect()}
    return [s for s in chosen if s.segment in names]


def vacuum(spark: SparkSession, path: str, first_run: int) -> None:
    """Delete what no run from `first_run` on needs, should it be repeated: manifests
    older than the last one before `first_run`, and segments no manifest names."""
    found = manifests(spark, path)
    before = [run for run in found if run < first_run]
    needed = {run: found[run] for run in found if run >= first_run or run == max(before)}
    names = {s.segment for one in needed.values() for s in one}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{path}/_levels")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # manifests go first, so that none ever names a segment that is gone
    for folder, kept in (("manifests", {f"run={run}" for run in needed}), ("segments", names)):
        place = hadoop(root, folder)
        if not files.exists(place):
            continue
        for entry in files.listStatus(place):
            if entry.isDirectory() and entry.getPath().getName() not in kept:
                files.delete(entry.getPath(), True)
