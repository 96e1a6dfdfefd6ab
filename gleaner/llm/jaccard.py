"""N-gram Jaccard join and its components, with a count-vector R-tree.

Documents link when 100 * intersection >= 80 * union of their sets of distinct
5-word shingles. Nobody can hold all points in one tree, and in one tree unrelated
long texts lie too close for its boxes to part them. So the root level is spread
over the cluster: shingles have a global order, and two linked sets share one of
their first n // 5 + 1 shingles. Each such shingle is a branch. The order puts
frequent shingles last, by the logarithm of the counts of all documents' shingles
in a table of `COUNTERS` hash buckets, then goes by hash; any order is right, and
this one keeps passages that many documents share from being branches. In a branch:

1. Equal sets are one class from the start; only their least document goes on.
2. The members of a branch are compared with a pivot: first the summed coordinate
   minima of their count vectors, then, for pairs that survive, the sets. Verified
   links give components. This is repeated with other pivots, `ROUNDS` times at most,
   as long as that finds many links, so that a large group of near copies becomes
   one component without all its pairs.
3. What is left of a branch, that is members of different components, goes through
   an R-tree: all pairs of different components that its bounds can't rule out are
   verified. Branches are cut in bands of sizes and blocks of `BLOCK_ROWS` members;
   each pair of neighbouring bands and of blocks is a tree of its own.

All links between different components are found, so that components are exact.

Rules: a null text, or one without words, has no shingles and links with nothing.
Rows with null ids have a null component. Rows with equal ids are one document,
which has the links of each. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, mix, tidy, tidy_group
from gleaner.llm.components import components
from gleaner.llm.rtree import count_vector, forest_pairs, least_overlap, vector_of, vectors_of
from gleaner.llm.shingles import shingle_sets
from gleaner.sources.tables import broadcast_if_small, written

ROUNDS, BLOCK_ROWS = 4, 1024
COUNTER_BITS, SLICES = 21, 16
COUNTERS = 1 << COUNTER_BITS
SMALL = 16 << 20


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket of shingles 0, or the logarithm of how far its count is
    above the mean, where it is above what chance makes of rare shingles. Tasks send `COUNTERS` numbers each, which are added in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                total += np.bincount(_bucket(np.concatenate(shingle_sets(b))), minlength=COUNTERS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES)), pa.array([x.astype("<u4").tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        # a task sends 32 bits a counter, sums have 64
        parts = [x.as_py() for x in table["counts"]]
        total = sum(np.frombuffer(x, f"<u{len(x) * SLICES // COUNTERS}").astype("<i8") for x in parts)
        return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice long, counts binary"
    rows = docs.select(F.col(text).cast("string")).mapInArrow(tidy(count), kind)
    rows = rows.groupBy("slice", F.floor(F.spark_partition_id() / 256)).applyInArrow(tidy_group(add), kind).groupBy("slice").applyInArrow(tidy_group(add), kind)
    total = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for i, counts in rows.collect():
        total[i] = np.frombuffer(counts, "<i8")
    total = total.ravel()
    mean = total.mean()
    noise = mean + 6 * np.sqrt(mean) + 16  # what buckets of rare shingles hold at most
    return np.where(total > noise, 1 + np.log2(np.maximum(total, 1) / max(mean, 1)), 0).astype(np.uint8)


def profiles(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, n (size of the set), s1 and s2 (128 bits of it), branches (its first
    shingles), counts (its count vector) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text))

    def first_of(s: np.ndarray) -> np.ndarray:
        classes = shared.value[_bucket(s)]
        return (s[np.argsort(classes, kind="stable")] if classes.any() else s)[: len(s) // 5 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                sets = shingle_sets(b)
                n = np.array([len(s) for s in sets])
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                first = [first_of(s) for s in sets]
                at = np.cumsum([0, *map(len, first)])
                branches = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
                counts = pa.array([count_vector(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), branches, counts],
                    names=["id", "n", "s1", "s2", "branches", "counts"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, n long, s1 long, s2 long, branches array<long>, counts binary")


def sets_of(docs: DataFrame, ids: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, shingles (sorted hashes, binary) of the documents in `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array([s.tobytes() for s in shingle_sets(b)], pa.binary())], names=["id", "shingles"]
                )

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(broadcast_if_small(ids, SMALL), "id", "left_semi")
    return rows.mapInArrow(tidy(run), f"id {docs.schema[key].dataType.simpleString()}, shingles binary")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that the summed coordinate minima can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            fits = (4 * n <= 5 * m) & (4 * m <= 5 * n)
            need = least_overlap(n, m)
            left, right = batch.column("c1"), batch.column("c2")
            for i in np.flatnonzero(fits):
                fits[i] = np.minimum(vector_of(left[i].as_py()), vector_of(right[i].as_py())).sum() >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    kind = pairs.schema["a"].dataType.simpleString()
    one, two = (points.select(F.col("id").alias(x), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")) for k, x in ((1, "a"), (2, "b")))
    close = pairs.join(two, "b").join(one, "a").select("a", "b", "n1", "n2", "c1", "c2")
    return close.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s1"), batch.column("s2"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{k}")) for k, x in ((1, "a"), (2, "b")))
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "s1", "s2")
    return full.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def tree_pairs(members: DataFrame) -> DataFrame:
    """a < b: pairs of different components in a branch, by R-trees. `members`:
    branch, id, n, counts, component. A pair that meets in several branches is
    told by the least of them (rows know the branches below their own), and in the
    band of its smaller set."""
    others = members.groupBy("id").agg(F.sort_array(F.collect_set("branch")).alias("branches"))
    own = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    rows = members.join(others, "id").withColumn("own", own)
    rows = rows.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    sizes = rows.groupBy("branch", "band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"), F.count_distinct("component").alias("k"))
    sizes = written(sizes.filter("k > 1").drop("k"), "trees")
    rows = rows.join(broadcast_if_small(sizes, SMALL), ["branch", "band"])
    part = F.pmod(F.hash("id"), F.col("parts"))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("branch", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "own", "id", "n", "counts", "component", F.filter("branches", lambda x: x < F.col("branch")).alias("branches"))
    kind = members.schema["id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            heads = _heads(held)
            if heads[-1]:  # the last tree may go on
                yield told(held.slice(0, heads[-1]), heads[:-1])
                held = held.slice(heads[-1])
        if held is not None and held.num_rows:
            yield told(held, _heads(held))

    def told(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        ids, comp, own, part, band, p, q = (table[x].to_numpy() for x in ("id", "component", "own", "part", "band", "p", "q"))
        vectors, branches = vectors_of(table["counts"].combine_chunks()), table["branches"].combine_chunks()
        lists, a, b = {}, [], []
        for tree, i, j in forest_pairs(vectors, table["n"].to_numpy(), heads):
            # pairs inside a block are told by the block's own tree
            keep = (comp[i] != comp[j]) & (np.minimum(own[i], own[j]) == band[i]) & ((p[i] == q[i]) | (part[i] != part[j]))
            i, j = tree.fine(i[keep], j[keep])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                for k in (x, y):
                    if k not in lists:
                        lists[k] = frozenset(branches[k].as_py())
                if lists[x].isdisjoint(lists[y]):
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        kept = table.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, ids.dtype), kept) for x in (a, b)], names=["a", "b"])

    keys = ["branch", "band", "p", "q"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(near), f"a {kind}, b {kind}").distinct()


def _heads(table: pa.Table) -> np.ndarray:
    """Where trees begin in rows that are sorted by tree."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for x in ("branch", "band", "p", "q"):
        c = table[x].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """With the component of each member; of one without links itself."""
    return members.join(broadcast_if_small(labels, SMALL).select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def join_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`."""
    rows = written(profiles(docs, text, key), "profiles")
    known = rows.filter("n > 0 and id is not null")
    classes = known.groupBy("s1", "s2", "n").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most").select("s1", "s2", "n", "least")
    classes = broadcast_if_small(written(classes, "classes"), SMALL)
    members = known.select("id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
    copies = written(members.filter("a != b"), "copies")  # later documents of a class

    points = known.join(broadcast_if_small(copies.select(F.col("a").alias("id")).distinct(), SMALL), "id", "left_anti")
    branches = points.select("id", F.explode("branches").alias("branch"))
    repeated = written(known.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"), "repeated")
    again = not repeated.isEmpty()
    if again:  # each set of an id is one point, and each id one member of a branch
        ids = broadcast_if_small(repeated, SMALL)
        own = known.join(ids, "id", "left_semi").join(classes, ["s1", "s2", "n"], "left").filter("least is null or id = least").drop("least")
        own = written(own.dropDuplicates(["id", "s1", "s2", "n"]), "repeated-points")
        points, branches = points.join(ids, "id", "left_anti"), branches.join(ids, "id", "left_anti")
        points = points.unionByName(own)
        branches = branches.union(own.select("id", F.explode("branches").alias("branch")).distinct())
    shared = branches.groupBy("branch").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("members")).filter("pivot != last")
    shared = written(shared.drop("last"), "branches")
    members = written(branches.join(shared, "branch"), "members")
    # branches with the same members ask the same questions: one of each kind is enough
    kinds = members.groupBy("branch").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.count("*").alias("k"))
    kept = written(kinds.groupBy("x", "y", "k").agg(F.min("branch").alias("branch")).select("branch"), "kinds")
    members = written(members.join(broadcast_if_small(kept, SMALL), "branch", "left_semi"), "members")

    def verify(pairs: DataFrame) -> tuple[DataFrame, int, int]:
        pairs = written(pairs, "pairs")
        tried = pairs.count()
        involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = sets_of(docs, involved, text, key)
        found = written(verified(pairs, written(sets.dropDuplicates() if again else sets, "sets")), "links") if tried else pairs
        return found, tried, found.count()

    def mixed() -> DataFrame:
        """Members of branches with several components, and a pivot of each branch."""
        own = labelled(members.filter("members > 2").select("branch", "id"), components(reduce(DataFrame.union, links)))
        pick = F.min(F.struct(F.xxhash64("id", F.lit(len(links))), "id", "component"))
        several = own.groupBy("branch").agg(F.min("component").alias("low"), F.max("component").alias("high"), pick.alias("pick"))
        several = written(several.filter("low != high").select("branch", "pick"), "mixed")
        return written(own.join(broadcast_if_small(several, SMALL), "branch"), "own")

    distinct = lambda pairs: pairs.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")
    vectors = points.select("id", "n", "counts")
    pairs = members.filter("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = [copies.select("a", "b")]
    found, tried, good = verify(bounded(distinct(pairs), vectors))
    links.append(found)
    rest = mixed()
    for _ in range(ROUNDS - 1):
        pairs = rest.filter("pick.component != component").select(F.least("pick.id", "id").alias("a"), F.greatest("pick.id", "id").alias("b"))
        found, tried, good = verify(bounded(distinct(pairs), vectors))
        links.append(found)
        if good * 4 < tried or not tried:
            break  # what these few links join may be compared once more
        rest = mixed()
    links.append(verify(tree_pairs(rest.drop("pick").join(vectors, "id")))[0])
    labels = components(reduce(DataFrame.union, links))
    out = rows.select("id", "n").join(broadcast_if_small(labels, SMALL), rows["id"] == labels["node"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
