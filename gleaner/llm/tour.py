"""Prefix trie of conversations, summed over subtrees by an Euler tour.

A conversation is its turns ordered by turn (null first), then role, then the digest of
the text. A trie node is a distinct sequence of first turns, known by its depth
and two 64-bit sums of digests of (place, turn) along the sequence; these are running
sums, so that a conversation of any length is cut across tasks.

The tour has an enter and an exit arc for each node: from a node into its first child, from a
child to the next one, and from the last child back out. Its order is found by list
ranking: tasks hold ranges of arcs, follow the list as far as it stays inside, and
leave one arc for each stretch; stretches are a shorter list, which is ranked in the same
way. As nodes are numbered by their smallest conversation and depth, most of the tour
stays inside a range. A list that doesn't get shorter any more is ranked by doubling
its steps. What a subtree holds is a difference of running sums at a node's two arcs.

`runs` does what a window over a hot key can't: rows are dealt by ranges of key and
order, and what a range hands on to the next is one row. Only a node's conversations, joined
to one text for its hash, meet in one task: as a stream of rows of `CHUNK` ids.

Rules: rows without conv_id are no part of a conversation; null role and text are empty;
repeated rows are turns of their own; an empty table has no nodes, not even a root.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.blocks import tidy
from gleaner.sources.tables import broadcast_if_small, written

GROUP, MOST_SHARED, CHUNK = 5, 9, 4096
STRETCH = 250_000
MOST_HOT = 1000


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def runs(df: DataFrame, key: list[str], order: list, sums: tuple[str, ...] = (), lag: str | None = None, name: str = "runs") -> DataFrame:
    """`df` with _at (place among the rows of a key, from 1), _ends (last row of its
    key), `sums` as running sums of a key modulo 2 ** 64 with those of the row before as
    _before_*, and _lag: `lag` of the row before in the key (null: first row).

    `key`, `sums` and `lag`: bigint columns without nulls. The driver sees two rows a range.
    """
    fields = df.schema.fieldNames()
    kept = [f for f in fields if f not in sums]
    spec = [(f"`{f}`", df.schema[f].dataType.simpleString()) for f in kept]
    spec += [(c, "bigint") for s in sums for c in (s, f"_before_{s}")] + [("_at", "bigint"), ("_ends", "boolean")]
    spec += [("_lag", "bigint")] if lag else []
    schema = ", ".join(f"{n} {t}" for n, t in spec)
    places = [F.col(k) for k in key] + order
    rows = df.repartitionByRange(*places).sortWithinPartitions(*places)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Everything for a range by itself, with _part, _head (row of the range's first
        key) and _tail (last row of the range)."""
        part, opens, last, held = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(fields.index(c)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            keys = np.stack([column(k) for k in key], axis=1)
            opens = keys[0] if opens is None else opens
            on = last is not None and bool((last["key"] == keys[0]).all())
            new = np.append(not on, (keys[1:] != keys[:-1]).any(axis=1))
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = ~np.logical_or.accumulate(new)
            out = {f: batch.column(fields.index(f)) for f in kept}
            last_sums = []
            for k, s in enumerate(sums):
                own = column(s).view(np.uint64)
                total = np.cumsum(own, dtype=np.uint64)
                total -= np.where(goes_on, np.uint64(0), total[start] - own[start])
                if on:
                    total[goes_on] += last["sums"][k]
                out[s], out[f"_before_{s}"] = pa.array(total.view(np.int64)), pa.array((total - own).view(np.int64))
                last_sums.append(total[-1])
            at = np.arange(n) - start + 1 + (goes_on * last["at"] if on else 0)
            out["_at"], out["_ends"] = pa.array(at), None
            if lag:
                out["_lag"] = pa.array(np.append(last["lag"] if on else 0, column(lag)[:-1]), mask=new)
            out |= {"_part": pa.array(np.full(n, part, np.int32)), "_head": pa.array((keys == opens).all(axis=1))}
            if held:
                yield done(held, tail=False, more=on)
            held = (out, new)
            last = {"key": keys[-1], "sums": last_sums, "at": at[-1], "lag": column(lag)[-1] if lag else None}
        if held:
            yield done(held, tail=True, more=False)

    def done(held: tuple, tail: bool, more: bool) -> pa.RecordBatch:
        out, new = held
        is_tail = np.zeros(len(new), bool)
        is_tail[-1] = tail
        out["_ends"] = pa.array(np.append(new[1:], not more))
        return _table(out | {"_tail": pa.array(is_tail)})

    found = written(rows.mapInArrow(tidy(scan), f"{schema}, _part int, _head boolean, _tail boolean"), name)
    state = ["_part", *key, "_head", "_at", *sums, *([lag] if lag else [])]
    heads = {r._part: tuple(r[k] for k in key) for r in found.filter("_head and _at = 1").select("_part", *key).collect()}
    tails = sorted(found.filter("_tail").select(*state).collect(), key=lambda r: r._part)
    # what each range takes over from those before it: rows and sums of its first key, and the value before
    taken = np.zeros((1 + max(heads, default=0), 3 + len(sums)), np.int64)
    followed, before = np.zeros(len(taken), bool), None
    for r in tails:
        here = tuple(r[k] for k in key)
        if before is not None and before["key"] == heads[r._part]:
            followed[before["part"]] = True
            taken[r._part] = [1, before["at"], before["lag"], *before["sums"]]
        more = taken[r._part] if r._head else np.zeros(len(taken[0]), np.int64)
        with np.errstate(over="ignore"):
            totals = [np.int64(r[s]) + more[3 + k] for k, s in enumerate(sums)]
        before = {"key": here, "part": r._part, "at": r._at + more[1], "sums": totals, "lag": r[lag] if lag else 0}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {f: batch.column(f) for f in batch.schema.names}
            get = lambda c: out[c].to_numpy(zero_copy_only=False)  # noqa: E731, B023
            part, head, at = get("_part"), get("_head"), get("_at")
            with np.errstate(over="ignore"):
                for k, s in enumerate(sums):
                    for c in (s, f"_before_{s}"):
                        out[c] = pa.array(get(c) + head * taken[part, 3 + k])
            out["_ends"] = pa.array(get("_ends") & ~(get("_tail") & followed[part]))
            if lag:
                opens = head & (at == 1) & (taken[part, 0] == 1)
                none = out["_lag"].is_null().to_numpy(zero_copy_only=False)
                out["_lag"] = pa.array(np.where(opens, taken[part, 2], out["_lag"].fill_null(0).to_numpy()), mask=none & ~opens)
            out["_at"] = pa.array(at + head * taken[part, 1])
            yield _table({n.strip("`"): out[n.strip("`")] for n, _ in spec})

    return found.mapInArrow(join, schema)


def shared_turns(conv: Column) -> Column:
    """Number of turns that a conversation takes over from its group."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def own_turns(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, d1, d2 (digests of role and text), bytes, _at, _ends of each turn."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    turns = rows.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), text, role).alias("d2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return runs(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")], name="turns").drop("turn", "role")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of their group's first one.

    conv, _at, p1, p2 (sums of their turns up to here), _before_p1, _before_p2, bytes, _ends of
    the turns; conv, turns (number) of all conversations, those without turns too."""
    turns = written(turns, "numbered-turns")
    convs = turns.filter("_ends").select("conv", F.col("_at").alias("n"), shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    first = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(first, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv", "n", "h", "k")
    convs = written(convs, "conversations")

    members = F.array(*[F.lit(d) for d in range(1 - GROUP, GROUP)])
    shared = turns.filter(F.col("_at") < MOST_SHARED).withColumn("target", F.explode(F.transform(members, lambda d: F.col("conv") + d)))
    shared = shared.filter((F.col("target") - F.col("target") % GROUP == F.col("conv")) & (F.col("_at") <= shared_turns(F.col("target"))))
    shared = shared.drop("conv").join(convs.select(F.col("conv").alias("target")), "target").select(F.col("target").alias("conv"), "_at", "d1", "d2", "bytes")

    own = turns.filter(F.col("_at") > shared_turns(F.col("conv")))
    moved = written(convs.filter("n > h and k < h").select("conv", (F.col("h") - F.col("k")).alias("by")), "moved")
    own = own.join(broadcast_if_small(moved), "conv", "left").select("conv", (F.col("_at") - F.coalesce("by", F.lit(0))).alias("_at"), "d1", "d2", "bytes")

    rows = shared.union(own).select("conv", F.col("_at").alias("place"), F.xxhash64("_at", "d1", "d2").alias("p1"), F.xxhash64(F.lit(1), "_at", "d2", "d1").alias("p2"), "bytes")
    paths = runs(rows, ["conv"], [F.col("place")], sums=("p1", "p2"), name="paths").drop("place")
    return paths, convs.select("conv", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """node (a number in the order of conv and depth), conv, depth, p1, p2, q1, q2 (of the parent), n_convs, bytes."""
    nodes = paths.groupBy(F.col("_at").alias("depth"), "p1", "p2").agg(
        F.max("_before_p1").alias("q1"), F.max("_before_p2").alias("q2"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")
    )
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(none.alias("depth"), none.alias("p1"), none.alias("p2"), none.alias("q1"), none.alias("q2"), "conv", "n_convs", none.alias("bytes"))
    nodes = nodes.union(root).repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth")
    return written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def with_parents(nodes: DataFrame, most_hot: int = MOST_HOT) -> DataFrame:
    """node, parent, parent_conv of all nodes but the root. Parents with more than 1 / `most_hot`
    of all nodes are `most_hot` at most and broadcast; the others are joined."""
    children = nodes.filter("depth > 0").select("node", (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    key = ["depth", "p1", "p2"]
    parents = nodes.select(*key, F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    many = children.groupBy(*key).count().filter(F.col("count") > nodes.count() // most_hot).drop("count")
    hot = written(parents.join(many, key), "hot-parents")
    children = children.join(F.broadcast(hot), key, "left")
    rest = children.filter("parent is null").drop("parent", "parent_conv").join(parents, key)
    columns = ["node", "parent", "parent_conv"]
    return children.filter("parent is not null").select(columns).union(rest.select(columns))


def ranked(arcs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """arc, w1, w2: sums of the weights from the start of a list up to and with each arc.

    `arcs`: arc, next (null: the last one), w1, w2, all bigint; weights of 0 or more."""
    n = arcs.count()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        arc, w1, w2 = (rows[c].to_numpy() for c in ("arc", "w1", "w2"))
        following = rows["next"].combine_chunks().fill_null(-1).to_numpy()
        order = np.argsort(arc)
        at = np.searchsorted(arc, following, sorter=order).clip(max=len(arc) - 1)
        inside = arc[order[at]] == following
        before = np.full(len(arc), -1)
        before[order[at[inside]]] = np.flatnonzero(inside)
        head, sums = np.arange(len(arc)), [w1.copy(), w2.copy()]
        while (more := np.flatnonzero(before >= 0)).size:
            step = before[more]
            for w in sums:
                w[more] += w[step]
            head[more], before[more] = head[step], before[step]
        yield _table({"arc": pa.array(arc), "head": pa.array(arc[head]), "w1": pa.array(sums[0]), "w2": pa.array(sums[1]), "next": rows["next"].combine_chunks(), "leaves": pa.array(~inside)})

    ranges = arcs.repartitionByRange(max(1, -(-n // stretch)), "arc") if n > stretch else arcs.coalesce(1)
    local = written(ranges.select("arc", "next", "w1", "w2").mapInArrow(tidy(follow), "arc bigint, head bigint, w1 bigint, w2 bigint, next bigint, leaves boolean"), "stretches")
    ends = written(local.filter("leaves").select(F.col("head").alias("arc"), "next", "w1", "w2"), "stretch-ends")
    left = ends.count()
    if left <= 1:
        return local.select("arc", "w1", "w2")
    sums = doubled(ends) if 2 * left > n else ranked(ends, stretch)
    before = sums.withColumnsRenamed({"w1": "u1", "w2": "u2"}).join(ends.drop("next"), "arc")
    before = written(before.select(F.col("arc").alias("head"), (F.col("u1") - F.col("w1")).alias("u1"), (F.col("u2") - F.col("w2")).alias("u2")), "stretch-sums")
    return local.join(broadcast_if_small(before), "head").select("arc", (F.col("w1") + F.col("u1")).alias("w1"), (F.col("w2") + F.col("u2")).alias("w2"))


def doubled(arcs: DataFrame) -> DataFrame:
    """As `ranked`, for lists in any order: each round every arc jumps twice as far."""
    rows = arcs.withColumnsRenamed({"w1": "s1", "w2": "s2"})
    while not rows.filter("next is not null").isEmpty():
        ahead = rows.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
        added = [(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in ("s1", "s2")]
        rows = written(rows.join(ahead, "next", "left").select("arc", F.col("_next").alias("next"), *added), "doubled")
    total = rows.agg(F.max("s1").alias("t1"), F.max("s2").alias("t2")).first()
    joined = arcs.drop("next").join(rows.drop("next"), "arc")
    return joined.select("arc", *[(F.lit(total[k]) - F.col(f"s{i}") + F.col(f"w{i}")).alias(f"w{i}") for k, i in enumerate((1, 2))])


def ends_digests(paths: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, p1, p2, ends_sha256 of the conversations that end at a node."""
    key = ["p1", "p2", "depth"]
    none = F.lit(0).cast("long")
    ends = paths.filter("_ends").select("p1", "p2", F.col("_at").alias("depth"), "conv")
    ends = ends.union(convs.filter("turns = 0").select(none, none, none, "conv"))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = keys_of(batch), batch.column(3).cast(pa.string()).to_pylist()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [c for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True) for c in range(lo, hi, chunk)] + [len(ids)]
            at = pa.array(cuts[:-1])
            yield _table({
                **{k: batch.column(i).take(at) for i, k in enumerate(key)}, "low": batch.column(3).take(at),
                "ids": pa.array([",".join(ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]),
            })

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a node's rows follow one another, over batches too: its hash goes on with each
        current, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for k, ids in zip(keys_of(batch).tolist(), batch.column(4), strict=True):
                if k != current:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = k, hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            if out:
                yield batch_of(out)
                out = []
        if current is not None:
            yield batch_of([(*current, state.hexdigest())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return _table({n: pa.array(c) for n, c in zip([*key, "ends_sha256"], zip(*rows, strict=True), strict=True)})

    schema = "p1 bigint, p2 bigint, depth bigint"
    spelled = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(spell, f"{schema}, low bigint, ids string")
    return spelled.repartition(*key).sortWithinPartitions(*key, "low").mapInArrow(digest, f"{schema}, ends_sha256 string")


def prefix_trie(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of all nodes."""
    paths, convs = rebuilt(own_turns(rows, key, turn, role, text))
    paths = written(paths, "rebuilt")
    nodes = trie(paths, convs)
    links = with_parents(nodes)
    siblings = written(runs(links, ["parent"], [F.col("node")], lag="node", name="siblings"), "tour")

    # what each node needs to know for its two arcs, from its own row and its neighbours'
    facts = {"first": "bigint", "following": "bigint", "up": "bigint", "n_children": "bigint", "parent_conv": "bigint"}
    fact = lambda df, node, **known: df.select(F.col(node).alias("node"), *[F.expr(known.get(f, f"cast(null as {t})")).alias(f) for f, t in facts.items()])
    told = fact(siblings.filter("_lag is null"), "parent", first="node")
    told = told.union(fact(siblings.filter("_lag is not null"), "_lag", following="node"))
    told = told.union(fact(siblings.filter("_ends"), "node", up="parent")).union(fact(siblings.filter("_ends"), "parent", n_children="_at"))
    told = told.union(fact(siblings, "node", parent_conv="parent_conv"))
    told = told.groupBy("node").agg(*[F.max(f).alias(f) for f in facts])
    nodes = nodes.join(told, "node", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("bytes"),
        "leaf": F.col("first").isNull().cast("long"),
    })
    nodes = written(nodes.drop("q1", "q2", "bytes"), "tour-nodes")

    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    none = F.lit(0).cast("long")
    both = F.array(
        F.struct(enter("node").alias("arc"), F.coalesce(enter("first"), leave("node")).alias("next"), F.col("leaf").alias("w1"), F.col("saving").alias("w2")),
        F.struct(leave("node").alias("arc"), F.coalesce(enter("following"), leave("up")).alias("next"), none.alias("w1"), none.alias("w2")),
    )
    sums = ranked(nodes.select(F.explode(both).alias("a")).select("a.*"), stretch)
    side = lambda w: F.max(F.when(F.col("arc") % 2 == 1, F.col(w))) - F.max(F.when(F.col("arc") % 2 == 0, F.col(w)))
    sums = sums.groupBy(F.expr("arc div 2").alias("node")).agg(side("w1").alias("below"), side("w2").alias("saved_below"))
    nodes = nodes.join(sums, "node").join(ends_digests(paths, convs), ["depth", "p1", "p2"], "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf") + F.col("below")).alias("n_leaves"), (F.col("saving") + F.col("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
