"""Removal of repeated substrings, by suffix sorting of shards.

A byte goes if it is covered by a string of `length` bytes that also starts
earlier (in a document of smaller id, or earlier in the same one). Strings don't
cross documents. The steps:

1. Texts that equal one of a smaller id go whole, without being looked at.
2. Every string of `length` bytes has an anchor: the `ANCHOR`-byte string with the
   least hash in it, the first of equal ones. Equal strings have the same anchor at
   the same place, so it is enough to compare the surroundings of equal anchors:
   what the strings with that anchor cover. They are dealt to shards by its hash.
3. Of equal surroundings the first keeps its place; the strings in all others
   start later, so these go whole. Tasks do so for their own blocks before they
   deal them out, so that passages that very many documents share arrive once a
   block. Anchors with one kind of surroundings are done.
4. The other surroundings, mostly edges of copies and of shared passages, are cut
   from the texts and laid end to end, a text for each shard, less those that share
   none of five strings around the anchor, of which an equal string has to hold one.
   The suffixes of that text are sorted by external induced sorting (induced.py). Neighbours in that order with
   a common prefix of `length` bytes are equal strings; the first stays.

Common prefixes are only asked for up to `length` bytes. They are taken from the
text for neighbours in the final order, and not carried through the queues.

Rules: a null text is an empty text. Rows with null ids lose nothing and are not compared.
Rows with equal ids and texts are one document, with one result each; several texts of one
id are documents in the order of their MD5 digests. Other columns of the input aren't
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, mix, rows_of, span_hashes, tidy, tidy_group, Block
from gleaner.llm.induced import suffix_order
from gleaner.sources.tables import broadcast_if_small, written

LENGTH, ANCHOR = 100, 32
SHARD_BYTES, BLOCK_BYTES, STEPS = 3 << 20, 1 << 20, 5
SMALL = 64 << 20

_BLOBS = "shard int, doc binary, at binary, left binary, right binary, anchor binary, around binary"
_TYPES = {"doc": "<i8", "at": "<i4", "left": "<u2", "right": "<u2", "anchor": "<u8", "around": "<u8"}


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """least(values[i : i + width]) for all i, by doubling."""
    have = 1
    n = len(values) - width + 1
    while have * 2 <= width:
        values = least(values[: len(values) - have], values[have:])
        have *= 2
    return least(values[:n], values[width - have : width - have + n])


def anchors(block: Block, length: int, size: int) -> dict[str, np.ndarray]:
    """Anchors of a block's strings: row, place in the document, how far what its
    strings cover reaches to the left and (from the place) to the right, the hash of
    the anchor, and a hash of the surroundings and the place in them."""
    data, offsets = block.data, block.offsets
    n = len(data) - size + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return {"row": none, **{k: none.astype(t) for k, t in _TYPES.items() if k != "doc"}}
    at = np.arange(n, dtype=np.int64)
    hashes = span_hashes(data, at, at + size)
    low = np.uint64(0xFFFFFFFF)
    owner = (_slide((hashes & ~low) | at.astype(np.uint64), length - size + 1, np.minimum) & low).astype(np.int64)
    begins = np.arange(len(owner))
    inside = np.flatnonzero(begins + length <= offsets[rows_of(begins, offsets) + 1])
    owner = owner[inside]
    cut = np.append(True, (np.diff(owner) != 0) | (np.diff(inside) != 1))[: len(owner)]
    heads = np.flatnonzero(cut)
    found = owner[heads]
    first, last = inside[heads], inside[np.append(heads[1:], len(owner)) - 1] + length
    row = rows_of(found, offsets)
    around = mix(span_hashes(data, first, last) + (found - first).astype(np.uint64)) | np.uint64(1)
    return {"row": row, "at": found - offsets[row], "left": found - first, "right": last - found, "anchor": hashes[found], "around": around}


def first_of_each(doc: np.ndarray, at: np.ndarray, anchor: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor and surroundings, then place; and where in it a new kind of surroundings begins."""
    order = np.lexsort((at, doc, around, anchor))
    a, b = anchor[order], around[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]


def _dealt(shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per shard, with its part of each column as bytes."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)).tolist()
    arrays = [pa.array(shard[cuts[:-1]].astype(np.int32))]
    for c in columns:
        c = c[order]
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _BLOBS.split(", ")][: len(arrays)])


def _joined(table: pa.Table, name: str, kind: str = "<i8") -> np.ndarray:
    """A column of bytes as numbers."""
    return np.frombuffer(b"".join(x.as_py() for x in table[name]), kind)


def _places(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Document, place, reach to the left and to the right, as 64-bit numbers."""
    return tuple(_joined(table, k, _TYPES[k]).astype(np.int64) for k in ("doc", "at", "left", "right"))


_SPANS = "shard int, edge boolean, doc binary, at binary, left binary, right binary"


def _span_table(shard: int, edge: bool, *columns: np.ndarray) -> pa.Table:
    blobs = {k: pa.array([c.astype(_TYPES[k] if edge else "<i8").tobytes()], pa.binary()) for k, c in zip(("doc", "at", "left", "right"), columns, strict=True)}
    return pa.table({"shard": pa.array([shard], pa.int32()), "edge": pa.array([edge]), **blobs})


def compare_surroundings(rows: DataFrame, shards: int, length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """Spans as bytes: `edge` false: they go whole; true: the first of their
    kind where an anchor has several kinds. `rows`: id, text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1), BLOCK_BYTES):
                found = anchors(b, length, size)
                doc = ids[b.lo : b.hi][found["row"]].astype("<i8")
                order, new = first_of_each(doc, found["at"], found["anchor"], found["around"])
                # later ones of a kind go with a mark instead of their hash
                around = found["around"].copy()
                around[order[~new]] = 0
                shard = (found["anchor"] >> np.uint64(20)) % np.uint64(shards)
                columns = found | {"doc": doc, "around": around}
                yield from _dealt(shard, [columns[k].astype(t) for k, t in _TYPES.items()])

    def compare(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        doc, at, left, right = _places(table)
        anchor, around = _joined(table, "anchor", "<u8"), _joined(table, "around", "<u8")
        later = around == 0
        gone = [np.flatnonzero(later)]
        rest = np.flatnonzero(~later)
        order, new = first_of_each(doc[rest], at[rest], anchor[rest], around[rest])
        order = rest[order]
        gone.append(order[~new])
        first = order[new]
        a = anchor[first]
        several = np.zeros(len(first), bool)
        same = a[1:] == a[:-1]
        several[1:] |= same
        several[:-1] |= same
        gone, edges = np.concatenate(gone), first[several]
        doc_, start, end = joined_runs(doc[gone], at[gone] - left[gone], at[gone] + right[gone])
        none = np.zeros(len(doc_), np.int64)
        return pa.concat_tables([_span_table(shard, False, doc_, start, none, end - start), _span_table(shard, True, doc[edges], at[edges], left[edges], right[edges])])

    return rows.mapInArrow(tidy(find), _BLOBS).groupBy("shard").applyInArrow(tidy_group(compare), _SPANS)


def joined_runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those that overlap or touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    other = np.append(True, doc[1:] != doc[:-1])
    rank = np.cumsum(other) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * wide) - rank * wide
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def edges_by_document(found: DataFrame) -> DataFrame:
    """id, cuts: (shard, place, left, right) of the document's edges as bytes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column(0).to_pylist()):
                doc, at, left, right = _places(pa.table(batch.slice(i, 1).columns, names=batch.schema.names))
                order = np.argsort(doc, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(doc[order]) != 0)), len(doc)).tolist() if len(doc) else [0]
                four = np.stack([np.full(len(doc), shard), at, left, right], axis=1)[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[order][cuts[:-1]]), pa.array([four[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["id", "cuts"]
                )

    rows = found.filter("edge").drop("edge").mapInArrow(tidy(spread), "id long, cuts binary")
    return rows.groupBy("id").agg(F.array_join(F.collect_list(F.hex("cuts")), "").alias("cuts")).select("id", F.unhex("cuts").alias("cuts"))


def sort_shards(rows: DataFrame, edges: DataFrame, length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """Spans as bytes: the strings of the edges that also start earlier."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                parts = []
                for i in range(b.lo, b.hi):
                    four = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(-1, 4).astype(np.int64)
                    own = np.broadcast_to([b.offsets[i - b.lo], ids[i]], (len(four), 2))
                    parts.append(np.concatenate([four, own], axis=1))
                parts = np.concatenate(parts)
                shard, at, left, right, base, doc = parts[np.argsort(parts[:, 0], kind="stable")].T
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(shard) != 0)), len(shard)).tolist()
                raw, place = b.data.tobytes(), base + at
                text = [b"".join([raw[x:y] for x, y in zip((place - left)[p:q].tolist(), (place + right)[p:q].tolist(), strict=True)]) for p, q in zip(cuts, cuts[1:], strict=False)]
                columns = {"doc": doc, "at": at, "left": left, "right": right}
                blobs = [pa.array([c[p:q].astype(_TYPES[k]).tobytes() for p, q in zip(cuts, cuts[1:], strict=False)], pa.binary()) for k, c in columns.items()]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), *blobs, pa.array(text, pa.binary())], names=["shard", *columns, "text"])

    def later(table: pa.Table) -> pa.Table:
        doc, at, left, right = _places(table)
        text = _joined(table, "text", "u1")
        kept = may_repeat(text, left, right, length, size)
        d, p = repeated_strings(text[np.repeat(kept, left + right)], doc[kept], (at - left)[kept], (at + right)[kept], length)
        d, start, end = joined_runs(d, p, p + length)
        return _span_table(table["shard"][0].as_py(), False, d, start, np.zeros(len(d), np.int64), end - start)

    kind = "shard int, doc binary, at binary, left binary, right binary, text binary"
    return rows.join(edges, "id").mapInArrow(tidy(cut), kind).groupBy("shard").applyInArrow(tidy_group(later), _SPANS)


def may_repeat(text: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which segments share one of the strings around their anchor. A string of
    `length` bytes with the anchor in it reaches so far to its left or right that
    it holds one of them."""
    anchor = np.cumsum(left + right) - right  # its place in the text
    step = max(1, (length - size) // STEPS)
    out = np.zeros(len(left), bool)
    for more in range(0, length - size + 1, step):
        rest = size + max(0, length - size - more - step)
        inside = np.flatnonzero((left >= more) & (right >= rest))
        hashes = span_hashes(text, anchor[inside] - more, anchor[inside] + rest)
        _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        out[inside] |= counts[which] > 1
    return out


def repeated_strings(text: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each string of `length` bytes in the segments that
    starts earlier in another segment. `text`: the segments' bytes, end to end."""
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    # bytes are 2 to 257, 1 stands after each segment, 0 at the end
    ends = first + sizes
    symbols = np.append(np.insert(text.astype(np.int32) + 2, ends, 1), 0)
    first = first + np.arange(len(first))
    order = suffix_order(symbols)
    place = np.full(len(symbols), -1, np.int64)  # segment of each string that fits in
    fits = np.maximum(sizes - length + 1, 0)
    inside = np.repeat(first, fits) + np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    place[inside] = np.repeat(np.arange(len(first)), fits)
    order = order[place[order] >= 0]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none
    padded = np.append(symbols[:-1], np.zeros(length, np.int32))
    windows = np.lib.stride_tricks.sliding_window_view(padded.astype("<u2"), length)
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), 8192):
        hi = min(lo + 8192, len(order))
        same[lo:hi] = (windows[order[lo:hi]] == windows[order[lo - 1 : hi - 1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    d, p = doc[place[order]], start[place[order]] + order - first[place[order]]
    by = np.lexsort((p, d, group))
    g, d, p = group[by], d[by], p[by]
    # the first place of each string, which may be in several segments, stays
    head = np.append(True, g[1:] != g[:-1])
    leader = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    later = (d != d[leader]) | (p != p[leader])
    return d[later], p[later]


def merged_spans(found: DataFrame, shards: int) -> DataFrame:
    """id, spans: start and end of the maximal removed runs of each document, as bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, start, size = (np.frombuffer(row[c], "<i8") for c in ("doc", "at", "right"))
                yield from _dealt(mix(doc.astype(np.uint64)) % np.uint64(shards), [doc, start, start + size])

    def merge(table: pa.Table) -> pa.Table:
        ids, start, end = joined_runs(*(_joined(table, c) for c in ("doc", "at", "left")))
        pairs = np.stack([start, end], axis=1)
        cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)).tolist()
        return pa.table({"id": pa.array(ids[cuts[:-1]]), "spans": pa.array([pairs[a:b].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    kind = "shard int, doc binary, at binary, left binary"  # here left is the end
    return found.select("doc", "at", "right").mapInArrow(tidy(deal), kind).groupBy("shard").applyInArrow(tidy_group(merge), "id long, spans binary")


def with_sums(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of `docs` as id and text, with the digest of the text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("sum", F.unhex(F.md5(F.col("text").cast("binary"))))


def numbers(sums: DataFrame) -> DataFrame | None:
    """id, sum, number: numbers in the order of id and digest, if an id has several texts."""
    if sums.groupBy("id").agg((F.min("sum") != F.max("sum")).alias("clash")).filter("clash").isEmpty():
        return None
    order = sums.select("id", "sum").distinct().repartitionByRange("id", "sum").sortWithinPartitions("id", "sum")
    return written(order.withColumn("number", F.monotonically_increasing_id()), "numbers")


def numbered(rows: DataFrame, order: DataFrame | None) -> DataFrame:
    """`rows` (id, sum, ...) with numbers as ids, where there are such."""
    if order is None:
        return rows
    joined = rows.join(broadcast_if_small(order, SMALL), ["id", "sum"], "left")
    return joined.withColumn("id", F.col("number")).drop("number")


def removed_spans(rows: DataFrame, sums: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents that go whole (id), and the spans of the others (id, spans). `rows`: id, text; `sums`: id, sum, n."""
    repeated = written(sums.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    rows = rows.filter(F.octet_length("text") >= length)
    long = sums.filter(F.col("n") >= length)
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["id"])
    total = long.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    kinds = long.groupBy("sum", "n").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most")
    copies = long.join(broadcast_if_small(written(kinds.drop("most"), "kinds"), SMALL), ["sum", "n"]).filter("id != least").select("id").distinct()
    copies = written(copies, "copies")
    rows = rows.join(broadcast_if_small(copies, SMALL), "id", "left_anti")
    size = min(ANCHOR, length // 2)
    found = written(compare_surroundings(rows, shards, length, size), "surroundings")
    edges = written(edges_by_document(found), "edges")
    later = sort_shards(rows, broadcast_if_small(edges, SMALL), length, size)
    return copies, written(merged_spans(found.filter("not edge").unionByName(later), shards), "spans")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    rows = with_sums(docs, text, key)
    sums = written(rows.filter("id is not null").select("id", "sum", F.octet_length("text").alias("n")), "sums")
    order = numbers(sums)
    if order is not None:
        sums = written(numbered(sums, order), "numbered-sums")
    own = numbered(rows.filter("id is not null"), order).select("id", "text")
    copies, spans = removed_spans(own, sums, length, shard_bytes)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found, copy in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = raw.as_py().encode() if raw.is_valid else b""
                pairs = [[0, len(raw)]] if copy.is_valid else np.frombuffer(found.as_py(), "<i8").reshape(-1, 2).tolist() if found.is_valid else []
                at, kept = 0, []
                for a, b in pairs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((len(raw), sum(b - a for a, b in pairs), len(pairs), hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    if order is None:
        rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("id"))
    else:
        rows = numbered(rows.withColumn("doc_id", F.col("id").cast(kind)), order)
    rows = rows.withColumn("long_id", F.when(F.octet_length("text") >= length, F.col("id")))
    rows = rows.join(broadcast_if_small(spans.withColumnRenamed("id", "long_id"), SMALL), "long_id", "left").join(
        broadcast_if_small(copies.select(F.col("id").alias("long_id"), F.lit(1).alias("copy")), SMALL), "long_id", "left"
    )
    return rows.select("doc_id", "text", "spans", "copy").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
