"""Fingerprints of documents that can be merged: threshold-scaled sketches.

Everything here is DataFrame functions, no Python runs in tasks.

A text's shingles are its runs of `SIZE` words in lower case (of a shorter text the
whole sequence; of one without words none). A sketch holds the distinct shingle hashes
in the lowest `1 / SCALE` of the 64-bit range, so that the sketch of a union is the
union of sketches, and shares of long and of short texts compare without bias, however
unequal they are. So that short texts compare as well, a sketch holds the `LEAST`
smallest hashes in any case; two sketches are compared below the lower of the bounds up
to which each is complete. A sketch of fewer than `LEAST` hashes is complete. The union
of two sketches, thinned by the same rule (`merge`), is the sketch of both texts together.

`digests` compares each document with itself after an edit and with the next one.

Rules: null texts are empty texts; documents without words have the empty sketch, which
is like itself (1) and unlike any other (0). Documents are ordered by id, equal ids
by the hash of their text, rows without id last; repeated rows follow one another, and each
of them but the last has its own text as the next. The only row of a table is its own
next. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.sources.tables import written

SIZE, SCALE, LEAST = 5, 8, 16
_LOWEST = -(1 << 63)
_BLANKS = r"[ \t\n\x0B\f\r]+"


def bound(scale: int = SCALE) -> int:
    """The largest signed hash that every sketch keeps."""
    return _LOWEST + (1 << 64) // scale - 1


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """Hashes of all shingles of a text, in their order."""
    words = F.transform(F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))
    # bound to a name once: lambdas would compute the words anew for each shingle
    runs = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(size)])
    )
    few = lambda w: F.array(F.aggregate(w, F.lit(0).cast("long"), lambda h, x: F.xxhash64(h, x)))
    hashed = F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, runs(w)).when(F.size(w) > 0, few(w)).otherwise(F.array().cast("array<long>")))
    return F.element_at(hashed, 1)


def thinned(hashes: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of an array of hashes, repeated ones included."""
    kept = lambda h: F.when(
        F.size(h[1]) >= least, F.array_sort(h[1])
    ).otherwise(F.slice(F.array_sort(h[0]), 1, least))
    low = F.transform(F.array(F.array_distinct(hashes)), lambda h: F.array(h, F.filter(h, lambda x: x <= F.lit(bound(scale)))))
    return F.element_at(F.transform(low, kept), 1)


def sketch(text: Column, size: int = SIZE, scale: int = SCALE, least: int = LEAST) -> Column:
    return thinned(shingle_hashes(text, size), scale, least)


def merge(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts together, from their sketches."""
    return thinned(F.concat(a, b), scale, least)


def complete_to(a: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Up to this hash a sketch holds all hashes of its text."""
    return F.when(F.size(a) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(a, -1), F.lit(bound(scale))))


def _shared(a: Column, b: Column, scale: int, least: int) -> Column:
    """Sizes, below the common bound: both, either, a, b."""
    upto = F.least(complete_to(a, scale, least), complete_to(b, scale, least))
    parts = F.transform(F.array(upto), lambda t: F.struct(F.filter(a, lambda x: x <= t).alias("a"), F.filter(b, lambda x: x <= t).alias("b")))
    sizes = F.transform(parts, lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("both"), F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b")))
    return F.element_at(sizes, 1)


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated shingles of both texts by shingles of either, 0 to 1."""
    n = _shared(a, b, scale, least)
    share = lambda n: F.when(n["a"] + n["b"] == 0, F.lit(1.0)).otherwise(n["both"] / (n["a"] + n["b"] - n["both"]))
    return F.element_at(F.transform(F.array(n), share), 1)


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated part of a's shingles that b has too, 0 to 1; 1 for an empty `a`."""
    n = _shared(a, b, scale, least)
    share = lambda n: F.when(n["a"] == 0, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(n["both"] / n["a"])
    return F.element_at(F.transform(F.array(n), share), 1)


def spelled(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


KEY = ["_none", "_id", "_sum", "_n"]


def neighbours(keys: DataFrame) -> DataFrame:
    """`keys` (KEY: distinct id and text) with the key of the one before, _before, in their
    order, the last one before the first.

    The order is by ranges; windows stay inside a range, and only the last key of each
    range goes on to the next."""
    ranges = written(keys.repartitionByRange(*KEY).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*KEY)
    inside = ranges.withColumn("_before", F.lag(key).over(Window.partitionBy("_range").orderBy(*KEY)))
    # one row for each range
    last = ranges.groupBy("_range").agg(F.max(key).alias("_last"))
    everyone = Window.orderBy("_range")
    carried = F.coalesce(F.lag("_last").over(everyone), F.last("_last").over(everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = written(last.select("_range", carried.alias("_carried")), "range-ends")
    return inside.join(F.broadcast(last), "_range").withColumn("_before", F.coalesce("_before", "_carried")).drop("_range", "_carried")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and contained_edited, contained_next: the part of the document found there.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by
    the first as many of the next document (all, if it has fewer)."""
    # a missing id is a flag, so that keys compare by plain equality and texts move once for grouping and joins
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_id"), F.xxhash64("_text").alias("_sum"), F.length("_text").alias("_n"), "_text")
    order = written(neighbours(rows.groupBy(*KEY).agg(F.count("*").alias("_copies"))), "order")
    texts = rows.groupBy(*KEY).agg(F.first("_text").alias("_text")).join(order, KEY)

    # the part that the document before takes over
    before = [F.col(f"_before.{k}").alias(k) for k in KEY]
    head = texts.select(*before, F.expr("left(_text, _before._n div 2)").alias("_head"), sketch(F.col("_text"), size, scale, least).alias("_next"))
    pairs = texts.drop("_before").join(head, KEY).withColumn("_sketch", sketch(F.col("_text"), size, scale, least))
    pairs = pairs.select(*KEY, "_text", "_sketch", "_copies", F.struct(F.lit(1).cast("long").alias("times"), "_head", "_next").alias("_last"))
    # copies of a row follow one another: all but the last have their own text next
    own = F.struct((F.col("_copies") - 1).alias("times"), F.expr("left(_text, _n div 2)").alias("_head"), F.col("_sketch").alias("_next"))
    each = pairs.select("_none", "_id", "_n", "_text", "_sketch", F.explode(F.when(F.col("_copies") > 1, F.array(own, "_last")).otherwise(F.array("_last"))).alias("_with"))
    each = each.select("_none", "_id", "_n", "_sketch", F.concat(F.expr("left(_text, _n - _n div 2)"), F.col("_with._head")).alias("_edited"), F.col("_with._next").alias("_next"), F.col("_with.times").alias("_times"))
    each = each.withColumn("_edited_sketch", sketch(F.col("_edited"), size, scale, least))
    compared = lambda of: (of(F.col("_sketch"), F.col("_edited_sketch"), scale, least), of(F.col("_sketch"), F.col("_next"), scale, least))
    (near_edited, near_next), (in_edited, in_next) = compared(likeness), compared(containment)
    out = each.select(
        F.when(~F.col("_none"), F.col("_id")).alias(key), F.col("_n").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        spelled(F.col("_sketch")).alias("fingerprint"), spelled(F.col("_edited_sketch")).alias("edited_fingerprint"),
        near_edited.alias("near_edited"), near_next.alias("near_next"), in_edited.alias("contained_edited"), in_next.alias("contained_next"), "_times",
    )
    return out.withColumn("_", F.explode(F.expr("sequence(1L, _times)"))).drop("_", "_times")
