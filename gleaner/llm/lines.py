"""Line dedup by a log-template tree, in DataFrame operations only.

A line's words are its runs of characters other than blanks, tabs, carriage
returns, form feeds and vertical tabs; words with a digit become `<*>`. The tree
has a fixed depth: number of words, then the leading `DEPTH` words. In each leaf
that shows up in enough documents, the most frequent word of every place makes
the leaf's template; a line with at least `SIMILAR` of its words in these places
belongs to it, and the places where such lines differ are its variable fields.
Any other line is a template of its own, with `<*>` for its words with digits.

A leaf may hold several templates. Of its lines whose template doesn't recur, the
words that are frequent at their place are taken as fixed; lines with the same fixed words
are one template, if these, the leading words and the `<*>` are `SIMILAR` of all. What is
still left is tried with one fixed word fewer, as a field may have frequent values: a line
joins a template found before, or goes to the one that most documents left share. Each of these steps is one
grouping, so the number of jobs doesn't depend on the lines.

A template found in `min_docs` documents or more recurs; a line of `long_words` words or more
recurs if it is found word for word, digits too, in `long_docs`. The document of the
smallest id keeps its lines of that template, all other documents lose theirs:
nothing vanishes altogether, and copies of a text don't wipe each other out.

Rules: null ids and null texts pass unchanged and count nowhere; lines without
words are kept; rows with equal id and text count once and change alike; rows
with equal ids and other texts are the same document when documents are counted.
Columns of the input other than the text stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import let
from gleaner.sources.tables import SMALL, broadcast_if_small, measured_bytes, written

DEPTH, SIMILAR, MIN_DOCS = 3, 0.7, 8
LONG_DOCS, LONG_WORDS = 2, 50

_BLANKS = " \t\r\f\x0B"


def spaced(line: Column) -> Column:
    """The words of a line with one blank between them. Most lines are so already, and
    byte searches tell that for less than a pattern does."""
    other = reduce(Column.__or__, [F.contains(line, F.lit(blank)) for blank in ["  ", *_BLANKS[1:]]])
    return F.when(other, F.regexp_replace(F.btrim(line, F.lit(_BLANKS)), rf"[{_BLANKS}]+", " ")).otherwise(F.trim(line))


def n_words(spaced_line: Column) -> Column:
    """Words of a line as `spaced` gives it, one at least."""
    return F.octet_length(spaced_line) - F.octet_length(F.replace(spaced_line, F.lit(" "), F.lit(""))) + 1


def masked(line: Column) -> Column:
    """A line with `<*>` for its words with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"[^{_BLANKS}0-9]*+[0-9][^{_BLANKS}]*+", "<*>")).otherwise(line)


def spaced_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """__id, __sum (of the text), _at, _line (as `spaced` gives it) of each line. Hashing and
    respacing come before lines become rows: rows then carry no text, and filters on them
    don't respace once more (nor does one that Spark would infer without `outer`)."""
    lines = F.transform(F.split(F.col(text), "\n", -1), spaced)
    texts = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__sum"), lines.alias("__lines")
    )
    return texts.select("__id", "__sum", F.posexplode_outer("__lines").alias("_at", "_line"))


def line_table(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """__id, __sum (of the text), _at, _line (masked, spaced), _leaf (a hash) of each line with words."""
    lines = spaced_lines(docs, text, key).filter("_line != ''").withColumn("_line", masked(F.col("_line")))
    return lines.withColumn("_leaf", F.xxhash64(n_words(F.col("_line")), F.substring_index("_line", " ", depth)))


def leaf_templates(lines: DataFrame) -> DataFrame:
    """_leaf, _places: the most frequent word of each place (ties: the smaller
    word), for leaves that hold several lines."""
    counted = (
        lines.filter("_several")
        .select("_leaf", F.posexplode("_words").alias("_place", "_word"))
        .groupBy("_leaf", "_place", "_word")
        .count()
    )
    most = counted.groupBy("_leaf", "_place").agg(F.min(F.struct(-F.col("count"), F.col("_word"))).alias("_most"))
    return most.groupBy("_leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_most"))), lambda x: x["_most"]["_word"]).alias("_places"))


def shared_leaves(lines: DataFrame, min_docs: int) -> DataFrame:
    """_leaf, _several (whether its lines differ) of leaves with lines of enough documents."""
    per_document = lines.groupBy("_leaf", "__id").agg(F.min("_line").alias("_low"), F.max("_line").alias("_high"))
    return (
        per_document.groupBy("_leaf").agg(F.count("*").alias("_docs"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        .filter(F.col("_docs") >= min_docs)
        .select("_leaf", (F.col("_low") != F.col("_high")).alias("_several"))
    )


LINE = ["__id", "__sum", "_at"]
SALTS = 16


def join_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Each line with the template of its leaf. Beyond the size of a broadcast, a leaf's lines
    are dealt out by salts, as one leaf may hold a third of them."""
    if measured_bytes(templates) <= SMALL:
        return lines.join(F.broadcast(templates), "_leaf", "left")
    salted = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64(*LINE), F.lit(SALTS)).cast("int")).join(salted, ["_leaf", "_salt"], "left").drop("_salt")


def recurring(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR, long_docs: int | None = LONG_DOCS, long_words: int = LONG_WORDS) -> DataFrame:
    """__id, __sum, __drop: places of the lines that a text loses. `long_docs`: in so
    many documents an equal line of `long_words` words or more recurs (None: no such rule)."""
    lines = line_table(docs, text, key, depth)
    shared = written(shared_leaves(lines.select("_leaf", F.xxhash64("_line").alias("_line"), "__id"), min_docs), "leaves")
    lines = lines.join(broadcast_if_small(shared), "_leaf").withColumn("_words", F.split("_line", " ")).drop("_line")
    lines = written(lines, "lines")
    joined = join_templates(lines, written(leaf_templates(lines), "modes"))
    same = F.size(F.filter(F.zip_with("_words", "_places", lambda a, b: a == b), lambda x: x))
    member = ~F.col("_several") | (same >= F.lit(similar) * F.size("_words"))
    own = F.when(member, F.lit(0)).otherwise(F.xxhash64("_words"))
    found = written(joined.select(*LINE, "_leaf", own.alias("_own"), F.when(F.col("_several"), F.col("_words")).alias("_words")), "templates")
    recurs = written(in_enough(found, ["_leaf", "_own"], min_docs), "recurring")
    rest = found.filter("_words is not null").join(broadcast_if_small(recurs.select("_leaf", "_own")), ["_leaf", "_own"], "left_anti")
    drops = [later(found, recurs, ["_leaf", "_own"]), *further_templates(rest.drop("_own"), min_docs, depth, similar)]
    if long_docs:
        drops.append(repeated_long_lines(docs, text, key, long_words, long_docs))
    dropped = reduce(DataFrame.unionByName, drops)
    return written(dropped.groupBy("__id", "__sum").agg(F.collect_set("_at").alias("__drop")), "drops")


def in_enough(found: DataFrame, template: list[str], min_docs: int, kept: str = "_first") -> DataFrame:
    """Templates found in enough documents, with the first of these (or their number, _docs)."""
    return (
        found.groupBy(*template, "__id").agg(F.lit(1).alias("_one"))
        .groupBy(*template).agg(F.count("*").alias("_docs"), F.min("__id").alias("_first"))
        .filter(F.col("_docs") >= min_docs)
        .select(*template, kept)
    )


def later(found: DataFrame, recurs: DataFrame, template: list[str]) -> DataFrame:
    """__id, __sum, _at of lines outside the first document of their template."""
    return found.join(broadcast_if_small(recurs), template).filter(F.col("__id") != F.col("_first")).select("__id", "__sum", "_at")


def further_templates(rest: DataFrame, min_docs: int, depth: int, similar: float) -> list[DataFrame]:
    """Lines to drop by further templates of a leaf: by all words that are frequent at their
    place, then by all but one of them."""
    rest = written(rest.dropDuplicates(LINE), "lines-left")
    masks = F.size(F.filter(F.slice("_words", depth + 1, F.size("_words")), lambda w: w == "<*>"))
    words_of = rest.select(*LINE, "_leaf", F.size("_words").alias("_n"), (masks + depth).alias("_sure"), F.posexplode("_words").alias("_place", "_word"))
    words_of = words_of.filter((F.col("_place") >= depth) & (F.col("_word") != "<*>"))
    frequent = words_of.groupBy("_leaf", "_place", "_word").count().filter(F.col("count") >= min_docs)
    frequent = written(frequent.select("_leaf", "_place", "_word", F.xxhash64("_place", "_word").alias("_hash")), "frequent")
    fixed = words_of.join(broadcast_if_small(frequent), ["_leaf", "_place", "_word"], "left")
    one = F.when(F.col("_hash").isNotNull(), F.struct("_place", "_hash"))
    parts = fixed.groupBy(*LINE, "_leaf", "_n", "_sure").agg(F.bit_xor(F.coalesce("_hash", F.lit(0))).alias("_own"), F.collect_list(one).alias("_fixed"))
    alike = lambda fewer: F.col("_sure") + F.size("_fixed") - fewer >= F.lit(similar) * F.col("_n")
    parts = written(parts.filter(alike(0)), "parts")
    recurs = written(in_enough(parts, ["_leaf", "_own"], min_docs), "recurring")

    left = parts.filter(alike(1)).join(broadcast_if_small(recurs.select("_leaf", "_own")), ["_leaf", "_own"], "left_anti")
    fewer = left.select(*LINE, "_leaf", "_own", F.explode("_fixed").alias("_one"))
    fewer = fewer.select(*LINE, "_leaf", F.col("_one._place").alias("_place"), F.col("_own").bitwiseXOR(F.col("_one._hash")).alias("_own"))
    fewer = written(fewer, "parts-left")
    joins = fewer.join(broadcast_if_small(recurs), ["_leaf", "_own"]).select(*LINE, "_first")
    fewer = fewer.join(broadcast_if_small(joins.select(*LINE).distinct()), LINE, "left_anti")
    shared = written(in_enough(fewer, ["_leaf", "_place", "_own"], min_docs, "_docs"), "shared")
    most = F.max(F.struct("_docs", -F.col("_place"), "_own")).alias("_most")
    picked = fewer.join(broadcast_if_small(shared), ["_leaf", "_place", "_own"]).groupBy(*LINE, "_leaf").agg(most)
    picked = written(picked.select(*LINE, "_leaf", (-F.col("_most.col2")).alias("_place"), F.col("_most._own").alias("_own")), "picked")
    again = in_enough(picked, ["_leaf", "_place", "_own"], min_docs)
    joined = joins.filter("__id != _first").select(*LINE)
    return [later(parts, recurs, ["_leaf", "_own"]), joined, later(picked, again, ["_leaf", "_place", "_own"])]


def repeated_long_lines(docs: DataFrame, text: str, key: str, least_words: int, min_docs: int) -> DataFrame:
    """__id, __sum, _at of long lines that equal a line of an earlier document word
    for word, numbers too, and stand in enough documents."""
    line = F.col("_line")
    lines = spaced_lines(docs, text, key).filter((F.octet_length(line) >= 2 * least_words - 1) & (n_words(line) >= least_words))
    lines = lines.select("__id", "__sum", "_at", F.xxhash64(line).alias("_leaf"), F.xxhash64(F.lit(1), line).alias("_own"))
    lines = written(lines, "long-lines")
    return later(lines, written(in_enough(lines, ["_leaf", "_own"], min_docs), "recurring"), ["_leaf", "_own"])


def without(lines: Column, drop: Column) -> Column:
    """Lines but those at the places `drop`, joined."""
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform(drop, lambda x: x + 1))
    return F.array_join(F.transform(kept, lambda p: F.element_at(lines, p)), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", dropped: str = "n_dropped", **parameters) -> DataFrame:
    """All rows and columns of `docs`; the text without recurring lines, and the
    column `dropped` with their number (a column of that name is replaced)."""
    drops = recurring(docs, text, key, **parameters)
    rows = docs.withColumn("__sum", F.xxhash64(F.col(text)))
    joined = rows.join(broadcast_if_small(drops, 16 << 20), (rows[key] == drops["__id"]) & (rows["__sum"] == drops["__sum"]), "left").drop("__id", "__sum")
    # split once a text, not once a line of it
    rest = let(F.split(F.col(text), "\n", -1), lambda lines: without(lines, F.col("__drop")))
    return joined.withColumns({text: F.when(F.col("__drop").isNull(), F.col(text)).otherwise(rest), dropped: F.coalesce(F.size("__drop"), F.lit(0)).cast("long")}).drop("__drop")
