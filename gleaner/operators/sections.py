"""Digest bodies as ordered rows.

A body is a table of text fragments with sort keys, not one string: the digest
of a run grows with the sources, and one row must not. Joined by newlines in the
order of their keys the fragments are the body; `write_body` does that with a
distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import values as v
from gleaner.functions.text import escape_href, escape_html

KEYS = ["part", "src_ord", "line", "ord"]
_HEAD, _SECTIONS, _TAIL = 0, 1, 2


def overview(n_items: Column, messages: Column) -> Column:
    """Opening words of a section: only empty sections get any."""
    return F.when(
        n_items == 0, F.concat(F.lit(v.NO_LINKS), F.array_join(messages, " "))
    ).otherwise("")


def sections(sources: DataFrame, items: DataFrame) -> DataFrame:
    """`src, src_ord, name, n_items, overview` of every source, also of those
    without items. `sources` has `src, src_ord, name, messages`."""
    counts = items.groupBy("src").agg(F.count("*").alias("n_items"))
    joined = sources.join(counts, "src", "left").withColumn(
        "n_items", F.coalesce("n_items", F.lit(0))
    )
    return joined.select(
        "src", "src_ord", "name", "n_items", overview(F.col("n_items"), F.col("messages")).alias("overview")
    )


def _layout(html: bool):
    if html:
        return (v.HTML_HEAD, v.HTML_SECTION, v.HTML_ITEM, v.HTML_SECTION_END, v.HTML_TAIL, escape_href)
    return ("", v.TEXT_SECTION, v.TEXT_ITEM, "", "", escape_html)


def render(sections: DataFrame, items: DataFrame, html: bool = True) -> DataFrame:
    """Fragments `part, src_ord, line, ord, body` of a digest. `items` has
    `src_ord, ord, link_url, caption`."""
    head, section, item, end, tail, url = _layout(html)
    spark = sections.sparkSession

    def fragment(df, part, src_ord, line, ord_, body):
        return df.select(
            F.lit(part).alias("part"),
            src_ord.cast("bigint").alias("src_ord"),
            F.lit(line).alias("line"),
            ord_.cast("bigint").alias("ord"),
            body.alias("body"),
        )

    zero = F.lit(0)
    frame = spark.range(1)
    c = F.col
    titles = fragment(
        sections,
        _SECTIONS,
        c("src_ord"),
        0,
        zero,
        F.format_string(section, escape_html(c("name")), escape_html(c("overview"))),
    )
    lines = fragment(
        items,
        _SECTIONS,
        c("src_ord"),
        1,
        c("ord"),
        F.format_string(item, escape_html(c("caption")), url(c("link_url"))),
    )
    ends = fragment(sections, _SECTIONS, c("src_ord"), 2, zero, F.lit(end))
    return (
        fragment(frame, _HEAD, zero, 0, zero, F.lit(head))
        .unionByName(titles)
        .unionByName(lines)
        .unionByName(ends)
        .unionByName(fragment(frame, _TAIL, zero, 0, zero, F.lit(tail)))
    )


def write_body(fragments: DataFrame, path: str) -> None:
    """Write a body as text files; in name order they are the body."""
    fragments.orderBy(*KEYS).select("body").write.mode("overwrite").text(path)


def print_body(fragments: DataFrame, write=print) -> None:
    """Write a body to a console instead of a folder, one partition at a time."""
    for row in fragments.orderBy(*KEYS).toLocalIterator():
        write(row["body"])


def extract_items(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Item elements found in bodies, one row each."""
    keep = [c for c in bodies.columns if c != body_col]
    found = F.regexp_extract_all(F.col(body_col), F.lit(v.ITEM_IN_BODY), F.lit(1))
    rows = bodies.select(*keep, F.explode_outer(found).alias("item"))
    return rows.filter(F.col("item").isNotNull())


def digests_since(digests: DataFrame, since) -> DataFrame:
    """Digests created at `since` or later."""
    return digests.filter(F.col("created") >= since)
