"""RSS and Atom bodies with Spark's own XML reader."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from gleaner.functions import values as v
from gleaner.functions.text import let

_RSS = (
    "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING>>>, "
    "_corrupt_record STRING"
)
_ATOM = (
    "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, "
    "summary: STRING>>, _corrupt_record STRING"
)
_OPTIONS = {"columnNameOfCorruptRecord": "_corrupt_record"}

_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}
# entity names of HTML 4, by the standard library's table
_ENTITIES = {f"&{name};": chr(code) for name, code in sorted(name2codepoint.items()) if name not in _XML_NAMES}
_XML = rf"(?:{'|'.join(sorted(_XML_NAMES))})"
_NAMED = rf"&(?!{_XML};)[A-Za-z][A-Za-z0-9]*;"


def lenient(body: Column) -> Column:
    """A body that Spark's XML reader accepts where only its entities or control
    characters are wrong: names of HTML entities become characters, any other
    ampersand that starts no entity is taken as text, control characters go."""
    # one literal after constant folding; pieces start with a name, all but the first
    known = F.str_to_map(F.lit("\x01".join(f"{name}\x02{char}" for name, char in _ENTITIES.items())), F.lit("\x01"), F.lit("\x02"))

    def named(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&[A-Za-z][A-Za-z0-9]*;", 0)
        return F.concat(F.coalesce(F.element_at(known, name), name), F.substr(piece, F.length(name) + 1))

    some = F.when(body.rlike(_NAMED), F.array_join(F.transform(F.split(body, f"(?={_NAMED})"), named), "")).otherwise(body)
    bare = rf"&(?!(?:{_XML}|#[0-9]{{1,7}}|#x[0-9A-Fa-f]{{1,6}});)"
    return F.regexp_replace(F.regexp_replace(some, bare, "&amp;"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def _item(i: Column, link: Column, title: Column, description: Column) -> Column:
    trimmed = F.trim(F.coalesce(title, F.lit("")))
    return F.struct(
        i.alias("ord"),
        F.coalesce(F.trim(link), F.lit("")).alias("link_url"),
        F.when(trimmed != "", trimmed)
        .otherwise(F.coalesce(F.trim(description), F.lit("")))
        .alias("caption"),
    )


def _result(doc: Column, items: Column) -> Column:
    none = F.array()
    return F.when(
        doc._corrupt_record.isNotNull(),
        F.struct(
            none.cast("array<struct<ord: int, link_url: string, caption: string>>").alias("items"),
            F.array(F.lit(v.MSG_BAD_FEED)).alias("messages"),
        ),
    ).otherwise(
        F.struct(
            F.coalesce(
                items, none.cast("array<struct<ord: int, link_url: string, caption: string>>")
            ).alias("items"),
            none.cast("array<string>").alias("messages"),
        )
    )


def rss_items(body: Column) -> Column:
    """STRUCT<items, messages> of an RSS 0.9x or 2.0 body. Links stay as they
    are; the caption is the title, else the description."""
    return let(
        F.from_xml(lenient(body), F.lit(_RSS), _OPTIONS),
        lambda doc: _result(
            doc,
            F.transform(
                doc.channel.item,
                lambda e, i: _item(i, e.link, e.title, e.description),
            ),
        ),
    )


def atom_items(body: Column) -> Column:
    """STRUCT<items, messages> of an Atom body; the link is the first one with
    no `rel` or with rel="alternate"."""

    def link(e):
        usable = F.filter(e.link, lambda x: F.coalesce(x._rel, F.lit("alternate")) == "alternate")
        return F.get(usable, F.lit(0))._href

    return let(
        F.from_xml(lenient(body), F.lit(_ATOM), _OPTIONS),
        lambda doc: _result(
            doc,
            F.transform(doc.entry, lambda e, i: _item(i, link(e), e.title, e.summary)),
        ),
    )
