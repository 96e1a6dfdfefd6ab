"""CSS selectors as data.

A selector string becomes a struct column (`parse`), and `select` evaluates that
struct over a page's nodes. Selectors therefore may differ from row to row:
a million sources with a million selectors still make one plan.

Covered: `tag`, `*`, `#id`, `.class`, `[attr]` and `[attr=value]` with the
operators `=`, `!=`, `~=`, `|=`, `^=`, `$=`, `*=`, `:nth-of-type()`, `:nth-child()`,
`:nth-last-of-type()` and `:nth-last-child()` with a number, `odd`, `even` or `an+b`,
the first, last and only of both kinds, `:empty`, `:not()` and `:has()` with tag, id,
classes and attributes of one element, the combinators blank, `>`, `+`, `~`, and selector lists. Names may hold letters
beyond ASCII and escaped signs (`.wide\\:box`), but no escapes by number. Anything else
is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions.text import let
from gleaner.operators.links import is_element, node_at

_ESCAPE = r"\\[^0-9A-Fa-f\n\r\f]"
_IDENT = rf"-?(?:[A-Za-z_]|[^\x00-\x7F]|{_ESCAPE})(?:[A-Za-z0-9_-]|[^\x00-\x7F]|{_ESCAPE})*"
# of a sign that is not escaped itself
_BARE = r"(?<!\\)"
_VALUE = rf"(?:\"[^\"]*\"|'[^']*'|{_IDENT})"
_ATTRIBUTE = rf"\[\s*{_IDENT}\s*(?:[~|^$*!]?=\s*{_VALUE}\s*)?\]"
_PLACE = r"(?:odd|even|[+-]?[0-9]*n(?:\s*[+-]\s*[0-9]+)?|[+-]?[0-9]+)"
_MARK = rf"(?:#{_IDENT}|\.{_IDENT}|{_ATTRIBUTE})"
_PLAIN = rf"(?:(?:{_IDENT}|\*){_MARK}*+|{_MARK}++)"
_NESTED = rf":(?:not|has)\(\s*{_PLAIN}\s*\)"
_QUALIFIER = (
    rf"(?:{_MARK}|{_NESTED}|:nth-(?:last-)?(?:of-type|child)\(\s*{_PLACE}\s*\)"
    r"|:(?:first|last|only)-(?:of-type|child)|:empty)"
)
_COMPOUND = rf"(?:(?:{_IDENT}|\*){_QUALIFIER}*+|{_QUALIFIER}++)"
_BLANKS = r"[\t\n\f\r ]+"
_COMBINATOR = r"(?:\s*[>+~]\s*|\s+)"
_CHAIN = rf"{_COMPOUND}(?:{_COMBINATOR}{_COMPOUND})*+"
_LIST = rf"^\s*{_CHAIN}(?:\s*,\s*{_CHAIN})*+\s*$"

_PLAIN_FIELDS = (
    "tag: STRING, id: STRING, classes: ARRAY<STRING>, "
    "attrs: ARRAY<STRUCT<attr: STRING, op: STRING, value: STRING>>"
)
STEP = (
    f"STRUCT<comb: STRING, {_PLAIN_FIELDS}, "
    "nth: STRUCT<a: INT, b: INT>, child: STRUCT<a: INT, b: INT>, "
    "nth_end: STRUCT<a: INT, b: INT>, child_end: STRUCT<a: INT, b: INT>, empty: BOOLEAN, "
    f"nots: ARRAY<STRUCT<{_PLAIN_FIELDS}>>, has: ARRAY<STRUCT<{_PLAIN_FIELDS}>>>"
)


def is_valid(selector: Column) -> Column:
    return selector.rlike(_LIST)


def parse(selector: Column) -> Column:
    """Selector text as ARRAY<ARRAY<STEP>>: alternatives of steps from left to
    right. NULL for a missing or invalid selector."""
    # not split at commas, which values may hold
    alternatives = F.regexp_extract_all(selector, F.lit(rf"({_CHAIN})"), F.lit(1))
    return F.when(is_valid(selector), F.transform(alternatives, _chain))


def _chain(chain: Column) -> Column:
    parts = F.regexp_extract_all(
        chain, F.lit(rf"((?:{_COMBINATOR})?{_COMPOUND})"), F.lit(1)
    )
    return F.transform(parts, _step)


def _name(text: Column) -> Column:
    """A name without the backslashes of its escapes."""
    return F.regexp_replace(text, r"\\(.)", "$1")


def _attribute(a: Column) -> Column:
    """One selector in brackets."""

    def group(pattern, n=1):
        return F.regexp_extract(a, pattern, n)

    quoted = F.coalesce(
        F.nullif(group(r"=\s*\"([^\"]*)\"\s*\]$"), F.lit("")),
        F.nullif(group(r"=\s*'([^']*)'\s*\]$"), F.lit("")),
        _name(group(rf"=\s*({_IDENT})\s*\]$")),
    )
    return F.struct(
        F.lower(_name(group(rf"^\[\s*({_IDENT})"))).alias("attr"),
        group(rf"^\[\s*{_IDENT}\s*([~|^$*!]?=)").alias("op"),
        quoted.alias("value"),
    )


def _bare(text: Column) -> Column:
    # values in brackets are no classes
    return F.regexp_replace(text, _ATTRIBUTE, "")


def _plain(text: Column, bare: Column) -> list[Column]:
    """Tag, id, classes and attributes that an element has to have."""

    def first(pattern):
        return _name(F.nullif(F.regexp_extract(bare, pattern, 1), F.lit("")))

    classes = F.regexp_extract_all(bare, F.lit(rf"{_BARE}\.({_IDENT})"), F.lit(1))
    attributes = F.regexp_extract_all(text, F.lit(rf"({_ATTRIBUTE})"), F.lit(1))
    return [
        F.lower(first(rf"^({_IDENT})")).alias("tag"),
        first(rf"{_BARE}#({_IDENT})").alias("id"),
        F.transform(classes, _name).alias("classes"),
        F.transform(attributes, _attribute).alias("attrs"),
    ]


def _step(part: Column) -> Column:
    def nested(kind):
        pattern = rf"{_BARE}:{kind}\(\s*({_PLAIN})\s*\)"
        found = F.regexp_extract_all(part, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda t: let(_bare(t), lambda bare: F.struct(*_plain(t, bare))))

    # what stands in :not() and :has() is looked at on its own
    own = F.regexp_replace(F.regexp_replace(part, _BARE + _NESTED, ""), r"^\s*[>+~]?\s*", "")
    comb = F.trim(F.regexp_extract(part, r"^(\s*[>+~]?\s*)", 1))

    def place(bare, kind, end=False):
        counted = f"last-{kind}" if end else kind
        text = F.regexp_replace(F.regexp_extract(bare, rf"{_BARE}:nth-{counted}\(\s*({_PLACE})\s*\)", 1), r"\s", "")
        only = f"{_BARE}:(?:only|{'last' if end else 'first'})-{kind}(?![A-Za-z0-9_-])"
        return let(text, lambda text: F.when(bare.rlike(only), pair(F.lit(0), F.lit(1))).otherwise(formula(text)))

    def pair(a, b):
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def formula(text):
        step, rest = F.regexp_extract(text, "^([+-]?[0-9]*)n", 1), F.regexp_extract(text, "n([+-][0-9]+)$", 1)
        a = F.when(step.isin("", "+"), 1).when(step == "-", -1).otherwise(step.try_cast("int"))
        return (
            F.when(text == "odd", pair(F.lit(2), F.lit(1)))
            .when(text == "even", pair(F.lit(2), F.lit(0)))
            .when(F.contains(text, F.lit("n")), pair(a, F.coalesce(rest.try_cast("int"), F.lit(0))))
            .when(text != "", pair(F.lit(0), text.try_cast("int")))
        )

    def whole(own, bare):
        return F.struct(
            comb.alias("comb"),
            *_plain(own, bare),
            place(bare, "of-type").alias("nth"),
            place(bare, "child").alias("child"),
            place(bare, "of-type", end=True).alias("nth_end"),
            place(bare, "child", end=True).alias("child_end"),
            bare.rlike(_BARE + ":empty").alias("empty"),
            nested("not").alias("nots"),
            nested("has").alias("has"),
        )

    return let(own, lambda own: let(_bare(own), lambda bare: whole(own, bare)))


def matches_attribute(have: Column, a: Column) -> Column:
    """Whether an attribute value (NULL if absent) fits; empty values never fit
    the operators that look for a part."""
    part = a.value != ""
    return F.coalesce(
        F.when(a.op == "", have.isNotNull())
        .when(a.op == "=", have == a.value)
        .when(a.op == "!=", have.isNull() | (have != a.value))
        .when(a.op == "^=", part & F.startswith(have, a.value))
        .when(a.op == "$=", part & F.endswith(have, a.value))
        .when(a.op == "*=", part & F.contains(have, a.value))
        .when(a.op == "~=", part & F.array_contains(F.split(have, _BLANKS), a.value))
        .when(a.op == "|=", (have == a.value) | F.startswith(have, F.concat(a.value, F.lit("-")))),
        F.lit(False),
    )


def in_place(place: Column, number: Column) -> Column:
    """Whether a place, counted from 1, is one of an + b."""
    off = number - place.b
    return (
        F.when(place.isNull(), True)
        .when(place.a == 0, off == 0)
        .otherwise((off % place.a == 0) & (off * F.signum(place.a) >= 0))
    )


def _classes(n: Column) -> Column:
    return F.split(F.coalesce(F.element_at(n.attrs, "class"), F.lit("")), _BLANKS)


def matches_plain(n: Column, x: Column) -> Column:
    """Whether an element has the tag, id, classes and attributes that are asked for."""
    return (
        (x.tag.isNull() | (n.tag == x.tag))
        & is_element(n)
        & (x.id.isNull() | F.coalesce(F.element_at(n.attrs, "id") == x.id, F.lit(False)))
        & ((F.size(x.classes) == 0) | (F.size(F.array_except(x.classes, _classes(n))) == 0))
        & F.forall(x.attrs, lambda a: matches_attribute(F.element_at(n.attrs, a.attr), a))
    )


def inner_counts(nodes: Column, own: Column, x: Column) -> Column:
    """For each of the nodes `own`, how many nodes below it fit: those that start
    up to its end less those that start up to itself."""
    starts = F.transform(F.filter(nodes, lambda n: matches_plain(n, x)), lambda n: n.nid)

    def counts(starts):
        ended = rank_below(starts, F.transform(own, lambda n: n.last + 1))
        begun = rank_below(starts, F.transform(own, lambda n: n.nid + 1))
        return F.zip_with(ended, begun, lambda a, b: a - b)

    return let(starts, counts)


def matches_step(n: Column, step: Column, nodes: Column) -> Column:
    """Whether an element fits one step, its combinator and `:has()` left aside."""
    filled = F.exists(F.slice(nodes, n.nid + 2, n.last - n.nid), lambda m: m.kind != "comment")
    return (
        matches_plain(n, step)
        & in_place(step.nth, n.nth)
        & in_place(step.child, n.sib + 1)
        & in_place(step.nth_end, n.nth_end)
        & in_place(step.child_end, n.sib_end)
        & F.when(step.empty, ~filled).otherwise(True)
        & ~F.exists(step.nots, lambda x: matches_plain(n, x))
    )


def earlier_sibling_counts(own: Column, found: Column) -> Column:
    """For each of the nodes `own`, how many of its earlier siblings are among `found`.
    Sorts by (parent, sibling number) instead of a look at each pair of siblings."""
    def key(n, sib):  # both are -1 at least
        return F.shiftleft((n.parent + 1).cast("bigint"), 32) + (sib + 1)

    among = F.transform(found, lambda n: key(n, n.sib))
    before = rank_below(among, F.transform(own, lambda n: key(n, n.sib)), wide=True)
    at_first = rank_below(among, F.transform(own, lambda n: key(n, F.lit(-1))), wide=True)
    return F.zip_with(before, at_first, lambda a, b: a - b)


def found_ancestor_counts(own: Column, found: Column) -> Column:
    """For each of the nodes `own`, how many of its ancestors are among `found`: those
    that start before it less those that also end before it."""
    nids = F.transform(own, lambda n: n.nid)
    started = rank_below(F.transform(found, lambda n: n.nid), nids)
    ended = rank_below(F.transform(found, lambda n: n.last), nids)
    return F.zip_with(started, ended, lambda a, b: a - b)


def found_counts(nids: Column, found: Column) -> Column:
    """1 for each of `nids` (-1: no node) that is among `found`, else 0."""
    among = F.transform(found, lambda n: n.nid + 1)
    upto = rank_below(among, F.transform(nids, lambda i: i + 2))
    below = rank_below(among, F.transform(nids, lambda i: i + 1))
    return F.zip_with(upto, below, lambda a, b: a - b)


def rank_below(among: Column, points: Column, wide: bool = False) -> Column:
    """For each point, how many values of `among` are below it (n log n). Both are whole
    numbers from 0 on, below 2^31, or with `wide` below 2^63.

    Points and values are sorted together; the rank of a point is its place
    less the number of points before it. Numbers are sorted many times faster than
    structs, so a value and what belongs to it are one number where they fit.
    """
    value = F.lit(1 << 31)  # behind all points of the same key

    def mark(key, i):
        key, i = key.cast("bigint"), i.cast("bigint")
        return F.struct(key.alias("k"), i.alias("i")) if wide else F.shiftleft(key, 32) + i

    def number(m):
        return m.i if wide else m.bitwiseAND(F.lit((1 << 32) - 1))

    marks = F.concat(
        F.transform(points, lambda p, i: mark(p, i)), F.transform(among, lambda p: mark(p, value))
    )
    placed = F.filter(
        F.transform(
            F.sort_array(marks),
            lambda m, at: let(number(m), lambda i: F.when(i < value, F.shiftleft(i, 32) + at)),
        ),
        lambda m: m.isNotNull(),
    )
    ranked = F.sort_array(F.transform(placed, lambda m, before: m - before))
    return F.transform(ranked, lambda m: m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


_FOUND = "ARRAY<STRUCT<nid: INT, last: INT, parent: INT, sib: INT>>"


def select(nodes: Column, selector: Column, elements: Column | None = None) -> Column:
    """nids of the elements that a parsed selector matches, in document order.
    `elements`: those of the nodes, where several selectors share them.

    Each step yields the nodes found so far; of the nodes that fit the next step
    those stay whose parent, sibling or an ancestor was found, so chains are
    matched exactly without backtracking. Only these few nodes are sorted, not the page.
    """

    elements = nodes if elements is None else elements

    def fitting(step):
        def having(own):
            return let(
                F.transform(step.has, lambda x: inner_counts(elements, own, x)),
                lambda inner: F.filter(own, lambda n, i: F.forall(inner, lambda counts: F.get(counts, i) > 0)),
            )

        own = F.filter(elements, lambda n: matches_step(n, step, nodes))
        return F.when(F.size(step.has) == 0, own).otherwise(let(own, having))

    def advance(found, step):
        def linked(own):
            counts = (
                F.when(step.comb == "~", earlier_sibling_counts(own, found))
                .when(step.comb == "", found_ancestor_counts(own, found))
                .when(step.comb == ">", found_counts(F.transform(own, lambda n: n.parent), found))
                .otherwise(found_counts(F.transform(own, lambda n: n.prev), found))
            )
            # the first step follows none
            return F.when(found.isNull(), own).otherwise(
                let(counts, lambda counts: F.filter(own, lambda n, i: F.get(counts, i) > 0))
            )

        return F.transform(
            let(fitting(step), linked),
            lambda n: F.struct(n.nid.alias("nid"), n.last.alias("last"), n.parent.alias("parent"), n.sib.alias("sib")),
        )

    def chain(steps):
        found = F.aggregate(steps, F.lit(None).cast(_FOUND), advance)
        return F.transform(found, lambda n: n.nid)

    nids = let(
        F.flatten(F.transform(selector, chain)),
        # one alternative finds its nodes in order and once
        lambda nids: F.when(F.size(selector) == 1, nids).otherwise(F.sort_array(F.array_distinct(nids))),
    )
    none = F.array().cast("array<int>")
    return F.when(nodes.isNotNull(), F.coalesce(nids, none))
