"""HTML pages as node tables.

`with_nodes` adds one ARRAY<STRUCT> column per page, filled by an Arrow UDF;
`node_table` explodes it. Nodes are in document order, so `nid` is at once the
pre-order number and the index into the array, and `[nid, last]` is the
interval of a subtree. Nothing is shuffled: a page stays in its scan task.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schemas

# Fixed values of the HTML standard.
_VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split()
)
_RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
_ESCAPABLE_RAW = frozenset("textarea title".split())
_IN_HEAD = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext "
    "pre section summary table ul xmp".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_BARRIER = frozenset("applet caption html marquee object table td template th".split())
_TABLE_PARTS = {
    "caption": ("table",), "colgroup": ("table",), "thead": ("table",), "tbody": ("table",),
    "tfoot": ("table",), "tr": ("tbody", "thead", "tfoot", "table"), "td": ("tr",), "th": ("tr",),
}

# bytes of pages that a worker parses at a time, and that it is sent at a time
PIECE, SENT = 1 << 18, 1 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?:!|\?|/(?=[^a-zA-Z>]))[^>]*>?"
    r"|</>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>"
    r"|(?P<text>[^<]+|<(?![a-zA-Z/!?]))",
    re.S,
)
_ATTR = re.compile(r"([^\s/=>\"'][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_ATTR_REF = re.compile(r"&(?:#[0-9a-zA-Z]+;?|[0-9a-zA-Z]+(?:;|(?![=0-9a-zA-Z])))")


def _attributes(raw: str) -> dict[str, str]:
    attrs: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        if "&" in value:
            value = _ATTR_REF.sub(lambda m: html.unescape(m.group()), value)
        attrs.setdefault(name.lower(), value)
    return attrs


class _Node:
    __slots__ = ("kind", "tag", "text", "attrs", "children", "number", "is_open")

    def __init__(self, kind, tag=None, text=None, attrs=None):
        self.kind, self.tag, self.text, self.attrs = kind, tag, text, attrs
        self.children, self.number, self.is_open = [], -1, False


class _Tree:
    """Tree building for one page: implied elements, automatic closing, raw
    text and re-opened formatting elements."""

    def __init__(self):
        self.root = _Node("element", "html", attrs={})
        self.open = [self.root]
        self.n_open = {"html": 1}
        self.head = self.body = None
        self.formatting: list[_Node] = []

    def add(self, node):
        self.open[-1].children.append(node)
        return node

    def enter(self, node):
        self.open.append(node)
        node.is_open = True
        self.n_open[node.tag] = self.n_open.get(node.tag, 0) + 1

    def leave(self, i=-1):
        """Close the open elements from place `i` on."""
        for node in self.open[i:]:
            self.n_open[node.tag] -= 1
            node.is_open = False
        del self.open[i:]

    def push(self, tag, attrs=None):
        self.enter(self.add(_Node("element", tag, attrs=attrs or {})))
        return self.open[-1]

    def find(self, tags, stop=_BARRIER):
        """Index of the innermost open element with one of `tags`, else 0."""
        if not any(self.n_open.get(tag) for tag in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def close(self, tags, stop=_BARRIER):
        i = self.find(tags, stop)
        if i:
            self.leave(i)
        return i

    def enter_head(self):
        if self.head is None:
            self.head = self.push("head")

    def enter_body(self):
        if self.body is None:
            self.enter_head()
            self.leave(1)
            self.body = self.push("body")

    def reopen_formatting(self):
        """Formatting elements cut off by a closed block go on in the next."""
        for i, node in enumerate(self.formatting):
            if not node.is_open:
                self.formatting[i] = self.push(node.tag, node.attrs)

    def text(self, data):
        if self.body is None:
            blank = data.lstrip(" \t\n\f")
            space = data[: len(data) - len(blank)]
            if space and self.head is not None:
                self.append_text(space)
            if not blank:
                return
            self.enter_body()
            data = blank
        if self.formatting:
            self.reopen_formatting()
        self.append_text(data)

    def append_text(self, data):
        siblings = self.open[-1].children
        if siblings and siblings[-1].kind == "text":
            siblings[-1].text += data
        else:
            self.add(_Node("text", text=data))

    def table_context(self, tag):
        """Open the table parts that `tag` needs; False when outside a table."""
        if not self.find(("table",), ("template", "html")):
            return False
        wanted = _TABLE_PARTS[tag]
        while self.open[-1].tag not in wanted and self.open[-1].tag not in (
            "table", "tbody", "thead", "tfoot", "tr",
        ):
            self.leave()
        while self.open[-1].tag not in wanted and self.open[-1].tag != "table":
            if tag in ("td", "th") and self.open[-1].tag in ("tbody", "thead", "tfoot"):
                break
            self.leave()
        if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
            self.push("tbody")
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self.push("tr")
        return True

    def start(self, tag, attrs, self_closing):
        if tag == "html" or (tag == "body" and self.body is not None):
            target = self.root if tag == "html" else self.body
            for k, val in attrs.items():
                target.attrs.setdefault(k, val)
            return None
        if tag == "head":
            if self.head is None:
                self.head = self.push("head", attrs)
            return None
        if tag == "body":
            self.enter_body()
            self.body.attrs.update(attrs)
            return None
        if self.body is None:
            if tag in _IN_HEAD:
                self.enter_head()
                if not self.head.is_open:
                    # a late head element: it stays in the head, alone
                    self.enter(self.head)
                    node = self.push(tag, attrs)
                    self.leave(self.open.index(self.head))
                    if tag not in _VOID:
                        self.enter(node)
                    return node
                node = self.push(tag, attrs)
                if tag in _VOID:
                    self.leave()
                return node
            self.enter_body()
        if tag in _TABLE_PARTS:
            if not self.table_context(tag):
                return None
            return self.push(tag, attrs)
        if tag in _CLOSES_P:
            if tag in ("li", "dd", "dt"):
                same = ("li",) if tag == "li" else ("dd", "dt")
                self.close(same, _BARRIER | {"ul", "ol", "dl", "menu", "dir", "section", "article",
                                             "nav", "aside", "main", "blockquote", "header",
                                             "footer", "form", "fieldset", "figure"})
            self.close(("p",), _BARRIER | {"button"})
            if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
                self.leave()
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.leave()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.leave()
        elif tag in ("a", "nobr"):
            self.end(tag)
        if tag not in _CLOSES_P and self.formatting and tag not in _RAW:
            self.reopen_formatting()
        node = self.push(tag, attrs)
        if tag in _VOID or (self_closing and self.find(("svg", "math"), ("html",))):
            self.leave()
        elif tag in _FORMATTING:
            # at most three of a kind are re-opened in later blocks
            alike = [n for n in self.formatting if n.tag == tag and n.attrs == attrs]
            if len(alike) == 3:
                self.formatting.remove(alike[0])
            self.formatting.append(node)
        return node

    def end(self, tag):
        if self.body is None:
            if tag == "head" and self.head is not None:
                self.leave(1)
            elif self.close((tag,)) == 0 and tag == "br":
                self.start("br", {}, False)
            return
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p" and not self.find(("p",), _BARRIER | {"button"}):
            self.push("p")
            self.leave()
        elif tag in _HEADINGS:
            self.close(_HEADINGS)
        elif tag == "li":
            self.close(("li",), _BARRIER | {"ol", "ul"})
        elif tag in _TABLE_PARTS or tag == "table":
            self.close((tag,), ("template", "html") if tag == "table" else ("table", "template"))
        elif tag in _FORMATTING:
            for node in reversed(self.formatting):
                if node.tag == tag:
                    self.formatting.remove(node)
                    if node.is_open:
                        self.leave(self.open.index(node))
                    break
        else:
            self.close((tag,))


def parse_html(page: str) -> _Node:
    """Root node of a page."""
    tree = _Tree()
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        if m is None:  # an unterminated tag ends the page
            break
        pos = m.end()
        kind = m.lastgroup
        if kind == "attrs":
            tag, raw = m.group("start").lower(), m.group("attrs")
            node = tree.start(tag, _attributes(raw) if raw else {}, raw.endswith("/"))
            if node is None:
                continue
            if tag in _RAW or tag in _ESCAPABLE_RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                stop = end.start() if end else size
                data = page[pos:stop]
                if tag in _ESCAPABLE_RAW:
                    data = html.unescape(data)
                if tag == "textarea":
                    data = data.removeprefix("\n")
                if data:
                    node.children.append(_Node("text", text=data))
                if tree.open[-1] is node:
                    tree.leave()
                if end:
                    close = page.find(">", stop)
                    pos = size if close < 0 else close + 1
                else:
                    pos = size
            elif tag in ("pre", "listing") and page.startswith("\n", pos):
                pos += 1
        elif kind == "end":
            tree.end(m.group("end").lower())
        elif kind == "text":
            data = m.group("text")
            while pos < size and page[pos] != "<":
                more = page.find("<", pos)
                more = size if more < 0 else more
                data, pos = data + page[pos:more], more
            tree.text(html.unescape(data) if "&" in data else data)
        elif kind == "comment":
            if tree.head is not None:
                tree.add(_Node("comment", text=m.group("comment")))
    tree.enter_body()
    return tree.root


class _Batch:
    """Node columns of a batch of pages."""

    def __init__(self):
        self.page_offsets = [0]
        self.rows: list[tuple] = []
        self.last: list[int] = []
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []

    def add_page(self, page: str | None) -> None:
        if page is not None:
            self._number(parse_html(page))
        self.page_offsets.append(len(self.rows))

    def _number(self, root: _Node) -> None:
        """Number the nodes of a page in document order."""
        first = len(self.rows)
        path: list[int] = []
        todo: list = [(root, 0, 1, None, 1, 1)]
        while todo:
            entry = todo.pop()
            if entry is None:  # all children of the innermost element are done
                self.last[first + path.pop()] = len(self.rows) - first - 1
                continue
            node, sib, nth, prev, sib_end, nth_end = entry
            node.number = nid = len(self.rows) - first
            self.last.append(nid)
            self.rows.append((
                nid, path[-1] if path else -1, len(path), node.kind, node.tag, node.text,
                sib, nth, prev.number if prev else -1, sib_end, nth_end,
            ))
            if node.kind == "element":
                self.attr_keys.extend(node.attrs.keys())
                self.attr_values.extend(node.attrs.values())
                path.append(nid)
                todo.append(None)
                todo.extend(reversed(_numbered_siblings(node.children)))
            self.attr_offsets.append(len(self.attr_keys))

    def to_arrow(self) -> pa.Array:
        cols = list(zip(*self.rows)) or [()] * 11
        ints, strings = pa.int32(), pa.string()
        nid, parent, depth, kind, tag, txt, sib, nth, prev, sib_end, nth_end = (
            pa.array(col, strings if i in (3, 4, 5) else ints) for i, col in enumerate(cols)
        )
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, ints), pa.array(self.attr_keys, strings),
            pa.array(self.attr_values, strings),
        )
        fields = {
            "nid": nid, "parent": parent, "depth": depth, "last": pa.array(self.last, ints),
            "kind": kind, "tag": tag, "txt": txt, "attrs": attrs, "sib": sib, "nth": nth,
            "prev": prev, "sib_end": sib_end, "nth_end": nth_end,
        }
        nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(pa.array(self.page_offsets, ints), nodes)


def _numbered_siblings(children):
    """(node, element number, number among the same tag, previous element, places from
    the end among all elements and among the same tag)."""
    out, n, per_tag, prev = [], 0, {}, None
    for child in children:
        if child.kind == "element":
            per_tag[child.tag] = nth = per_tag.get(child.tag, 0) + 1
            out.append((child, n, nth, prev))
            n, prev = n + 1, child
        else:
            out.append((child, -1, 0, prev))
    return [
        (child, sib, nth, prev, n - sib, per_tag[child.tag] - nth + 1) if nth else (child, sib, nth, prev, 0, 0)
        for child, sib, nth, prev in out
    ]


def _pieces(pages: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A batch of pages cut between pages, in slices of about `limit` bytes; one longer
    page is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield pages.slice(first, i - first)
            first, held = i, 0
        held += size
    if len(pages) > first:
        yield pages.slice(first)


def _parse_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Node arrays, in more and smaller batches than the pages: what a worker holds
    goes by `PIECE` and the longest page, not by the pages of a task."""
    for pages in batches:
        for piece in _pieces(pages, PIECE):
            batch = _Batch()
            for page in piece.to_pylist():
                batch.add_page(page)
            yield batch.to_arrow()


# Ship the parser with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of `SENT` bytes or one longer row, unless the session
    has a lower limit: by rows alone, the pages that a worker holds grow with those of a task."""
    if _bytes(spark.conf.get(_BATCH_BYTES)) > SENT:
        spark.conf.set(_BATCH_BYTES, str(SENT))


def _bytes(size: str) -> int:
    """A size of Spark's configuration, such as 64MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << " kmgtp".index(unit or " ") * 10


def _parser():
    parse = F.arrow_udf(_parse_pages, f"ARRAY<{schemas.NODE}>")
    # Marked so, filters above are not pushed below, which would parse pages twice.
    return parse.asNondeterministic()


def with_nodes(pages: DataFrame, html_col: str = "html", when: Column | None = None) -> DataFrame:
    """Add the `nodes` array of each page (empty where `when` is false)."""
    small_batches(pages.sparkSession)
    page = F.col(html_col) if when is None else F.when(when, F.col(html_col))
    return pages.withColumn("nodes", _parser()(page))


def register(spark: SparkSession, name: str = "dom_nodes") -> None:
    """Make the parser known to SQL:

        SELECT page_id, n.* FROM pages LATERAL VIEW explode(dom_nodes(html)) AS n
    """
    small_batches(spark)
    spark.udf.register(name, _parser())


def node_table(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per node of each page: the columns of `schemas.NODE` next to the
    other columns of `pages`."""
    keep = [c for c in pages.columns if c != html_col]
    parsed = with_nodes(pages, html_col).select(*keep, F.explode_outer("nodes").alias("node"))
    return parsed.filter(F.col("node").isNotNull()).select(*keep, "node.*")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when a small table's rows come in at least four times fewer tasks
    than there are slots: a file of one row group has several splits, but one with
    rows. Tables of more splits than slots keep their scan tasks: no shuffle, no counting."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits > slots:
        return df
    if 4 * splits > slots:
        splits = df.select(F.spark_partition_id()).distinct().count()
    return df if 4 * splits > slots else df.repartition(slots, key)
