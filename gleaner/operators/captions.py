"""Captions: the text of a container, block by block."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions import values as v
from gleaner.functions.text import end_block, finish_caption, let, text_piece, word_count
from gleaner.operators.links import inline, is_element, node_at

_LONG = 4096
# pieces that are joined at once
_FAN = 64


def subtree(nodes: Column, nid: Column) -> Column:
    """All nodes below `nid`, itself included, in document order."""
    return F.slice(nodes, nid + 1, node_at(nodes, nid).last - nid + 1)


def text_events(below: Column) -> Column:
    """Text pieces of a subtree together with the start and end of its block
    elements, in document order: ARRAY<STRUCT<pos, closes, depth, txt>>.

    Inline elements leave no events, as their text runs on in their parent.
    """

    def event(pos, closes, n, txt):
        return F.struct(
            pos.alias("pos"),
            F.lit(closes).alias("closes"),
            # among blocks that end together the deepest ends first
            (-n.depth).alias("depth"),
            txt.alias("txt"),
        )

    none = F.lit(None).cast("string")
    blocks = F.filter(below, lambda n: is_element(n) & ~inline(n.tag))
    texts = F.filter(
        F.transform(
            F.filter(below, lambda n: n.kind == "text"),
            lambda n: event(n.nid, False, n, text_piece(n.txt, let)),
        ),
        lambda e: e.txt != "",
    )
    return F.sort_array(
        F.concat(
            texts,
            F.transform(blocks, lambda n: event(n.nid, False, n, none)),
            F.transform(blocks, lambda n: event(n.last, True, n, none)),
        )
    )


def _pieces(words, fresh, packs, bales) -> Column:
    """Text of an open block as pieces of three sizes, the latest in `fresh`,
    and its number of words."""
    return F.struct(
        words.alias("words"), fresh.alias("fresh"), packs.alias("packs"), bales.alias("bales")
    )


def _added(top: Column, words: Column, txt: Column) -> Column:
    """`top` with one more piece. A full array is joined to one piece of the next
    size, so that a piece is copied a few times however many there are."""

    def join(c):
        return F.array(F.array_join(c, ""))

    none = F.array().cast("array<string>")
    fresh = F.concat(top.fresh, F.array(txt))
    total = top.words + words
    return (
        F.when(F.size(top.fresh) < _FAN - 1, _pieces(total, fresh, top.packs, top.bales))
        .when(
            F.size(top.packs) < _FAN - 1,
            _pieces(total, none, F.concat(top.packs, join(fresh)), top.bales),
        )
        .otherwise(
            _pieces(
                total, none, none, F.concat(top.bales, join(F.concat(top.packs, join(fresh))))
            )
        )
    )


def _whole(top: Column) -> Column:
    return F.array_join(F.concat(top.bales, top.packs, top.fresh), "")


def _fold(events: Column, min_words: Column, keep, full) -> Column:
    """Fold over the events of a subtree. The state is the innermost open block
    and, apart from it, the blocks around it, which pieces of text don't touch.

    A piece ends in a blank, so words don't run on from one to the next and their
    counts add up. `keep` shortens a piece; a block with `full` words takes no more.
    """
    none = F.array().cast("array<string>")
    empty = _pieces(F.lit(0), none, none, none)

    def state(around, top):
        return F.struct(around.alias("around"), top.alias("top"))

    def append(top, words, txt):
        return F.when((txt == "") | full(top.words), top).otherwise(_added(top, words, txt))

    def opened(s):
        return state(F.concat(s.around, F.array(s.top)), empty)

    def closed(s):
        def with_text(txt):
            gone = (F.trim(txt) != "") & (s.top.words <= min_words)
            done = F.when(F.trim(txt) == "", txt).when(gone, F.lit("")).otherwise(end_block(txt))
            return append(
                F.element_at(s.around, -1), F.when(gone, F.lit(0)).otherwise(s.top.words), done
            )

        outer = F.slice(s.around, F.lit(1), F.size(s.around) - 1)
        return state(outer, let(_whole(s.top), with_text))

    def added(s, e):
        return state(
            s.around, let(keep(e.txt), lambda txt: append(s.top, word_count(txt), txt))
        )

    def step(s, e):
        return F.when(e.closes, closed(s)).when(e.txt.isNull(), opened(s)).otherwise(added(s, e))

    start = state(F.slice(F.array(empty), F.lit(1), F.lit(0)), empty)
    return F.aggregate(events, start, step, lambda s: _whole(s.top))


def fold_text(events: Column, min_words: Column) -> Column:
    """Text of a subtree, whole."""
    return _fold(events, min_words, lambda txt: txt, lambda words: F.lit(False))


def fold_beginning(events: Column, min_words: Column) -> Column:
    """Like `fold_text`, as far as a caption shows it.

    A caption shows what comes before word 21, and a block is kept when it has
    more than `min_words` words. Once a block holds more words than both, all
    that follows in it can no longer show, so blocks are full then, and very long
    pieces are cut there.
    """
    bound = F.greatest(F.lit(v.CAPTION_WORDS), min_words) + 1
    pattern = F.concat(
        F.lit("^(?:[^A-Za-z0-9_-]*+[A-Za-z0-9_-]++){"), bound.cast("string"), F.lit("}")
    )

    def cut(txt):
        return F.when(
            (F.length(txt) > _LONG) & (word_count(txt) > bound), F.regexp_substr(txt, pattern)
        ).otherwise(txt)

    return _fold(events, min_words, cut, lambda words: words >= bound)


def caption(nodes: Column, container: Column, min_words: Column) -> Column:
    """Caption of a container; NULL for body, which is not a usable container."""
    text = let(subtree(nodes, container), lambda below: fold_beginning(text_events(below), min_words))
    return F.when(node_at(nodes, container).tag != "body", let(text, lambda t: finish_caption(t, let)))
