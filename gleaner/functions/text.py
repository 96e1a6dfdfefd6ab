"""Caption text rules as Column -> Column functions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gleaner.functions import values as v


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    Inside lambdas Catalyst does not share common subexpressions; a one-element
    `transform` does.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_any(c: Column) -> Column:
    """Strip blanks, newlines and tabs on both sides."""
    return F.btrim(c, F.lit(v.TRIM_CHARS))


def inline_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """Like `let`, for use outside lambdas: there generated code shares common
    subexpressions by itself."""
    return body(value)


def text_piece(c: Column, bind=inline_value) -> Column:
    """Text of one text node: collapse white space, drop non-printing
    characters, strip the left side and end in one blank. Inside lambdas give
    `bind=let`."""
    collapsed = F.regexp_replace(c, v.WHITESPACE_RUN, " ")
    return bind(
        collapsed,
        lambda d: F.concat(
            F.ltrim(F.regexp_replace(d, v.NON_PRINTING, ""), F.lit(" \t\n")),
            F.when((d != "") & ~d.endswith(" "), " ").otherwise(""),
        ),
    )


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(v.WORD))


def end_block(c: Column) -> Column:
    """Give a block a full stop unless it ends in punctuation."""
    return F.when(c.rlike(v.ENDS_IN_PUNCTUATION), c).otherwise(F.concat(F.rtrim(c), F.lit(". ")))


def close_block(c: Column, min_words: Column) -> Column:
    """Text of a block element when it closes: blank text passes through, short
    blocks (`min_words` words or fewer) vanish, others get a full stop."""
    return (
        F.when(F.trim(c) == "", c)
        .when(word_count(c) <= min_words, F.lit(""))
        .otherwise(end_block(c))
    )


def truncate_words(c: Column, bind=inline_value) -> Column:
    """Cut before word 21 and add an ellipsis. The pattern ends at the start of
    word 21, so it finds nothing, and nothing is cut, in texts of 20 words."""
    head = (
        rf"^((?:[^A-Za-z0-9_-]*+[A-Za-z0-9_-]++){{{v.CAPTION_WORDS}}}[^A-Za-z0-9_-]*+)[A-Za-z0-9_-]"
    )
    return bind(
        F.regexp_extract(c, head, 1),
        lambda h: F.when(h != "", F.concat(F.rtrim(h), F.lit("..."))).otherwise(c),
    )


def tighten_punctuation(c: Column) -> Column:
    """Remove white space before punctuation."""
    return F.regexp_replace(c, v.SPACE_BEFORE_PUNCTUATION, "$1")


def finish_caption(c: Column, bind=inline_value) -> Column:
    return trim_any(tighten_punctuation(truncate_words(c, bind)))


def link_key(caption: Column, link_url: Column) -> Column:
    """Identity of an item in the seen store."""
    return F.sha2(F.concat(caption, link_url), 256)


def escape_html(c: Column) -> Column:
    """Escape text for an HTML text or attribute context."""
    for plain, escaped in [
        ("&", "&amp;"), ("\x00", "�"), ('"', "&#34;"), ("'", "&#39;"),
        ("+", "&#43;"), ("<", "&lt;"), (">", "&gt;"),
    ]:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def escape_href(c: Column) -> Column:
    """Make a URL safe inside an href attribute: only http, https, mailto or
    relative URLs pass, bytes outside the URL alphabet are percent-encoded."""
    scheme = F.lower(F.regexp_extract(c, r"^([^/:]*):", 1))
    allowed = scheme.isin("", "http", "https", "mailto") & ~c.startswith(":")
    # url_encode handles UTF-8 bytes; what it encodes beyond need is put back.
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(
                c,
                F.lit(r"(?s)(%[0-9A-Fa-f]{2}|[A-Za-z0-9!#$&*+,/:;=?@\[\]._~-]+|.)"),
                F.lit(1),
            ),
            lambda p: F.when(
                p.rlike(r"^(%[0-9A-Fa-f]{2}|[A-Za-z0-9!#$&*+,/:;=?@\[\]._~-]+)$"), p
            )
            .when(p == " ", "%20")
            .otherwise(F.lower(F.url_encode(p))),
        ),
        "",
    )
    safe = F.when(c.rlike(r"^[A-Za-z0-9!#$&*+,/:;=?@\[\]._~-]*$"), c).otherwise(encoded)
    return F.when(allowed, escape_html(safe)).otherwise(F.lit("#ZgotmplZ"))
