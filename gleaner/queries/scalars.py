"""Text and URL rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.functions import text, urls, values as v
from gleaner.queries import sql
from gleaner.queries.registry import query
from gleaner.sources import pages


@query(
    "text_normalize",
    f"SELECT doc_id, {sql.text_piece('text')} AS piece FROM documents",
)
def text_normalize(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.text_piece(F.col("text")).alias("piece")
    )


@query("word_count", f"SELECT doc_id, {sql.words('text')} AS n_words FROM documents")
def word_count(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.word_count(F.col("text")).cast("bigint").alias("n_words")
    )


@query(
    "terminal_punctuation",
    f"SELECT conv_id, turn, {sql.end_block('text')} AS block FROM conversations",
)
def terminal_punctuation(spark, sf):
    return inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.end_block(F.col("text")).alias("block")
    )


@query(
    "short_element_filter",
    f"SELECT conv_id, turn, {sql.close_block('text', '(turn % 4) * 5')} AS block "
    "FROM conversations",
)
def short_element_filter(spark, sf):
    return inputs.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.close_block(F.col("text"), F.col("turn") % 4 * 5).alias("block"),
    )


@query(
    "caption_truncate",
    f"SELECT doc_id, {sql.truncate_words('text')} AS short FROM documents",
)
def caption_truncate(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.truncate_words(F.col("text")).alias("short")
    )


@query(
    "space_before_punct",
    f"SELECT doc_id, {sql.tighten('spaced')} AS tight FROM "
    "(SELECT doc_id, replace(text, '.', ' ' || chr(10) || '.') AS spaced FROM documents)",
)
def space_before_punct(spark, sf):
    spaced = F.replace(F.col("text"), F.lit("."), F.lit(" \n."))
    return inputs.documents(spark, sf).select(
        "doc_id", text.tighten_punctuation(spaced).alias("tight")
    )


@query(
    "caption_trim",
    f"SELECT item_id, {sql.trim_any('padded')} AS trimmed FROM "
    "(SELECT item_id, chr(9) || ' ' || text || chr(10) || ' ' AS padded FROM benchmark)",
)
def caption_trim(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n "))
    return inputs.table(spark, sf, "benchmark").select(
        "item_id", text.trim_any(padded).alias("trimmed")
    )


@query(
    "link_key",
    "SELECT d.doc_id, sha256(d.text || d.source) AS link_key FROM documents d",
)
def link_key(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.link_key(F.col("text"), F.col("source")).alias("link_key")
    )


@query(
    "html_escape",
    f"SELECT doc_id, {sql.escape_html('text')} AS escaped FROM documents",
)
def html_escape(spark, sf):
    return inputs.documents(spark, sf).select(
        "doc_id", text.escape_html(F.col("text")).alias("escaped")
    )


_SUFFIXES = ["", " a", "é", "/100%", "/%41(b)", "#frag'x'"]
_ENCODED = ["", "%20a", "%c3%a9", "/100%25", "/%41%28b%29", "#frag%27x%27"]
_PREFIXES = ["", "x", "javascript:", "mailto:"]


@query(
    "href_escape",
    f"""SELECT page_id, CASE page_id % 4 WHEN 2 THEN '#ZgotmplZ'
       WHEN 1 THEN CASE WHEN regexp_matches(url, '^http') THEN '#ZgotmplZ' END
       ELSE {sql.by_turns('page_id', _PREFIXES)} || {sql.escape_html('url')}
            || {sql.by_turns('page_id', _ENCODED)} END AS href
       FROM pages""",
)
def href_escape(spark, sf):
    link = F.concat(
        inputs.by_turns("page_id", _PREFIXES), F.col("url"), inputs.by_turns("page_id", _SUFFIXES)
    )
    return inputs.table(spark, sf, "pages").select("page_id", text.escape_href(link).alias("href"))


# link as found on a page, host expected (NULL: that of the source), path expected
_LINKS = [
    ("/a/b?x=1#f", None, "/a/b"),
    ("page2", None, "page2"),
    ("https://other.example.com:8080/p%20q", "other.example.com:8080", "/p q"),
    ("//cdn.example.com/c+d", "cdn.example.com", "/c+d"),
    ("mailto:someone@example.com", None, ""),
    ("http://user:pw@host.example.com", "host.example.com", ""),
    ("#top", None, ""),
    ("", None, ""),
]


@query(
    "display_url",
    f"""SELECT page_id, {sql.scheme('url')} || '://'
       || coalesce({sql.by_turns('page_id', [h for _, h, _ in _LINKS])}, {sql.host('url')})
       || {sql.by_turns('page_id', [p for _, _, p in _LINKS])} AS link_url FROM pages""",
)
def display_url(spark, sf):
    link = inputs.by_turns("page_id", [link for link, _, _ in _LINKS])
    return inputs.table(spark, sf, "pages").select(
        "page_id",
        urls.display_url(urls.scheme(F.col("url")), urls.host(F.col("url")), link).alias("link_url"),
    )


_STATUSES = [200, 204, 301, 400, 401, 403, 404, 429, 500, 503, 600, 700, 0]


def _status_messages(code):
    def text_of(msg):
        return "'" + msg.replace("'", "''") + "'"

    def formatted(msg):
        a, b = msg.split("%s")
        return f"{text_of(a)} || {code} || {text_of(b)}"

    return (
        f"CASE WHEN {code} = 403 THEN {text_of(v.MSG_403)} WHEN {code} = 404 THEN "
        f"{text_of(v.MSG_404)} WHEN {code} = 429 THEN {text_of(v.MSG_429)} "
        f"WHEN {code} = 400 THEN {formatted(v.MSG_400)} "
        f"WHEN {code} BETWEEN 500 AND 599 THEN {formatted(v.MSG_5XX)} "
        f"WHEN {code} >= 600 THEN {formatted(v.MSG_600)} END"
    )


STATUS_MESSAGES = _status_messages


@query(
    "status_messages",
    f"SELECT page_id, status, {_status_messages('status')} AS message FROM "
    f"(SELECT page_id, {sql.by_turns('page_id', _STATUSES)} AS status FROM pages)",
)
def status_messages(spark, sf):
    status = inputs.by_turns("page_id", _STATUSES)
    return (
        inputs.table(spark, sf, "pages")
        .select("page_id", status.alias("status"))
        .withColumn("message", pages.status_message(F.col("status")))
    )


@query(
    "success_pages",
    f"SELECT page_id, status FROM (SELECT page_id, {sql.by_turns('page_id', _STATUSES)} AS status "
    "FROM pages) WHERE status BETWEEN 200 AND 299 OR status = 0",
)
def success_pages(spark, sf):
    status = inputs.by_turns("page_id", _STATUSES)
    rows = inputs.table(spark, sf, "pages").select("page_id", status.alias("status"))
    return rows.filter(pages.is_success(F.col("status")))


@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def pages_scan(spark, sf):
    return inputs.table(spark, sf, "pages").select(
        "page_id", "url", F.length("html").cast("bigint").alias("n_chars")
    )


@query(
    "page_size_cap",
    "SELECT doc_id, CASE WHEN strlen(a) > 3000 THEN a[1:3000] ELSE a END AS capped FROM "
    r"(SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS a FROM documents)",
)
def page_size_cap(spark, sf):
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return inputs.documents(spark, sf).select(
        "doc_id", pages.cap_page(ascii_text, 3000).alias("capped")
    )


_OPENINGS = [
    ('<RSS version="2.0">\n', ""), ("<!DOCTYPE html>\n", ""), ("<feed xmlns='x'>", ""),
    ('<html class="rss">\n', ""), ("", ""), ("", "\n<html>"), ("<p>\n  <html lang='en'", "\n<rss>"),
]
_FORMAT = r"(<rss[^>\n]*>?|<!doctype html>|<html[^>\n]*>?|<feed[^>\n]*>?)"


@query(
    "page_format",
    f"""WITH bodies AS (
         SELECT doc_id, lower({sql.by_turns('doc_id', [a for a, _ in _OPENINGS])} || text
                || {sql.by_turns('doc_id', [b for _, b in _OPENINGS])}) AS body FROM documents),
       tags AS (SELECT doc_id, regexp_extract(body, '{_FORMAT}', 1) AS tag FROM bodies)
       SELECT doc_id, CASE
         WHEN tag = '' THEN 'unknown'
         WHEN contains(tag, 'rss') THEN 'rss' WHEN contains(tag, 'html') THEN 'html'
         ELSE 'atom' END AS format FROM tags""",
)
def page_format(spark, sf):
    body = F.concat(
        inputs.by_turns("doc_id", [a for a, _ in _OPENINGS]),
        F.col("text"),
        inputs.by_turns("doc_id", [b for _, b in _OPENINGS]),
    )
    return inputs.documents(spark, sf).select(
        "doc_id", pages.page_format(body).alias("format")
    )
