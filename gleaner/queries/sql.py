"""Pieces of the SQL twins.

The pages of the sample tables hold all their links as
`<li><a href="...">...</a></li>` in one list, so a regular expression finds
what the library finds by parsing.
"""

from __future__ import annotations

from gleaner.inputs import NOW, STATUS

WORD = "[A-Za-z0-9_-]+"


def by_turns(key: str, choices: list) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    arms = " ".join(f"WHEN {i} THEN {lit(x)}" for i, x in enumerate(choices))
    return f"CASE {key} % {len(choices)} {arms} END"


def words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{WORD}'))"


def text_piece(t: str) -> str:
    run = r"'([\t\n\f\r ]{2,}|\n|\t)'"
    collapsed = f"regexp_replace({t}, {run}, ' ', 'g')"
    kept = rf"regexp_replace({collapsed}, '[^\x20-\x7E\x{{A1}}-\x{{10FFFF}}]', '', 'g')"
    space = f"CASE WHEN {collapsed} <> '' AND right({collapsed}, 1) <> ' ' THEN ' ' ELSE '' END"
    return f"(ltrim({kept}, ' ' || chr(9) || chr(10)) || {space})"


def end_block(t: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '[!.?] ?\\z') THEN {t} "
        f"ELSE rtrim({t}, ' ') || '. ' END"
    )


def close_block(t: str, m: str) -> str:
    return (
        f"CASE WHEN trim({t}, ' ') = '' THEN {t} WHEN {words(t)} <= {m} THEN '' "
        f"ELSE {end_block(t)} END"
    )


def truncate_words(t: str) -> str:
    head = f"regexp_extract({t}, '^((?:[^A-Za-z0-9_-]*{WORD}){{20}}[^A-Za-z0-9_-]+)', 1)"
    return f"CASE WHEN {words(t)} > 20 THEN rtrim({head}, ' ') || '...' ELSE {t} END"


def tighten(t: str) -> str:
    return rf"regexp_replace({t}, '[\t\n\f\r ]+([!.?])', '\1', 'g')"


def trim_any(t: str) -> str:
    return f"trim({t}, ' ' || chr(10) || chr(9))"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def escape_html(t: str) -> str:
    for plain, escaped in [
        ("&", "&amp;"), ('"', "&#34;"), ("''", "&#39;"), ("+", "&#43;"), ("<", "&lt;"),
        (">", "&gt;"),
    ]:
        t = f"replace({t}, '{plain}', '{escaped}')"
    return t


PATTERN = '<li><a href="([^"]*)">([^<]*)</a></li>'

# one row per link, `pos` counts them per page
ANCHORS = f"""
anchors AS (
  SELECT page_id, CAST(page_id AS VARCHAR) AS src, url,
         unnest(regexp_extract_all(html, '{PATTERN}', 1)) AS href,
         unnest(regexp_extract_all(html, '{PATTERN}', 2)) AS txt,
         unnest(range(0, len(regexp_extract_all(html, '{PATTERN}')))) AS pos
  FROM pages)"""

# items before dedupe: display URL and caption with no minimum of words
RAW_ITEMS = f"""{ANCHORS},
pieces AS (SELECT *, {text_piece("txt")} AS piece FROM anchors),
blocks AS (SELECT *, {close_block("piece", "0")} AS block FROM pieces),
raw_items AS (
  SELECT page_id, src, page_id AS src_ord, pos,
         {scheme("url")} || '://' || {host("url")} || href AS link_url,
         {trim_any(tighten(truncate_words("block")))} AS caption
  FROM blocks)"""

# items of a source set: last of each URL, no blank captions
SET_ITEMS = f"""{RAW_ITEMS},
last_items AS (
  SELECT * FROM raw_items
  QUALIFY row_number() OVER (PARTITION BY src, link_url ORDER BY pos DESC) = 1),
clean AS (SELECT * FROM last_items WHERE {trim_any("caption")} <> ''),
set_items AS (SELECT *, sha256(caption || link_url) AS link_key FROM clean)"""

STATUS_OF = by_turns("page_id", STATUS)
# items of the sources with a good response
GOOD_ITEMS = f"good_items AS (SELECT * FROM set_items WHERE {STATUS_OF} = 200)"

SEEN = """seen AS (
  SELECT link_key, min(TIMESTAMP '2024-01-01' + to_days(CAST(src_ord % 12 * 30 AS INTEGER))) AS seen_at
  FROM set_items GROUP BY link_key)"""
ALIVE = f"alive AS (SELECT * FROM seen WHERE seen_at > TIMESTAMP '{NOW}' - INTERVAL 180 DAY)"
FIRST = """firsts AS (
  SELECT * FROM good_items
  QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY src_ord, pos) = 1)"""
NEW = "new_items AS (SELECT f.* FROM firsts f ANTI JOIN alive a ON f.link_key = a.link_key)"
RUN = f"WITH {SET_ITEMS}, {GOOD_ITEMS}, {SEEN}, {ALIVE}, {FIRST}, {NEW}"
# the same over all sources
RUN_ALL = RUN.replace(GOOD_ITEMS, "good_items AS (SELECT * FROM set_items)")
