"""Feeds made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.queries.registry import query
from gleaner.sources import feeds

_CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', '', 'g')"
_ITEMS = f"""
lines AS (
  SELECT doc_id, unnest(string_split({_CLEAN}, chr(10))) AS line,
         unnest(range(0, len(string_split({_CLEAN}, chr(10))))) AS n FROM documents),
feed_items AS (
  SELECT doc_id, CAST(n AS INTEGER) AS ord,
         'http://feed.example.org/' || doc_id || '?line=' || n || '&x=1' AS link_url,
         CASE WHEN length(line) > 20 AND (doc_id % 3 = 0 OR trim(line, ' ') <> '') THEN trim(line || CASE WHEN doc_id % 3 = 0 THEN chr(160) || 'R&D ' || chr(8217) || 'x' || chr(8217) ELSE '' END, ' ')
              ELSE trim('Line: ' || line, ' ') END AS caption
  FROM lines)"""
FEED_ITEMS = _ITEMS
_SQL = f"WITH {_ITEMS} SELECT doc_id, ord, link_url, caption FROM feed_items"


def _exploded(bodies, found):
    rows = bodies.select("doc_id", F.explode_outer(found.getField("items")).alias("x"))
    return rows.filter(F.col("x").isNotNull()).select("doc_id", "x.*")


@query("feed_items_rss", _SQL)
def feed_items_rss(spark, sf):
    bodies = inputs.rss_bodies(spark, sf)
    return _exploded(bodies, feeds.rss_items(F.col("html")))


@query("feed_items_atom", _SQL)
def feed_items_atom(spark, sf):
    bodies = inputs.atom_bodies(spark, sf)
    return _exploded(bodies, feeds.atom_items(F.col("html")))
