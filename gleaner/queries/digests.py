"""Digest bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.functions import values as v
from gleaner.operators import sections as op, store
from gleaner.operators.items import explode_items
from gleaner.plans.digest import digest, run_digest
from gleaner.queries import sql
from gleaner.queries.registry import query
from gleaner.queries.scalars import STATUS_MESSAGES
from gleaner.sources.tables import new_dir


def _text(msg):
    return "'" + msg.replace("'", "''") + "'"


def _fill(template, *values):
    """SQL expression of a %s template."""
    parts = template.split("%s")
    out = [_text(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [value, _text(part)]
    return "concat(" + ", ".join(out) + ")"


_MESSAGE = f"coalesce({STATUS_MESSAGES(sql.STATUS_OF)}, '')"
_SECTIONS = f"""
sections AS (
  SELECT CAST(p.page_id AS VARCHAR) AS src, p.page_id, 'Site ' || p.page_id AS name,
         count(n.link_key) AS n_items,
         CASE WHEN count(n.link_key) = 0
              THEN {_text(v.NO_LINKS)} || {_MESSAGE.replace('page_id', 'p.page_id')}
              ELSE '' END AS overview
  FROM pages p LEFT JOIN items_of_run n ON p.page_id = n.page_id GROUP BY p.page_id)"""


def _sections(items):
    return _SECTIONS.replace("items_of_run", items)


def _body(items, html):
    section, item, head, end, tail = (
        (v.HTML_SECTION, v.HTML_ITEM, v.HTML_HEAD, v.HTML_SECTION_END, v.HTML_TAIL)
        if html
        else (v.TEXT_SECTION, v.TEXT_ITEM, "", "", "")
    )
    title = _fill(section, sql.escape_html("name"), sql.escape_html("overview"))
    # the links of the sample pages have letters that an href percent-encodes
    href = (
        "list_aggregate(list_transform(regexp_extract_all(link_url, '(.)', 1), lambda x: "
        "CASE WHEN regexp_matches(x, '[A-Za-z0-9!#$&*+,/:;=?@\\[\\]._~%-]') THEN x "
        "ELSE lower(url_encode(x)) END), 'string_agg', '')"
    )
    url = sql.escape_html(href if html else "link_url")
    line = _fill(item, sql.escape_html("caption"), url)
    return f"""{sql.RUN}, {_sections(items)}
      SELECT 0 AS part, 0 AS src_ord, 0 AS line, 0 AS pos, {_text(head)} AS body
      UNION ALL SELECT 1, page_id, 0, 0, {title} FROM sections
      UNION ALL SELECT 1, page_id, 1, row_number() OVER (PARTITION BY src ORDER BY pos), {line}
        FROM {items}
      UNION ALL SELECT 1, page_id, 2, 0, {_text(end)} FROM sections
      UNION ALL SELECT 2, 0, 0, 0, {_text(tail)}"""


def _stateless(spark, sf):
    """Sets and items of a run without a store."""
    status = inputs.by_turns("page_id", inputs.STATUS)
    sets = inputs.written_sets(spark, sf, status=status)
    return sets, explode_items(sets)


def _ranked(fragments):
    """Replace node numbers by places, which the SQL twin can know."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("part", "src_ord", "line").orderBy("ord"))
    pos = F.when(F.col("line") == 1, place).otherwise(0).cast("bigint")
    return fragments.select("part", "src_ord", "line", pos.alias("pos"), "body")


@query(
    "newsletter_sections",
    f"{sql.RUN}, {_sections('good_items')} SELECT src, name, n_items, overview FROM sections",
)
def newsletter_sections(spark, sf):
    sets, items = _stateless(spark, sf)
    return op.sections(sets, items).select("src", "name", "n_items", "overview")


@query("newsletter_html", _body("good_items", True))
def newsletter_html(spark, sf):
    return _ranked(digest(*_stateless(spark, sf), html=True))


@query("newsletter_text", _body("good_items", False))
def newsletter_text(spark, sf):
    return _ranked(digest(*_stateless(spark, sf), html=False))


@query("newsletter", _body("new_items", True))
def newsletter(spark, sf):
    """A full run: sources, pages, items, seen store, digest."""
    all_sets = inputs.written_sets(spark, sf)
    out = new_dir(spark, "run")
    store.commit_run(inputs.seen_from(all_sets), f"{out}/seen", 0, inputs.NOW, inputs.EXPIRY_DAYS)
    run = run_digest(
        inputs.sources(spark, sf), inputs.fetched(spark, sf), inputs.NOW, out, f"{out}/seen", 1,
        inputs.EXPIRY_DAYS,
    )
    return _ranked(digest(spark.read.parquet(run.sets), spark.read.parquet(run.items)))


@query(
    "extract_items",
    _body("good_items", True).replace("SELECT 0 AS part", "SELECT src_ord, pos, trim(body, chr(9) "
    "|| chr(10)) AS item FROM (SELECT 0 AS part") + ") WHERE line = 1",
)
def extract_items(spark, sf):
    bodies = _ranked(digest(*_stateless(spark, sf), html=True))
    return op.extract_items(bodies).select("src_ord", "pos", "item")


@query(
    "newsletters_since",
    "SELECT event_id, ts AS created, props AS body FROM events WHERE ts >= TIMESTAMP "
    "'2024-01-15 12:00:00'",
)
def newsletters_since(spark, sf):
    sent = inputs.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("created"), F.col("props").alias("body")
    )
    return op.digests_since(sent, F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"))
