"""Item tables and the seen store."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.functions import values as v
from gleaner.operators import items as op, levels, store
from gleaner.plans.digest import run_items
from gleaner.plans.source_sets import detected, source_pages as join_pages, source_sets, with_route
from gleaner.queries import sql
from gleaner.queries.feeds import FEED_ITEMS
from gleaner.queries.registry import query
from gleaner.queries.scalars import STATUS_MESSAGES
from gleaner.sources.tables import new_dir, written


def _raw_items(spark, sf, **settings):
    """Items before dedupe and caps, with the limit of their source."""
    found = detected(with_route(inputs.page_rows(spark, sf, **settings)))
    rows = found.select(
        "src", "src_ord", "max_items", F.explode_outer("found.items").alias("item")
    )
    return rows.filter(F.col("item").isNotNull()).select("src", "src_ord", "max_items", "item.*")


@query("dedupe_url", f"WITH {sql.SET_ITEMS} SELECT src, link_url, caption FROM last_items")
def dedupe_url(spark, sf):
    return op.dedupe_url(_raw_items(spark, sf)).select("src", "link_url", "caption")


@query(
    "clean_items",
    f"WITH {sql.RAW_ITEMS} SELECT src, link_url, caption FROM raw_items "
    f"WHERE {sql.trim_any('caption')} <> ''",
)
def clean_items(spark, sf):
    return op.clean_items(_raw_items(spark, sf)).select("src", "link_url", "caption")


@query(
    "max_items",
    f"""WITH {sql.RAW_ITEMS} SELECT src, link_url, caption FROM raw_items
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= page_id % 4
             OR page_id % 4 = 0""",
)
def max_items(spark, sf):
    limit = (F.col("page_id") % 4).cast("int")
    return op.cap_items(_raw_items(spark, sf, max_items=limit)).select("src", "link_url", "caption")


@query(
    "remove_items",
    f"""WITH {sql.SET_ITEMS}, gone AS (SELECT src, link_url FROM set_items WHERE length(caption) < 5)
        SELECT src, link_url, caption FROM set_items ANTI JOIN gone USING (src, link_url)""",
)
def remove_items(spark, sf):
    items = op.explode_items(inputs.written_sets(spark, sf))
    gone = items.filter(F.length("caption") < 5)
    return op.remove_items(items, gone).select("src", "link_url", "caption")


@query(
    "item_counts",
    f"""WITH {sql.SET_ITEMS}, {sql.GOOD_ITEMS}
        SELECT CAST(p.page_id AS VARCHAR) AS src, count(g.link_url) AS n_items
        FROM pages p LEFT JOIN good_items g ON p.page_id = g.page_id GROUP BY p.page_id""",
)
def item_counts(spark, sf):
    status = inputs.by_turns("page_id", inputs.STATUS)
    return op.item_counts(inputs.sets(spark, sf, status=status))


def _page_status():
    return inputs.by_turns("page_id", inputs.STATUS)


@query(
    "source_items",
    f"WITH {sql.SET_ITEMS}, {sql.GOOD_ITEMS} SELECT src, link_url, caption FROM good_items "
    "QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= 5",
)
def source_items(spark, sf):
    sets = inputs.sets(spark, sf, status=_page_status(), max_items=F.lit(5))
    return op.explode_items(sets).select("src", "link_url", "caption")


@query(
    "source_messages",
    f"SELECT CAST(page_id AS VARCHAR) AS src, coalesce({STATUS_MESSAGES(sql.STATUS_OF)}, '') "
    "AS messages FROM pages",
)
def source_messages(spark, sf):
    sets = inputs.sets(spark, sf, status=_page_status())
    return sets.select("src", F.array_join("messages", " ").alias("messages"))


@query(
    "null_pages",
    f"SELECT CAST(page_id AS VARCHAR) AS src, '' AS name, '{v.MSG_NULL_PAGE}' AS messages "
    "FROM pages WHERE length(html) % 3 = 0",
)
def null_pages(spark, sf):
    body = F.when(F.length("html") % 3 != 0, F.col("html"))
    sets = source_sets(inputs.page_rows(spark, sf).withColumn("html", body))
    missing = sets.filter(F.array_contains("messages", v.MSG_NULL_PAGE))
    return missing.select("src", "name", F.array_join("messages", " ").alias("messages"))


@query(
    "source_pages",
    f"SELECT CAST(page_id AS VARCHAR) AS src, url, {sql.STATUS_OF} AS status, "
    "length(html) AS n_chars FROM pages",
)
def source_pages(spark, sf):
    joined = join_pages(inputs.sources(spark, sf), inputs.fetched(spark, sf))
    return joined.select("src", "url", "status", F.length("html").cast("bigint").alias("n_chars"))


@query(
    "source_pages_refetched",
    f"SELECT CAST(page_id AS VARCHAR) AS src, 'News' AS name, url, 200 AS status, "
    "length(html) + CASE WHEN page_id % 2 = 0 THEN 14 ELSE 0 END AS n_chars FROM pages",
)
def source_pages_refetched(spark, sf):
    """Sources of the same name, with two or three fetches of many pages."""
    page = inputs.pages(spark, sf).select(
        F.col("page_id"), F.col("page_id").cast("string").alias("src"), F.lit(200).alias("status"), "html"
    )
    fetch = lambda day, rows, html: rows.withColumn("html", html).withColumn(
        "fetched_at", F.lit(f"{day} 00:00:00").cast("timestamp"))
    again = F.concat("html", F.lit("<!-- again -->"))
    fetched = (
        fetch("2024-01-02", page.filter("page_id % 2 = 0"), again)
        .union(fetch("2024-01-01", page, F.col("html")))
        .union(fetch("2023-12-31", page.filter("page_id % 3 = 0"), F.lit("old")))
    )
    joined = join_pages(inputs.sources(spark, sf, name=F.lit("News")), fetched)
    return joined.select("src", "name", "url", "status", F.length("html").cast("bigint").alias("n_chars"))


@query(
    "items_all",
    f"""WITH {sql.SET_ITEMS}, {FEED_ITEMS}
        SELECT src, link_url, caption FROM (
          SELECT src, link_url, caption, page_id AS k, pos FROM clean
          UNION ALL SELECT 'rss-' || doc_id, link_url, caption, doc_id, ord FROM feed_items
          UNION ALL SELECT 'atom-' || doc_id, link_url, caption, doc_id, ord FROM feed_items)""",
)
def items_all(spark, sf):
    """Pages and both kinds of feeds through one plan."""

    def feed(kind, bodies):
        return bodies.select(
            F.concat(F.lit(f"{kind}-"), F.col("doc_id").cast("string")).alias("src"),
            F.lit("http://feed.example.org/").alias("url"),
            F.col("doc_id").alias("src_ord"),
            "html",
        )

    pages = inputs.page_rows(spark, sf).select("src", "url", "src_ord", "html")
    feeds = feed("rss", inputs.rss_bodies(spark, sf)).unionByName(
        feed("atom", inputs.atom_bodies(spark, sf))
    )
    rows = pages.unionByName(feeds).select(
        "*",
        F.col("src").alias("name"),
        F.lit(0).alias("max_items"),
        F.lit(0).alias("min_element_words"),
        F.lit(200).alias("status"),
        F.lit(True).alias("fetched"),
    )
    return op.explode_items(source_sets(rows)).select("src", "link_url", "caption")


@query(
    "latest_pages",
    f"SELECT page_id, url, length(html) AS n_chars FROM pages "
    f"QUALIFY row_number() OVER (PARTITION BY {sql.host('url')} ORDER BY page_id DESC) = 1",
)
def latest_pages(spark, sf):
    from gleaner.functions.urls import host

    pages = inputs.table(spark, sf, "pages").select(
        "page_id", "url", host(F.col("url")).alias("host"), F.length("html").cast("bigint").alias("n_chars")
    )
    return op.latest_snapshots(pages, "host", [], "page_id").drop("host")


@query(
    "seen_entries",
    f"WITH {sql.SET_ITEMS} SELECT DISTINCT link_key, epoch(TIMESTAMP '{inputs.NOW}')::BIGINT AS seen_at "
    "FROM set_items",
)
def seen_entries(spark, sf):
    rows = store.entries(op.explode_items(inputs.sets(spark, sf)), inputs.NOW)
    return rows.select("link_key", F.unix_timestamp("seen_at").alias("seen_at"))


def _run(spark, sf):
    """Items of all sources, and the store."""
    all_sets = inputs.written_sets(spark, sf)
    return op.explode_items(all_sets), inputs.seen_from(all_sets)


@query(
    "seen_lookup",
    f"{sql.RUN_ALL} SELECT g.src, g.link_url, s.seen_at FROM good_items g "
    "LEFT JOIN alive s ON g.link_key = s.link_key",
)
def seen_lookup(spark, sf):
    items, seen = _run(spark, sf)
    alive = store.alive(seen, inputs.NOW, inputs.EXPIRY_DAYS)
    return store.lookup(items, alive).select("src", "link_url", "seen_at")


@query("new_items", f"{sql.RUN_ALL} SELECT src, link_url, caption, link_key FROM new_items")
def new_items(spark, sf):
    items, seen = _run(spark, sf)
    new = store.new_items(items, seen, inputs.NOW, inputs.EXPIRY_DAYS)
    return new.select("src", "link_url", "caption", "link_key")


@query(
    "new_items_stateless",
    f"{sql.RUN} SELECT src, link_url, caption, link_key FROM good_items",
)
def new_items_stateless(spark, sf):
    sets = inputs.sets(spark, sf, status=_page_status())
    return run_items(sets, None, inputs.NOW).select("src", "link_url", "caption", "link_key")


@query(
    "seen_upsert",
    f"{sql.RUN_ALL} SELECT link_key, min(seen_at) AS seen_at FROM (SELECT link_key, seen_at FROM alive "
    f"UNION ALL SELECT link_key, TIMESTAMP '{inputs.NOW}' FROM new_items) GROUP BY link_key",
)
def seen_upsert(spark, sf):
    items, seen = _run(spark, sf)
    seen = written(seen, "seen")
    new = store.new_items(items, seen, inputs.NOW, inputs.EXPIRY_DAYS)
    return store.upsert(seen, new, inputs.NOW, inputs.EXPIRY_DAYS)


@query("seen_cleanup", f"{sql.RUN_ALL} SELECT link_key, seen_at FROM alive")
def seen_cleanup(spark, sf):
    seen = inputs.seen_from(inputs.sets(spark, sf))
    return store.cleanup(seen, inputs.NOW, inputs.EXPIRY_DAYS)


@query(
    "repeat_items",
    f"{sql.RUN_ALL} SELECT src, link_url, caption FROM good_items SEMI JOIN alive USING (link_key)",
)
def repeat_items(spark, sf):
    """Items of a run that an earlier digest had."""
    items, seen = _run(spark, sf)
    before = store.alive(seen, inputs.NOW, inputs.EXPIRY_DAYS)
    return op.items_in_both(before, op.with_key(items), ["link_key"]).select(
        "src", "link_url", "caption"
    )


_RUNS, _RUN_DAYS, _KEPT_DAYS = 6, 20, 50


def _run_times():
    return [datetime(2024, 1, 1) + timedelta(days=_RUN_DAYS * n) for n in range(_RUNS)]


def _seen_compacted_sql():
    """The stores after each run, one after the other."""
    steps, before = [], "SELECT '' AS link_key, TIMESTAMP '2000-01-01' AS seen_at WHERE false"
    for n, now in enumerate(_run_times()):
        steps.append(
            f"live{n} AS (SELECT * FROM ({before}) WHERE seen_at > TIMESTAMP '{now}' - INTERVAL {_KEPT_DAYS} DAY), "
            f"store{n} AS (SELECT * FROM live{n} UNION ALL SELECT DISTINCT link_key, TIMESTAMP '{now}' FROM "
            f"(SELECT * FROM set_items WHERE src_ord % {_RUNS} = {n} OR src_ord % 4 = {n % 4}) i "
            f"ANTI JOIN live{n} l ON i.link_key = l.link_key)"
        )
        before = f"SELECT * FROM store{n}"
    return f"WITH {sql.SET_ITEMS}, {', '.join(steps)} {before}"


@query("seen_compacted", _seen_compacted_sql())
def seen_compacted(spark, sf):
    """Six runs on one store, each over a part of the pages, a quarter of which every
    fourth run sees again; the store merges and drops keys as it goes."""
    items = written(op.with_key(op.explode_items(inputs.sets(spark, sf))), "items")
    path = new_dir(spark, "seen")
    for n, now in enumerate(_run_times()):
        part = items.filter((F.col("src_ord") % _RUNS == n) | (F.col("src_ord") % 4 == n % 4))
        keys = part.select("link_key").distinct()
        seen = store.seen_before(spark, path, keys, now, _KEPT_DAYS, before_run=n)
        new = keys.join(seen, "link_key", "left_anti")
        store.commit_run(new, path, n, now, _KEPT_DAYS, fanout=2)
        levels.vacuum(spark, path, n)
    return store.alive(store.read_seen(spark, path), _run_times()[-1], _KEPT_DAYS)
