"""Table schemas."""

LINK_SOURCES = (
    "src STRING, name STRING, url STRING, item_selector STRING, caption_selector STRING, "
    "link_selector STRING, max_items INT, min_element_words INT, src_ord BIGINT"
)
PAGES = "page_id BIGINT, url STRING, html STRING"
FETCHED = "src STRING, url STRING, status INT, fetched_at TIMESTAMP, html STRING"
NODE = (
    "STRUCT<nid: INT, parent: INT, depth: INT, last: INT, kind: STRING, tag: STRING, "
    "txt: STRING, attrs: MAP<STRING, STRING>, sib: INT, nth: INT, prev: INT, sib_end: INT, nth_end: INT>"
)
ITEM = "STRUCT<ord: INT, link_url: STRING, caption: STRING>"
SEEN = "link_key STRING, seen_at TIMESTAMP"
