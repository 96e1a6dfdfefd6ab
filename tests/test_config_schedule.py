"""Configuration checks, schedules and ticks."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import schedules, urls, values as v
from gleaner.operators import ticks as op
from gleaner.sources import configs
from gleaner.sources.pages import page_format
from gleaner.sources.tables import new_dir


def test_url_validity(spark):
    cases = {
        "http://www.example.com/path": True, "localhost:3000": True, "http://www.example": True,
        "www.example.com": False, "localhost": False, "/path": False, "": False, "http://#": False,
        "http://www.example test.com": False, "https://u:p@h:1/x?y#z": True, "http://h:x": False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u STRING")
    got = {r.u: r.ok for r in df.select("u", urls.source_url_valid(F.col("u")).alias("ok")).collect()}
    assert got == cases


def test_display_url(spark):
    cases = {
        "/p": "http://h:1/p", "page2": "http://hpage2".replace("h", "h", 1).replace("hpage2", "h:1page2"),
        "https://o.com/a%20b%2Bc+d": "http://o.com/a b+c+d", "//o.com": "http://o.com",
        "mailto:x@y.z": "http://h:1", "?q=1": "http://h:1", "/a%zz": None, "http://a b/": None,
        "http://u@o.com/x": "http://o.com/x", "1a:b": None, "/x:y": "http://h:1/x:y",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u STRING")
    shown = urls.display_url(F.lit("http"), F.lit("h:1"), F.col("u"))
    assert {r.u: r.d for r in df.select("u", shown.alias("d")).collect()} == cases


def test_config_file(spark):
    out = new_dir(spark, "test")
    good = {"name": "Site", "url": "http://e.com"}
    broken = [
        ({"url": "e.com"}, v.ERR_URL_INVALID), ({"name": ""}, v.ERR_NAME_BLANK),
        ({"maxItems": "x"}, v.ERR_MAX_ITEMS), ({"minElementWords": -1}, v.ERR_MIN_WORDS),
        ({"linkSelector": "123"}, v.ERR_LINK_SELECTOR),
        ({"itemSelector": "li"}, v.ERR_NEEDS_LINK_SELECTOR),
        ({"itemSelector": "li", "linkSelector": "a"}, v.ERR_ITEM_AND_CAPTION),
        ({"captionSelector": "p", "linkSelector": "a"}, v.ERR_ITEM_AND_CAPTION),
    ]
    conf = {
        "email": {"smtpServerAddress": "smtp://0.0.0.0:123"},
        "scraping": {"storageDir": "./d", "schedule": "MWF 12", "linkExpiryDays": 0},
        "link_sources": [good, {**good, "maxItems": 0, "minElementWords": 0},
                         {**good, "maxItems": 9, "linkSelector": "ul li a"}]
        + [{**good, **b} for b, _ in broken],
    }
    spark.createDataFrame([(json.dumps(conf, indent=1),)], "v STRING").coalesce(1).write.text(f"{out}/c")
    rows = configs.link_sources(configs.read_config_file(spark, f"{out}/c")).orderBy("src_ord").collect()
    assert [r.error for r in rows] == [None] * 3 + [e for _, e in broken]
    assert [(r.max_items, r.min_element_words) for r in rows[:3]] == [(5, 3), (5, 0), (9, 3)]
    s = configs.read_scraping(spark, f"{out}/c").first()
    assert (s.storage_dir, s.link_expiry_days, s.weekdays, s.hour, s.error) == ("./d", 180, 21, 12, None)


def test_scraping_errors(spark):
    rows = [("./d", "M 1", None, None), ("", "M 1", "3", v.ERR_STORAGE), ("./d", "M 1", "x", v.ERR_EXPIRY),
            ("./d", "M 1", "-3", v.ERR_EXPIRY), ("./d", "12 M", "3", v.ERR_SCHEDULE_HOUR)]
    df = spark.createDataFrame(rows, "storageDir STRING, schedule STRING, linkExpiryDays STRING, want STRING")
    got = [r.error for r in configs.check_scraping(df).collect()]
    assert got == [r[3] for r in rows]
    assert configs.check_scraping(df.limit(2), stateless=True).filter("error is null").count() == 2


@pytest.mark.parametrize("text,days,hour,error", [
    ("W 12", [2], 12, None), ("MF 13", [0, 4], 13, None), ("MTuW 13", [0, 1, 2], 13, None),
    ("WMTu 13", [0, 1, 2], 13, None), ("MM 15", [0], 15, None), ("SaSuTh 0", [3, 5, 6], 0, None),
    ("x 7", [], 7, None), ("M", None, None, v.ERR_SCHEDULE_PARTS), ("12", None, None, v.ERR_SCHEDULE_PARTS),
    ("", None, None, v.ERR_SCHEDULE_PARTS), ("MTW 12", None, None, v.ERR_SCHEDULE_DAY),
    ("12 MT", None, None, v.ERR_SCHEDULE_HOUR), ("M 99", [0], 99, None),
])
def test_schedule(spark, text, days, hour, error):
    df = spark.createDataFrame([("h", text)], "handle STRING, schedule STRING")
    r = op.parse_schedules(df).withColumn("days", schedules.day_numbers(F.col("weekdays"))).first()
    assert (r.days, r.hour, r.error) == (days or [], hour, error)


TICKS = {
    "two handles": (["2025-06-04 14:00"], [("2025-06-04 14:00", "a"), ("2025-06-04 14:00", "b")]),
    "same hour": (["2025-06-02 12:00", "2025-06-02 12:01"], [("2025-06-02 12:00", "m")]),
    "next week": (["2025-06-02 12:00", "2025-06-09 12:00"],
                  [("2025-06-02 12:00", "m"), ("2025-06-09 12:00", "m")]),
    "backwards": (["2025-06-02 14:00", "2025-06-02 12:00", "2025-06-02 14:30"],
                  [("2025-06-02 14:00", "m"), ("2025-06-02 12:00", "m"), ("2025-06-02 14:30", "m")]),
    "not due": (["2025-06-03 12:00"], []),
}


@pytest.mark.parametrize("case", TICKS)
@pytest.mark.parametrize("block", [1, 2, 1000])
def test_ticks(spark, case, block):
    texts = [("a", "W 14"), ("b", "W 14"), ("m", "M 12"), ("m", "M 14")]
    moments = op.moments(op.parse_schedules(spark.createDataFrame(texts, "handle STRING, schedule STRING")))
    arrived, want = TICKS[case]
    ticks = spark.createDataFrame(list(enumerate(arrived)), "n BIGINT, t STRING").select(
        "n", F.col("t").cast("timestamp").alias("ts"))
    fired = op.due_ticks_by_arrival(ticks, "n", block=block)
    got = {(r.ts.strftime("%Y-%m-%d %H:%M"), r.handle) for r in op.due(fired, moments).collect()}
    assert got == set(want)
    if case != "backwards":
        in_order = op.due(op.due_ticks(ticks), moments).collect()
        assert {(r.ts.strftime("%Y-%m-%d %H:%M"), r.handle) for r in in_order} == set(want)


def test_page_format(spark):
    cases = {
        '<rss version="0.91">': "rss", '<?xml?><feed xmlns="x">': "atom", "<!dOcTyPe html>": "html",
        '<html lang="en" op="news">': "html", "<html><head>": "html", '<?xml?><rss version="2.0"': "rss",
        '<html class="rss">': "rss", "text": "unknown", "<!doctype html public>": "unknown",
        "a\n<html>\n<rss>": "html", "x" * 65536 + "\n<html>": "html", "x" * 65535 + "\n<html>": "html",
        "<html>" + "x" * 70000: "html", "<html>\n" + "x" * 70000: "html",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c STRING")
    assert {r.c: r.f for r in df.select("c", page_format(F.col("c")).alias("f")).collect()} == cases
