"""Streams against their batch twins."""

from pyspark.sql import functions as F

from gleaner.operators import ticks as op
from gleaner.operators.store import read_seen
from gleaner.queries import QUERIES
from gleaner.sources.pages import stream_pages
from gleaner.sources.tables import new_dir
from gleaner.streaming.common import write_all
from gleaner.streaming.digest import run_stream, run_when_due
from gleaner.streaming.seen import new_items_stream
from gleaner.streaming.ticks import due_stream
from tests.test_runs import CHANGED, FIVE, site, sources


def land(df, folder, n):
    df.coalesce(1).write.parquet(f"{folder}/{n}")


def test_due_stream(spark):
    out = new_dir(spark, "test")
    ticks = spark.range(0, 60 * 24 * 10).select(
        (F.timestamp_seconds(F.lit(1748736000) + F.col("id") * 60)).alias("ts"))
    land(ticks.filter("ts < '2025-06-05 10:30'"), f"{out}/in", 0)
    land(ticks.filter("ts >= '2025-06-05 10:30'"), f"{out}/in", 1)
    texts = [("a", "MWF 12"), ("b", "Th 10"), ("c", "SaSu 0")]
    moments = op.moments(op.parse_schedules(spark.createDataFrame(texts, "handle STRING, schedule STRING")))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/*")
    write_all(due_stream(stream, moments), f"{out}/due", f"{out}/check")
    got = sorted(map(tuple, spark.read.parquet(f"{out}/due").select("date", "hour", "handle").collect()))
    twin = op.due(op.due_ticks(ticks), moments).select("date", "hour", "handle")
    assert got == sorted(map(tuple, twin.collect())) and len(got) == 8


def test_new_items_stream_across_batches(spark):
    out = new_dir(spark, "test")
    schema = "link_key STRING, link_url STRING, caption STRING, src STRING, day INT"
    rows = [[("k1", "u1", "c1", "b", 1), ("k1", "u1", "c1", "a", 1), ("k2", "u2", "c2", "a", 2)],
            [("k2", "u2", "c2", "z", 100), ("k3", "u3", "c3", "z", 500)],
            [("k1", "u1", "c1", "z", 510), ("k3", "u3", "c3", "z", 520), ("k4", "u4", "c4", "z", 5)],
            [("k1", "u1", "c1", "y", 511)]]
    for n, batch in enumerate(rows):
        land(spark.createDataFrame(batch, schema), f"{out}/in", n)
        items = spark.readStream.schema(schema).parquet(f"{out}/in/*").withColumn(
            "fetched_at", F.timestamp_seconds(F.col("day") * 86400))
        write_all(new_items_stream(items, 180), f"{out}/new", f"{out}/check")
    got = sorted((r.link_key, r.link_url) for r in spark.read.parquet(f"{out}/new").collect())
    # k1 is new again after its time, k4 comes too late
    assert got == [("k1", "u1"), ("k1", "u1"), ("k2", "u2"), ("k3", "u3")]


def test_run_stream(spark):
    out = new_dir(spark, "test")
    schema = "src STRING, status INT, html STRING"
    src = sources(spark, ["one", "two"])
    landed = [[("one", 200, site(FIVE))], [("one", 200, site(CHANGED)), ("two", 404, "")]]
    for n, pages in enumerate(landed):
        land(spark.createDataFrame(pages, schema), f"{out}/in", n)
        fetched = stream_pages(spark, f"{out}/in/*", schema)
        run_stream(src, fetched, f"{out}/runs", f"{out}/check",
                   lambda batch: f"2024-01-0{batch + 1} 00:00:00")
    first = spark.read.parquet(f"{out}/runs/0/items")
    second = spark.read.parquet(f"{out}/runs/1/items")
    assert first.count() == 5
    assert {r.caption for r in second.collect()} == {"New one. go.", "New two. go."}
    assert spark.read.parquet(f"{out}/runs/1/sets").count() == 2
    assert read_seen(spark, f"{out}/runs/seen").count() == 7
    assert read_seen(spark, f"{out}/runs/seen", before_run=1).count() == 5


def test_no_plan_has_a_single_partition_window(spark):
    ticks = spark.range(5000).select("id", F.timestamp_seconds(F.lit(1748736000) + F.col("id") * 600).alias("ts"))
    found = op.due_ticks_by_arrival(ticks, "id", block=100)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == op.due_ticks(ticks).count()


def test_first_run_and_one_run_for_each_due_tick(spark):
    out = new_dir(spark, "test")
    ticks = spark.range(0, 60 * 24 * 8, 20).select(
        F.timestamp_seconds(F.lit(1748736000) + F.col("id") * 60).alias("ts"))
    land(ticks, f"{out}/in", 0)
    texts = spark.createDataFrame([("mine", "TuF 9")], "handle STRING, schedule STRING")
    due = due_stream(spark.readStream.schema(ticks.schema).parquet(f"{out}/in/*"),
                     op.moments(op.parse_schedules(texts)))
    calls = []

    def read_pages():
        calls.append(1)
        page = site(FIVE[: 1 + len(calls)])
        return spark.createDataFrame([("one", 200, page)], "src STRING, status INT, html STRING")

    run_when_due(due, sources(spark, ["one"]), read_pages, "2025-06-01 00:00:00", f"{out}/runs", f"{out}/check")
    found = sorted(r.n for r in spark.read.parquet(f"{out}/runs/*/items").select(
        F.regexp_extract(F.input_file_name(), "runs/([0-9]+)/", 1).cast("bigint").alias("n")).collect())
    # Tuesday and Friday at nine: one new link each, after two in the first run
    assert found == [0, 0, 485817, 485889]


def test_newsletter_stream_reads_tables_of_one_file_and_of_many(spark):
    one, many = new_dir(spark, "test"), new_dir(spark, "test")
    rows = [(n, f"http://s{n}.example.org/", site([(h, f"{t} {n}") for h, t in FIVE])) for n in range(10)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    pages.repartition(4).write.parquet(f"{many}/pages.parquet")
    pages.coalesce(1).write.parquet(f"{one}/written")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    (file,) = spark.read.parquet(f"{one}/written").inputFiles()
    fs = path(file).getFileSystem(conf)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(file), fs, path(f"{one}/pages.parquet"), False, conf)
    got = [sorted(map(tuple, QUERIES["newsletter_stream"](spark, sf).collect())) for sf in (one, many)]
    # the sources 5 to 9 were fetched
    assert got[0] == got[1] and len(got[0]) == 5 * 5
