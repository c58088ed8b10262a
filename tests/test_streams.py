import pytest
from pyspark.sql import functions as F

from checks import derived as D
from checks import queries
from pagemill import schema
from pagemill.operators import items
from pagemill.operators.binding import bind_sites
from pagemill.operators.links import explode_links, extract_links, with_links
from pagemill.sources import catalog
from pagemill.sources.pages import stream_pages
from pagemill.streaming import jobs, visits
from tests import golden

SOURCE = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The pages in five files, read two files per micro-batch."""
    path = str(tmp_path_factory.mktemp("pages"))
    spark.read.parquet(SOURCE).repartition(5).write.mode("overwrite").parquet(path)
    return path


def stream(spark, path):
    return stream_pages(spark, path, maxFilesPerTrigger=2)


def drain(df, path, mode="append"):
    jobs.write_batches(df, str(path / "out"), str(path / "ck"), mode).awaitTermination()
    return df.sparkSession.read.parquet(str(path / "out"))


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_links_equal_batch(spark, split, tmp_path):
    out = drain(jobs.stream_links(stream(spark, split)), tmp_path)
    assert out.select("batch_id").distinct().count() == 3
    assert same(out.drop("batch_id"), extract_links(spark.read.parquet(split)))


def test_first_seen_and_visits_equal_batch(spark, split, tmp_path):
    pages = spark.read.parquet(split)
    sites = D.sites(pages)
    batch = explode_links(with_links(bind_sites(pages, sites)), "site_key")
    rows = jobs.site_urls(stream(spark, split), sites)
    out = drain(jobs.first_seen(rows), tmp_path / "a")
    assert same(out.drop("batch_id"), batch.select("site_key", "url").distinct())
    visits = jobs.flag_visits(drain(jobs.visit_counts(jobs.site_urls(stream(spark, split), sites)), tmp_path / "b", "update"))
    want = batch.groupBy("site_key", "url").agg(F.count("*").alias("visits"))
    assert same(visits.drop("repeated"), want)
    assert same(visits.where("repeated"), visits.where("visits > 1"))


def test_first_seen_survives_a_restart(spark, split, tmp_path):
    pages = spark.read.parquet(split)
    folder, sites = tmp_path / "in", D.sites(pages)
    for _ in range(2):
        pages.coalesce(1).write.mode("append").parquet(str(folder))
        df = jobs.first_seen(jobs.site_urls(stream(spark, str(folder)), sites))
        drain(df, tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("site_key", "url").distinct().count() > 0


def test_first_seen_within_a_watermark(spark, split, tmp_path):
    rows = jobs.site_urls(stream(spark, split), D.sites(spark.read.parquet(split)))
    timed = rows.withColumn("at", F.timestamp_seconds("page_id"))
    out = drain(jobs.first_seen(timed, "at"), tmp_path)
    assert out.count() == out.select("site_key", "url").distinct().count() > 0


def test_items_split_into_three_tables(spark, split, tmp_path):
    pages = spark.read.parquet(split)
    sites = D.sites(pages)
    jobs.write_items(stream(spark, split), sites, str(tmp_path), str(tmp_path / "ck"), D.SERVER).awaitTermination()
    found = items.extract_items(items.with_facts(bind_sites(pages, sites)))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").drop("batch_id")
    want = items.envelopes(items.valid_items(found))
    assert same(read("items").select("page_id", "body"), want.select("page_id", "body"))
    assert same(read("quarantine"), items.item_quarantine(found))
    assert read("outbox").count() == want.count() > 0


def test_error_pages_are_left_out(spark, tmp_path):
    rows = [(1, "http://h/", '<html><body><pre>{"error":500}</pre><a href="/x">x</a>'), (2, "http://h/b", '<a href="/y">y</a>')]
    spark.createDataFrame(rows, schema.PAGES).write.parquet(str(tmp_path / "in"))
    out = drain(jobs.stream_links(stream(spark, str(tmp_path / "in"))), tmp_path)
    assert [r.url for r in out.collect()] == ["http://h/y"]


def test_visits_are_flagged_within_the_stream(spark, split, tmp_path):
    """A URL is first once, repeated ever after, and its visits add up over micro-batches."""
    folder = str(tmp_path / "in")
    pages = spark.read.parquet(split)
    for _ in range(2):
        pages.coalesce(1).write.mode("append").parquet(folder)
    sites = D.sites(pages)
    rows = jobs.site_urls(stream_pages(spark, folder, maxFilesPerTrigger=1), sites, broadcast_limit=0)
    jobs.write_batches(
        visits.flagged_visits(rows, ttl_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "ck"), "update", empty_batches=False
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    once = jobs.site_urls(pages, sites).groupBy("site_key", "url").count()
    assert same(out.where("batch_id = 0").select("site_key", "url", F.col("visits").alias("count")), once)
    assert same(out.where("batch_id = 1").select("site_key", "url", (F.col("visits") / 2).cast("long").alias("count")), once)
    assert out.where("first <> (batch_id = 0)").isEmpty() and out.where("repeated <> (visits > 1)").isEmpty()


def test_a_page_that_arrives_again_is_not_parsed_again(spark, tmp_path):
    page = '<div id="doc"><h2>s</h2><h1>T</h1><span class="dt">d</span><meta name="d" content="x"></div>'
    spellings = ["http://g.example/p", "HTTP://G.example/p", "http://g.example/p#top"]
    for i, url in enumerate(spellings):
        spark.createDataFrame([(i, url, page)], schema.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sites = catalog.usable_sites(golden.sites(spark))
    for name, once in (("gated", True), ("open", False)):
        arriving = stream_pages(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
        jobs.write_items(arriving, sites, str(tmp_path / name), str(tmp_path / name / "ck"), D.SERVER, once=once).awaitTermination()
        assert spark.read.parquet(str(tmp_path / name / "items")).count() == (1 if once else 3)


def test_large_catalogs_serve_streams(spark, split, tmp_path):
    pages = spark.read.parquet(split)
    sites = D.sites(pages)
    small, large = (jobs.site_urls(pages, sites, broadcast_limit=limit) for limit in (1 << 25, 0))
    assert same(small, large)
    for name, limit in (("a", 1 << 25), ("b", 0)):
        jobs.write_items(stream(spark, split), sites, str(tmp_path / name), str(tmp_path / name / "ck"), D.SERVER, broadcast_limit=limit).awaitTermination()
    a, b = (spark.read.parquet(f"{tmp_path}/{name}/items").select("site_key", "page_id", "body") for name in "ab")
    assert same(a, b) and not a.isEmpty()


@pytest.mark.parametrize("name", ["stream_links", "stream_first_seen", "stream_visits", "stream_items"])
def test_stream_queries_read_tables_of_several_files(spark, tmp_path, name):
    """A table is one file or a folder of files, of any name."""
    pages = spark.read.parquet(SOURCE)
    pages.coalesce(1).write.parquet(str(tmp_path / "one"))
    pages.repartition(3).write.parquet(str(tmp_path / "many/pages.parquet"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "single/pages.parquet")
    for i, part in enumerate((tmp_path / "many/pages.parquet").glob("part-*")):
        part.rename(part.with_name(f"{i}.data"))
    made = [queries.registry()[name](spark, str(tmp_path / kind)) for kind in ("single", "many")]
    assert same(*made) and not made[0].isEmpty()


def test_visits_are_flagged_in_a_session_without_a_state_store(spark, split, tmp_path):
    """Spark's default store keeps no keyed state; the session's own settings stay as they are."""
    key, rows = "spark.sql.streaming.stateStore.providerClass", jobs.site_urls(stream(spark, split), D.sites(spark.read.parquet(split)))
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        flagged = visits.flagged_visits(rows)
        jobs.write_batches(flagged, str(tmp_path / "out"), str(tmp_path / "ck"), "update").awaitTermination()
        assert spark.conf.get(key, None) is None
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("first").count() == out.select("site_key", "url").distinct().count() > 0
