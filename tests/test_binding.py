"""Binding and parsing must not depend on page ids or on how large the catalog is."""

import re

import pytest
from pyspark.sql import functions as F
from tests import golden

from pagemill import schema
from pagemill.operators import binding, items
from pagemill.plans import crawl
from pagemill.sources import catalog
from tests.test_plans import plan

H = golden.HOST


def rows(df):
    return sorted(map(str, df.select("site_key", "page_id", "url", "page_key", "html", "scope", "fields").collect()))


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Repeated ids, null ids, a null URL, and two rows that are alike in all."""
    return spark.createDataFrame(
        [
            (1, H + "/x", "<div id='doc'><h1>one</h1>"), (1, H + "/y", "<h1>two</h1>"), (None, H + "/z", "<div id='doc'>"),
            (2, None, "no url"), (3, H + "/x", "other copy"), (4, H + "/x", None), (5, H + "/y", "a"), (5, H + "/y", "a"),
            (6, "http://stranger.example/", "x"), (None, H, "root"),
        ],
        schema.PAGES,
    )


@pytest.fixture(scope="module")
def sites(spark):
    return catalog.usable_sites(golden.sites(spark, {}, {"key": "deep", "link": H + "/x"}, {"key": "again", "condition": ["//h1"]}))


@pytest.mark.parametrize("limit", [0, binding.BROADCAST_LIMIT_BYTES])
def test_every_row_binds_by_its_url(odd_pages, sites, limit):
    bound = binding.bind_sites(odd_pages, sites, limit)
    # Each page below the host for two sites; the three copies of /x for the deeper one too.
    assert bound.count() == 8 * 2 + 3
    assert bound.where("page_id IS NULL").count() == 4
    assert bound.where(F.col("page_key") != F.coalesce(F.regexp_replace("url", "example$", "example/"), F.lit(""))).isEmpty()
    assert rows(bound) == rows(binding.bind_sites(odd_pages, sites))


@pytest.mark.parametrize("limit", [0, binding.BROADCAST_LIMIT_BYTES])
def test_one_parse_tells_what_a_parse_for_each_site_does(odd_pages, sites, limit, monkeypatch):
    monkeypatch.setattr(binding, "SITES_PER_CALL", 1)
    columns = ["site_key", "page_id", "url", "page_key", "facts"]
    want = items.with_facts(binding.bind_sites(odd_pages, sites)).select(columns)
    got = binding.parse_sites(odd_pages, sites, limit).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_questions_to_every_page(odd_pages, sites):
    asked = [(["//h1"], [], []), (["//nothing"], ["//h1"], [])]
    for limit in (0, binding.BROADCAST_LIMIT_BYTES):
        told = binding.parse_pages(odd_pages, binding.index_sites(sites, limit), everywhere=asked)
        assert told.count() == odd_pages.count() and told.where("size(everywhere) <> 2").isEmpty()
        hits = told.select("page_id", F.explode("everywhere").alias("e")).where("e.facts.is_content")
        assert {(r.page_id, r.e.site) for r in hits.collect()} == {(1, 0)}


def test_fifty_sites_on_one_folder_parse_a_page_once(spark, tmp_path):
    many = catalog.usable_sites(golden.sites(spark, *[{"key": f"s{i:02}", "condition": [f"//h{i % 3}"]} for i in range(50)]))
    golden.pages(spark).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    found = binding.parse_sites(pages, many).select("site_key", "facts.is_content")
    text = plan(found)
    # One call for the numbers, one for the parse, both below the multiplication by sites.
    assert text.count("ArrowEvalPython") == 2 and text.index("Generate explode") < text.index("ArrowEvalPython")
    assert not re.search(r"Exchange (hash|range|Round)", text)
    assert found.count() == 50 * len(golden.PAGES)


def test_repeated_pages_give_one_reached_row(spark, odd_pages, sites):
    """Copies of a URL, ids that repeat, and pages without an id."""
    links = "".join(f'<a href="{H}/{p}">' for p in "xyz")
    pages = odd_pages.unionByName(spark.createDataFrame([(0, H + "/", links), (0, H + "/", links), (0, H, links)], schema.PAGES))
    result = crawl.crawl(pages, sites.where("site_key = 'g'"))
    got = sorted((r.url.removeprefix(H), r.depth, r.status, r.is_content) for r in result.reached.collect())
    assert got == [("/", 0, "ok", False), ("/x", 1, "ok", True), ("/y", 1, "ok", False), ("/z", 1, "ok", True)]
    content = {(r.url.removeprefix(H), r.page_id) for r in result.content().collect()}
    assert content == {("/x", 1), ("/z", None)}
