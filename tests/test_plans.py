"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from checks import derived as D
from pagemill import runtime
from pagemill.operators import items, links
from pagemill.operators.binding import bind_sites
from pagemill.plans import crawl

SOURCE = "/root/testdata/sf0.001/pages.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_link_extraction_never_shuffles_and_reads_only_its_columns(spark):
    text = plan(links.extract_links(spark.read.parquet(SOURCE)))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text
    assert "html" not in re.search("ReadSchema: (.*)", plan(spark.read.parquet(SOURCE).select("url")))[1]


def test_a_small_catalog_binds_without_shuffling_pages(spark):
    pages = spark.read.parquet(SOURCE)
    text = plan(bind_sites(pages, D.sites(pages)))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    assert not re.search(r"Exchange hashpartitioning\((url|page)", text)


def test_each_page_is_parsed_once(spark):
    pages = spark.read.parquet(SOURCE)
    found = items.extract_items(items.with_facts(bind_sites(pages, D.sites(pages))))
    for df in (items.envelopes(items.valid_items(found)), items.item_quarantine(found)):
        assert plan(df).count("ArrowEvalPython") == 1


def test_a_crawl_round_joins_buckets_in_place(spark, monkeypatch):
    """One shuffle per round: the pre-aggregated candidates."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rounds = []
    expand = crawl.expand

    def record(*a):
        fresh = expand(*a)
        rounds.append(plan(fresh))
        return fresh

    monkeypatch.setattr(crawl, "expand", record)
    try:
        pages = spark.read.parquet(SOURCE)
        sites = D.corpus_site(pages, next_page=False)
        seeds = sites.select("site_key", F.lit(D.CORPUS + "0").alias("url"))
        crawl.crawl(D.corpus(pages), sites, seeds, crawl.CrawlOptions(max_depth=2))
        text = rounds[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("Exchange") == 1 and text.count("Bucketed: true") == 3
    assert spark.catalog.listTables() == []


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(200).select(F.lit("hot").alias("k"), F.col("id").alias("l"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, r int")
    assert runtime.salted_join(left, right, ["k"], F.col("l")).count() == 400


def test_scratch_follows_the_session(spark):
    assert runtime.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
