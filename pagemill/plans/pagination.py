"""Pagination chains by pointer doubling, and routing of the listed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import materialize, scratch_path


def next_pages(facts: DataFrame) -> DataFrame:
    """(site_key, url, next_url) of stored pages, one hop; next_url is null at the
    end of a chain or when the next page is not stored."""
    keys = facts.select("site_key", F.col("page_key").alias("url"))
    hops = facts.where(F.col("next_url").isNotNull()).select(
        "site_key", F.col("page_key").alias("url"), "next_url"
    )
    stored = hops.join(keys.withColumnRenamed("url", "next_url"), ["site_key", "next_url"], "left_semi")
    return keys.join(stored, ["site_key", "url"], "left")


def walk_chains(hops: DataFrame, starts: DataFrame, include_last: bool = True) -> DataFrame:
    """(site_key, start, step, url): every page reached from each start by next links.

    Each round doubles the span of the jump table, so a chain of n pages takes
    log2(n) rounds. A cycle ends where it would revisit a page.
    """
    jump = materialize(hops.where(F.col("next_url").isNotNull()), "jump")
    pages = hops.select("site_key", "url")
    chain = materialize(
        starts.select("site_key", "url").distinct()
        .join(pages, ["site_key", "url"], "left_semi")
        .select("site_key", F.col("url").alias("start"), F.lit(0).alias("step"), "url"),
        "chain",
    )
    span = 1
    while True:
        ahead = (
            chain.join(jump, ["site_key", "url"])
            .groupBy("site_key", "start", F.col("next_url").alias("url"))
            .agg((F.min("step") + span).alias("step"))
        )
        seen = chain.select("site_key", "start", "url")
        fresh = materialize(
            ahead.join(seen, ["site_key", "start", "url"], "left_anti").select(*chain.columns), "chain"
        )
        if fresh.isEmpty():
            break
        chain = chain.unionByName(fresh)
        far = jump.select("site_key", F.col("url").alias("next_url"), F.col("next_url").alias("far"))
        jump = materialize(
            jump.join(far, ["site_key", "next_url"]).select("site_key", "url", F.col("far").alias("next_url")),
            "jump",
        )
        span *= 2
    if include_last:
        return chain
    with_next = hops.where(F.col("next_url").isNotNull()).select("site_key", "url")
    return chain.join(with_next, ["site_key", "url"], "left_semi").select(*chain.columns)


def rank_chains(hops: DataFrame) -> DataFrame:
    """(site_key, head, rank, url): pages cut into chains of next links, one row for each.

    Where several pages have the same next page, the smallest URL goes before it and the
    others end their chains. A cycle is cut before its smallest URL. Lists are ranked by
    pointer jumping towards the head, in log2(n) rounds for chains of n pages: every page
    carries a window of pages before it, its smallest URL and how far back that is, and
    the windows double. The same smallest URL in two windows that follow on each other
    means a cycle that is seen whole. Both ends of a jump are unique, so no key is hot.
    """
    spark = hops.sparkSession
    steps = hops.where(F.col("next_url").isNotNull() & (F.col("next_url") != F.col("url")))
    before = steps.groupBy("site_key", F.col("next_url").alias("url")).agg(F.min("url").alias("ptr"))
    pages = steps.select("site_key", "url").distinct().join(before, ["site_key", "url"], "full")
    path, done = scratch_path(spark, "ranks"), "site_key string, url string, head string, rank long"
    pages.where("ptr IS NULL").select("site_key", "url", F.col("url").alias("head"), F.lit(0).cast("long").alias("rank")).write.parquet(path)
    # In the window of one page, the page itself is the smallest.
    state = pages.where("ptr IS NOT NULL").select("site_key", "url", "ptr", F.col("url").alias("low"), F.lit(0).cast("long").alias("back"))
    state, span = materialize(state, "jump"), 1
    while not state.isEmpty():
        ranked = spark.read.schema(done).parquet(path).select("site_key", F.col("url").alias("ptr"), F.col("head").alias("p_head"), F.col("rank").alias("p_rank"))
        ahead = state.select("site_key", F.col("url").alias("ptr"), F.col("ptr").alias("p_ptr"), F.col("low").alias("p_low"), F.col("back").alias("p_back"))
        met = state.join(ranked, ["site_key", "ptr"], "left").join(ahead, ["site_key", "ptr"], "left")
        whole, far = F.col("low") == F.col("p_low"), F.lit(span)
        head = F.when(F.col("p_head").isNotNull(), F.col("p_head")).when(whole, F.col("low"))
        rank = F.when((F.col("p_head") == F.col("low")) | whole, F.col("back")).otherwise(far + F.col("p_rank"))
        nearer = F.col("low") < F.col("p_low")
        met = materialize(met.select(
            "site_key", "url", F.col("p_ptr").alias("ptr"), F.least("low", "p_low").alias("low"),
            F.when(nearer, F.col("back")).otherwise(far + F.col("p_back")).alias("back"), head.alias("head"), rank.alias("rank"),
        ), "jump")
        met.where("head IS NOT NULL").select("site_key", "url", "head", "rank").write.mode("append").parquet(path)
        state, span = met.where("head IS NULL").drop("head", "rank"), span * 2
    return spark.read.schema(done).parquet(path).select("site_key", "head", "rank", "url")


def route_listings(chain: DataFrame, facts: DataFrame) -> DataFrame:
    """(site_key, url, route) for the links of the pages in the chains, once each:
    "emit" content, "frontier" other pages, "missing" absent ones; error pages are
    skipped."""
    listing = chain.select("site_key", F.col("url").alias("page_key")).distinct()
    links = (
        facts.join(listing, ["site_key", "page_key"], "left_semi")
        .select("site_key", "scope", F.explode("targets").alias("page_key"))
        .where(F.col("page_key").startswith(F.col("scope")))
        .select("site_key", "page_key")
        .distinct()
    )
    flags = facts.select("site_key", "page_key", "is_error", "is_content")
    route = (
        F.when(F.col("is_error").isNull(), "missing")
        .when(F.col("is_content"), "emit")
        .otherwise("frontier")
    )
    return (
        links.join(flags, ["site_key", "page_key"], "left")
        .where(~F.coalesce("is_error", F.lit(False)))
        .select("site_key", F.col("page_key").alias("url"), route.alias("route"))
    )
