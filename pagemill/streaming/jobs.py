"""Streaming forms of extraction, first-seen URLs, visit counts and item delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import dom, predicates, urls
from pagemill.operators import items
from pagemill.operators.binding import SiteIndex, bind_sites, index_sites, parse_sites
from pagemill.operators.links import LinkOptions, explode_links, with_links
from pagemill.runtime import BROADCAST_LIMIT_BYTES, recommended, settings
from pagemill.sources.sinks import outbox

SALT_BUCKETS = 16


def fine_pages(pages: DataFrame) -> DataFrame:
    """Drop error pages; stateless. Climbing URLs go before anything is parsed."""
    kept = pages.where(~F.coalesce(predicates.has_climbing_path(F.col("url")), F.lit(False)))
    body = dom.error_body(F.col("html"))
    return kept.withColumn("_pre", body).where(~predicates.is_error_body(F.col("_pre"))).drop("_pre")


def stream_links(pages: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """Links of arriving fine pages; the batch operators, since they hold no state."""
    return explode_links(with_links(fine_pages(pages), options), "page_id")


def site_urls(
    pages: DataFrame, sites: DataFrame | SiteIndex, options: LinkOptions = LinkOptions(), broadcast_limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """(site_key, page_id, url): in-scope link targets of arriving pages. Links are taken
    first, so that only they, not the html, meet a large catalog; both joins are
    stream-static and hold no state."""
    linked = with_links(fine_pages(pages), options).select("page_id", "url", F.col("links.url").alias("targets"))
    bound = bind_sites(linked, sites, broadcast_limit)
    rows = bound.select("site_key", "page_id", "scope", F.explode_outer("targets").alias("url"))
    return rows.where(F.col("url").startswith(F.col("scope"))).select("site_key", "page_id", "url")


def unseen_pages(pages: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each page URL once, whatever its spelling: a gate to put before parsing. State holds
    the URLs alone; with an event time column it is bounded by the watermark delay."""
    keyed = pages.withColumn("_key", F.coalesce(urls.canonicalize_url(F.col("url")), F.lit("")))
    if event_time is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def first_seen(rows: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each (site_key, url) once.

    Two deduplications: the first spreads a hot URL over SALT_BUCKETS tasks, so
    the second sees it at most that many times. State grows with the distinct
    URLs; with an event time column it is bounded by the watermark delay.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT_BUCKETS)))
    if event_time is None:
        once = salted.dropDuplicates(["site_key", "url", "_salt"])
        return once.dropDuplicates(["site_key", "url"]).select("site_key", "url")
    timed = salted.withWatermark(event_time, delay)
    once = timed.dropDuplicatesWithinWatermark(["site_key", "url", "_salt"])
    return once.dropDuplicatesWithinWatermark(["site_key", "url"]).select("site_key", "url", event_time)


def visit_counts(rows: DataFrame) -> DataFrame:
    """Running visits per (site_key, url), for update mode. A built-in aggregate
    combines within each task first, so a hot URL costs one row per task."""
    return rows.groupBy("site_key", "url").agg(F.count(F.lit(1)).alias("visits"))


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True, **trigger
) -> StreamingQuery:
    """Write each micro-batch to its own folder; a repeated batch replaces itself.

    A stream whose state has a time to live would go on with empty batches for ever, also
    when it is to end with the available input: it runs without `empty_batches`. Where the
    session names no state store, the recommended one is used: Spark's default keeps no keyed state."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    )
    spark = stream.sparkSession
    wanted = recommended(spark, _STATE_STORE) | ({} if empty_batches else {_EMPTY_BATCHES: "false"})
    with settings(spark, wanted):  # a query keeps those it was started with
        return writer.start()


def flag_visits(batches: DataFrame) -> DataFrame:
    """Latest count per URL out of written update batches, and whether it repeats."""
    latest = batches.groupBy("site_key", "url").agg(F.max("visits").alias("visits"))
    return latest.withColumn("repeated", F.col("visits") > 1)


def write_items(
    pages: DataFrame, sites: DataFrame | SiteIndex, path: str, checkpoint: str, server: str, once: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES, **trigger,
) -> StreamingQuery:
    """Items, outbox and quarantine of arriving pages, one folder per batch.

    A batch is parsed once, without its html from there on; writing under its batch
    id makes a replay idempotent. Pages that fail to parse are quarantined too. With
    `once`, a page URL that arrived before is neither parsed nor emitted again.
    """
    index = index_sites(sites, broadcast_limit)
    arriving = pages.where(~F.coalesce(predicates.has_climbing_path(F.col("url")), F.lit(False)))
    arriving = unseen_pages(arriving) if once else arriving

    def save(batch: DataFrame, batch_id: int) -> None:
        fine = ~predicates.is_error_body(F.col("facts.error_body"))
        parsed = parse_sites(batch, index).where(fine).select("site_key", "page_id", "url", "depart", "facts").persist()
        try:
            found = items.extract_items(parsed)
            shaped = items.envelopes(items.valid_items(found))
            tables = {
                "items": shaped,
                "outbox": outbox(shaped, server),
                "quarantine": items.item_quarantine(found).unionByName(items.parse_quarantine(parsed)),
            }
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return (
        arriving.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
