"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks import queries  # noqa: E402
from pagemill.runtime import RECOMMENDED_CONF  # noqa: E402

HEADLINE = [
    "unique_links", "extract_links", "canonical_urls", "link_filters", "link_regions", "error_pages",
    "page_scope_deny", "content_pages", "item_envelopes", "item_sink_roundtrip", "crawl_full",
    "crawl_leaf_stop", "pagination_chain", "listing_router", "stream_links", "stream_first_seen",
    "stream_visits", "stream_items", "crawl_sites", "stream_repeats",
]


def baseline(spark, sf_dir: str, n_pages: int, seconds: dict[str, float]) -> dict[str, float]:
    found = {}
    if "extract_links" in seconds:
        n_links = queries.extract_links(spark, sf_dir).count()
        found |= {"links_per_sec": round(n_links / seconds["extract_links"])}
    if "item_envelopes" in seconds:
        found |= {"item_pages_per_sec": round(n_pages / seconds["item_envelopes"])}
    if "crawl_full" in seconds:
        found |= {"crawl_full_sec": seconds["crawl_full"]}
    if "stream_first_seen" in seconds:
        found |= {"first_seen_pages_per_sec": round(n_pages / seconds["stream_first_seen"])}
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagemill-bench-"))
        .config(map=RECOMMENDED_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    seconds = {}
    queries.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        began = time.time()
        queries.registry()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "pages_per_sec": {name: round(n_pages / s) for name, s in seconds.items()},
                "baseline": baseline(spark, sf_dir, n_pages, seconds),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
