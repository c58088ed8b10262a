"""Page source and the tables around fetching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.functions import predicates, urls

# What a render request appends to the target URL.
RENDER_QUERY = "&timeout=10&wait=0.5"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages. A small input is spread over the idle cores; a large one
    already has more splits than cores and is never shuffled."""
    pages = spark.read.schema(schema.PAGES).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def stream_pages(spark: SparkSession, path: str, glob: str = "*.parquet", **options) -> DataFrame:
    return (
        spark.readStream.schema(schema.PAGES).option("pathGlobFilter", glob).options(**options).parquet(path)
    )


def _decoded(body: pa.Array, charset: pa.Array) -> pa.Array:
    def one(data, name):
        try:
            # Through UTF-8 again: some codecs make surrogates, which no string may hold.
            return data.decode(name, "replace").encode("utf-8", "replace").decode("utf-8")
        except (LookupError, ValueError):
            return None

    pairs = zip(body.to_pylist(), charset.to_pylist())
    return pa.array([None if data is None else one(data, name) for data, name in pairs], pa.string())


def decode_body(body: Column, charset: str | Column = "UTF-8") -> Column:
    """Text of a BINARY body in its response charset: a name, or a column of names with
    null for UTF-8. Bytes that are no text become replacement characters; an unknown charset gives null.

    UTF-8 and ISO-8859-1 are decoded natively, others by an Arrow UDF.
    """
    utf8 = F.make_valid_utf8(body.cast("string"))
    if isinstance(charset, str):
        charset, plain = F.lit(charset), {"UTF-8": utf8, "ISO-8859-1": F.decode(body, "ISO-8859-1")}.get(charset.upper())
        if plain is not None:
            return plain
    name = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    convert = F.arrow_udf(_decoded, "string")
    other = convert(F.when(name != "UTF-8", body), name)
    return F.when(name == "UTF-8", utf8).otherwise(other)


def robots_split(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to fetch, answered with 404 without a fetch)."""
    robots = predicates.is_robots(F.col("url"))
    return requests.where(~robots), requests.where(robots).withColumn("http_status", F.lit(404))


def fetch_manifest(
    frontier: DataFrame, renderer: str, encode: bool = False, raw: bool = False
) -> DataFrame:
    """(url, request_url) for URLs still to be fetched, robots files left out.

    `raw` is the click mode, which opens the URL itself.
    """
    url = F.col("url")
    target = F.url_encode(url) if encode else url
    rendered = F.concat(F.lit(renderer + "?url="), target, F.lit(RENDER_QUERY))
    to_fetch, _ = robots_split(frontier)
    return to_fetch.select("url", (url if raw else rendered).alias("request_url"))


def absent_urls(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows with no stored page, whatever the spelling of its URL."""
    key = urls.canonicalize_url(F.col("url")).alias("_key")
    stored = pages.select(key).where("_key IS NOT NULL")
    return frontier.withColumn("_key", key).join(stored, "_key", "left_anti").drop("_key")


def normalise_fetch(results: DataFrame) -> DataFrame:
    """Headers and status of the last history entry beside url, cookies and html."""
    last = F.try_element_at("history", F.lit(-1))
    return results.select(
        "url", last["headers"].alias("headers"), last["status"].alias("http_status"), "cookies", "html"
    )


def fetch_status(log: DataFrame) -> DataFrame:
    """Target URL, status code and body of each logged fetch."""
    url = F.concat(F.lit("http://"), "site", "path")
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return log.select(
        url.alias("url"),
        F.when(ok, 200).otherwise(500).alias("status_code"),
        F.when(ok, F.col("content"))
        # Fixed value: the text of a failed fetch.
        .otherwise(F.concat(F.lit("FAIL to load the address:"), url))
        .alias("body"),
    )
