"""Site catalog: scan, lookup, normalisation and quarantine of bad sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.functions import dom, urls


def read_sites(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema.SITES).format(fmt).load(path)


def scan(sites: DataFrame) -> DataFrame:
    """All sites whose key is not the empty string; a null key passes here."""
    return sites.where(~F.col("key").eqNullSafe(F.lit("")))


def lookup(sites: DataFrame, key: str) -> DataFrame:
    """The site with this key, or no row."""
    return sites.where(F.col("key") == key).orderBy("link").limit(1)


def xpath_list(value: Column) -> Column:
    """A bare path, a JSON list of paths or null, as an array."""
    empty = F.array().cast("array<string>")
    return F.when(value.isNull(), empty).otherwise(
        F.coalesce(F.from_json(value, "array<string>"), F.array(value))
    )


def last_definitions(fields: Column) -> Column:
    """Drop earlier definitions of a repeated field name."""
    names = F.reverse(F.transform(fields, lambda f: f["name"]))
    return F.filter(
        fields, lambda f, i: F.size(fields) - F.array_position(names, f["name"]) == i
    )


def _unsupported(paths: Column) -> Column:
    return F.exists(paths, lambda p: p.isNull() | ~p.rlike(dom.XPATH_PATTERN))


def _checked(sites: DataFrame) -> DataFrame:
    xpaths = F.transform("fields", lambda f: f["xpath"])
    reason = (
        F.when(F.col("key").isNull(), "key is missing")
        .when(F.col("link").isNull(), "link is missing")
        .when(F.col("condition").isNull(), "condition is missing")
        .when(F.col("fields").isNull(), "fields are missing")
        .when(_unsupported(F.col("condition")), "condition is not supported")
        .when(_unsupported(F.col("next_xpaths")), "next page is not supported")
        .when(_unsupported(xpaths), "field is not supported")
    )
    # A key names one site: of several documents the first usable one by link stands.
    same_key = Window.partitionBy("key").orderBy(F.col("reason").isNotNull(), "link", F.to_json(F.struct(*sites.columns)))
    checked = scan(sites).withColumn("next_xpaths", xpath_list(F.col("next_page_xpath"))).withColumn("reason", reason)
    repeated = F.when(F.row_number().over(same_key) > 1, "key is repeated")
    return checked.withColumn("reason", F.coalesce("reason", repeated))


def usable_sites(sites: DataFrame) -> DataFrame:
    """Normalised rows of the sites that can run."""
    return (
        _checked(sites)
        .where(F.col("reason").isNull())
        .select(
            F.col("key").alias("site_key"),
            "link",
            urls.canonicalize_url(F.col("link")).alias("scope"),
            urls.host_of(F.col("link")).alias("host"),
            F.col("condition").alias("conditions"),
            last_definitions(F.col("fields")).alias("fields"),
            "next_xpaths",
            F.coalesce("filter_urls", F.array().cast("array<string>")).alias("filter_urls"),
            F.coalesce("deny", F.lit(True)).alias("deny"),
            F.coalesce("depart", F.lit("")).alias("depart"),
        )
    )


def site_quarantine(sites: DataFrame) -> DataFrame:
    """(site_key, url, stage, reason) of the sites that cannot run."""
    return _checked(sites).where(F.col("reason").isNotNull()).select(
        F.col("key").alias("site_key"), F.col("link").alias("url"), F.lit("catalog").alias("stage"), "reason"
    )


def seeds(sites: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(site_key, url) start rows: each usable site's link, plus any given rows."""
    rows = sites.select("site_key", F.col("link").alias("url"))
    return (rows if extra is None else rows.unionByName(extra.select("site_key", "url"))).distinct()
