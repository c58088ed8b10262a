"""Content pages to items, envelopes, and a quarantine for incomplete ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.schema import ITEM_FIELDS


def with_facts(bound: DataFrame) -> DataFrame:
    """Add `facts` to bound pages; every page is parsed once."""
    return bound.withColumn("facts", dom.page_facts("html", "conditions", "next_xpaths", "fields"))


def content_pages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("facts.is_content"))


def parse_quarantine(parsed: DataFrame) -> DataFrame:
    """Pages whose parsing failed; they count as pages without content."""
    return parsed.where(F.col("facts.failure").isNotNull()).select(
        "site_key", "page_id", "url", F.lit("parse").alias("stage"), F.col("facts.failure").alias("reason")
    )


def extract_items(parsed: DataFrame) -> DataFrame:
    """Item rows of the content pages. A field no path matched is null, or absent
    from option_fields; the page URL comes first in link."""
    values = F.map_from_entries(F.coalesce("facts.values", F.array().cast(dom.FACTS_TYPE["values"].dataType)))
    found = content_pages(parsed).withColumn("_m", values)
    m = F.col("_m")
    none = F.array().cast("array<string>")
    fixed = {name: F.try_element_at(m, F.lit(name)) for name in ITEM_FIELDS}
    fixed["link"] = F.concat(F.array("url"), F.coalesce(fixed["link"], none))
    optional = F.map_filter(m, lambda k, v: ~k.isin(*ITEM_FIELDS))
    return found.select(
        "site_key",
        "page_id",
        "url",
        F.col("depart").alias("default_depart"),
        *[fixed[name].alias(name) for name in ITEM_FIELDS],
        optional.alias("option_fields"),
    )


def scalarise(value: Column) -> Column:
    return F.try_element_at(value, F.lit(1))


def _with_reason(items: DataFrame, strict: bool) -> DataFrame:
    """`reason` names the required fields that fail; null when the item is valid."""

    def fails(name: str) -> Column:
        first = scalarise(F.col(name))
        if name == "depart":
            default_fails = F.col("default_depart") == ""
            absent = F.col(name).isNull() & default_fails
        else:
            absent = F.col(name).isNull()
        if not strict:
            return absent
        return absent | (F.col(name).isNotNull() & F.coalesce(first == "", F.lit(True)))

    missing = F.array_compact(F.array(*[F.when(fails(n), F.lit(n)) for n in ITEM_FIELDS]))
    return items.withColumn("reason", F.when(F.size(missing) > 0, F.array_join(missing, ",")))


def valid_items(items: DataFrame, strict: bool = True) -> DataFrame:
    return _with_reason(items, strict).where(F.col("reason").isNull()).drop("reason")


def item_quarantine(items: DataFrame, strict: bool = True) -> DataFrame:
    return _with_reason(items, strict).where(F.col("reason").isNotNull()).select(
        "site_key", "page_id", "url", F.lit("item").alias("stage"), "reason"
    )


def envelopes(items: DataFrame) -> DataFrame:
    """(…, mkey, subKey, data, body): body is the JSON text, without escapes for
    non-ASCII characters and without `data` when there is no title."""
    optional = F.map_filter(
        F.transform_values("option_fields", lambda k, v: scalarise(v)), lambda k, v: v.isNotNull()
    )
    fixed = F.map_filter(
        F.create_map(*[x for n in ("title", "link", "date") for x in (F.lit(n), scalarise(F.col(n)))]),
        lambda k, v: v.isNotNull(),
    )
    shaped = items.select(
        "site_key",
        "page_id",
        "url",
        F.coalesce(scalarise(F.col("depart")), "default_depart").alias("mkey"),
        scalarise(F.col("section")).alias("subKey"),
        F.when(F.size("title") > 0, F.map_concat(fixed, optional)).alias("data"),
    )
    return shaped.withColumn("body", F.to_json(F.struct("mkey", "subKey", "data")))
