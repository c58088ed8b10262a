"""Row predicates on URLs, scopes and error bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that mark a JSON body as an error page, and the ending of
# a robots file request.
ERROR_CODES = (502.0, 404.0, 500.0)
ROBOTS_ENDING = "robots.txt"


def is_robots(url: Column) -> Column:
    return url.endswith(ROBOTS_ENDING)


def has_climbing_path(url: Column) -> Column:
    """Four or more `../` in a row, in the raw URL."""
    return url.rlike(r"(\.\./){4,}")


def is_error_body(body: Column) -> Column:
    """The text is JSON whose `error` is one of the codes, as a number."""
    value = F.try_variant_get(F.try_parse_json(body), "$.error", "variant")
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    code = F.try_variant_get(value, "$", "double")
    return F.coalesce(numeric & code.isin(*ERROR_CODES), F.lit(False))


def is_error_page(url: Column, body: Column) -> Column:
    return has_climbing_path(url) | is_error_body(body)


def in_scope(url: Column, start_host: Column, filter_urls: Column, deny: Column) -> Column:
    """Inside the site, and not below a denied prefix (`deny`) or below an allowed
    one (`not deny`). No prefixes: deny keeps everything, allow nothing."""
    prefixes = F.coalesce(filter_urls, F.array().cast("array<string>"))
    listed = F.exists(prefixes, lambda p: url.startswith(p))
    return url.startswith(start_host) & F.when(F.coalesce(deny, F.lit(True)), ~listed).otherwise(listed)
