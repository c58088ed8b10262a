"""Apply each site's configuration to the pages below its link.

Binding depends on a page's URL alone, never on its page_id: ids may repeat or be null.
It is an exact prefix join without comparing all pairs of a host: per host, the set of
scope lengths in use (no more than the longest URL has characters) tells which prefixes
of a page URL to look up by equality.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom, site_facts, urls
from pagemill.runtime import BROADCAST_LIMIT_BYTES, materialize_measured, salted_join

CONFIG = ["scope", "conditions", "fields", "next_xpaths", "filter_urls", "deny", "depart"]
QUESTIONS = ["conditions", "next_xpaths", "fields"]
# Above the broadcast limit: how many sites one call of the parser answers.
SITES_PER_CALL = 1000


@dataclass(frozen=True)
class SiteIndex:
    """A catalog, written and measured once. A small one is also held as `entries`, rows
    that workers look up by their position."""

    sites: DataFrame
    columns: list[str]
    entries: list | None

    def numbered(self) -> DataFrame:
        """The small catalog with each row's position, to be broadcast."""
        rows = [(i, *row) for i, row in enumerate(self.entries)]
        schema = self.sites.schema
        return self.sites.sparkSession.createDataFrame(rows, "_site int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def index_sites(sites: DataFrame | SiteIndex, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> SiteIndex:
    """Write and measure a catalog of usable sites; other columns, like crawl options, are kept."""
    if isinstance(sites, SiteIndex):
        return sites
    table, size = materialize_measured(sites.drop("link"), "sites")
    entries = table.collect() if size <= broadcast_limit else None
    return SiteIndex(table, [c for c in table.columns if c != "host"], entries)


def _keyed(pages: DataFrame) -> DataFrame:
    # Never null, so that no filter on a join key is inferred and evaluated again.
    return pages.withColumn("page_key", F.coalesce(urls.canonicalize_url(F.col("url")), F.lit("")))


def bind_sites(pages: DataFrame, sites: DataFrame | SiteIndex, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """pages x sites where the canonical page URL starts with the site's scope.

    Two equi-joins with the catalog, which hold no state in a stream: a catalog measured
    below `broadcast_limit` is broadcast and the rows of `pages` are not shuffled at all;
    a larger one is met salted. Rows are joined by their URL's host and prefixes only.
    """
    index = index_sites(sites, broadcast_limit)
    lengths = index.sites.groupBy("host").agg(F.collect_set(F.length("scope")).alias("_lengths"))
    keyed = _keyed(pages).withColumn("host", F.coalesce(urls.host_of(F.col("url")), F.lit("")))
    # Whatever tells rows of a hot host apart.
    spread = F.xxhash64("url", *[c for c in ("page_id",) if c in pages.columns])

    def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return salted_join(left, right, [key], spread) if index.entries is None else left.join(F.broadcast(right), key)

    probed = (
        met(keyed, lengths, "host")
        .withColumn("_n", F.explode("_lengths"))
        .where(F.col("_n") <= F.length("page_key"))
        .withColumn("scope", F.substr("page_key", F.lit(1), F.col("_n")))
        .drop("_n", "_lengths", "host")
    )
    return met(probed, index.sites.drop("host"), "scope")


def _same(pages: DataFrame) -> DataFrame:
    return pages


def parse_pages(
    pages: DataFrame, index: SiteIndex, per_page: Callable[[DataFrame], DataFrame] = _same, everywhere: list | None = None
) -> DataFrame:
    """Bound pages, each once and parsed once, with `answers` (and, above the broadcast
    limit, `configs`) for `site_rows`; `per_page` adds columns of the page itself.

    A small catalog goes to the workers, pages get the numbers of their sites and are not
    shuffled. With a larger one, the distinct URLs are bound, each URL's configurations
    are gathered (SITES_PER_CALL to a row), and pages meet them in one join on the URL.

    `everywhere`, if given, are questions to every page, bound or not; their answers are
    in the column `everywhere`, by their position.
    """
    asked_everywhere = everywhere or []
    if index.entries is not None:
        questions = [tuple(_plain(row[name]) for name in QUESTIONS) for row in index.entries]
        n = len(questions)
        match = site_facts.matching_sites([row["scope"] for row in index.entries])
        bound = _keyed(pages).withColumn("_numbers", match("page_key"))
        if everywhere is None:
            bound = bound.where(F.size("_numbers") > 0)
        elif everywhere:
            more = F.sequence(F.lit(n), F.lit(n + len(everywhere) - 1))
            bound = bound.withColumn("_numbers", F.concat("_numbers", more))
        answer = site_facts.facts_by_number(questions + asked_everywhere)("html", "_numbers")
        told = per_page(bound).withColumn("_told", answer).drop("_numbers")
        first = F.lit(n)
    else:
        most = index.sites.groupBy("scope").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        parts = -(-most // SITES_PER_CALL) or 1
        pairs = bind_sites(pages.select("url").distinct(), index).select("url", F.struct(*index.columns).alias("config"))
        part = F.pmod(F.xxhash64("config.site_key"), F.lit(parts)).alias("_part")
        gathered = pairs.groupBy("url", part).agg(F.sort_array(F.collect_list("config")).alias("configs")).drop("_part")
        spread = F.xxhash64(*[c for c in pages.columns if c != "url"])
        bound = salted_join(_keyed(pages), gathered, ["url"], spread, "inner" if everywhere is None else "left")
        none = F.array().cast(dict(gathered.dtypes)["configs"])
        bound = bound.withColumn("configs", F.coalesce("configs", none))
        asked = F.transform("configs", lambda c: F.struct(*[c[name].alias(name) for name in QUESTIONS]))
        if everywhere:
            asked = F.concat(asked, _literal(asked_everywhere))
        told = per_page(bound).withColumn("_told", site_facts.facts_by_config("html", asked))
        first = F.size("configs")
    told = told.withColumn("answers", F.filter("_told", lambda x: x["site"] < first))
    if everywhere is not None:
        renumbered = F.transform(F.filter("_told", lambda x: x["site"] >= first), lambda x: x.withField("site", x["site"] - first))
        told = told.withColumn("everywhere", renumbered)
    return told.drop("_told")


def asked_configs(found: DataFrame) -> DataFrame:
    """Pages with an array `configs` of site rows, plus `answers` to each."""
    asked = F.transform("configs", lambda c: F.struct(*[c[name].alias(name) for name in QUESTIONS]))
    return found.withColumn("answers", site_facts.facts_by_config("html", asked))


def _literal(questions: list):
    """Questions as an array column of structs."""
    kind = "array<struct<conditions: array<string>, next_xpaths: array<string>, fields: array<struct<name: string, xpath: string>>>>"
    rows = [dict(zip(QUESTIONS, asked, strict=True)) for asked in questions]
    return F.from_json(F.lit(json.dumps(rows)), kind)


def site_rows(told: DataFrame, index: SiteIndex) -> DataFrame:
    """`parse_pages` rows to one row for each page and site, with the site's columns and `facts`."""
    if index.entries is not None:
        rows = told.withColumn("_answer", F.explode_outer("answers")).where(F.col("_answer").isNotNull())
        rows = rows.select("*", F.col("_answer.site").alias("_site"), F.col("_answer.facts").alias("facts"))
        return rows.drop("answers", "_answer").join(F.broadcast(index.numbered().drop("host")), "_site").drop("_site")
    rows = told.select("*", F.explode_outer(F.arrays_zip("configs", "answers")).alias("_pair")).where(F.col("_pair").isNotNull())
    rows = rows.drop("configs", "answers")
    return rows.select(*[c for c in rows.columns if c != "_pair"], F.col("_pair.answers.facts").alias("facts"), "_pair.configs.*")


def parse_sites(
    pages: DataFrame,
    sites: DataFrame | SiteIndex,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    per_page: Callable[[DataFrame], DataFrame] = _same,
) -> DataFrame:
    """`bind_sites`, plus `facts`; each bound page is parsed once, whatever the number of
    its sites. Only in a stream with a catalog above the limit, where URLs cannot be
    gathered, a page is parsed for each of its sites."""
    index = index_sites(sites, broadcast_limit)
    if pages.isStreaming and index.entries is None:
        return per_page(bind_sites(pages, index)).withColumn("facts", dom.page_facts("html", *QUESTIONS))
    return site_rows(parse_pages(pages, index, per_page), index)


def _plain(value):
    """A cell of the catalog as workers get it."""
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value
