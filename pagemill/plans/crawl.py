"""Graph traversal over stored pages: breadth first, all sites and modes at once.

Fetching a URL is an equi-join with the page table on the canonical URL. State lives in
tables in the shared folder, bucketed by (site, URL):

* facts    one row per (site, page): what the site asks of the page, parsed once
* edges    (site, src, dst, weight, inside the site or not), bucketed by (site, src)
* visited  (site, URL, depth, inside), bucketed alike and partitioned by round

A round reads only the last round of visited, joins edges bucket by bucket, shuffles
the new candidates once (partial minimum first, so a URL half the web points to becomes
one row per task), drops those visited at no greater depth bucket by bucket and appends.
Nothing is collected, and every round is a written table, so a lost executor repeats
tasks of the current round only. No round reads html: where sites may leave their scope,
the one scan of the pages also asks every page what those sites would ask of it.

Long chains of next links get shortcuts: edges over 2, 4, 8, ... next links, with that
weight, so a chain of n pages takes log2(n) rounds. A page may then be reached at a
greater depth before its least one; it is expanded again when a lesser one is found.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagemill.functions import predicates, urls
from pagemill.operators.binding import SiteIndex, asked_configs, index_sites, parse_pages, site_rows
from pagemill.operators.links import LinkOptions, with_links
from pagemill.plans import pagination
from pagemill.runtime import bounded_join, materialize, materialize_parsed, scratch_path
from pagemill.sources import catalog

# What may happen to a reached URL.
OK, ERROR, MISSING = "ok", "error", "missing"


@dataclass(frozen=True)
class CrawlOptions:
    """`expand_content` False stops at content pages (leaf-stop). `scope` is
    "prefix" (the URL starts with the site's link), "rules" (that, and the site's
    filter_urls with deny), "pattern" (the link is searched in the URL as a regular
    expression) or None (no restriction). Every `shortcut_after` rounds shortcuts over next
    links are considered: they are built once the frontier no longer grows while many next
    pages wait to be reached. They change how many rounds a crawl takes, not its result."""

    expand_content: bool = True
    error_filter: bool = True
    scope: str | None = "prefix"
    follow_next: bool = True
    canonical_identity: bool = False
    max_depth: int | None = None
    shortcut_after: int | None = 4
    links: LinkOptions = LinkOptions(with_text=False)

    def __post_init__(self):
        if self.scope not in ("prefix", "rules", "pattern", None):
            raise ValueError(f"unknown scope {self.scope!r}")

    @property
    def leaves_site(self) -> bool:
        return self.scope in ("pattern", None)


FULL = CrawlOptions()
LEAF_STOP = CrawlOptions(
    expand_content=False, error_filter=False, scope=None, follow_next=False
)


@dataclass(frozen=True)
class CrawlResult:
    """`reached`: site_key, url, depth, status, is_content. `facts`: parsed pages.
    `rounds`: how many the run took."""

    reached: DataFrame
    facts: DataFrame
    rounds: int

    def log(self) -> DataFrame:
        """What a run writes to the crawl log: error pages are logged, absent ones not."""
        return self.reached.where(F.col("status").isin(OK, ERROR)).select("site_key", "url")

    def failures(self) -> DataFrame:
        """Quarantine rows of pages that could not be parsed."""
        return self.facts.where(F.col("failure").isNotNull()).select(
            "site_key", "page_id", "url", F.lit("parse").alias("stage"), F.col("failure").alias("reason")
        )

    def content(self) -> DataFrame:
        """Parsed content pages among the reached ones, ready for item extraction."""
        keys = self.reached.where((F.col("status") == OK) & F.col("is_content")).select(
            "site_key", F.col("url").alias("reached_url"), urls.canonicalize_url(F.col("url")).alias("page_key")
        )
        found = self.facts.select("site_key", "page_key", "page_id", "depart", F.struct("is_content", "values").alias("facts"))
        return found.join(keys, ["site_key", "page_key"]).withColumnRenamed("reached_url", "url")


# Options that are columns of a site, so that sites of several modes crawl in one run.
PER_SITE = {
    "expand_content": "boolean", "error_filter": "boolean", "crawl_scope": "string", "follow_next": "boolean",
    "canonical_identity": "boolean", "max_depth": "int",
}
# Shortcuts pay when so many times a round's URLs wait behind next links.
WAITING = 4
# Questions to every page in one pass over the pages.
PROFILES_PER_PASS = 1000


def _option(o: CrawlOptions, name: str) -> Column:
    value = asdict(o)["scope" if name == "crawl_scope" else name]
    return F.lit(value).cast(PER_SITE[name])


def with_options(sites: DataFrame, options: CrawlOptions | dict[str, CrawlOptions], modes: DataFrame | None = None) -> DataFrame:
    """Sites with their crawl options as columns. With options by mode, `modes`
    (site_key, mode) says which; a site without a mode there is not visited."""
    if isinstance(options, CrawlOptions):
        return sites.withColumns({"mode": F.lit(None).cast("string")} | {name: _option(options, name) for name in PER_SITE})
    chosen = sites.join(modes.select("site_key", "mode").where(F.col("mode").isin(*options)).distinct(), "site_key")

    def by_mode(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("mode") == mode, _option(o, name)) for mode, o in options.items()], F.lit(None).cast(PER_SITE[name]))

    return chosen.withColumns({name: by_mode(name) for name in PER_SITE})


def _identity() -> Column:
    """What tells the copies of a URL apart: the one with the smallest id stands for it,
    rows without an id come last, and rows equal in all of this are interchangeable."""
    return F.struct(F.col("page_id").isNull(), "page_id", "url", "digest")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row for each page_key, chosen by the rows themselves; combines within tasks, so
    copies of a URL, however many, become one row per task."""
    kept = F.struct(*[c for c in rows.columns if c != "page_key"])
    chosen = rows.where("page_key <> ''").groupBy("page_key").agg(F.min_by(kept, _identity()).alias("kept"))
    return chosen.select("page_key", "kept.*").drop("digest")


def _page_columns(links: LinkOptions):
    """Adds what a page says whoever asks: link targets, base and an identity."""
    o = replace(links, unique=False, with_text=False)

    def add(pages: DataFrame) -> DataFrame:
        digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
        targets = F.array_distinct(F.transform("links", lambda x: x["url"]))
        return with_links(pages.withColumn("digest", digest), o, base="base").withColumn("targets", targets).drop("links")

    return add


def _next_url(facts: Column) -> Column:
    href = facts["next_href"]
    return F.when(href.isNotNull(), urls.canonicalize_url(urls.resolve_url(href, F.col("base"))))


def _told(pages: DataFrame, index: SiteIndex, links: LinkOptions, everywhere: list | None = None) -> DataFrame:
    """One row for each stored URL: what the page says, and the answers to its sites."""
    asked = parse_pages(pages, index, _page_columns(links), everywhere)
    return _one_of_each(asked.drop("html"))


def _facts(told: DataFrame, index: SiteIndex) -> DataFrame:
    """Facts rows (site, page): flags, values, next page and link targets."""
    # Raw URL errors (`../` runs) are looked for before resolution removes them.
    error = predicates.is_error_page(F.col("url"), F.col("facts.error_body"))
    return site_rows(told, index).select(
        "site_key", "page_id", "url", "page_key", "scope", "filter_urls", "deny", "depart",
        *[c for c in ("mode", *PER_SITE) if c in index.columns],
        "facts.is_content", "facts.values", "facts.failure", error.alias("is_error"),
        _next_url(F.col("facts")).alias("next_url"), "targets",
    )


def site_facts(pages: DataFrame, sites: DataFrame | SiteIndex, options: CrawlOptions = FULL) -> DataFrame:
    """One written row per (site, canonical page URL). Pages are parsed where they are
    read, and once for all their sites; only the narrow results are shuffled."""
    index = sites if isinstance(sites, SiteIndex) else index_sites(with_options(sites, options))
    return materialize_parsed(_facts(_told(pages, index, options.links), index), "facts")


def in_crawl_scope(url: Column, mode: Column) -> Column:
    """On rows that carry the site's scope, filter_urls and deny."""
    scope = F.col("scope")
    return (
        F.when(mode == "rules", predicates.in_scope(url, scope, F.col("filter_urls"), F.col("deny")))
        .when(mode == "prefix", url.startswith(scope))
        .when(mode == "pattern", F.rlike(url, scope))
        .otherwise(True)
    )


def click_edges(landings: DataFrame) -> DataFrame:
    """(src, dst) from clicked anchors: blanks dropped, first position of each URL kept."""
    return (
        landings.where(F.coalesce("landed_url", F.lit("")) != "")
        .groupBy(F.col("src_url").alias("src"), F.col("landed_url").alias("dst"))
        .agg(F.min("pos").alias("pos"))
    )


def _open(facts: DataFrame) -> DataFrame:
    """Facts of the pages whose links a site follows."""
    return facts.where(~(F.col("error_filter") & F.col("is_error")) & (F.col("expand_content") | ~F.col("is_content")))


def _edge_rows(rows: DataFrame, canonical: bool) -> DataFrame:
    """Rows with site columns, src and dst, to edges."""
    key = F.col("dst") if canonical else urls.canonicalize_url(F.col("dst"))
    return rows.where(in_crawl_scope(F.col("dst"), F.col("crawl_scope"))).select(
        "site_key", "src", F.when(F.col("canonical_identity"), key).otherwise(F.col("dst")).alias("dst"), F.lit(1).alias("weight"),
        F.coalesce(key.startswith(F.col("scope")), F.lit(False)).alias("inside"), "max_depth",
    )


def edges_of(facts: DataFrame, links: LinkOptions, clicks: DataFrame | None) -> DataFrame:
    site = ["site_key", "scope", "filter_urls", "deny", *PER_SITE]
    if clicks is not None:
        landed = clicks.select(urls.canonicalize_url(F.col("src")).alias("page_key"), "dst")
        rows = _open(facts).select("page_key", *site).join(landed, "page_key").withColumnRenamed("page_key", "src")
        return _edge_rows(rows, False)
    next_too = F.array_union("targets", F.array_compact(F.array("next_url")))
    targets = F.explode(F.when(F.col("follow_next"), next_too).otherwise(F.col("targets")))
    return _edge_rows(_open(facts).select(F.col("page_key").alias("src"), *site, targets.alias("dst")), links.canonicalize)


def next_hops(facts: DataFrame) -> DataFrame:
    """(site_key, url, next_url): the next links that sites follow."""
    hops = _open(facts).where(F.col("follow_next") & F.col("next_url").isNotNull())
    return hops.where(in_crawl_scope(F.col("next_url"), F.col("crawl_scope"))).select("site_key", F.col("page_key").alias("url"), "next_url")


def shortcuts(facts: DataFrame, hops: DataFrame) -> DataFrame | None:
    """Edges over 2, 4, 8, ... next links that a site follows one by one, or None."""
    ranks = pagination.rank_chains(hops)
    longest = ranks.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    if longest < 2:
        return None
    jumps = F.explode(F.array(*[F.lit(1 << i) for i in range(1, longest.bit_length())])).alias("weight")
    ahead = ranks.select("site_key", "head", "rank", F.col("url").alias("src"), jumps)
    ahead = ahead.where(F.col("rank") + F.col("weight") <= longest).withColumn("rank", F.col("rank") + F.col("weight"))
    found = ahead.join(ranks.withColumnRenamed("url", "dst"), ["site_key", "head", "rank"])
    flags = facts.select("site_key", F.col("page_key").alias("dst"), "scope", "max_depth")
    return found.join(flags, ["site_key", "dst"], "left").select(
        "site_key", "src", "dst", F.col("weight").cast("int").alias("weight"),
        F.coalesce(F.col("dst").startswith(F.col("scope")), F.lit(False)).alias("inside"), "max_depth",
    )


class _Table:
    """A bucketed table in the shared folder; dropping it leaves its files."""

    def __init__(self, spark, kind: str, keys: list[str], partition: str | None = None):
        self.spark, self.keys, self.partition = spark, keys, partition
        self.name = f"pagemill_{kind}_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, kind)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        writer = df.write.mode("append").format("parquet").option("path", self.path)
        if self.partition:
            writer = writer.partitionBy(self.partition)
        writer.bucketBy(self.buckets, *self.keys).saveAsTable(self.name)

    def append_clustered(self, df: DataFrame) -> None:
        """Shuffle first, so that each bucket is one file."""
        self.append(df.repartition(self.buckets, *self.keys))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def expand(frontier: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Children of the frontier (site_key, src, depth) not yet visited at their depth or a
    lesser one. With bucketed edges and visited rows the only shuffle is that of the
    distinct children."""
    depth = F.col("depth") + F.col("weight")
    children = (
        frontier.join(edges, ["site_key", "src"])
        .where(F.coalesce(depth <= F.col("max_depth"), F.lit(True)))
        .groupBy("site_key", F.col("dst").alias("url"))
        .agg(F.min(depth).cast("int").alias("depth"), F.max("inside").alias("inside"))
    )
    c, k = children.alias("c"), known.select("site_key", "url", "depth").alias("k")
    at_most = (F.col("c.site_key") == F.col("k.site_key")) & (F.col("c.url") == F.col("k.url")) & (F.col("k.depth") <= F.col("c.depth"))
    return c.join(k, at_most, "left_anti")


def _counts() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("new"), F.count_if(~F.col("inside")).alias("outside")


def _waiting(hops: DataFrame, visited: DataFrame) -> int:
    """How many next pages have not been reached."""
    targets = hops.select("site_key", F.col("next_url").alias("url")).distinct()
    return targets.join(visited.select("site_key", "url"), ["site_key", "url"], "left_anti").count()


class _Foreign:
    """What sites that may leave their scope would ask of any page, answered in the same
    scan as all else: their distinct questions about content and next pages. `pages` has
    a row for each stored URL; `answers` one for each page and question with a result."""

    def __init__(self, pages: DataFrame, index: SiteIndex, links: LinkOptions):
        self.pages, self.index, self.links = pages, index, links
        leaving = index.sites.where(F.coalesce(F.col("crawl_scope") == "pattern", F.lit(True)))
        config = ["conditions", "next_xpaths"]
        asked = materialize(leaving.groupBy(*config).agg(F.min("site_key").alias("profile")), "profiles")
        self.sites = bounded_join(leaving, asked, config, F.col("site_key")).select(
            "site_key", "profile", "scope", "filter_urls", "deny", "depart", "mode", *PER_SITE
        )
        # A bounded block of questions at a time; a pass over the pages for each.
        blocks, block = [], []
        for row in asked.toLocalIterator():
            block.append((row.profile, (list(row.conditions), list(row.next_xpaths), [])))
            if len(block) == PROFILES_PER_PASS:
                blocks.append(block)
                block = []
        blocks = [*blocks, block] if block or not blocks else blocks
        self.told = materialize_parsed(_told(pages, index, links, [q for _, q in blocks[0]]), "told")
        tables = [self._answers(self.told, blocks[0])]
        for more in blocks[1:]:
            nobody = index_sites(index.sites.where("false"))
            told = materialize_parsed(_told(pages, nobody, links, [q for _, q in more]), "told")
            tables.append(self._answers(told, more))
        self.buckets = _Table(pages.sparkSession, "open", ["page_key"])
        flagged = predicates.is_error_page(F.col("url"), F.col("error_body")).alias("is_error")
        body = F.get("everywhere", F.lit(0))["facts"]["error_body"].alias("error_body")
        self.buckets.append_clustered(self.told.select("page_key", "page_id", "url", "targets", "base", body).select("*", flagged).drop("error_body"))
        self.answers = _Table(pages.sparkSession, "answers", ["page_key"])
        for table in tables:
            self.answers.append_clustered(table)

    def _answers(self, told: DataFrame, block: list) -> DataFrame:
        names = F.array(*[F.lit(profile) for profile, _ in block]).cast("array<string>")
        some = lambda x: x["facts"]["is_content"] | x["facts"]["next_href"].isNotNull() | x["facts"]["failure"].isNotNull()
        rows = told.select("page_key", F.explode(F.filter("everywhere", some)).alias("a"))
        return rows.select(
            "page_key", F.get(names, F.col("a.site")).alias("profile"), "a.facts.is_content", "a.facts.next_href", "a.facts.failure"
        )

    def facts(self, outside: DataFrame, known: list[DataFrame]) -> DataFrame:
        """Facts, without values, of stored pages among `outside` (site_key, url) that no
        table of `known` has."""
        keys = outside.select("site_key", urls.canonicalize_url(F.col("url")).alias("page_key")).distinct()
        for facts in known:
            keys = keys.join(facts.select("site_key", "page_key"), ["site_key", "page_key"], "left_anti")
        found = keys.join(self.buckets.read(), "page_key")
        asked = bounded_join(found, self.sites, ["site_key"], F.col("page_key"))
        rows = asked.join(self.answers.read(), ["page_key", "profile"], "left")
        return rows.select(
            "site_key", "page_id", "url", "page_key", "scope", "filter_urls", "deny", "depart", "mode", *PER_SITE,
            F.coalesce("is_content", F.lit(False)).alias("is_content"), "failure", "is_error",
            _next_url(F.struct("next_href")).alias("next_url"), "targets",
        )

    def values(self, facts: DataFrame) -> DataFrame:
        """The field values of foreign content pages: one more read of the pages, pruned to
        these URLs, at the end."""
        wanted = facts.where("is_content").select("site_key", "page_key")
        config = self.index.sites.select("site_key", F.struct(*self.index.columns).alias("config"))
        pairs = bounded_join(wanted, config, ["site_key"], F.col("page_key"))
        gathered = pairs.groupBy("page_key").agg(F.sort_array(F.collect_list("config")).alias("configs"))
        keyed = self.pages.withColumn("page_key", F.coalesce(urls.canonicalize_url(F.col("url")), F.lit("")))
        found = bounded_join(keyed, gathered, ["page_key"], F.xxhash64("url", "page_id"))
        return materialize_parsed(values_of(found), "values")

    def drop(self) -> None:
        self.buckets.drop()
        self.answers.drop()


def values_of(found: DataFrame) -> DataFrame:
    """(site_key, page_key, values) of pages with the configurations that ask them."""
    told = asked_configs(found).withColumn("digest", F.md5(F.coalesce("html", F.lit("")).cast("binary"))).drop("html")
    rows = _one_of_each(told).select("page_key", F.explode(F.arrays_zip("configs", "answers")).alias("pair"))
    return rows.select(F.col("pair.configs.site_key").alias("site_key"), "page_key", F.col("pair.answers.facts.values").alias("values"))


def crawl(
    pages: DataFrame,
    sites: DataFrame,
    seeds: DataFrame | None = None,
    options: CrawlOptions | dict[str, CrawlOptions] = FULL,
    landings: DataFrame | None = None,
    modes: DataFrame | None = None,
) -> CrawlResult:
    """Visit everything reachable from the seeds of usable sites.

    `landings` (src_url, pos, landed_url) replaces anchors as the source of edges. With
    options by mode, `modes` (site_key, mode) assigns sites to them, and all sites crawl
    in one run over one scan of the pages; link options are then those of all modes.
    """
    spark = pages.sparkSession
    used = [options] if isinstance(options, CrawlOptions) else list(options.values())
    if len({(o.links, o.shortcut_after) for o in used}) != 1:
        raise ValueError("modes of one run must agree on links and shortcut_after")
    links, shortcut_after = used[0].links, used[0].shortcut_after
    index = index_sites(with_options(sites, options, modes))
    run = index.sites
    foreign = _Foreign(pages, index, links) if any(o.leaves_site for o in used) else None
    told = foreign.told.drop("everywhere") if foreign else _told(pages, index, links)
    facts = materialize_parsed(_facts(told, index), "facts")
    parsed = [facts]
    clicks = None if landings is None else click_edges(landings)
    edges = _Table(spark, "edges", ["site_key", "src"])
    visited = _Table(spark, "visited", ["site_key", "url"], partition="round")
    canonical = links.canonicalize and landings is None

    try:
        edges.append_clustered(edges_of(facts, links, clicks))
        start = catalog.seeds(sites) if seeds is None else seeds.select("site_key", "url")
        own = run.select("site_key", "scope", "canonical_identity")
        key = urls.canonicalize_url(F.col("url"))
        start = start.join(own, "site_key").select(
            "site_key", F.when(F.col("canonical_identity"), key).otherwise(F.col("url")).alias("url"),
            F.lit(0).alias("depth"), F.coalesce(key.startswith(F.col("scope")), F.lit(False)).alias("inside"),
        ).distinct().withColumn("round", F.lit(0))
        found = Observation()
        visited.append_clustered(start.observe(found, *_counts()))
        number, outside, jumped, before, new = 0, found.get["outside"], False, None, found.get["new"]
        hops = next_hops(facts) if shortcut_after is not None and clicks is None and any(o.follow_next for o in used) else None
        while True:
            frontier = visited.read().where(F.col("round") == number).drop("round")
            if outside and foreign:
                more = materialize(foreign.facts(frontier.where(~F.col("inside")), parsed), "foreign")
                if not more.isEmpty():
                    parsed.append(more)
                    edges.append_clustered(edges_of(more, links, clicks))
            due = hops is not None and not jumped and number % max(1, shortcut_after) == 0 and number >= shortcut_after
            if due and (before is None or new <= before) and _waiting(hops, visited.read()) > WAITING * new:
                jumps = shortcuts(facts, hops)
                if jumps is not None:
                    # What was expanded without them is expanded again, once.
                    edges.append_clustered(jumps)
                    frontier, jumped = visited.read().drop("round"), True
            src = F.col("url")
            if number == 0 or not canonical or jumped:
                # Only here can the identity differ from the key of the page table.
                src = urls.canonicalize_url(src)
            frontier = frontier.select("site_key", src.alias("src"), "depth")
            fresh = expand(frontier, edges.read(), visited.read())
            found = Observation()
            number += 1
            visited.append(fresh.observe(found, *_counts()).withColumn("round", F.lit(number)))
            before, new, outside = new, found.get["new"], found.get["outside"]
            if new == 0:
                break
    finally:
        edges.drop()
        visited.drop()
        if foreign:
            foreign.drop()

    reached = spark.read.schema("site_key string, url string, depth int").parquet(visited.path)
    if jumped:  # only then may a URL have been found again at a lesser depth
        reached = reached.groupBy("site_key", "url").agg(F.min("depth").alias("depth"))
    if len(parsed) > 1:
        strangers = parsed[1]
        for more in parsed[2:]:
            strangers = strangers.unionByName(more)
        strangers = strangers.join(foreign.values(strangers), ["site_key", "page_key"], "left")
        facts = materialize(facts.unionByName(strangers), "facts")
    flags = facts.select("site_key", "page_key", "is_error", "is_content", "error_filter")
    status = (
        F.when(F.col("is_error").isNull(), MISSING)
        .when(F.col("is_error") & F.col("error_filter"), ERROR)
        .otherwise(OK)
    )
    reached = (
        reached.withColumn("page_key", urls.canonicalize_url(F.col("url")))
        .join(flags, ["site_key", "page_key"], "left")
        .select(
            "site_key", "url", "depth", status.alias("status"),
            F.coalesce("is_content", F.lit(False)).alias("is_content"),
        )
    )
    return CrawlResult(reached, facts, number)


def crawl_by_mode(
    pages: DataFrame, sites: DataFrame, modes: DataFrame, options: dict[str, CrawlOptions]
) -> dict[str, CrawlResult]:
    """One run over the sites that `modes` (site_key, mode) assigns to a mode, by mode."""
    result = crawl(pages, sites, options=options, modes=modes)
    own = modes.select("site_key", "mode").distinct()

    def of(mode: str) -> CrawlResult:
        keys = own.where(F.col("mode") == mode).select("site_key")
        return CrawlResult(result.reached.join(keys, "site_key", "left_semi"), result.facts.where(F.col("mode") == mode), result.rounds)

    return {mode: of(mode) for mode in options}
