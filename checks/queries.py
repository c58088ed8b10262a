"""One query per operator group; each reads whole tables under `sf_dir`."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from pagemill.functions import dom, predicates, urls
from pagemill.operators import items, links
from pagemill.operators.binding import bind_sites, parse_sites
from pagemill.plans import crawl, pagination
from pagemill.runtime import scratch_path
from pagemill.sources import catalog, sinks
from pagemill.sources import pages as fetch
from pagemill.streaming import jobs, visits

LINK_RECORDS = links.LinkOptions()


def site_catalog(spark, sf_dir):
    return catalog.scan(D.site_docs(D.pages(spark, sf_dir))).select("key", "link")


def site_quarantine(spark, sf_dir):
    return catalog.site_quarantine(D.site_docs(D.pages(spark, sf_dir)))


def site_lookup(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    key = source.where("page_id = 0").select(D.origin(F.col("url"))).first()[0]
    site = catalog.usable_sites(catalog.lookup(D.site_docs(source), key))
    fields = site.select("site_key", F.explode("fields").alias("f")).select("site_key", "f.*")
    paths = site.select("site_key", F.posexplode("next_xpaths").alias("name", "xpath"))
    return fields.unionByName(paths.withColumn("name", F.concat(F.lit("next"), F.col("name").cast("string"))))


def seed_urls(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    extra = source.where(F.col("url").contains("?page=")).select(D.origin(F.col("url")).alias("site_key"), "url")
    return catalog.seeds(D.sites(source), extra)


def _scoped(spark, sf_dir, deny: bool):
    source = D.pages(spark, sf_dir)
    bound = bind_sites(source, D.sites(source).withColumn("deny", F.lit(deny)))
    keep = predicates.in_scope(F.col("url"), F.col("scope"), F.col("filter_urls"), F.col("deny"))
    return bound.where(keep).select("site_key", "page_id", "url")


def page_scope_deny(spark, sf_dir):
    return _scoped(spark, sf_dir, True)


def page_scope_allow(spark, sf_dir):
    return _scoped(spark, sf_dir, False)


def error_pages(spark, sf_dir):
    source = D.error_candidates(D.pages(spark, sf_dir))
    with_body = source.withColumn("pre", dom.error_body(F.col("html")))
    return with_body.select("page_id", "url", predicates.is_error_page(F.col("url"), F.col("pre")).alias("bad"))


def robots_filter(spark, sf_dir):
    ending = F.when(F.col("page_id") % 5 == 0, "robots.txt").when(F.col("page_id") % 5 == 1, "robots.txt?x").otherwise("r")
    requests = D.pages(spark, sf_dir).select("page_id", F.concat(D.origin(F.col("url")), ending).alias("url"))
    to_fetch, answered = fetch.robots_split(requests)
    return to_fetch.withColumn("http_status", F.lit(None).cast("int")).unionByName(answered)


def fetch_manifest(spark, sf_dir):
    stored = D.corpus(D.pages(spark, sf_dir))
    frontier = stored.select(D.corpus_url(2 * F.col("page_id") + 1).alias("url"))
    return fetch.fetch_manifest(fetch.absent_urls(frontier, stored), D.RENDERER)


def fetch_result(spark, sf_dir):
    entry = lambda k: F.struct(
        F.create_map(F.lit("n"), k.cast("string")).alias("headers"), (k + 200).cast("int").alias("status")
    )
    history = F.when(F.col("page_id") % 3 > 0, F.transform(F.sequence(F.lit(1), F.col("page_id") % 3), entry))
    results = D.pages(spark, sf_dir).select(
        "url",
        F.coalesce(history, F.array().cast("array<struct<headers:map<string,string>,status:int>>")).alias("history"),
        F.array(F.struct(F.lit("c").alias("name"), F.lit("v").alias("value"))).alias("cookies"),
        "html",
    )
    return fetch.normalise_fetch(results).select(
        "url", "http_status", F.try_element_at("headers", F.lit("n")).alias("header_n"),
        F.size("cookies").alias("n_cookies"), F.length("html").alias("n_chars"),
    )


def fetch_status(spark, sf_dir):
    log = D.pages(spark, sf_dir).select(
        urls.host_of(F.col("url")).alias("site"),
        F.concat(F.lit("/p"), F.col("page_id").cast("string")).alias("path"),
        F.when(F.col("page_id") % 4 == 0, "fail").when(F.col("page_id") % 4 > 1, "success").alias("status"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("content"),
    )
    return fetch.fetch_status(log)


def extract_links(spark, sf_dir):
    raw = links.LinkOptions(canonicalize=False, unique=False)
    return links.extract_links(D.pages(spark, sf_dir), raw).select("page_id", "pos", "url", "text")


def link_attrs(spark, sf_dir):
    source = D.attribute_pages(D.pages(spark, sf_dir))
    source = source.withColumn("html", fetch.decode_body(F.col("body"), "ISO-8859-1"))
    hook = lambda u: F.when(~u.contains("drop"), F.regexp_replace(u, "/area$", "/zone"))
    return links.extract_links(source, links.LinkOptions(process_value=hook))


def link_filters(spark, sf_dir):
    options = links.LinkOptions(
        allow=(r"/[a-m]\w*$", "/[n-s]"), deny=(r"/de",), allow_domains=("example.com", "example.org"),
        deny_domains=("spam-farm.example.org", "theron.example.org"),
    )
    return links.extract_links(D.pages(spark, sf_dir), options).select("page_id", "url")


def url_filters(spark, sf_dir):
    options = links.LinkOptions(deny_extensions=("html",), deny_domains=("example.net",))
    return D.pages(spark, sf_dir).where(links.link_allowed(F.col("url"), options)).select("page_id", "url")


def _by_domain_list(spark, sf_dir, allow: bool):
    source = D.pages(spark, sf_dir)
    return links.filter_domains(source.select("page_id", "url"), D.domain_list(source), allow)


def allow_domain_list(spark, sf_dir):
    return _by_domain_list(spark, sf_dir, True)


def deny_domain_list(spark, sf_dir):
    return _by_domain_list(spark, sf_dir, False)


def link_regions(spark, sf_dir):
    options = links.LinkOptions(restrict_xpaths=("//nav/ul/li[2]", "//article"), restrict_css=("nav ul", "div.ad"))
    return links.extract_links(D.pages(spark, sf_dir), options).select("page_id", "pos", "url", "text")


def canonical_urls(spark, sf_dir):
    return D.pages(spark, sf_dir).select("page_id", urls.canonicalize_url(F.col("url")).alias("url"))


def unique_links(spark, sf_dir):
    return links.extract_links(D.pages(spark, sf_dir), LINK_RECORDS, urls_only=True).select("page_id", "pos", "url")


def _parsed(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    return items.with_facts(bind_sites(source, D.sites(source)))


def content_pages(spark, sf_dir):
    return items.content_pages(_parsed(spark, sf_dir)).select("site_key", "page_id", "url")


def next_page(spark, sf_dir):
    found = _parsed(spark, sf_dir).where(F.col("facts.next_xpath").isNotNull())
    return found.select(
        "site_key", "page_id", F.col("facts.next_xpath").alias("xpath"),
        urls.resolve_url(F.col("facts.next_href"), F.col("url")).alias("next_url"),
    )


def _items(spark, sf_dir):
    return items.extract_items(_parsed(spark, sf_dir))


def item_fields(spark, sf_dir):
    fixed = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in items.ITEM_FIELDS])
    rows = _items(spark, sf_dir).select(
        "site_key", "page_id", F.explode(F.concat(fixed, F.map_entries("option_fields"))).alias("e")
    )
    flat = rows.select("site_key", "page_id", F.col("e.key").alias("name"), F.posexplode("e.value").alias("pos", "value"))
    return flat


def item_envelopes(spark, sf_dir):
    shaped = items.envelopes(items.valid_items(_items(spark, sf_dir)))
    data = [F.try_element_at("data", F.lit(k)).alias(k) for k in ("title", "link", "date", "footer")]
    return shaped.select("site_key", "page_id", "mkey", "subKey", *data, "body")


def item_quarantine(spark, sf_dir):
    return items.item_quarantine(_items(spark, sf_dir)).select("site_key", "page_id", "url", "stage", "reason")


def item_outbox(spark, sf_dir):
    shaped = items.envelopes(items.valid_items(_items(spark, sf_dir)))
    return sinks.outbox(shaped, D.SERVER).select("page_id", "endpoint", "content_type", F.length("body").alias("n_chars"))


def item_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "item-lines")
    sinks.append_item_lines(items.envelopes(items.valid_items(_items(spark, sf_dir))), path)
    back = sinks.read_item_lines(spark, path)
    return back.select("mkey", "subKey", *[F.col("data")[k].alias(k) for k in ("title", "link", "date")])


def crawl_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "crawl-log")
    source = D.pages(spark, sf_dir).select(D.origin(F.col("url")).alias("site_key"), "url")
    sinks.append_crawl_log(source, path)
    sinks.append_crawl_log(source.where(F.col("url").contains("#")), path)
    return sinks.read_crawl_log(spark, path)


def _full(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    sites = D.corpus_site(source, next_page=True)
    seeds = sites.select("site_key", F.lit(D.CORPUS + "0").alias("url"))
    return crawl.crawl(D.corpus(source), sites, seeds)


def crawl_full(spark, sf_dir):
    return _full(spark, sf_dir).reached


def crawl_items(spark, sf_dir):
    found = items.extract_items(_full(spark, sf_dir).content())
    return found.select("site_key", "page_id", "url", items.scalarise(F.col("title")).alias("title"))


def _leaf_stop(spark, sf_dir, landings=None):
    source = D.pages(spark, sf_dir)
    sites = D.corpus_site(source, next_page=False)
    seeds = sites.select("site_key", F.lit(D.CORPUS + "1").alias("url"))
    clicks = D.landings(source) if landings else None
    return crawl.crawl(D.corpus(source), sites, seeds, crawl.LEAF_STOP, clicks)


def crawl_leaf_stop(spark, sf_dir):
    return _leaf_stop(spark, sf_dir).reached


def crawl_clicks(spark, sf_dir):
    return _leaf_stop(spark, sf_dir, landings=True).reached


def _chains(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    facts = crawl.site_facts(D.corpus(source), D.corpus_site(source, next_page=True))
    starts = source.where("page_id % 15 = 0").select(F.lit("c").alias("site_key"), D.corpus_url(F.col("page_id")).alias("url"))
    return pagination.walk_chains(pagination.next_pages(facts), starts), facts


def pagination_chain(spark, sf_dir):
    return _chains(spark, sf_dir)[0].select("site_key", "start", "step", "url")


def listing_router(spark, sf_dir):
    return pagination.route_listings(*_chains(spark, sf_dir))


def _stream(spark, sf_dir):
    """Braces make the path a pattern, which may name one file or a folder of them."""
    return fetch.stream_pages(spark, sf_dir + "/{pages.parquet}", glob="*")


def _drain(spark, stream: DataFrame, mode: str = "append", **options) -> DataFrame:
    """Run to the end of the input with a fresh checkpoint, and read the output back."""
    path = scratch_path(spark, "stream")
    query = jobs.write_batches(stream, path + "/out", path + "/checkpoint", mode, **options)
    query.awaitTermination()
    return spark.read.parquet(path + "/out").drop("batch_id")


def stream_links(spark, sf_dir):
    return _drain(spark, jobs.stream_links(_stream(spark, sf_dir)))


def _stream_urls(spark, sf_dir):
    return jobs.site_urls(_stream(spark, sf_dir), D.sites(D.pages(spark, sf_dir)))


def stream_first_seen(spark, sf_dir):
    return _drain(spark, jobs.first_seen(_stream_urls(spark, sf_dir)))


def stream_visits(spark, sf_dir):
    return jobs.flag_visits(_drain(spark, jobs.visit_counts(_stream_urls(spark, sf_dir)), "update"))


def stream_items(spark, sf_dir):
    path = scratch_path(spark, "stream-items")
    sites = D.sites(D.pages(spark, sf_dir))
    jobs.write_items(_stream(spark, sf_dir), sites, path, path + "/checkpoint", D.SERVER).awaitTermination()
    part = lambda name, detail: spark.read.parquet(f"{path}/{name}").select(
        F.lit(name).alias("part"), "page_id", F.col(detail).alias("detail")
    )
    return part("items", "body").unionByName(part("outbox", "endpoint")).unionByName(part("quarantine", "reason"))


def bind_large_catalog(spark, sf_dir):
    """As with a catalog too large to broadcast, over rows whose ids say nothing."""
    source = D.pages(spark, sf_dir)
    found = parse_sites(D.repeated(source), D.sites(source), broadcast_limit=0)
    return found.groupBy("site_key", "url").agg(F.count(F.lit(1)).alias("n"), F.bool_and("facts.is_content").alias("is_content"))


def crawl_repeated_pages(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    sites = D.corpus_site(source, next_page=True)
    seeds = sites.select("site_key", F.lit(D.CORPUS + "0").alias("url"))
    return crawl.crawl(D.repeated(D.corpus(source)), sites, seeds).reached


def crawl_sites(spark, sf_dir):
    """All sites in one run: some in full below their links, some to leaves anywhere, three deep."""
    source = D.pages(spark, sf_dir)
    modes = D.site_modes(source)
    leaf = replace(crawl.LEAF_STOP, max_depth=3)
    options = {"full": crawl.FULL, "leaf": leaf}
    return crawl.crawl(D.linked(source), D.sites(source), modes.select("site_key", "url"), options, modes=modes).reached


def chain_ranks(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    facts = crawl.site_facts(D.corpus(source), D.corpus_site(source, next_page=True))
    return pagination.rank_chains(pagination.next_pages(facts))


def next_page_base(spark, sf_dir):
    """The next link of a page counts from the page's base."""
    source = D.pages(spark, sf_dir)
    based = source.withColumn("html", F.concat(F.lit('<base href="https://base.example/x/">'), "html"))
    return crawl.site_facts(based, D.sites(source)).where("next_url IS NOT NULL").select("site_key", "page_id", "next_url")


def decoded_bodies(spark, sf_dir):
    text = fetch.decode_body(F.col("body"), F.col("charset"))
    return D.bodies(D.pages(spark, sf_dir)).select("page_id", F.md5(text.cast("binary")).alias("digest"))


def item_sink_rerun(spark, sf_dir):
    """A run that was killed before its commit and one that is run again add nothing."""
    path = scratch_path(spark, "item-lines")
    shaped = items.envelopes(items.valid_items(_items(spark, sf_dir)))
    sinks.stage_only(shaped.select(F.col("body").alias("value")), path)
    for _ in range(2):
        sinks.append_item_lines(shaped, path, run_id="r1")
    back = sinks.read_item_lines(spark, path)
    return back.select("mkey", "subKey", *[F.col("data")[k].alias(k) for k in ("title", "link", "date")])


def stream_repeats(spark, sf_dir):
    """Flags within a stream of several micro-batches; state is forgotten after a day."""
    source = D.pages(spark, sf_dir)
    arriving = fetch.stream_pages(spark, D.split(source, "pages"), maxFilesPerTrigger=2)
    rows = jobs.site_urls(arriving, D.sites(source), broadcast_limit=0)
    flagged = _drain(spark, visits.flagged_visits(rows, ttl_ms=86_400_000), "update", empty_batches=False)
    return flagged.groupBy("site_key", "url").agg(
        F.max("visits").alias("visits"), F.count_if("first").alias("firsts"), F.bool_or("repeated").alias("repeated")
    )


def stream_items_once(spark, sf_dir):
    """Every page arrives three times, over several micro-batches, and is emitted once."""
    source = D.pages(spark, sf_dir)
    # One page for each canonical URL, so that it does not matter which arrives first.
    page = F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p")
    single = source.groupBy(urls.canonicalize_url(F.col("url"))).agg(page).select("p.*")
    path, thrice = scratch_path(spark, "stream-items"), single.unionByName(single).unionByName(single)
    arriving = fetch.stream_pages(spark, D.split(thrice, "pages"), maxFilesPerTrigger=2)
    jobs.write_items(arriving, D.sites(source), path, path + "/checkpoint", D.SERVER, once=True, broadcast_limit=0).awaitTermination()
    return spark.read.parquet(f"{path}/items").select("site_key", "page_id", "body")


ALL = [
    site_catalog, site_quarantine, site_lookup, seed_urls, page_scope_deny, page_scope_allow, error_pages,
    robots_filter, fetch_manifest, fetch_result, fetch_status, extract_links, link_attrs, link_filters,
    url_filters, allow_domain_list, deny_domain_list, link_regions, canonical_urls, unique_links, content_pages, next_page, item_fields,
    item_envelopes, item_quarantine, item_outbox, item_sink_roundtrip, crawl_log_roundtrip, crawl_full,
    crawl_items, crawl_leaf_stop, crawl_clicks, pagination_chain, listing_router, stream_links,
    stream_first_seen, stream_visits, stream_items, bind_large_catalog, crawl_repeated_pages, crawl_sites, chain_ranks,
    next_page_base, decoded_bodies, item_sink_rerun, stream_repeats, stream_items_once,
]


def registry() -> dict:
    return {query.__name__: query for query in ALL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to canonical, filtered, per-page unique links."""
    return unique_links(spark, sf_dir)
