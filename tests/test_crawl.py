import json
import random

import pytest
from pyspark.sql import functions as F
from tests import golden

from pagemill import schema
from pagemill.operators import items
from pagemill.plans import crawl, pagination
from pagemill.sources import catalog

H = golden.HOST


def _run(spark, options, **kw):
    sites = catalog.usable_sites(golden.sites(spark))
    return crawl.crawl(golden.pages(spark), sites, options=options, **kw)


def _status(result):
    return {r.url.removeprefix(H): (r.depth, r.status) for r in result.reached.collect()}


def test_full_crawl(spark):
    result = _run(spark, crawl.FULL)
    assert _status(result) == {
        "/": (0, "ok"), "/l1": (1, "ok"), "/a": (1, "ok"), "/d1": (2, "ok"), "/d2": (2, "ok"),
        "/l2": (2, "ok"), "/d3": (3, "ok"), "/e1": (3, "error"), "/deep": (3, "ok"), "/gone": (4, "missing"),
    }
    assert H + "/e1" in {r.url for r in result.log().collect()}
    assert H + "/gone" not in {r.url for r in result.log().collect()}
    found = items.extract_items(result.content())
    valid = items.envelopes(items.valid_items(found)).orderBy("url").collect()
    assert [r.url for r in valid] == [H + "/d1", H + "/d3"]
    assert json.loads(valid[0].body) == {
        "mkey": "dep", "subKey": "sec",
        "data": {"title": "One", "link": H + "/d1", "date": "2020-01-02", "author": "Ann"},
    }
    assert "Dréi" in valid[1].body and "again" not in valid[1].body
    bad = items.item_quarantine(found).collect()
    assert [(r.url, r.reason) for r in bad] == [(H + "/d2", "date")]


def test_leaf_stop(spark):
    got = _status(_run(spark, crawl.LEAF_STOP))
    assert "/deep" not in got and "/gone" not in got
    assert got["/never"] == (4, "missing") and got["http://other.example/"] == (1, "missing")
    assert got["/e1"] == (3, "ok")


def test_pattern_scope_and_depth_limit(spark):
    got = _status(_run(spark, crawl.CrawlOptions(scope="pattern", max_depth=1)))
    assert set(got) == {"/", "/l1", "/a"}


def test_rules_scope_and_modes(spark):
    sites = catalog.usable_sites(
        golden.sites(spark, {"filter_urls": [H + "/a", H + "/l2"]}, {"key": "leaf"}, {"key": "off"})
    )
    modes = spark.createDataFrame([("g", "rules"), ("leaf", "leaf")], "site_key string, mode string")
    options = {"rules": crawl.CrawlOptions(scope="rules"), "leaf": crawl.CrawlOptions(expand_content=False)}
    found = crawl.crawl_by_mode(golden.pages(spark), sites, modes, options)
    assert set(_status(found["rules"])) == {"/", "/l1", "/d1", "/d2", "/deep", "/gone"}
    assert set(_status(found["leaf"])) == {"/", "/l1", "/a", "/d1", "/d2", "/l2", "/d3", "/e1"}
    assert {r.site_key for r in found["leaf"].reached.collect()} == {"leaf"}
    assert found["rules"].failures().isEmpty()


def test_foreign_pages_are_judged_by_the_crawling_site(spark):
    """Site t links to a content page of site g; without scope t reaches and tests it."""
    sites = catalog.usable_sites(
        golden.sites(spark, {}, {"key": "t", "link": "http://t.example/", "condition": ["//i"]})
    )
    extra = spark.createDataFrame([(100, "http://t.example/", f'<a href="{H}/d1">x</a>')], golden.schema.PAGES)
    pages = golden.pages(spark).unionByName(extra)
    rows = crawl.crawl(pages, sites, options=crawl.LEAF_STOP).reached.where("site_key = 't'").collect()
    assert {(r.url, r.status, r.is_content) for r in rows} == {
        ("http://t.example/", "ok", False), (H + "/d1", "ok", True),
    }


def test_raw_seed_identity(spark):
    """Two spellings of the seed are two log lines, or one when asked."""
    seeds = spark.createDataFrame([("g", H), ("g", H + "/")], "site_key string, url string")
    raw = _run(spark, crawl.CrawlOptions(max_depth=1), seeds=seeds).reached
    assert raw.where("depth = 0").count() == 2 and raw.where("status = 'missing'").count() == 0
    one = _run(spark, crawl.CrawlOptions(max_depth=1, canonical_identity=True), seeds=seeds).reached
    assert one.where("depth = 0").count() == 1


def test_reached_set_ignores_partitioning_and_copies(spark):
    sites = catalog.usable_sites(golden.sites(spark))
    want = _status(_run(spark, crawl.FULL))
    copies = golden.pages(spark).crossJoin(spark.range(1, 40)).select(
        (F.col("page_id") + F.col("id") * 1000).alias("page_id"), "url", F.lit("<a href='/junk'>").alias("html")
    )
    pages = golden.pages(spark).unionByName(copies).repartition(13)
    assert _status(crawl.crawl(pages, sites)) == want


def test_crawls_with_nothing_to_follow(spark):
    """No links, no stored seed, no site: results are empty or one row, and runs end."""
    sites = catalog.usable_sites(golden.sites(spark))
    lonely = golden.pages(spark).where("page_id = 4").withColumn("url", F.lit(H + "/"))
    assert _status(crawl.crawl(lonely, sites)) == {"/": (0, "ok")}
    assert _status(crawl.crawl(golden.pages(spark).where("false"), sites)) == {"/": (0, "missing")}
    for options in (crawl.FULL, crawl.LEAF_STOP):
        assert _status(crawl.crawl(golden.pages(spark), sites.where("false"), options=options)) == {}


def test_click_edges(spark):
    landings = spark.createDataFrame(
        [(H + "/", 0, H + "/l1"), (H + "/", 1, ""), (H + "/", 2, H + "/l1"), (H + "/l1", 0, H + "/d1"), (H + "/d1", 0, H + "/deep")],
        "src_url string, pos int, landed_url string",
    )
    assert set(_status(_run(spark, crawl.LEAF_STOP, landings=landings))) == {"/", "/l1", "/d1"}


def test_pagination_and_router(spark):
    facts = crawl.site_facts(golden.pages(spark), catalog.usable_sites(golden.sites(spark)))
    starts = spark.createDataFrame([("g", H + "/l1")], "site_key string, url string")
    hops = pagination.next_pages(facts)
    chain = pagination.walk_chains(hops, starts)
    assert {(r.step, r.url) for r in chain.collect()} == {(0, H + "/l1"), (1, H + "/l2")}
    short = pagination.walk_chains(hops, starts, include_last=False)
    assert [r.url for r in short.collect()] == [H + "/l1"]
    routes = {r.url.removeprefix(H): r.route for r in pagination.route_listings(chain, facts).collect()}
    assert routes == {"/d1": "emit", "/d2": "emit", "/d3": "emit", "/l2": "frontier"}


def test_chains_of_every_shape_match_a_plain_walk(spark):
    """Chains with cycles and merges, against a loop."""
    step = {i: (i * i + 3) % 50 for i in range(50)}
    del step[7], step[20]
    hops = spark.createDataFrame(
        [("s", str(i), None if i not in step else str(step[i])) for i in range(50)],
        "site_key string, url string, next_url string",
    )
    want = set()
    for i in range(50):
        at, seen = i, []
        while at is not None and at not in seen:
            seen.append(at)
            at = step.get(at)
        want |= {(str(i), n, str(u)) for n, u in enumerate(seen)}
    got = pagination.walk_chains(hops, hops.select("site_key", "url"))
    assert {(r.start, r.step, r.url) for r in got.collect()} == want


def test_spellings_of_a_url_give_one_row_each(spark):
    """A landing spelled otherwise, foreign pages at two depths and a repeated site key."""
    sites = catalog.usable_sites(golden.sites(spark, {}, {}))
    pages = spark.createDataFrame(
        [(1, H + "/", ""), (2, H + "/b", ""), (3, "http://o.example/p", "")], schema.PAGES
    )
    landings = spark.createDataFrame(
        [(H + "/", 1, "HTTP://G.example/b"), (H + "/", 2, "http://o.example/p#1"), (H + "/b", 1, "http://o.example/p#2")],
        "src_url string, pos int, landed_url string",
    )
    reached = crawl.crawl(pages, sites, options=crawl.LEAF_STOP, landings=landings).reached
    assert sorted((r.url, r.depth, r.status) for r in reached.collect()) == [
        ("HTTP://G.example/b", 1, "ok"), (H + "/", 0, "ok"), ("http://o.example/p#1", 1, "ok"), ("http://o.example/p#2", 2, "ok"),
    ]


def _chain_pages(spark, n, last=""):
    """A chain of next links, each page with a link of its own."""
    row = lambda i: (i, f"{H}/c{i}", f'<a href="/leaf{i}"></a><a class="next" href="/c{i + 1}"></a>' if i < n - 1 else last)
    return spark.createDataFrame([row(i) for i in range(n)], schema.PAGES)


def _rounds(monkeypatch):
    """Counts the rounds of the crawls that follow."""
    rounds, expand = [], crawl.expand
    monkeypatch.setattr(crawl, "expand", lambda *a: rounds.append(1) or expand(*a))
    return rounds


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    sites = catalog.usable_sites(golden.sites(spark))
    seeds = spark.createDataFrame([("g", H + "/c0")], "site_key string, url string")
    rounds = _rounds(monkeypatch)
    got = {r.url: r.depth for r in crawl.crawl(_chain_pages(spark, 1000), sites, seeds).reached.collect()}
    want = {f"{H}/c{i}": i for i in range(1000)} | {f"{H}/leaf{i}": i + 1 for i in range(999)}
    assert got == want and len(rounds) <= 15


def test_shortcuts_leave_depths_and_limits_as_they_are(spark, monkeypatch):
    """A chain that ends in a cycle, with links back into it at lesser depths."""
    sites = catalog.usable_sites(golden.sites(spark))
    seeds = spark.createDataFrame([("g", H + "/c0"), ("g", H + "/side")], "site_key string, url string")
    pages = _chain_pages(spark, 18, '<a class="next" href="/c9"></a>').unionByName(
        spark.createDataFrame([(900, H + "/side", '<a href="/c13"></a>'), (901, H + "/leaf5", '<a href="/c15"></a>')], schema.PAGES)
    )
    plain = crawl.CrawlOptions(shortcut_after=None)
    want = _status(crawl.crawl(pages, sites, seeds, plain))
    built, shortcuts = [], crawl.shortcuts
    monkeypatch.setattr(crawl, "WAITING", 0)
    monkeypatch.setattr(crawl, "shortcuts", lambda *a: built.append(1) or shortcuts(*a))
    assert _status(crawl.crawl(pages, sites, seeds, crawl.CrawlOptions(shortcut_after=2))) == want
    limited = _status(crawl.crawl(pages, sites, seeds, crawl.CrawlOptions(shortcut_after=0, max_depth=9)))
    assert len(built) == 2
    assert limited == {url: row for url, row in want.items() if row[0] <= 9}


def test_chains_are_ranked_from_their_heads(spark):
    """Against a loop: random next links with merges and cycles, and one long chain."""
    rng = random.Random(3)
    for n, step in ((60, {i: rng.randrange(60) for i in range(60) if rng.random() < 0.9}), (300, {i: i + 1 for i in range(299)}), (50, {i: (i + 1) % 50 for i in range(50)})):
        hops = spark.createDataFrame([("s", f"{i:03}", f"{step[i]:03}" if i in step else None) for i in range(n)], "site_key string, url string, next_url string")
        got = {r.url: (r.head, r.rank) for r in pagination.rank_chains(hops).collect()}
        before = {}
        for i, j in sorted(step.items()):
            if i != j:
                before.setdefault(j, i)
        for i in {x for pair in step.items() for x in pair if pair[0] != pair[1]}:
            path = [i]
            while path[-1] in before and before[path[-1]] not in path:
                path.append(before[path[-1]])
            if path[-1] in before:  # a cycle: cut before its smallest URL
                path = path[: path.index(min(path)) + 1]
            assert got[f"{i:03}"] == (f"{path[-1]:03}", len(path) - 1)


def test_sites_of_several_modes_crawl_in_one_run(spark, monkeypatch):
    """The same rows as one run for each mode, which must agree on links."""
    sites = catalog.usable_sites(golden.sites(
        spark, {}, {"key": "leaf"}, {"key": "short"}, {"key": "t", "link": "http://t.example/", "condition": ["//h1"]}, {"key": "off"},
    ))
    extra = spark.createDataFrame([(100, "http://t.example/", f'<a href="{H}/l1">x</a><h1>')], schema.PAGES)
    pages = golden.pages(spark).unionByName(extra)
    modes = spark.createDataFrame([("g", "full"), ("leaf", "leaf"), ("short", "short"), ("t", "leaf")], "site_key string, mode string")
    options = {"full": crawl.FULL, "leaf": crawl.LEAF_STOP, "short": crawl.CrawlOptions(max_depth=1, scope="pattern")}
    together = crawl.crawl_by_mode(pages, sites, modes, options)
    assert set(_status(together["full"])) == set(_status(_run(spark, crawl.FULL)))
    assert set(_status(together["short"])) == {"/", "/l1", "/a"}
    for mode in ("leaf",):
        o = options[mode]
        own = sites.join(modes.where(F.col("mode") == mode), "site_key", "left_semi")
        alone = crawl.crawl(pages, own, options=o)
        for one, other in ((together[mode].reached, alone.reached), (together[mode].content(), alone.content())):
            assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    with pytest.raises(ValueError):
        crawl.crawl(pages, sites, options={"a": crawl.FULL, "b": crawl.CrawlOptions(shortcut_after=9)}, modes=modes)


def test_foreign_content_pages_give_items(spark, monkeypatch):
    """Fields of foreign pages are read at the end, each URL once."""
    monkeypatch.setattr(crawl, "PROFILES_PER_PASS", 1)
    sites = catalog.usable_sites(golden.sites(
        spark, {"key": "t", "link": "http://t.example/"}, {"key": "u", "link": "http://t.example/u", "condition": ["//i"]},
    ))
    anchors = "".join(f'<a href="{H}/{p}">' for p in ("d1", "d3", "l1", "nowhere"))
    extra = [(100, "http://t.example/", anchors), (101, "http://t.example/u", anchors)]
    pages = golden.pages(spark).unionByName(spark.createDataFrame(extra, schema.PAGES))
    pages = pages.unionByName(pages.where("page_id = 3"))
    result = crawl.crawl(pages, sites, options=crawl.LEAF_STOP)
    found = {(r.site_key, r.url.removeprefix(H), r.title[0]) for r in items.extract_items(result.content()).collect()}
    assert found == {("t", "/d1", "One"), ("t", "/d3", "Dréi"), ("t", "/d2", "Two"), ("u", "/d1", "One")}
    reached = [(r.site_key, r.url) for r in result.reached.collect()]
    assert len(reached) == len(set(reached))


def test_no_round_reads_html(spark, monkeypatch, tmp_path):
    golden.pages(spark).write.parquet(str(tmp_path / "pages"))
    plans, expand = [], crawl.expand

    def record(frontier, edges, known):
        plans.append(expand(frontier, edges, known)._jdf.queryExecution().executedPlan().toString())
        return expand(frontier, edges, known)

    foreign = crawl._Foreign.facts

    def record_foreign(self, *a):
        found = foreign(self, *a)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(crawl, "expand", record)
    monkeypatch.setattr(crawl._Foreign, "facts", record_foreign)
    sites = catalog.usable_sites(golden.sites(spark, {"link": "http://t.example/"}, {}))
    seeds = spark.createDataFrame([("g", H + "/"), ("g", "http://o.example/")], "site_key string, url string")
    crawl.crawl(spark.read.parquet(str(tmp_path / "pages")), sites, seeds, crawl.LEAF_STOP)
    assert len(plans) > 3 and not any("html" in text or "Python" in text for text in plans)
