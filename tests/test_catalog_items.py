import json

from pyspark.sql import functions as F
from tests import golden

from pagemill import schema
from pagemill.operators import items
from pagemill.operators.binding import bind_sites
from pagemill.sources import catalog, sinks
from pagemill.sources import pages as fetch


def docs(spark, *changes):
    return golden.sites(spark, *changes)


def test_scan_lookup_and_quarantine(spark):
    bad = [{"name": "x", "xpath": "//a[position()>1]"}]
    sites = docs(
        spark, {"key": "a"}, {"key": ""}, {"key": None}, {"key": "b", "fields": None}, {"key": "c", "condition": ["h1"]},
        {"key": "d", "fields": bad}, {"key": "e", "next_page_xpath": '["//a", "//b()"]'}, {"key": "f", "link": None},
    )
    assert {r.key for r in catalog.scan(sites).collect()} == {"a", None, "b", "c", "d", "e", "f"}
    assert [r.site_key for r in catalog.usable_sites(sites).collect()] == ["a"]
    reasons = {r.site_key: r.reason for r in catalog.site_quarantine(sites).collect()}
    assert reasons == {
        None: "key is missing", "b": "fields are missing", "c": "condition is not supported",
        "d": "field is not supported", "e": "next page is not supported", "f": "link is missing",
    }
    assert catalog.lookup(sites, "a").count() == 1 and catalog.lookup(sites, "zz").count() == 0


def test_config_normalisation(spark):
    fields = [{"name": "t", "xpath": "//a"}, {"name": "u", "xpath": "//b"}, {"name": "t", "xpath": "//c"}]
    sites = docs(
        spark, {"key": "1", "next_page_xpath": "//a[1]", "fields": fields}, {"key": "2", "next_page_xpath": '["//a","//b"]'},
        {"key": "3", "next_page_xpath": None},
    )
    got = {r.site_key: r for r in catalog.usable_sites(sites).collect()}
    assert [got[k].next_xpaths for k in "123"] == [["//a[1]"], ["//a", "//b"], []]
    assert [(f.name, f.xpath) for f in got["1"].fields] == [("u", "//b"), ("t", "//c")]
    assert got["1"].deny is True and got["1"].filter_urls == []


def test_catalog_reads_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(golden.SITE))
    assert catalog.usable_sites(catalog.read_sites(spark, str(tmp_path))).first().site_key == "g"


def test_binding_is_the_same_for_small_and_large_catalogs(spark):
    """Nested scopes, a partial last segment, sites without pages, many on one host."""
    links = ["http://h.example", "http://h.example/a", "http://h.example/a/b/", "http://H.example:80/a/", "http://x.example/", "https://h.example/"]
    links += [f"http://h.example/s{i}/" for i in range(200)]
    sites = catalog.usable_sites(docs(spark, *[{"key": f"k{i}", "link": link} for i, link in enumerate(links)]))
    paths = ["http://h.example", "http://h.example/abc?q", "http://h.example/a/b/c#f", "https://h.example/a", "http://h.example.evil/", "http://h.example/s7/x"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(paths)], schema.PAGES)
    want = {(0, "k0"), (1, "k0"), (1, "k1"), (2, "k0"), (2, "k1"), (2, "k2"), (2, "k3"), (3, "k5"), (5, "k0"), (5, "k13")}
    for limit in (1 << 20, 0):
        bound = bind_sites(pages, sites, broadcast_limit=limit)
        assert {(r.page_id, r.site_key) for r in bound.collect()} == want
        assert set(bound.columns) >= {"html", "url", "page_key", "scope", "conditions"}


ITEM = (
    "site_key string, page_id long, url string, default_depart string, depart array<string>, section array<string>, "
    "title array<string>, link array<string>, date array<string>, option_fields map<string,array<string>>"
)


def test_validation_strict_and_lenient(spark):
    full = ["s", 0, "u", "", ["d"], ["s"], ["t"], ["u"], ["x"], {}]

    def row(i, **change):
        names = ["site_key", "page_id", "url", "default_depart", "depart", "section", "title", "link", "date", "option_fields"]
        return tuple({**dict(zip(names, full)), "page_id": i, **change}.values())

    found = spark.createDataFrame(
        [row(0), row(1, title=[""]), row(2, date=None), row(3, depart=None), row(4, depart=None, default_depart="z"), row(5, title=[])],
        ITEM,
    )
    assert {r.page_id for r in items.valid_items(found).collect()} == {0, 4}
    assert {r.page_id: r.reason for r in items.item_quarantine(found).collect()} == {1: "title", 2: "date", 3: "depart", 5: "title"}
    assert {r.page_id for r in items.valid_items(found, strict=False).collect()} == {0, 1, 4, 5}
    bodies = {r.page_id: json.loads(r.body) for r in items.envelopes(items.valid_items(found, strict=False)).collect()}
    assert bodies[5] == {"mkey": "d", "subKey": "s"} and bodies[4]["mkey"] == "z"


def test_page_url_wins_over_a_configured_link(spark):
    fields = golden.SITE["fields"] + [{"name": "link", "xpath": "//h1"}, {"name": "none", "xpath": "//video"}]
    sites = catalog.usable_sites(docs(spark, {"fields": fields}))
    found = items.extract_items(items.with_facts(bind_sites(golden.pages(spark), sites)))
    one = items.envelopes(items.valid_items(found)).where("url like '%/d1'").first()
    assert one.data["link"] == golden.HOST + "/d1" and "none" not in one.data
    both = items.valid_items(found).where("url like '%/d1'").first()
    assert both.link == [golden.HOST + "/d1", "One"]
    # items and quarantine split the content pages
    total = items.valid_items(found).count() + items.item_quarantine(found).count()
    assert total == found.count() == 3


def test_sinks(spark, tmp_path):
    sites = catalog.usable_sites(docs(spark))
    found = items.extract_items(items.with_facts(bind_sites(golden.pages(spark), sites)))
    shaped = items.envelopes(items.valid_items(found))
    for _ in range(2):
        sinks.append_item_lines(shaped, str(tmp_path / "items"))
    assert sinks.read_item_lines(spark, str(tmp_path / "items")).where("subKey = 'sec'").count() == 4
    box = sinks.outbox(shaped, "http://s").collect()
    assert {r.endpoint for r in box} == {"http://s/api/1.0"} and {r.content_type for r in box} == {"application/json"}
    log = spark.createDataFrame([("a/b", "http://h"), ("a/b", "http://h/"), ("c", "http://é")], "site_key string, url string")
    for _ in range(2):
        sinks.append_crawl_log(log, str(tmp_path / "log"))
    back = sinks.read_crawl_log(spark, str(tmp_path / "log"))
    assert back.groupBy("site_key", "url").count().where("count = 2").count() == 3


def test_fetch_tables(spark):
    urls = spark.createDataFrame([("http://h/robots.txt",), ("http://h/robots.txt?x",), ("http://h/ä b",)], "url string")
    plain = {r.url: r.request_url for r in fetch.fetch_manifest(urls, "http://r/").collect()}
    assert plain == {
        "http://h/robots.txt?x": "http://r/?url=http://h/robots.txt?x&timeout=10&wait=0.5",
        "http://h/ä b": "http://r/?url=http://h/ä b&timeout=10&wait=0.5",
    }
    encoded = {r.request_url for r in fetch.fetch_manifest(urls, "http://r/", encode=True).collect()}
    assert "http://r/?url=http%3A%2F%2Fh%2F%C3%A4+b&timeout=10&wait=0.5" in encoded
    assert {r.request_url for r in fetch.fetch_manifest(urls, "", raw=True).collect()} == set(plain)
    results = spark.createDataFrame([("u", [], [], "h"), ("v", [({"a": "1"}, 301), ({"a": "2"}, 200)], [], "h")], schema.FETCH_RESULTS)
    got = {r.url: (r.http_status, r.headers) for r in fetch.normalise_fetch(results).collect()}
    assert got == {"u": (None, None), "v": (200, {"a": "2"})}
    raw = spark.createDataFrame([(bytearray("é", "latin-1"),)], "b binary")
    assert raw.select(fetch.decode_body(F.col("b"), "ISO-8859-1")).first()[0] == "é"


def test_bodies_in_any_charset(spark):
    rows = [
        (1, "é€".encode(), None), (2, "中文".encode("gbk"), "GBK"), (3, b"a\xffb", "utf-8"), (4, b"a\xffb", "GB18030"),
        (5, b"abc", "no-such-charset"), (6, None, "GBK"), (7, b"", "Big5"), (8, b"\xe9", "latin1"), (9, b"abc", "base64"),
    ]
    raw = spark.createDataFrame(rows, "id int, b binary, charset string")
    got = {r.id: r.text for r in raw.select("id", fetch.decode_body(F.col("b"), F.col("charset")).alias("text")).collect()}
    assert got == {1: "é€", 2: "中文", 3: "a\ufffdb", 4: got[4], 5: None, 6: None, 7: "", 8: "é", 9: None}
    assert "\ufffd" in got[4]
    assert raw.where("id = 3").select(fetch.decode_body(F.col("b"))).first()[0] == "a\ufffdb"


def test_a_repeated_key_is_one_site(spark):
    sites = golden.sites(spark, {}, {}, {"link": "http://a.example/", "condition": ["//h1/following::p"]})
    assert catalog.usable_sites(sites).count() == 1
    reasons = sorted(r.reason for r in catalog.site_quarantine(sites).collect())
    assert reasons == ["condition is not supported", "key is repeated"]
