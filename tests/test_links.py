from pyspark.sql import functions as F

from pagemill import schema
from pagemill.operators.links import LinkOptions, extract_links, is_nofollow, link_allowed, unique_urls, with_links

NASTY = """<html><head><base href="/dir/"><!-- <a href="no1"> --><script>var a='<a href="no2">';</script></head><body>
<a title="x > y href='bad'" HREF = 'one?a=1&amp;b=2' rel="external NoFollow">One <b>bold</b> &eacute;</a>
<area href=two.html><a name=nohref>none</a><a href="">empty</a><a href="http://[bad/">bad</a><a href="mailto:x@y">m</a>
<a href=" sp ace ">s</a><a href=x.pdf>pdf</a><a href="../../up">up</a>
<a href="one?b=2&a=1" rel="nofollow external">One bold é</a><a href="unclosed">text"""


def page(spark, html, url="http://H.com/x/y?q#f"):
    return spark.createDataFrame([(1, url, html)], schema.PAGES)


def rows(df):
    return sorted(tuple(r) for r in df.select("pos", "url", "text", "nofollow").collect())


def test_nasty_page_on_both_paths(spark):
    want = [
        (0, "http://h.com/dir/one?a=1&b=2", "One bold é", True),
        (1, "http://h.com/dir/two.html", "", False),
        (2, "http://h.com/dir/", "empty", False),
        (5, "http://h.com/dir/sp%20ace", "s", False),
        (7, "http://h.com/up", "up", False),
        (9, "http://h.com/dir/unclosed", "text", False),
    ]
    assert rows(extract_links(page(spark, NASTY))) == want
    parsed = LinkOptions(tags=lambda t: t in ("a", "area"), attrs=lambda a: a == "href")
    assert rows(extract_links(page(spark, NASTY), parsed)) == want


def test_native_scan_equals_parser_on_every_stored_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    native = extract_links(pages, LinkOptions(unique=False))
    parsed = extract_links(pages, LinkOptions(unique=False, tags=lambda t: t in ("a", "area")))
    assert native.exceptAll(parsed).isEmpty() and parsed.exceptAll(native).isEmpty()


def test_other_tags_and_attributes(spark):
    html = '<img src="/a.html" longdesc="/b.html"><link href="/c"><img alt="x">'
    options = LinkOptions(tags=("img", "link"), attrs=("src", "href", "longdesc"))
    got = rows(extract_links(page(spark, html), options))
    assert [r[1] for r in got] == ["http://h.com/a.html", "http://h.com/b.html", "http://h.com/c"]


def test_hook_drops_and_rewrites(spark):
    html = '<a href="keep">k</a><a href="drop">d</a>'
    hook = lambda u: F.when(~u.contains("drop"), F.lit("../moved"))
    got = rows(extract_links(page(spark, html), LinkOptions(process_value=hook)))
    assert got == [(0, "http://h.com/moved", "k", False)]


def test_filters(spark):
    values = ["http://a.x.com/p", "https://x.com/p.PDF", "ftp://x.com/d", "http://badx.com/", "javascript:1", "http://x.com/en/q"]

    def kept(**options):
        df = spark.createDataFrame([(v,) for v in values], "u string")
        return {r.u for r in df.where(link_allowed(F.col("u"), LinkOptions(**options))).collect()}

    every = set(values)
    assert kept() == every - {"https://x.com/p.PDF", "javascript:1"}
    assert kept(deny_extensions=()) == every - {"javascript:1"}
    assert kept(allow_domains=("x.com",)) == {"http://a.x.com/p", "ftp://x.com/d", "http://x.com/en/q"}
    assert kept(deny_domains=("X.com",)) == {"http://badx.com/"}
    assert kept(allow=("/en/", "/d$"), deny=("q",)) == {"ftp://x.com/d"}


def test_regions_in_order_and_unique_across(spark):
    html = '<div id="b"><a href="/1">1</a></div><div class="c"><a href="/2">2</a><a href="/1">1</a></div><a href="/3">3</a>'
    options = LinkOptions(restrict_xpaths=("//div[@class='c']",), restrict_css=("#b",))
    assert [(r[0], r[1][-1]) for r in rows(extract_links(page(spark, html), options))] == [(0, "2"), (1, "1")]


def test_uniqueness_levels(spark):
    html = '<a href="/1">a</a><a href="/1#x">a</a><a href="/1">b</a><a rel="nofollow" href="/1">a</a><a href="/0">z</a>'
    df = with_links(page(spark, html))
    assert [r[0] for r in rows(extract_links(page(spark, html)))] == [0, 2, 3, 4]
    once = unique_urls(df)
    assert [(x.pos, x.url[-1]) for x in once.first().links] == [(0, "1"), (4, "0")]
    assert unique_urls(once).first().links == once.first().links


def test_a_huge_page_stays_linear(spark):
    n = 60_000
    html = "".join(f'<a href="/{i % 30_000}">t</a>' for i in range(n))
    assert extract_links(page(spark, html)).count() == 30_000


def test_nofollow_words(spark):
    df = spark.createDataFrame([("NOFOLLOW",), ("a nofollow b",), ("nofollows",), (None,), ("",)], "r string")
    assert [r[0] for r in df.select(is_nofollow(F.col("r"))).collect()] == [True, True, False, False, False]


def test_urls_with_a_base_outside_the_site(spark):
    html = '<base href="//cdn.example/a/"><a href="b">b</a>'
    assert rows(extract_links(page(spark, html)))[0][1] == "http://cdn.example/a/b"


MARKUP = [
    ("<a href=/x title=don't>x</a><a href=/y>y</a>", ["/x", "/y"], ["x", "y"]),
    ("<!--><a href='/1'>one</a><!---><a href='/2'>two</a><!-- <a href='/no'> -->", ["/1", "/2"], ["one", "two"]),
    ('<a title="<!--" href="/1">a</a><a href="/2">b</a>', ["/1", "/2"], ["a", "b"]),
    ('<area href="/m"><p>Hello world</p><a href="/n">n</a>', ["/m", "/n"], ["", "n"]),
    ('<a href="/i"><img alt="a>b">t</a>', ["/i"], ["t"]),
    ("<script>var x = '<a href=\"/s\">';</script><a href='/c'>&check; &#0000065;</a>", ["/c"], ["✓ A"]),
    ("<a href='/f.tar.gz'>f</a><a href='/gz'>g</a>", ["/gz"], ["g"]),
]


def test_awkward_markup_loses_no_link(spark):
    rows = [(i, "http://h.example/", html) for i, (html, _, _) in enumerate(MARKUP)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract_links(pages).orderBy("page_id", "pos").collect()
    for i, (_, targets, texts) in enumerate(MARKUP):
        mine = [r for r in found if r["page_id"] == i]
        assert [r["url"].removeprefix("http://h.example") for r in mine] == targets, i
        assert [r["text"] for r in mine] == texts, i


def test_unclosed_tags_stay_linear(spark):
    import time

    pages = spark.createDataFrame([(1, "http://h.example/", "<a x " * 100_000)], "page_id long, url string, html string")
    began = time.time()
    assert extract_links(pages).count() == 0
    assert time.time() - began < 20
