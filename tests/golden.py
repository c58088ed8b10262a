"""A tiny hand-built site with a cycle, an error page, a missing page and pagination."""

from pagemill import schema

HOST = "http://g.example"
SITE = {
    "key": "g",
    "link": HOST + "/",
    "condition": ["//div[@id='doc']"],
    "fields": [
        {"name": "depart", "xpath": "//meta[@name='d']/@content"},
        {"name": "section", "xpath": "//h2/text()"},
        {"name": "title", "xpath": "//h1/text()"},
        {"name": "date", "xpath": "//span[@class='dt']/text()"},
        {"name": "author", "xpath": "//i/text()"},
    ],
    "next_page_xpath": "//a[@class='next']",
    "filter_urls": None,
    "deny": None,
    "depart": None,
}


def _links(*hrefs):
    return "".join(f'<a href="{h}">{h}</a>' for h in hrefs)


def _doc(title, date=True, extra=""):
    when = '<span class="dt">2020-01-02</span>' if date else ""
    return (
        f'<html><head><meta name="d" content="dep"></head><body><div id="doc"><h2>sec</h2>'
        f"{title}{when}{extra}</div></body></html>"
    )


PAGES = [
    ("/", "<html><body>" + _links("/l1", "/a", "/a#x", "http://other.example/")),
    ("/l1", _links("/d1", "/d2") + '<a class="next" href="/l2">next</a>'),
    ("/l2", _links("/d3", "/e1")),
    ("/d1", _doc("<h1>One</h1>", extra="<i>Ann</i>" + _links("/deep"))),
    ("/d2", _doc("<h1>Two</h1>", date=False)),
    ("/d3", _doc("<h1>Dréi</h1><h1>again</h1>")),
    ("/a", _links("/")),
    ("/e1", '<html><body><pre>{"error": 404}</pre>' + _links("/never")),
    ("/deep", _links("/gone")),
]


def sites(spark, *changes):
    rows = [SITE | change for change in changes] or [SITE]
    return spark.createDataFrame(
        [[row[f.name] for f in schema.SITES] for row in rows], schema.SITES
    )


def pages(spark):
    rows = [(i, HOST + path, html) for i, (path, html) in enumerate(PAGES)]
    return spark.createDataFrame(rows, schema.PAGES)
