import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill import runtime
from pagemill.functions import dom
from pagemill.functions.dom import Document
from pagemill.operators.items import parse_quarantine

PAGE = """<html><head><meta name="d" content="dep"><title>T</title></head><body>
<div class="ad x"><p>one<p>two <b>bold</b></div><ul><li>a<li>b<ul><li>c</ul></ul>
<table><tr><td>1<td>2<tr><td>3</table><a class="next" href="/n">n</a><script>if (a</b>) "<p>no"</script>
<!-- <p>no --></body>"""


@pytest.mark.parametrize(
    "path, want",
    [
        ("/html/head/title", ["T"]),
        ("//title/text()", ["T"]),
        ("//meta[@name='d']/@content", ["dep"]),
        ("//p", ["one", "two bold"]),
        ("//p/text()", ["one", "two "]),
        ("//div[contains(@class,'a')]/p[2]/b", ["bold"]),
        ("//div[@class='ad']", []),
        ("//div[@class~='ad']/p[1]", ["one"]),
        ("//td[1]", ["1", "3"]),
        ("//tr[last()]/td", ["3"]),
        ("/html/body/ul/li[2]/ul/li", ["c"]),
        ("//ul//li", ["a", "bc", "c"]),
        ("//a[@class]/@href", ["/n"]),
        ("//b/..", ["two bold"]),
        ("//title | //a/@href", ["T", "/n"]),
        ("//b | //title", ["T", "bold"]),
        ("//*[@name]/@content", ["dep"]),
        ("//p[0]", []),
        ("//nothing", []),
    ],
)
def test_paths(path, want):
    assert re.search(dom.XPATH_PATTERN, path)
    assert Document(PAGE).strings(path) == want


@pytest.mark.parametrize("path", ["h1", "//a[position()>1]", "count(//a)", "//a[text()='x']", "", "//a/"])
def test_unsupported_paths_are_recognised(path):
    assert not re.search(dom.XPATH_PATTERN, path)


def test_css():
    html = '<div class="big ad-x"><a id="i">1</a></div><div class="ad big"><p><a>2</a></p></div>'
    assert Document(html).strings(dom.css_to_xpath("div.ad a")) == ["2"]
    assert Document(html).strings(dom.css_to_xpath(".big #i")) == ["1"]
    for bad in ("a > b", "a:hover", ""):
        with pytest.raises(ValueError):
            dom.css_to_xpath(bad)


def test_odd_markup():
    assert Document("").strings("//p") == []
    assert Document("</p></div>text<p>x").strings("//p") == ["x"]
    assert Document('<a href="1" href="2">').strings("//a/@href") == ["1"]
    deep = "<div>" * 3000 + "<p>x</p>"
    assert Document(deep).strings("//p/text()") == ["x"]


@pytest.mark.parametrize("junk", ["<![if IE]>", "<![odd[x]]>", "<!weird>", "<!DOCTYPE html>", "<![CDATA[x]]>", "<?php x ?>"])
def test_declarations_never_fail(junk):
    assert Document(junk + "<p>x</p>" + junk).strings("//p") == ["x"]
    Document(junk[:-1])


def test_a_failing_page_is_reported(spark):
    rows = [(1, "<p>a</p>", ["//p"]), (2, "<p>b</p>", [None])]
    df = spark.createDataFrame(rows, "page_id long, html string, c array<string>").withColumn(
        "facts", dom.page_facts("html", "c", F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<name:string,xpath:string>>"))
    )
    got = {r.page_id: (r.facts.is_content, r.facts.failure) for r in df.collect()}
    assert got[1] == (True, None) and got[2][0] is False and "TypeError" in got[2][1]
    bad = parse_quarantine(df.withColumn("site_key", F.lit("s")).withColumn("url", F.lit("u"))).collect()
    assert [(r.page_id, r.stage) for r in bad] == [(2, "parse")]


def test_patterns_agree_between_engines(spark):
    """The same pattern checks a catalog in the JVM and paths in Python."""
    paths = ["//a[@class='x y']/@href", "//h1/text() | /b", "//a[2][last()]", "//a[position()>1]", "h1"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(F.col("p").rlike(dom.XPATH_PATTERN)).collect()
    assert [r[0] for r in got] == [bool(re.search(dom.XPATH_PATTERN, p)) for p in paths]


def test_strings_come_in_document_order_and_once():
    doc = dom.Document("<article>x<p>a<b id=1>c<i>e</i>f</b>d</p>y</article><h1>t</h1>")
    assert doc.strings("//article//text()") == ["x", "a", "c", "e", "f", "d", "y"]
    assert doc.strings("//h1/text() | //h1/text()") == ["t"]
    assert doc.strings("//h1/text() | //b/@id | //article/text()") == ["x", "1", "y", "t"]
    assert doc.strings("//h1 | //b") == ["cef", "t"]


def test_workers_hold_few_rows_as_objects(monkeypatch):
    """However many pages a batch has, so many of them are Python objects at a time."""
    taken, cut = [], pa.array([f"<pre>{i}" for i in range(1050)])

    class Column:
        def __len__(self):
            return len(cut)

        def slice(self, at, n):
            taken.append(n)
            return cut.slice(at, n)

    found = dom.by_rows(lambda text: text[5:], [Column()], pa.string())
    assert found.to_pylist() == [str(i) for i in range(1050)] and max(taken) <= 100
    assert dom.by_rows(len, [cut.slice(0, 0)], pa.int64()).to_pylist() == []


def test_parsed_pages_are_written_in_recommended_batches(spark, monkeypatch):
    """Where the session names none; what it names, before or after, stays."""
    seen, keys = [], runtime.ARROW_BATCHES
    monkeypatch.setattr(runtime, "materialize", lambda df, name: seen.append([spark.conf.get(key, None) for key in keys]))
    before = [spark.conf.get(key) for key in keys]
    try:
        for key in keys:
            spark.conf.unset(key)
        runtime.materialize_parsed(spark.range(1), "x")
        assert [spark.conf.get(key, None) for key in keys] == [None, None]
        spark.conf.set(keys[0], "7")
        runtime.materialize_parsed(spark.range(1), "x")
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
    recommended = [runtime.RECOMMENDED_CONF[key] for key in keys]
    assert seen == [recommended, ["7", recommended[1]]]
