"""Inputs that Spark derives from `pages`, so that all work grows with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.runtime import scratch_path
from pagemill.sources.catalog import usable_sites
from pagemill.sources.pages import read_pages

CORPUS = "https://c.example/"
SERVER = "http://outbox.example"
RENDERER = "http://render.example/render.html"
TITLE, DATE = "//h1/text()", "//nav/ul/li[6]/a/text()"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^(https?://[^/]+/)", 1)


def site_docs(source: DataFrame) -> DataFrame:
    """One catalog document per origin of `pages`. By the smallest page_id: every
    11th key is empty, every 13th null, every 7th site asks for pages with a sixth
    nav link as its next page."""
    first = F.col("first_id")
    field = lambda name, path: F.struct(F.lit(name).alias("name"), F.lit(path).alias("xpath"))
    return (
        source.groupBy(origin(F.col("url")).alias("link"))
        .agg(F.min("page_id").alias("first_id"))
        .select(
            F.when(first % 13 == 5, F.lit(None)).when(first % 11 == 3, F.lit("")).otherwise(F.col("link")).alias("key"),
            "link",
            F.when(first % 5 == 0, F.array(F.lit("//div[@class='none']")))
            .otherwise(F.array(F.lit("//div[@class='none']"), F.lit("//nav/ul/li[5]")))
            .alias("condition"),
            F.array(
                field("title", "//title/text()"),
                field("title", TITLE),
                field("section", "//nav/ul/li[1]/a/text()"),
                field("date", DATE),
                field("footer", "//footer/text()"),
            ).alias("fields"),
            F.when(first % 7 == 0, F.lit('["//a[@class=\'next\']", "//nav/ul/li[6]/a"]'))
            .when(first % 7 == 1, F.lit("//nav/ul/li[6]/a"))
            .alias("next_page_xpath"),
            F.array(F.concat("link", F.lit("en/")), F.concat("link", F.lit("de/"))).alias("filter_urls"),
            (first % 2 == 0).alias("deny"),
            F.when(first % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("dep-"), urls.host_of(F.col("link")))).alias("depart"),
        )
    )


def sites(source: DataFrame) -> DataFrame:
    return usable_sites(site_docs(source))


def domain_list(source: DataFrame) -> DataFrame:
    """Hosts of every seventh page, without their first label when there are four."""
    host = urls.host_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]+\.([^.]+\.[^.]+\.[^.]+)$", "$1")
    return source.where("page_id % 7 = 0").select(parent.alias("domain"))


def _anchor(path: Column, extra: str = "") -> Column:
    return F.concat(F.lit("<a href=\"/"), path.cast("string"), F.lit(f'"{extra}>x</a>'))


def next_of(i: Column) -> Column:
    """Next page of every third page: chains of ten, half of which close a cycle."""
    return F.when(i % 30 < 27, i + 3).when(i % 60 == 27, i - 27)


def corpus(source: DataFrame) -> DataFrame:
    """A linked corpus: page i links to 2i+1, 2i+2 and back to i div 3; every third
    page may have a next page; every fifth is content; every 17th an error page.
    The body is the real page's article, which holds no links."""
    i = F.col("page_id")
    article = F.regexp_extract("html", "(?s)<article>.*</article>", 0)
    head = F.when(i % 17 == 16, F.lit('<html><body><pre>{"error": 502}</pre>')).otherwise(F.lit("<html><body>"))
    content = F.when(i % 5 == 0, F.lit('<div id="doc">c</div>')).otherwise(F.lit(""))
    next_link = F.coalesce(F.when(i % 3 == 0, _anchor(next_of(i), ' class="next"')), F.lit(""))
    html = F.concat(
        head, _anchor(2 * i + 1), _anchor(2 * i + 2), _anchor(F.expr("page_id div 3")),
        next_link, content, article, F.lit("</body></html>"),
    )
    return source.select("page_id", corpus_url(i).alias("url"), html.alias("html"))


def corpus_url(i: Column) -> Column:
    return F.concat(F.lit(CORPUS), i.cast("string"))


def landings(source: DataFrame) -> DataFrame:
    """Clicked anchors of the corpus: the second of four leads nowhere, the last repeats."""
    i = F.col("page_id")
    urls_ = F.array(corpus_url(2 * i + 1), F.lit(""), corpus_url(2 * i + 2), corpus_url(2 * i + 1))
    return source.select(corpus_url(i).alias("src_url"), F.posexplode(urls_).alias("pos", "landed_url"))


def error_candidates(source: DataFrame) -> DataFrame:
    """Pages with JSON bodies of every kind, and climbing paths in every 11th URL."""
    i = F.col("page_id")
    body = F.element_at(
        F.array(*[
            F.lit(x) for x in (
                '<pre>{"error":502}</pre>', '<pre>{"error":"502"}</pre>', "<pre>{&quot;error&quot;: 404.0}</pre>",
                '<pre>{"error":200}</pre>', "<pre>[1]</pre>", "<pre>x</pre>", "",
            )
        ]),
        (i % 7 + 1).cast("int"),
    )
    climb = F.when(i % 11 == 0, F.lit("a/../../../../b")).when(i % 11 == 1, F.lit("a/../../../b")).otherwise(F.lit("a"))
    return source.select(
        "page_id",
        F.concat(origin(F.col("url")), climb).alias("url"),
        F.concat(F.lit("<html><body>"), body, F.regexp_extract("html", "(?s)<article>.*", 0)).alias("html"),
    )


def attribute_pages(source: DataFrame) -> DataFrame:
    """Pages with a base, areas, rel values, entities, and targets that must be dropped."""
    i = F.col("page_id")
    base = F.when(i % 2 == 0, F.concat(F.lit('<base href="/b'), i.cast("string"), F.lit('/">'))).otherwise(F.lit(""))
    links = F.lit(
        '<!-- <a href="/no">no</a> --><a class="a > b" href="x?y=1&amp;z=2" rel="external NOFOLLOW">caf\u00e9 &amp; <b>tea</b></a>'
        '<area href="/area"><a name="n">n</a><a href="http://[bad/">bad</a><a href="drop-me">d</a><a href=\'../up\'>up</a>'
    )
    body = F.concat(F.lit("<html><head>"), base, F.lit("</head><body>"), links, F.lit("</body></html>"))
    return source.select("page_id", origin(F.col("url")).alias("url"), F.encode(body, "ISO-8859-1").alias("body"))


def corpus_site(source: DataFrame, next_page: bool) -> DataFrame:
    """The catalog of the derived corpus, grown out of its first page."""
    field = F.struct(F.lit("title").alias("name"), F.lit(TITLE).alias("xpath"))
    docs = source.where("page_id = 0").select(
        F.lit("c").alias("key"),
        F.lit(CORPUS).alias("link"),
        F.array(F.lit("//div[@id='doc']")).alias("condition"),
        F.array(field).alias("fields"),
        F.lit("//a[@class='next']" if next_page else None).cast("string").alias("next_page_xpath"),
        F.array().cast("array<string>").alias("filter_urls"),
        F.lit(True).alias("deny"),
        F.lit("d").alias("depart"),
    )
    return usable_sites(docs)


def repeated(source: DataFrame) -> DataFrame:
    """Pages with ids that say nothing: every fourth is null, every third row is there
    twice, and every fifth has the id of another page."""
    i = F.col("page_id")
    odd = F.when(i % 4 == 0, None).when(i % 5 == 0, i + 1).otherwise(i)
    return source.withColumn("page_id", odd).unionByName(source.where(i % 3 == 0).withColumn("page_id", odd.cast("long")))


def linked(source: DataFrame) -> DataFrame:
    """Whole pages, with anchors to pages i+1 and 2i+1 of any site added to their own links."""
    ahead = source.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("one"))
    twice = source.where("page_id % 2 = 1").select(F.expr("page_id div 2").alias("page_id"), F.col("url").alias("two"))
    both = source.join(ahead, "page_id", "left").join(twice, "page_id", "left")
    added = [F.coalesce(F.concat(F.lit('<a href="'), c, F.lit('">x</a>')), F.lit("")) for c in ("one", "two")]
    return both.select("page_id", "url", F.concat("html", *added).alias("html"))


def site_modes(source: DataFrame) -> DataFrame:
    """(site_key, mode, url): the mode of each origin and its first page; every fifth has no mode."""
    first = source.groupBy(origin(F.col("url")).alias("site_key")).agg(F.min(F.struct("page_id", "url")).alias("p"))
    i = F.col("p.page_id")
    mode = F.when(i % 5 == 4, None).when(i % 2 == 0, "full").otherwise("leaf")
    return first.select("site_key", mode.alias("mode"), "p.url").where("mode IS NOT NULL")


def split(source: DataFrame, name: str, files: int = 4) -> str:
    """The pages as several files, for streams of several micro-batches."""
    path = scratch_path(source.sparkSession, name)
    source.select("page_id", "url", "html").repartition(files).write.parquet(path)
    return path


def bodies(source: DataFrame) -> DataFrame:
    """Pages as bytes in four charsets, one of them unknown to the reader."""
    i = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("utf-8", "UTF-16LE", "utf-16be", "x-none")]), (i % 4 + 1).cast("int"))
    coded = F.when(i % 4 == 1, F.encode("html", "UTF-16LE")).when(i % 4 == 2, F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "UTF-8"))
    return source.select("page_id", coded.alias("body"), F.when(i % 8 > 0, name).alias("charset"))
