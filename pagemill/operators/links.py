"""Link extraction: one page row in, many link rows out.

Links stay in an array per page until the very end. Scanning, resolving,
filtering, canonicalizing and deduplicating therefore need no shuffle, and the
same code runs on streams. A page that shares its host or URL with millions of
others is still just one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom, urls
from pagemill.runtime import bounded_join

# Extensions that never lead to a page (media, archives, office
# files, programs), as the default list of a well-known crawler library has them,
# and the URL schemes links may have.
DENIED_EXTENSIONS = (
    "7z 7zip bz2 rar tar tar.gz xz zip "
    "mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg cdr ico webp "
    "mp3 wma ogg wav ra aac mid au aiff "
    "3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a m4v flv webm "
    "xls xlsx ppt pptx pps doc docx odt ods odg odp "
    "css pdf exe bin rss dmg iso apk jar xpi"
).split()
SCHEMES = ("http", "https", "file", "ftp")

# Fixed patterns. Possessive quantifiers keep Java's matcher from recursing
# once per character. Quotes count only after "=", where quoted values may hold ">"
# or "<"; elsewhere a "<" ends the scan, so unclosed tags cost no second look.
_ATTRS = r"""((?:[^>"'=<]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>"""
# Comments, scripts and style sheets, or else a whole tag, which is group 2: a
# comment sign within a tag's values is thus no comment.
_IGNORED = (
    r"(?s)<!--(?:-?>|.*?(?:-->|\z))|<(?i:(script|style)\b.*?(?:</\1\s*>|\z))|(<[A-Za-z/]" + _ATTRS + ")"
)
_TAG = r"<(?:[A-Za-z/]" + _ATTRS + "|[^>A-Za-z/][^>]*>)"
# Elements that have no content.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s>]++)"""


@dataclass(frozen=True)
class LinkOptions:
    """What to extract and keep. An empty tuple means no restriction.

    `process_value` maps an absolute URL Column to a URL or null; null drops it.
    Without `with_text` only targets are read: text is empty and nofollow false.
    """

    tags: Sequence[str] | Callable[[str], bool] = ("a", "area")
    attrs: Sequence[str] | Callable[[str], bool] = ("href",)
    allow: Sequence[str] = ()
    deny: Sequence[str] = ()
    allow_domains: Sequence[str] = ()
    deny_domains: Sequence[str] = ()
    deny_extensions: Sequence[str] | None = None
    restrict_xpaths: Sequence[str] = ()
    restrict_css: Sequence[str] = ()
    process_value: Callable[[Column], Column] | None = None
    canonicalize: bool = True
    unique: bool = True
    with_text: bool = True
    schemes: Sequence[str] = field(default=SCHEMES)


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute called `name`, or null."""
    pattern = (
        rf"(?is)^[\s/]*+(?:(?!{name}\s*=)[^\s=>/]++(?:\s*+=\s*+{_VALUE})?+[\s/]*+)*+"
        rf"{name}\s*+=\s*+{_VALUE}"
    )

    def unquote(v: Column) -> Column:
        bare = F.when(v.rlike("""^["']"""), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.when(v != "", urls.decode_entities(bare))

    return urls.let(F.regexp_extract(tag, pattern, 2), unquote)


def visible_markup(html: Column) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(html, _IGNORED, "$2")


def _native_links(markup: Column, o: LinkOptions) -> Column:
    names = "|".join(o.tags)
    opening = rf"(?s)<((?i:{names}))(?=[\s/>]){_ATTRS}"
    inner = rf"(?=(.*?)(?:</?(?i:{names})[\s/>]|\z))"
    tags = F.regexp_extract_all(markup, F.lit(opening), 2)
    if o.with_text:
        elements = F.regexp_extract_all(markup, F.lit(opening), 1)
        texts = F.regexp_extract_all(markup, F.lit(opening + inner), 3)
        zipped = F.arrays_zip(tags.alias("tag"), texts.alias("text"), elements.alias("name"))
    else:
        zipped = F.transform(tags, lambda t: F.struct(t.alias("tag")))

    def link(z: Column, name: str) -> Column:
        raw = _attribute(z["tag"], name).alias("raw")
        if not o.with_text:
            return F.struct(raw, F.lit("").alias("text"), F.lit(None).cast("string").alias("rel"))
        plain = F.when(z["text"].contains("<"), F.regexp_replace(z["text"], _TAG, "")).otherwise(z["text"])
        plain = F.when(F.lower(z["name"]).isin(*_VOID), F.lit("")).otherwise(plain)
        rel = F.when(F.lower(z["tag"]).contains("rel"), _attribute(z["tag"], "rel"))
        return F.struct(raw, urls.decode_entities(plain).alias("text"), rel.alias("rel"))

    per_tag = F.transform(zipped, lambda z: F.array(*[link(z, name) for name in o.attrs]))
    return F.filter(F.flatten(per_tag), lambda x: x["raw"].isNotNull())


def document_base(markup: Column, page_url: Column) -> Column:
    """First <base href>, resolved against the page URL, else the page URL."""
    tag = F.regexp_extract(markup, rf"(?is)<base(?=[\s/>]){_ATTRS}", 1)
    href = urls.let(tag, lambda t: F.when(t != "", _attribute(t, "href")))
    return urls.let(
        href, lambda h: F.when(h.isNull(), page_url).otherwise(urls.resolve_url(h, page_url))
    )


def is_nofollow(rel: Column) -> Column:
    words = F.split(F.lower(rel), r"\s+")
    return F.when(rel.isNull(), F.lit(False)).otherwise(F.array_contains(words, "nofollow"))


def _any(tests) -> Column | None:
    result = None
    for test in tests:
        result = test if result is None else result | test
    return result


def _in_domain(host: Column, domains: Sequence[str]) -> Column:
    return _any((host == d.lower()) | host.endswith("." + d.lower()) for d in domains)


def link_allowed(url: Column, o: LinkOptions) -> Column:
    """Scheme, allow/deny patterns, domains and extensions, as one predicate."""
    denied = DENIED_EXTENSIONS if o.deny_extensions is None else o.deny_extensions
    keep = F.lit(True)
    if o.schemes:
        keep = keep & F.lower(F.substring_index(url, "://", 1)).isin(*o.schemes)
    if o.allow:
        keep = keep & _any(url.rlike(p) for p in o.allow)
    if o.deny:
        keep = keep & ~_any(url.rlike(p) for p in o.deny)
    if o.allow_domains:
        keep = keep & urls.let(urls.host_of(url), lambda h: _in_domain(h, o.allow_domains))
    if o.deny_domains:
        keep = keep & ~urls.let(urls.host_of(url), lambda h: _in_domain(h, o.deny_domains))
    if denied:
        endings = [e.lower().lstrip(".") for e in denied]
        keep = keep & ~urls.extension_of(url).isin(*[e for e in endings if "." not in e])
        for ending in (e for e in endings if "." in e):  # endings of several parts
            keep = keep & ~F.lower(urls.path_end(url)).endswith("." + ending)
    return keep


def filter_domains(rows: DataFrame, domains: DataFrame, allow: bool, url: str = "url") -> DataFrame:
    """Allow or deny by a domain list too long for an expression.

    `domains` has a column `domain`. Only distinct hosts meet the list, through
    their suffixes; the matched hosts then select the rows, salted or broadcast."""
    hosts = rows.select(urls.host_of(F.col(url)).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    listed = domains.select(F.lower("domain").alias("_suffix")).distinct()
    matched = (
        hosts.select("_host", F.explode(suffixes).alias("_suffix"))
        .join(listed, "_suffix", "left_semi")
        .select("_host")
        .distinct()
    )
    keyed = rows.withColumn("_host", urls.host_of(F.col(url)))
    how = "left_semi" if allow else "left_anti"
    return bounded_join(keyed, matched, ["_host"], F.col(url), how).drop("_host")


def _first_by(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Keep the first of equal links in a sorted-array pass: n log n per page, where
    array_distinct on structs would compare all pairs."""
    order = F.array_sort(
        F.transform(column, lambda x: F.struct(*[x[k].alias(k) for k in keys], x["pos"].alias("pos"), x.alias("link")))
    )
    same = lambda x, before: F.struct(*[x[k] for k in keys]).eqNullSafe(F.struct(*[before[k] for k in keys]))
    kept = F.filter(
        "_sorted", lambda x, i: (i == 0) | ~same(x, F.get("_sorted", i - 1))
    )
    back = F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["link"].alias("link"))))
    return (
        df.withColumn("_sorted", order)
        .withColumn(column, F.transform(back, lambda x: x["link"]))
        .drop("_sorted")
    )


def with_links(
    pages: DataFrame, options: LinkOptions = LinkOptions(), url: str = "url", html: str = "html", base: str | None = None
) -> DataFrame:
    """Add `links`: array<struct<pos, url, text, nofollow>> in document order, and the
    document base they were resolved against as a column called `base`, if that is given."""
    o = options
    df = pages.withColumn("_markup", visible_markup(F.col(html)))
    df = df.withColumn("_base_url", document_base(F.col("_markup"), F.col(url)))
    df = df.withColumn("_base", urls.split_url(F.col("_base_url")))
    regions = [*o.restrict_xpaths, *map(dom.css_to_xpath, o.restrict_css)]
    if regions or callable(o.tags) or callable(o.attrs):
        raw = dom.region_links(regions, o.tags, o.attrs)(F.col(html))
    else:
        raw = _native_links(F.col("_markup"), o)

    def resolved(x: Column, i: Column) -> Column:
        absolute = urls.resolve_against(x["raw"], F.col("_base"))
        return F.struct(
            i.alias("pos"), absolute.alias("url"), F.coalesce(x["text"], F.lit("")).alias("text"),
            is_nofollow(x["rel"]).alias("nofollow"),
        )

    df = df.withColumn("links", F.transform(raw, resolved))
    if o.process_value:
        def hooked(x: Column) -> Column:
            value = urls.let(
                o.process_value(x["url"]),
                lambda v: F.when(v.isNotNull(), urls.resolve_url(v, F.col(url))),
            )
            return x.withField("url", value)

        df = df.withColumn("links", F.filter("links", lambda x: ~urls.is_malformed(x["url"])))
        df = df.withColumn("links", F.transform("links", hooked))
    keep = lambda x: x["url"].isNotNull() & ~urls.is_malformed(x["url"]) & link_allowed(x["url"], o)
    df = df.withColumn("links", F.filter("links", keep))
    if o.canonicalize:
        canonical = lambda x: x.withField("url", urls.canonicalize_url(x["url"]))
        df = df.withColumn("links", F.transform("links", canonical))
    if o.unique:
        df = _first_by(df, "links", ["url", "text", "nofollow"])
    df = df.drop("_markup", "_base")
    return df.withColumnRenamed("_base_url", base) if base else df.drop("_base_url")


def unique_urls(df: DataFrame, column: str = "links") -> DataFrame:
    """Keep the first link to each URL of a page, whatever its text."""
    return _first_by(df, column, ["url"])


def explode_links(df: DataFrame, *keep: str) -> DataFrame:
    # explode() would make the optimizer repeat the whole link expression as an
    # inferred "array is not empty" filter; explode_outer plus a null test does not.
    rows = df.select(*keep, F.explode_outer("links").alias("l"))
    return rows.where(F.col("l").isNotNull()).select(*keep, "l.*")


def extract_links(
    pages: DataFrame, options: LinkOptions = LinkOptions(), urls_only: bool = False
) -> DataFrame:
    """(page_id, pos, url, text, nofollow) rows."""
    df = with_links(pages, options)
    if urls_only:
        df = unique_urls(df)
    return explode_links(df, "page_id")
