"""URL expressions built only from native Spark functions.

Every function maps Columns to a Column, so it works in batch, in streams and
inside `transform` over an array of links.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (RFC 3986, appendix B). Delimiters stay with their part, so an
# empty query "?" is told apart from no query, and the parts concatenate back.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)"
_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*(\?[^#]*)"
_FRAGMENT = r"(?s)^[^#]*(#.*)"

# Most links of a page: a plain web URL that is canonical as it stands.
_PLAIN = r"^https?://[a-z0-9.\-]+/[^?#%]*$"

# The named character references of HTML 5, from the standard library.
_NAMED = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_url(url: Column) -> Column:
    return F.struct(
        F.regexp_extract(url, _SCHEME, 1).alias("scheme"),
        F.regexp_extract(url, _AUTHORITY, 1).alias("authority"),
        F.regexp_extract(url, _PATH, 1).alias("path"),
        F.regexp_extract(url, _QUERY, 1).alias("query"),
        F.regexp_extract(url, _FRAGMENT, 1).alias("fragment"),
    )


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 for a path that starts with a slash."""

    def fold(kept: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", kept)
            .when(seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(seg)))
        )

    folded = F.array_join(
        F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), fold), "/"
    )
    ends_in_dots = path.rlike(r"/\.\.?$")
    rebuilt = F.when(ends_in_dots, F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"/\.\.?(/|$)"), rebuilt).otherwise(path)


def resolve_parts(ref: Column, base: Column) -> Column:
    """Join a split reference to a split base and return the URL string."""
    absolute = ref["scheme"] != ""
    network = ref["authority"] != ""
    same_path = ref["path"] == ""
    folder = F.regexp_extract(base["path"], r"(?s)^(.*/)", 1)
    merged = (
        F.when(ref["path"].startswith("/"), ref["path"])
        .when((base["authority"] != "") & (base["path"] == ""), F.concat(F.lit("/"), ref["path"]))
        .otherwise(F.concat(folder, ref["path"]))
    )
    path = (
        F.when(absolute | network, ref["path"])
        .when(same_path, base["path"])
        .otherwise(merged)
    )
    inherit = ~absolute & ~network & same_path & (ref["query"] == "")
    return F.concat(
        F.when(absolute, ref["scheme"]).otherwise(base["scheme"]),
        F.when(absolute | network, ref["authority"]).otherwise(base["authority"]),
        let(path, lambda p: F.when(p.startswith("/"), remove_dot_segments(p)).otherwise(p)),
        F.when(inherit, base["query"]).otherwise(ref["query"]),
        ref["fragment"],
    )


def clean_reference(raw: Column) -> Column:
    """Drop tabs and line breaks, trim, escape inner spaces."""
    return F.replace(F.trim(F.translate(raw, "\t\r\n\f", "")), F.lit(" "), F.lit("%20"))


def resolve_against(raw: Column, base: Column) -> Column:
    """Resolve a raw reference against a split base. References that are a whole
    web URL or a path from the root, without dot segments, need no splitting."""

    def resolve(ref: Column) -> Column:
        plain = ~ref.contains("/.")
        rooted = ref.startswith("/") & ~ref.startswith("//")
        whole = ref.startswith("http://") | ref.startswith("https://")
        return (
            F.when(plain & rooted, F.concat(base["scheme"], base["authority"], ref))
            .when(plain & whole, ref)
            .otherwise(let(split_url(ref), lambda r: resolve_parts(r, base)))
        )

    return let(clean_reference(raw), resolve)


def resolve_url(ref: Column, base: Column) -> Column:
    """RFC 3986 reference resolution of `ref` against `base`."""
    return let(split_url(base), lambda b: resolve_against(ref, b))


def _upper_escapes(text: Column) -> Column:
    pieces = F.split(text, "%", -1)
    fixed = F.transform(
        pieces,
        lambda x, i: F.when(
            (i > 0) & x.rlike("^[0-9A-Fa-f]{2}"),
            F.concat(F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3))),
        ).otherwise(x),
    )
    return F.when(text.contains("%"), F.array_join(fixed, "%")).otherwise(text)


def _sorted_query(query: Column) -> Column:
    """Sort by the pair (key, value): sorting "k=v" strings would misplace "a1="."""

    def pair(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        return F.struct(key.alias("k"), F.substr(p, F.length(key) + 2).alias("v"))

    items = F.filter(F.split(F.substr(query, F.lit(2)), "&", -1), lambda p: p != "")
    ordered = F.array_sort(F.transform(items, pair))
    joined = F.array_join(F.transform(ordered, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(query == "", query).otherwise(
        let(joined, lambda j: F.when(j == "", j).otherwise(F.concat(F.lit("?"), j)))
    )


def canonicalize_url(url: Column, keep_fragment: bool = False) -> Column:
    """Lower scheme and host, drop default port and fragment, sort the query by
    (key, value) keeping blanks, give an empty path a slash, upper-case escapes."""

    def build(u: Column) -> Column:
        scheme = F.lower(u["scheme"])
        user = F.regexp_extract(u["authority"], r"^//(.*@)", 1)
        host = F.lower(F.substr(u["authority"], F.length(user) + 3))
        # A colon inside an unclosed bracket, or after another colon, begins no port.
        before = r"^(\[[^\[\]]*\]|[^\[\]:]*)"
        port = F.when(scheme == "http:", F.lit(before + ":(80)?$")).when(
            scheme == "https:", F.lit(before + ":(443)?$")
        ).otherwise(F.lit(before + ":$"))
        authority = F.when(u["authority"] == "", F.lit("")).otherwise(
            F.concat(F.lit("//"), user, F.regexp_replace(host, port, F.lit("$1")))
        )
        path = F.when((u["path"] == "") & (u["authority"] != ""), F.lit("/")).otherwise(
            _upper_escapes(u["path"])
        )
        parts = [scheme, authority, path, let(_upper_escapes(u["query"]), _sorted_query)]
        return F.concat(*parts, u["fragment"]) if keep_fragment else F.concat(*parts)

    return let(url, lambda u: F.when(u.rlike(_PLAIN), u).otherwise(let(split_url(u), build)))


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty string when there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_extract(authority, r"^//(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def is_malformed(url: Column) -> Column:
    """Unbalanced or misplaced brackets in the authority, or a port that is no number."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    well_formed = r"^(//(.*@)?(\[[0-9A-Fa-f:.]+\]|[^\[\]:]*)(:[0-9]*)?)?$"
    return ~url.rlike(_PLAIN) & ~authority.rlike(well_formed)


def extension_of(url: Column) -> Column:
    """Lower-case letters after the last dot of the path, or an empty string."""
    pattern = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*+:)?+(?://[^/?#]*+)?+[^?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$"
    return F.lower(F.regexp_extract(url, pattern, 1))


def path_end(url: Column) -> Column:
    """The URL without query and fragment."""
    return F.regexp_extract(url, r"(?s)^([^?#]*)", 1)


def decode_entities(text: Column) -> Column:
    """Decode numeric and HTML 5 named references that end in a semicolon."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def from_code(code: Column) -> Column:
        ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(
            F.lit("\ufffd")
        )

    def char_of(name: Column) -> Column:
        return (
            F.when(name == "amp", F.lit("&"))
            .when(name.rlike("^#[xX]"), let(F.conv(F.substr(name, F.lit(3)), 16, 10).cast("bigint"), from_code))
            .when(name.startswith("#"), let(F.substr(name, F.lit(2)).cast("bigint"), from_code))
            .when(name != "", F.try_element_at(named, name))
        )

    def one(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#0*+[0-9]{1,7}|#[xX]0*+[0-9A-Fa-f]{1,6}|#0++|#[xX]0++|[A-Za-z][A-Za-z0-9]*);", 1)
        decoded = let(
            name,
            lambda n: F.coalesce(
                F.concat(char_of(n), F.substr(piece, F.length(n) + 2)), F.concat(F.lit("&"), piece)
            ),
        )
        return F.when(i == 0, piece).otherwise(decoded)

    return F.when(
        text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), one), "")
    ).otherwise(text)
