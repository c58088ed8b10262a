from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import predicates, urls

BASE = "http://a/b/c/d;p?q"
# The worked examples of RFC 3986, section 5.4.
RFC = """
g:h g:h | g http://a/b/c/g | ./g http://a/b/c/g | g/ http://a/b/c/g/ | /g http://a/g | //g http://g
?y http://a/b/c/d;p?y | g?y http://a/b/c/g?y | #s http://a/b/c/d;p?q#s | g#s http://a/b/c/g#s
g?y#s http://a/b/c/g?y#s | ;x http://a/b/c/;x | g;x http://a/b/c/g;x | g;x?y#s http://a/b/c/g;x?y#s
. http://a/b/c/ | ./ http://a/b/c/ | .. http://a/b/ | ../ http://a/b/ | ../g http://a/b/g
../.. http://a/ | ../../ http://a/ | ../../g http://a/g | ../../../g http://a/g | ../../../../g http://a/g
/./g http://a/g | /../g http://a/g | g. http://a/b/c/g. | .g http://a/b/c/.g | g.. http://a/b/c/g..
..g http://a/b/c/..g | ./../g http://a/b/g | ./g/. http://a/b/c/g/ | g/./h http://a/b/c/g/h
g/../h http://a/b/c/h | g;x=1/./y http://a/b/c/g;x=1/y | g;x=1/../y http://a/b/c/y
g?y/./x http://a/b/c/g?y/./x | g?y/../x http://a/b/c/g?y/../x | g#s/./x http://a/b/c/g#s/./x
g#s/../x http://a/b/c/g#s/../x | http:g http:g
"""


def column(spark, values, *expressions):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in df.select(*[e(F.col("v")) for e in expressions]).collect()]


def test_rfc_examples(spark):
    cases = [tuple(c.split()) for line in RFC.strip().splitlines() for c in line.split(" | ")] + [("", "http://a/b/c/d;p?q")]
    got = column(spark, [ref for ref, _ in cases], lambda c: urls.resolve_url(c, F.lit(BASE)))
    assert [(ref, g[0]) for (ref, _), g in zip(cases, got)] == cases


def test_resolution_cleans_references(spark):
    got = column(spark, ["  /a b\n", "\thttp://h/\r", "/a/../b", "http://H/a/./b"], lambda c: urls.resolve_url(c, F.lit("http://h")))
    assert [g[0] for g in got] == ["http://h/a%20b", "http://h/", "http://h/b", "http://H/a/b"]


def test_canonical_cases(spark):
    cases = {
        "HTTP://H.example:80?b=2&a=1&a=#f": "http://h.example/?a=&a=1&b=2",
        "http://u:P@H:443/a%2fb%zz?x": "http://u:P@h:443/a%2Fb%zz?x=",
        "https://h:443/": "https://h/",
        "http://h:/?&&": "http://h/",
        "http://h/?a1=1&a=2&a": "http://h/?a=&a=2&a1=1",
        "http://h/é?ü=1": "http://h/é?ü=1",
        "mailto:x@y": "mailto:x@y",
        "http://h": "http://h/",
        "http://h/A": "http://h/A",
    }
    got = column(spark, cases, urls.canonicalize_url)
    assert dict(zip(cases, (g[0] for g in got))) == cases


part = st.text("aZ%2fé=&;:@/.?#- []", max_size=8)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.builds("{}://{}{}{}".format, st.sampled_from(["http", "HTTPS", "ftp"]), part, part, part), min_size=60, max_size=60))
def test_canonical_form_is_a_fixed_point(spark, values):
    once = lambda c: urls.canonicalize_url(c)
    for a, b in column(spark, values, once, lambda c: once(once(c))):
        assert a == b


def test_hosts_extensions_and_malformed(spark):
    values = ["http://u@H.x:8/p.TXT?q.pdf", "http://[::1]:80/", "http://[bad/", "http://h:8x/", "x.pdf", "http://h.com"]
    got = column(spark, values, urls.host_of, urls.extension_of)
    assert [got[i] for i in (0, 1, 4, 5)] == [("h.x", "txt"), ("[::1]", ""), ("", "pdf"), ("h.com", "")]
    bad = column(spark, values, urls.is_malformed)
    assert [g[0] for g in bad] == [False, False, True, True, False, False]


def test_entities(spark):
    got = column(spark, ["a&amp;lt;b &#233;&#xE9; &eacute; &nope; & &amp &apos;&#x1F600;&#0;", "plain"], urls.decode_entities)
    assert [g[0] for g in got] == ["a&lt;b éé é &nope; & &amp '😀\ufffd", "plain"]


def test_error_bodies_and_paths(spark):
    bodies = ['{"error":502}', '{"error": 404.0}', '{"error":"502"}', '{"error":200}', "[1]", "x", None, '{"error":null}', '{"e":{"error":500}}']
    got = column(spark, bodies, predicates.is_error_body)
    assert [g[0] for g in got] == [True, True] + [False] * 7
    paths = ["http://h/a/../../../../b", "http://h/../../../b", "http://h/../../a/../../b"]
    assert [g[0] for g in column(spark, paths, predicates.has_climbing_path)] == [True, False, False]


def test_scope(spark):
    def keep(prefixes, deny):
        allowed = F.array(*map(F.lit, prefixes)) if prefixes else F.array().cast("array<string>")
        got = column(
            spark, ["http://h/a/x", "http://h/b", "http://o/a"],
            lambda c: predicates.in_scope(c, F.lit("http://h/"), allowed, F.lit(deny)),
        )
        return [g[0] for g in got]

    assert keep([], True) == [True, True, False] and keep([], False) == [False, False, False]
    assert keep(["http://h/a"], True) == [False, True, False]
    assert keep(["http://h/a"], False) == [True, False, False]
