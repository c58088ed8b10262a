"""Tolerant HTML parsing and a small XPath subset, run as one Arrow UDF.

Spark's own xpath functions need well-formed XML and constant paths, and stored
pages have neither. Supported paths: `/a/b`, `//a`, `*`, `.`, `..`, `[n]`,
`[last()]`, `[@k]`, `[@k='v']`, `[contains(@k,'v')]`, `[@k~='v']` (v is one of
the words of k, for CSS classes), a last step `text()` or
`@k`, and unions with `|`. An element yields its string content.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PREDICATE = (
    r"\[\s*(?:\d+|last\(\)|@[\w:-]+(?:\s*~?=\s*(?:'[^']*'|\"[^\"]*\"))?"
    r"|contains\(\s*@[\w:-]+\s*,\s*(?:'[^']*'|\"[^\"]*\")\s*\))\s*\]"
)
# Names have no colon: axes and prefixes are not supported, and must not look so.
_STEP = rf"//?(?:[A-Za-z][\w-]*|\*|\.\.?)(?:{_PREDICATE})*"
_PATH = rf"(?:{_STEP})+(?://?(?:text\(\)|@[\w:-]+))?"
# A whole supported expression; valid in Java and Python, so a site catalog is
# checked with rlike before any page is read.
XPATH_PATTERN = rf"^\s*{_PATH}(?:\s*\|\s*{_PATH})*\s*$"

# HTML void elements, and elements whose end tag may be left out
# together with the containers that bound the implied end.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_IMPLIED_END = frozenset("p li td tr th dt dd option".split())
_BOUNDARY = frozenset("ul ol dl table div article section body select".split())

_step_re = re.compile(rf"(//?)(text\(\)|@[\w:-]+|[A-Za-z][\w-]*|\*|\.\.?)((?:{_PREDICATE})*)")
_path_re = re.compile(r"""(?:[^|'"]|'[^']*'|"[^"]*")+""")
_predicate_re = re.compile(
    r"\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|(?P<contains>contains\(\s*)?@(?P<k>[\w:-]+)"
    r"(?:\s*(?P<op>~?=|,)\s*(?:'(?P<v>[^']*)'|\"(?P<w>[^\"]*)\"))?\s*\)?)\s*\]"
)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _IMPLIED_END:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == tag:
                    del self.open[depth:]
                    break
                if self.open[depth].tag in _BOUNDARY:
                    break
        first_wins = {k: v or "" for k, v in reversed(attrs)}
        node = ET.SubElement(self.open[-1], tag, first_wins)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def parse_html_declaration(self, i):
        """Comments apart, `<!...>` is skipped up to its first `>`, as browsers do."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        parent = self.open[-1]
        if len(parent):
            parent[-1].tail = (parent[-1].tail or "") + data
        else:
            parent.text = (parent.text or "") + data


def parse(html: str) -> ET.Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _keep(nodes, predicates):
    for m in _predicate_re.finditer(predicates):
        value = m["v"] if m["v"] is not None else m["w"]
        if m["n"]:
            nodes = nodes[int(m["n"]) - 1 : int(m["n"])] if int(m["n"]) else []
        elif m["last"]:
            nodes = nodes[-1:]
        elif m["contains"]:
            nodes = [x for x in nodes if value in x.get(m["k"], "")]
        elif m["op"] == "~=":
            nodes = [x for x in nodes if value in x.get(m["k"], "").split()]
        elif value is None:
            nodes = [x for x in nodes if m["k"] in x.attrib]
        else:
            nodes = [x for x in nodes if x.get(m["k"]) == value]
    return nodes


def _text_parts(node):
    parts = [(node, "text"), *((c, "tail") for c in node)]
    return [part for part in parts if _string(*part)]


def _string(node, part):
    return node.attrib[part[1:]] if part.startswith("@") else getattr(node, part)


_cut: dict[str, list] = {}  # paths and steps of the expressions seen, which catalogs repeat


def _cached(kind: str, text: str, cut):
    key = kind + text
    if key not in _cut:
        if len(_cut) >= 10_000:
            _cut.clear()
        _cut[key] = cut(text)
    return _cut[key]


def _steps(path: str) -> list[tuple[str, str, str]]:
    return _cached("s", path, _step_re.findall)


def _paths(xpath: str) -> list[str]:
    return _cached("p", xpath, _path_re.findall)


class Document:
    """One parsed page; `select` returns elements or strings in document order."""

    def __init__(self, html: str):
        self.root = parse(html)
        self._rank = self._parent = self._place = None

    def _ordered(self, nodes):
        if self._rank is None:
            self._rank = {node: i for i, node in enumerate(self.root.iter())}
        return sorted(set(nodes), key=self._rank.__getitem__)

    def _below(self, nodes):
        """The nodes and all below them; a subtree within another is visited once."""
        seen = set()
        for node in self._ordered(nodes):
            if node not in seen:
                seen.update(node.iter())
        return self._ordered(seen)

    def _in_order(self, hits):
        """Elements and (element, part) strings by their place in the page, each once."""
        if self._place is None:
            self._place, open_nodes = {}, [(self.root, False)]
            while open_nodes:
                node, is_left = open_nodes.pop()
                if is_left:
                    self._place[node, "tail"] = len(self._place)
                    continue
                for key in (node, *[(node, "@" + name) for name in node.attrib], (node, "text")):
                    self._place[key] = len(self._place)
                for child in reversed(node):
                    open_nodes += [(child, True), (child, False)]
        return sorted(set(hits), key=self._place.__getitem__)

    def _up(self, node):
        if self._parent is None:
            self._parent = {child: node for node in self.root.iter() for child in node}
        return self._parent.get(node)

    def _one_path(self, path: str):
        nodes = [self.root]
        for axis, test, predicates in _steps(path):
            if axis == "//":
                nodes = list(self.root.iter()) if nodes == [self.root] else self._below(nodes)
            if test == "text()":
                return [part for node in nodes for part in _text_parts(node)]
            if test.startswith("@"):
                return [(node, test) for node in nodes if test[1:] in node.attrib]
            if test == "..":
                nodes = self._ordered(p for p in map(self._up, nodes) if p is not None)
            elif test != ".":
                found = []
                for node in nodes:
                    children = [c for c in node if test in ("*", c.tag)]
                    found += _keep(children, predicates) if predicates else children
                nodes = self._ordered(found) if axis == "//" or len(nodes) > 1 else found
        return nodes

    def select(self, xpath: str):
        paths = _paths(xpath)
        hits = [hit for path in paths for hit in self._one_path(path)]
        if len(hits) > 1 and (len(paths) > 1 or isinstance(hits[0], tuple)):
            hits = self._in_order(hits)
        return [_string(*hit) if isinstance(hit, tuple) else hit for hit in hits]

    def strings(self, xpath: str):
        return [x if isinstance(x, str) else "".join(x.itertext()) for x in self.select(xpath)]


_VALUES_TYPE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]
)
FACTS_TYPE = T.StructType(
    [
        T.StructField("is_content", T.BooleanType()),
        T.StructField("next_xpath", T.StringType()),
        T.StructField("next_href", T.StringType()),
        T.StructField("error_body", T.StringType()),
        T.StructField("values", T.ArrayType(_VALUES_TYPE)),
        T.StructField("failure", T.StringType()),
    ]
)
FACTS_ARROW = pa.struct(
    [
        ("is_content", pa.bool_()),
        ("next_xpath", pa.string()),
        ("next_href", pa.string()),
        ("error_body", pa.string()),
        (
            "values",
            pa.list_(pa.struct([("name", pa.string()), ("values", pa.list_(pa.string()))])),
        ),
        ("failure", pa.string()),
    ]
)


class Page:
    """One parsed page, asked by any number of sites."""

    def __init__(self, html: str | None):
        self.doc = Document(html or "")
        has_body = re.search("<pre", html or "", re.I)
        self.error_body = next(iter(self.doc.strings("/html/body/pre")), None) if has_body else None

    def facts(self, conditions, next_xpaths, fields) -> dict:
        doc = self.doc
        found = {"is_content": any(doc.select(c) for c in conditions or ()), "error_body": self.error_body}
        for xpath in next_xpaths or ():
            hits = doc.select(xpath)
            if hits:
                found["next_xpath"] = xpath
                found["next_href"] = hits[0] if isinstance(hits[0], str) else hits[0].get("href")
                break
        if found["is_content"]:
            pairs = [(f["name"], doc.strings(f["xpath"])) for f in fields or ()]
            found["values"] = [{"name": n, "values": v} for n, v in pairs if v]
        return found


def failed(error: Exception) -> dict:
    """Facts of a page that cannot be parsed."""
    return {"is_content": False, "failure": f"{type(error).__name__}: {error}"}


def once(returns):
    """An Arrow UDF that the optimizer must not evaluate again in a pushed-down filter."""
    return lambda f: F.arrow_udf(f, returns).asNondeterministic()


# Rows that are Python objects at a time; a batch may hold ten thousand pages.
_ROWS = 100


def by_rows(one, columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """`one` of each row of `columns`, as an array."""
    blocks = []
    for at in range(0, len(columns[0]), _ROWS):
        rows = zip(*[c.slice(at, _ROWS).to_pylist() for c in columns], strict=True)
        blocks.append(pa.array([one(*row) for row in rows], kind))
    return pa.concat_arrays(blocks) if blocks else pa.array([], kind)


@once(FACTS_TYPE)
def page_facts(
    html: pa.Array, conditions: pa.Array, next_xpaths: pa.Array, fields: pa.Array
) -> pa.Array:
    """Parse each page once and answer everything a site asks of it."""

    def one(text, *questions):
        try:
            return Page(text).facts(*questions)
        except Exception as e:  # one bad page is reported and the others go on
            return failed(e)

    return by_rows(one, [html, conditions, next_xpaths, fields], FACTS_ARROW)


@once(T.StringType())
def _pre_text(html: pa.Array) -> pa.Array:
    def one(text):
        try:
            return None if text is None else next(iter(Document(text).strings("/html/body/pre")), None)
        except Exception:  # page_facts reports such a page; here it has no error body
            return None

    return by_rows(one, [html], pa.string())


def error_body(html: Column) -> Column:
    """Text of the first /html/body/pre; pages without a pre tag skip the parser."""
    return _pre_text(F.when(html.rlike(r"(?i)<pre[\s>]"), html))


LINKS_TYPE = T.ArrayType(
    T.StructType([T.StructField(name, T.StringType()) for name in ("raw", "text", "rel")])
)
_LINKS_ARROW = pa.list_(
    pa.struct([("raw", pa.string()), ("text", pa.string()), ("rel", pa.string())])
)


def region_links(regions: list[str], tags, attrs):
    """UDF html -> raw links inside the nodes selected by each region path, regions
    in order; no region means the whole page. `tags` and `attrs` are lists of names or a predicate on one name."""
    tag_ok = tags if callable(tags) else frozenset(tags).__contains__
    attr_ok = attrs if callable(attrs) else frozenset(attrs).__contains__

    def one(html):
        doc = Document(html or "")
        return [
            {"raw": value, "text": "".join(el.itertext()), "rel": el.get("rel")}
            for top in ([x for region in regions for x in doc.select(region)] if regions else [doc.root])
            for el in top.iter()
            if tag_ok(el.tag)
            for name, value in el.attrib.items()
            if attr_ok(name)
        ]

    @once(LINKS_TYPE)
    def extract(html: pa.Array) -> pa.Array:
        def guarded(text):
            try:
                return one(text)
            except Exception:  # page_facts reports such a page; here it has no links
                return []

        return by_rows(guarded, [html], _LINKS_ARROW)

    return extract


def css_to_xpath(css: str) -> str:
    """`tag`, `.class`, `#id` and descendant combinators, as a path of this subset."""
    steps = []
    for part in css.split():
        m = re.fullmatch(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)", part)
        if not m or not part:
            raise ValueError(f"unsupported CSS selector: {css!r}")
        tests = [
            f"[@id='{name}']" if mark == "#" else f"[@class~='{name}']"
            for mark, name in re.findall(r"([.#])([\w-]+)", m[2])
        ]
        steps.append(f"//{m[1] or '*'}{''.join(tests)}")
    if not steps:
        raise ValueError("empty CSS selector")
    return "".join(steps)


# Ship this module inside the UDF, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
