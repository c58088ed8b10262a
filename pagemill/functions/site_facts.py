"""What many sites ask of one page, answered by parsing the page once."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T

from pagemill.functions.dom import FACTS_ARROW, FACTS_TYPE, Page, by_rows, failed, once

ANSWERS_TYPE = T.ArrayType(
    T.StructType([T.StructField("site", T.IntegerType()), T.StructField("facts", FACTS_TYPE)])
)
_ANSWERS_ARROW = pa.list_(pa.struct([("site", pa.int32()), ("facts", FACTS_ARROW)]))
# What a site asks: conditions, paths of the next page, and fields.
Questions = tuple[Sequence[str], Sequence[str], Sequence[dict]]


def _origin(url: str) -> str:
    return re.match(r"(?:[^/]*/){0,3}", url)[0]


def matching_sites(scopes: Sequence[str]):
    """UDF canonical page URL -> positions of the scopes that it starts with. Lookups
    are by equality, for the lengths that scopes of the same origin have."""
    by_scope: dict[str, list[int]] = {}
    for i, scope in enumerate(scopes):
        by_scope.setdefault(scope, []).append(i)
    lengths: dict[str, list[int]] = {}
    for scope in by_scope:
        lengths.setdefault(_origin(scope), []).append(len(scope))
    lengths = {origin: sorted(set(found)) for origin, found in lengths.items()}

    @once(T.ArrayType(T.IntegerType()))
    def match(page_key: pa.Array) -> pa.Array:
        def one(key):
            return [i for n in lengths.get(_origin(key), ()) if n <= len(key) for i in by_scope.get(key[:n], ())]

        return pa.array([one(key or "") for key in page_key.to_pylist()], pa.list_(pa.int32()))

    return match


def _answers(html: str | None, asked: list[tuple[int, Questions]]) -> list[dict]:
    try:
        page = Page(html)
    except Exception as e:  # one bad page is reported and the others go on
        return [{"site": i, "facts": failed(e)} for i, _ in asked]

    def one(questions: Questions) -> dict:
        try:
            return page.facts(*questions)
        except Exception as e:
            return failed(e)

    return [{"site": i, "facts": one(questions)} for i, questions in asked]


def facts_by_number(questions: Sequence[Questions]) -> Callable:
    """UDF (html, numbers) -> answers to the questions of those numbers."""

    @once(ANSWERS_TYPE)
    def answer(html: pa.Array, numbers: pa.Array) -> pa.Array:
        return by_rows(lambda text, asked: _answers(text, [(i, questions[i]) for i in asked or ()]), [html, numbers], _ANSWERS_ARROW)

    return answer


@once(ANSWERS_TYPE)
def facts_by_config(html: pa.Array, configs: pa.Array) -> pa.Array:
    """UDF (html, array<struct<conditions, next_xpaths, fields>>) -> answers, in order."""

    def asked(found):
        return [(i, (c["conditions"], c["next_xpaths"], c["fields"])) for i, c in enumerate(found or ())]

    return by_rows(lambda text, found: _answers(text, asked(found)), [html, configs], _ANSWERS_ARROW)


# Ship this module inside the UDFs, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
