"""Schemas of the engine's inputs."""

from pyspark.sql import types as T

_S = T.StringType()
_FIELD = T.StructType([T.StructField("name", _S), T.StructField("xpath", _S)])

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", _S), T.StructField("html", _S)]
)

SITES = T.StructType(
    [
        T.StructField("key", _S),
        T.StructField("link", _S),
        T.StructField("condition", T.ArrayType(_S)),
        T.StructField("fields", T.ArrayType(_FIELD)),
        T.StructField("next_page_xpath", _S),
        T.StructField("filter_urls", T.ArrayType(_S)),
        T.StructField("deny", T.BooleanType()),
        T.StructField("depart", _S),
    ]
)

FETCH_RESULTS = T.StructType(
    [
        T.StructField("url", _S),
        T.StructField(
            "history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("headers", T.MapType(_S, _S)),
                        T.StructField("status", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "cookies",
            T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("value", _S)])),
        ),
        T.StructField("html", _S),
    ]
)

# The item fields every page shares; all others are optional.
ITEM_FIELDS = ("depart", "section", "title", "link", "date")
