"""Mixing sources to target weights by hash thresholds.

Every row has a place in [0, 2^30) from a digest of its id and text, so a threshold
on the place takes a fixed share of a source, and a larger budget takes a superset
of a smaller one. Thresholds come from histograms: words are summed by source and
the upper bits of the place, the boundary bucket is found by a running sum, and only
rows of that bucket are summed again, by the next bits.

Defined results: null texts have size 0 and cost nothing; a null source is a source of its own,
after all others; rows that repeat both id and text share a place, and are taken or
left together; an empty table gives no rows. Weights are dealt over the sources
present, so there is one row for each source; a source is an entry of a mix, of which
the window over sources holds the totals only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import n_words
from pagemill.runtime import bounded_join, materialize

LEVELS = 3
LEVEL_BITS = 10
PLACES = 1 << (LEVELS * LEVEL_BITS)
MOST_COPIES = 3


def place(id_column: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.coalesce(id_column.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4)).cast("long")


def source_key(source: Column) -> Column:
    """Keys that sort like sources by code point, null last: "=name", and "~"."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, source, size, place), written once: nothing later reads a text."""
    id_column, text = F.col(id_col), F.col(text_col).cast("string")
    return materialize(
        docs.select(
            id_column.cast("long").alias("id"), source_key(F.col(source_col)).alias("source"),
            n_words(text).alias("size"), place(id_column, text).alias("place"),
        ),
        "sized",
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_copies: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size, target): targets share all words by weight, and none is above
    `most_copies` times its source, what is over being shared again by weight.

    Sources in order of size over weight meet their limit first, so the common share
    of the others follows from running sums, without iteration.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("source")
    number = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    limit = (most_copies * F.col("source_size")).cast("double")
    every = Window.partitionBy()
    full_first = Window.orderBy(F.col("limit") / F.col("weight"), "source")
    shared = totals.select("source", "source_size", weight.alias("weight"), limit.alias("limit"))
    shared = shared.withColumn("before", F.sum("limit").over(full_first) - F.col("limit"))
    shared = shared.withColumn("weight_left", F.sum("weight").over(every) - (F.sum("weight").over(full_first) - F.col("weight")))
    share = (F.sum("source_size").over(every) - F.col("before")) / F.col("weight_left")
    # The share is right where the first source that stays below its limit stands.
    shared = shared.withColumn("share", F.when(share * F.col("weight") <= F.col("limit"), share))
    shared = shared.withColumn("share", F.first("share", ignorenulls=True).over(
        full_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit")))
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (source, budget, cut): taking the rows of `source` with place < cut comes
    nearest to `words` of (source, budget, words) in `wanted`.

    Each level sums the rows of boundary buckets only, in at most 2^LEVEL_BITS buckets
    for each source and budget; after the last, whole places are taken or left.
    """
    cuts = wanted.select("source", "budget", F.col("words").cast("double").alias("missing"), F.lit(0).cast("long").alias("bucket"))
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - level - 1))
        inside = rows.withColumn("bucket", F.floor(F.col("place") / (width << LEVEL_BITS)))
        inside = inside.withColumn("fine", F.floor(F.col("place") / width))
        if level:
            inside = inside.join(cuts.select("source", "bucket").distinct(), ["source", "bucket"], "left_semi")
        counted = inside.groupBy("source", "bucket", "fine").agg(F.sum("size").alias("here"))
        here = cuts.drop("here").join(counted, ["source", "bucket"])
        upto = Window.partitionBy("source", "budget").orderBy("fine")
        here = here.withColumn("upto", F.sum("here").over(upto)).withColumn("before", F.col("upto") - F.col("here"))
        # The boundary bucket: the first that reaches what is missing, else the last.
        last = F.row_number().over(Window.partitionBy("source", "budget").orderBy(F.col("fine").desc())) == 1
        here = here.withColumn("last", last)
        here = here.where((F.col("before") < F.col("missing")) & ((F.col("upto") >= F.col("missing")) | F.col("last")))
        cuts = materialize(
            here.select("source", "budget", (F.col("missing") - F.col("before")).alias("missing"), F.col("fine").alias("bucket"), "here"), "cuts"
        )
    whole = F.col("here") - F.col("missing") <= F.col("missing")
    return cuts.select("source", "budget", F.when(whole, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("cut"))


def plan(rows: DataFrame, budgets: tuple[float, ...], weights: tuple[float, ...]) -> DataFrame:
    """Rows (source, source_size, target, plan): for each budget, how often the whole
    source is taken, and below which place once more."""
    goals = materialize(targets(rows, weights), "targets")
    parts = F.array(*[F.struct(F.lit(i).alias("budget"), F.lit(float(b)).alias("part")) for i, b in enumerate(budgets)])
    parted = goals.withColumn("p", F.explode(parts)).withColumn("goal", F.col("target") * F.col("p.part"))
    full = F.coalesce(F.floor(F.col("goal") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    parted = parted.select("source", "source_size", "target", "p.budget", "goal", full.alias("full"))
    parted = parted.withColumn("words", F.col("goal") - F.col("full") * F.col("source_size"))
    cuts = thresholds(rows, parted.where("words > 0").select("source", "budget", "words"))
    step = F.struct("budget", "full", F.coalesce("cut", F.lit(0)).alias("cut"))
    planned = parted.join(cuts, ["source", "budget"], "left").groupBy("source", "source_size", "target")
    return materialize(planned.agg(F.sort_array(F.collect_list(step)).alias("plan")), "mix-plan")


def _copies() -> Column:
    return F.transform("plan", lambda p: (p["full"] + (F.col("place") < p["cut"]).cast("long")).cast("long"))


def mix(
    docs: DataFrame, budgets: tuple[float, ...] = (1.0,), weights: tuple[float, ...] = (1, 2, 3),
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows (id, source, size, source_size, target, copies), source as a key (see source_key): copies
    is an array with, for each budget (a share of the targets), how often the document is taken.

    A source that a target exceeds is taken whole as often as it fits, and the rest
    by threshold, so no document is taken more than MOST_COPIES times.
    """
    rows = sized(docs, id_col, text_col, source_col)
    joined = bounded_join(rows, plan(rows, budgets, weights), ["source"], F.col("place"))
    return joined.select("id", "source", "size", "source_size", "target", _copies().alias("copies"))


def apply_mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its columns.
    Texts do not move, unless there are more sources than can be broadcast."""
    made = plan(sized(docs, id_col, text_col, source_col), (1.0,), weights).select(F.col("source").alias("_mix_key"), "plan")
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key(F.col(source_col)).alias("_mix_key"),
        place(F.col(id_col), F.col(text_col).cast("string")).alias("place"),
    )
    joined = bounded_join(placed, made, ["_mix_key"], F.col("place")).withColumn("_n", _copies()[0])
    return joined.where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
