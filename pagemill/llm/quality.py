"""Quality rules for documents and their hosts, in built-in functions only.

Each document is judged by its own words; failures are then added up by host, failure rates are
shrunk towards a beta prior fitted to all hosts, and a host whose shrunk rate is above
`reject_rate` takes its documents with it.

Defined results: a null or blank text has no words and fails; a document without a host is judged
by its own rules only; repeated rows count and come back as often as they stand; very long texts
are judged whole, and their windows compared by 64-bit hashes within the text; other columns
pass through or are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD
from pagemill.runtime import materialize

SPACES = r"[\x20\x09-\x0D]+"
# The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

# Words covered by windows of three words that occur twice or more: windows are named by
# a 64-bit hash, sorted with their positions, and kept where a neighbour has the same name;
# each kept position then adds the words that the one before it does not cover.
# Arrays are bound to lambda variables, so that each is made once for a text.
REPEATED = """
CASE WHEN size(words) < 4 THEN 0L ELSE
  aggregate(
    sort_array(flatten(transform(
      array(sort_array(flatten(transform(array(words), w -> transform(sequence(1, size(w) - 2),
        i -> struct(xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2)) AS g, i AS i)))))),
      s -> transform(
        filter(s, (x, k) -> (k > 0 AND x.g = get(s, k - 1).g) OR (k < size(s) - 1 AND x.g = get(s, k + 1).g)),
        x -> x.i)))),
    struct(0L AS n, -3 AS last),
    (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last),
    a -> a.n)
END
"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
    long = lambda c: c.cast("long")
    return rows.select(
        "id", "host", long(F.size("words")).alias("n_words"),
        long(F.length(F.regexp_replace("text", SPACES, ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
    )


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    few = F.col("n_words") < least_words
    return few | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def host_verdicts(judged: DataFrame, reject_rate: float = 0.5) -> DataFrame:
    """Rows (host, host_rejected) from rows (host, base_failed).

    The prior is beta(m s, (1 - m) s): m is the share of failures, and the strength s
    follows from the variance of host rates beyond what chance gives hosts of their sizes.
    """
    hosts = judged.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    hosts = materialize(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("n") * rate * rate).alias("squares")
    ).first()
    if not sums["k"]:
        return hosts.select("host", F.lit(False).alias("host_rejected"))
    mean = sums["failed"] / sums["n"]
    chance = mean * (1 - mean)
    excess = sums["squares"] / sums["n"] - mean * mean - chance * sums["k"] / sums["n"]
    strength = min(max(chance / excess - 1, 1.0), 1e6) if excess > 0 else 1e6
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", (shrunk > reject_rate).alias("host_rejected"))


def judge(docs: DataFrame, reject_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (id, host, measures, base_failed, host_rejected, kept). Texts are read once;
    only numbers are written, added up and joined. A hot host adds up within tasks, and its
    join partitions are split at run time."""
    judged = materialize(measures(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "measures")
    joined = judged.join(host_verdicts(judged, reject_rate), "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` whose verdict is to keep; rows that share an id share the strictest verdict,
    and rows without an id stay."""
    bad = judge(docs, id_col=id_col, **options).where("NOT kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
