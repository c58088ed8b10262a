"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import materialize

# A word is a run of characters other than the space and the five ASCII line
# and tab characters; bytes.split() cuts UTF-8 text at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096
ROWS = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts, some rows at a time: what a worker makes of them does not
    grow with the batch, and neither do the batches that it sends back."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def block_keys(fingerprint: Column, max_bits: int, agree: int) -> Column:
    """Array of join keys: two 64-bit fingerprints that differ in at most
    `max_bits` bits share at least one. The bits are cut into max_bits + agree
    blocks, of which at least `agree` are then equal, and each choice of `agree`
    blocks makes a key."""
    n = max_bits + agree
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    masks = [sum(1 << bit for bit in range(cuts[i], cuts[i + 1])) for i in range(n)]
    keys = []
    for number, chosen in enumerate(combinations(masks, agree)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(number), fingerprint.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def spread_groups(rows: DataFrame, key: str, spread: Column, chunk: int = CHUNK) -> DataFrame:
    """`rows` with the columns cell (long) and part (int) added, such that any two rows of one key meet
    in a cell, and no cell holds many more than 2 * chunk rows. A key of n rows is cut into ceil(n / chunk)
    parts by `spread`, and each pair of parts makes a cell, as does each part with itself."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    sizes = materialize(sizes.select(key, F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks")), "large-groups")
    cut = rows.join(sizes, key, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(F.lit("chunk"), spread), F.col("_chunks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cell = F.when(F.col("_chunks") == 1, F.col(key)).otherwise(
        F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))
    )
    return cut.withColumn("cell", cell).withColumnRenamed("_own", "part").drop("_chunks", "_other")


def cells(batches: Iterator[pa.RecordBatch], key: str = "cell") -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups from batches sorted by `key`: a table, with starts and ends of
    its groups of two or more rows."""
    kept: list[pa.RecordBatch] = []

    def cut(table: pa.Table, whole: int):
        keys = table.column(key).to_numpy()[:whole]
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, whole]
        many = ends - starts > 1
        return table, starts[many], ends[many]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and kept and kept[-1].column(kept[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
            kept.append(batch)
            continue
        done = pa.Table.from_batches([*kept, batch.slice(0, last)], schema=batch.schema)
        if done.num_rows:
            yield cut(done, done.num_rows)
        kept = [batch.slice(last)]
    if kept:
        table = pa.Table.from_batches(kept)
        yield cut(table, table.num_rows)


def bit_links(prints: np.ndarray, max_bits: int, pivots: np.ndarray, accept=None) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one cell exactly as all its pairs within
    `max_bits` bits (that `accept(i, candidates)` also confirms) would.

    Each fingerprint has a row in a table of its distances to the pivots. By the
    triangle inequality a pair is out when any coordinate differs by more than
    max_bits; the first coordinate is a sorted index, the maximum over the others
    discards, and what survives is verified. Rows already reached are not compared
    again, so a dense group costs one link for each member.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)
    first = table[:, 0]
    left = np.argsort(first, kind="stable")
    links = []
    while left.size:
        reached, left = [int(left[0])], left[1:]
        while reached and left.size:
            at = reached.pop()
            low, high = np.searchsorted(first[left], [first[at] - max_bits, first[at] + max_bits + 1])
            near = np.arange(low, high)
            near = near[np.abs(table[left[near]] - table[at]).max(axis=1, initial=0) <= max_bits]
            near = near[np.bitwise_count(prints[left[near]] ^ prints[at]) <= max_bits]
            if accept is not None and near.size:
                near = near[accept(at, left[near])]
            if near.size:
                found = left[near].tolist()
                links += [(at, other) for other in found]
                reached += found
                left = np.delete(left, near)
    return links


def near_pairs(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Which fingerprints of a cell have any other within max_bits bits."""
    found = np.zeros(prints.size, bool)
    for at in range(0, prints.size, 256):
        block = prints[at : at + 256]
        near = np.bitwise_count(block[:, None] ^ prints[None, :]) <= max_bits
        found[at : at + 256] = near.sum(axis=1) > 1
    return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node that is
    no root, with the smallest node of its component.

    Large-star and small-star rounds, each written to the shared folder, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain. Hubs
    are grouped by partial aggregates and joined, so no neighbourhood is collected.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if seen == before or not seen["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
        # In (a, b) with a > b: the smallest neighbour of b is below or equal b itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(hung.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
