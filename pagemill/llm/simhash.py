"""Near duplicates by SimHash, with pivot distance tables.

Defined results: null, empty and blank texts have fingerprint zero, and are linked like
any others; rows with a null id or a repeated id get the component of their
fingerprint; a component without any id has a null component_id. Whole texts are read
in blocks of bounded size. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bit_links, block_keys, cells, components, slices, spread_groups
from pagemill.runtime import BROADCAST_LIMIT_BYTES, materialize, materialize_measured

BLOCK = 1 << 16
SEED = 42


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: the same random 64-bit words in every task."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=7) for i in range(count)], np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """A bit is set if over half of the shingles' hashes have it; signed 64-bit."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, print): one for each row of `docs`, print a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["id", "print"])

    return source.mapInArrow(run, "id long, print long")


def print_links(prints: DataFrame, max_bits: int, agree: int, n_pivots: int) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `print` exactly as all pairs
    within max_bits bits do."""
    keyed = prints.select("print", F.explode(block_keys(F.col("print"), max_bits, agree)).alias("key"))
    dealt = spread_groups(keyed, "key", F.col("print")).select("cell", "print")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots(n_pivots)
        for table, starts, ends in cells(batches):
            all_prints = table.column("print").to_numpy().view(np.uint64)
            two = ends - starts == 2
            one, other = all_prints[starts[two]], all_prints[starts[two] + 1]
            far = np.zeros(one.size, bool)
            for pivot in references:
                gap = np.bitwise_count(one ^ pivot).astype(np.int8) - np.bitwise_count(other ^ pivot).astype(np.int8)
                far |= np.abs(gap) > max_bits
            one, other = one[~far], other[~far]
            near = np.bitwise_count(one ^ other) <= max_bits
            found_a, found_b = [one[near]], [other[near]]
            for start, end in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
                group = np.unique(all_prints[start:end])
                links = np.array(bit_links(group, max_bits, references), int).reshape(-1, 2)
                found_a.append(group[links[:, 0]])
                found_b.append(group[links[:, 1]])
            arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, agree: int = 3, n_pivots: int = 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, print, component): component is the smallest id reachable over links of
    at most `max_bits` differing bits.

    Copies meet in one row for each fingerprint before anything is compared. Candidate
    pairs share `agree` of max_bits + agree blocks of bits, which loses none; the pivot
    table discards most, and the bit distance decides. More `agree` means more, but far
    smaller, groups: three suit any corpus up to about 10^11 fingerprints.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    roots = components(print_links(distinct, max_bits, agree, n_pivots))
    rooted = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "print"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.select("print", "root").join(ids, "root").drop("root"), "print")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` without those whose component has a smaller id. Rows without an id stay,
    as do rows that repeat a kept id."""
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options).where("id > component").select(F.col("id").alias(id_col)).distinct()
    found, size = materialize_measured(found, "near-duplicates")
    found = F.broadcast(found) if size <= BROADCAST_LIMIT_BYTES else found  # then no text moves
    return docs.join(found, id_col, "left_anti").select(docs.columns)
