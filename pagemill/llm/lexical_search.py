"""Ranked lexical search over bit-sliced Bloom signatures.

The index deals documents into blocks of similar size. A block is a bit matrix: a
column for each distinct text, and as many rows (slices) as a signature has bits. A
term sets a few bits of its document's column; one that occurs two, four or eight times
also sets bits as a term of that tier. To search, the slices of a term are ANDed, which
tells for all columns at once where it may occur, never missing one. Sums of the
slices, weighted with the most that the tier lets a term add, bound every score above.

A search scores the documents of the highest bounds exactly, which gives each query a
score that its last result has at least. All documents whose bound reaches it, however
many, are then read again and scored exactly; only the others are provably out.

Queries are taken in blocks of bounded size, each against all documents. The driver
holds one block of queries, their terms' document counts and one score for each query.

Defined results: null, empty and termless texts are no documents for the statistics and
never found; a query without terms finds nothing. Rows that repeat an id, or a whole
document, are ranked one by one, and so are queries that repeat an id; documents without
an id are found too, after equal scores with one. Texts are read whole, and no table
but documents without any term gives rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.license_scan import WORD_BYTES
from pagemill.runtime import bounded_join, materialize, scratch_path

BITS, HASHES = 12, 4  # bits for each key of a full signature, and how many a key sets
TIERS = (1, 2, 4, 8)
BLOCK_BYTES = 1 << 19
BLOCK_DOCS = 1 << 14
QUERY_TERMS = 50_000
INDEX = "keys array<string>, n array<long>, top array<long>, bits long, slices binary, n_docs long, n_terms long"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def places(hashes: np.ndarray, tier: int, bits: int) -> np.ndarray:
    """The bits of each key, a row of HASHES."""
    mixed = (hashes ^ np.uint64(tier * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    one, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((one[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Block:
    """Columns of one size class on their way into a bit matrix."""

    def __init__(self, size: int):
        self.bits = BITS * size
        self.most = max(8, min(BLOCK_DOCS, 8 * BLOCK_BYTES // self.bits))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n, self.top, self.rows, self.n_docs, self.n_terms = [], [], [], 0, 0

    def add(self, key: str, counts: Counter, n: int) -> None:
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + n
        if key in self.at:  # a copy needs no column of its own
            return
        self.at[key] = len(self.at)
        times = np.fromiter(counts.values(), np.int64, len(counts))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
        set_bits = np.concatenate([places(hashes[times >= tier], tier, self.bits).ravel() for tier in TIERS])
        self.n.append(n)
        self.top.append(int(times.max()))
        self.rows.append(np.unique(set_bits).astype(np.int32))

    def row(self) -> dict:
        width = (len(self.at) + 7) // 8
        matrix = np.zeros((self.bits, width), np.uint8)
        for column, rows in enumerate(self.rows):
            matrix[rows, column >> 3] |= np.uint8(128 >> (column & 7))
        made = {
            "keys": list(self.at), "n": self.n, "top": self.top, "bits": self.bits, "slices": matrix.tobytes(),
            "n_docs": self.n_docs, "n_terms": self.n_terms,
        }
        self.clear()
        return made


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.md5(text).alias("key"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The signature blocks of all documents, written to the shared folder."""
    kind = pa.schema([
        ("keys", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("top", pa.list_(pa.int64())), ("bits", pa.int64()),
        ("slices", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        for batch in batches:
            for text, key in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = terms(text.as_py())
                if found:
                    counts = Counter(found)
                    keys = sum(sum(times >= tier for times in counts.values()) for tier in TIERS)
                    size = max(64, 1 << (keys - 1).bit_length())
                    block = blocks.setdefault(size, Block(size))
                    block.add(key, counts, len(found))
                    if len(block.at) >= block.most:
                        yield pa.RecordBatch.from_pylist([block.row()], kind)
        for block in blocks.values():
            if block.n_docs:
                yield pa.RecordBatch.from_pylist([block.row()], kind)

    return materialize(_source(docs, id_col, text_col).select("id", "text", "key").mapInArrow(run, INDEX), "signatures")


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Queries:
    """One block of queries: their ids, and their terms with weights times repeats."""

    def __init__(self, asked: list[tuple[object, list[bytes]]]):
        self.ids = [number for number, _ in asked]
        self.counts = [Counter(found) for _, found in asked]
        self.vocabulary = sorted({t for counts in self.counts for t in counts})
        self.sums: list[list[tuple[bytes, int]]] = []

    def weigh(self, n_docs: int, n_terms: int, df: dict[bytes, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.vocabulary if t in df}
        self.sums = [[(t, times * weight[t]) for t, times in counts.items() if weight.get(t)] for counts in self.counts]
        self.vocabulary = sorted({t for row in self.sums for t, _ in row})
        self.known = frozenset(self.vocabulary)

    def measure(self, n):
        """A document's m; n may be an array."""
        return 25 + (75 * n * self.n_docs) // self.n_terms

    def bounds(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """For each query, what the scores of the block's columns cannot exceed."""
        columns, bits = len(block["keys"]), block["bits"]
        matrix = np.frombuffer(block["slices"], np.uint8).reshape(bits, -1)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        m, top = self.measure(np.array(block["n"], np.int64)), np.array(block["top"], np.int64)
        least = None
        tiers = []
        for number, tier in enumerate(TIERS):
            # A term of this tier, not of the next, occurs fewer times than the next asks for.
            times = np.minimum(top, TIERS[number + 1] - 1) if tier < TIERS[-1] else top
            gain = 1_000_000_000 * times // (1000 * times + 8 * m)
            rows = places(hashes, tier, bits)
            present = matrix[rows[:, 0]]
            for i in range(1, HASHES):
                present &= matrix[rows[:, i]]
            tiers.append((present, gain if least is None else gain - least))
            least = gain
        at = {t: i for i, t in enumerate(self.vocabulary)}
        for number, row in enumerate(self.sums):
            if row:
                chosen, weights = [at[t] for t, _ in row], np.array([w for _, w in row], np.float64)
                total = np.zeros(columns, np.int64)
                for present, gain in tiers:
                    sums = weights @ np.unpackbits(present[chosen], axis=1, count=columns)
                    total += sums.astype(np.int64) * gain
                yield number, total

    def score(self, found: list[bytes], wanted: list[int]) -> Iterator[tuple[int, int]]:
        """(query, score) of a document for the queries wanted."""
        m, times = self.measure(len(found)), Counter(filter(self.known.__contains__, found))
        part = {t: 1_000_000_000 * tf // (1000 * tf + 8 * m) for t, tf in times.items()}
        for number in wanted:
            yield number, sum(w * part[t] for t, w in self.sums[number] if t in part)


def _document_counts(source: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents each term of a block of queries occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = set(vocabulary), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(known.intersection(terms(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    summed = source.select("text").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(row.term): row.n for row in summed.toLocalIterator()}


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each query, in two steps so that no query is one task's work."""
    salted = Window.partitionBy("query", F.pmod(F.xxhash64("key"), F.lit(32))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _probes(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, key): for each query the k texts of the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[str, int]] = {}
        for batch in batches:
            for block in _blocks(batch):
                for number, bound in queries.bounds(block):
                    first = np.argpartition(-bound, min(k, bound.size) - 1)[:k]
                    kept = best.get(number, {}) | {block["keys"][i]: int(bound[i]) for i in first.tolist() if bound[i] > 0}
                    best[number] = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:k])
        rows = [(number, key, bound) for number, kept in best.items() for key, bound in kept.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = [pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query", "key", "bound"])

    found = index.mapInArrow(run, "query int, key string, bound long").groupBy("query", "key").agg(F.max("bound").alias("bound"))
    return _best(found, k, F.desc("bound"), "key").groupBy("key").agg(F.collect_list("query").alias("wanted"))


def _not_excluded(index: DataFrame, queries: Queries, floor: list[int]) -> DataFrame:
    """(key, wanted): every text, with the queries whose floor its bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                texts, asked = [], []
                for number, bound in queries.bounds(block):
                    reached = np.flatnonzero(bound >= floor[number])
                    texts.append(reached)
                    asked.append(np.full(reached.size, number))
                if texts:
                    texts, asked = np.concatenate(texts), np.concatenate(asked)
                    order = np.argsort(texts, kind="stable")
                    which, starts = np.unique(texts[order], return_index=True)
                    wanted = np.split(asked[order].astype(np.int32), starts[1:]) if which.size else []
                    arrays = [pa.array([block["keys"][i] for i in which.tolist()], pa.string()), pa.array(wanted, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "wanted"])

    # Copies in other blocks have the same bounds.
    return index.mapInArrow(run, "key string, wanted array<int>").groupBy("key").agg(F.any_value("wanted").alias("wanted"))


def _scored(source: DataFrame, candidates: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, rank, id, score): the k best of the candidate texts' documents, exactly."""
    joined = bounded_join(source, candidates, ["key"], F.coalesce("id", F.lit(0))).select("id", "text", "key", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        last: tuple = (None, [])
        for batch in batches:
            for number, text, key, wanted in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                if key != last[0]:
                    last = key, list(queries.score(terms(text.as_py()), wanted))
                for query, score in last[1]:
                    if score > 0:
                        kept = best.setdefault(query, [])
                        kept.append((-score, number is None, number or 0, key))
                        if len(kept) >= 8 * k:
                            kept.sort()
                            del kept[k:]
        rows = [(query, None if none else number, -score, key) for query, kept in best.items() for score, none, number, key in sorted(kept)[:k]]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query", "id", "score", "key"])

    found = joined.mapInArrow(run, "query int, id long, score long, key string")
    return _best(found, k, F.desc("score"), F.asc_nulls_last("id"))


def _query_blocks(queries: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list]:
    """Queries with terms, a bounded block at a time."""
    block, size = [], 0
    for number, text in queries.select(item_col, F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull()).toLocalIterator():
        found = terms(bytes(text))
        if found:
            block.append((number, found))
            size += len(found)
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def rank(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """Rows (item, rank, id, score): each query's k documents of the highest score above 0,
    equal scores by ascending id. `query_terms` is how many terms, with repeats, a block
    of queries has about."""
    spark = docs.sparkSession
    source = _source(docs, id_col, text_col)
    index = build_index(docs, id_col, text_col)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    path = scratch_path(spark, "ranked")
    kind = dict(queries.dtypes)[item_col]
    schema = f"item {kind}, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for asked in _query_blocks(queries, item_col, text_col, query_terms) if n_docs else ():
        block = Queries(asked)
        block.weigh(n_docs, n_terms, _document_counts(source, block.vocabulary))
        first = _scored(source, _probes(index, block, k), block, k)
        floor = [1] * len(asked)
        for row in first.where(F.col("rank") == k).toLocalIterator():
            floor[row.query] = row.score
        found = _scored(source, _not_excluded(index, block, floor), block, k)
        items = spark.createDataFrame(list(enumerate(block.ids)), f"query int, item {kind}")
        found.join(F.broadcast(items), "query").select("item", "rank", "id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
