"""Fuzzy line deduplication: one occurrence of each group of similar lines stays.

Lines are cut at "\\n" and normalised: ASCII letters in lower case, ASCII digits as 0,
other ASCII punctuation as space, single spaces. Two lines are linked when the SimHash
of their words differs in at most `max_bits` bits and the edit similarity of their
normalised text is at least `similarity`; equal lines are one. Of each connected group
the occurrence of the smallest (id, position) stays.

Defined results: null and empty texts have no lines; lines without a word are never
compared or removed; rows without an id are left alone; rows that repeat an id are
documents of their own if their texts differ, told apart by the texts' md5 sums, and one
document if they are equal. Ties between them go to the smaller sum. Very long texts and
lines are read whole, in blocks. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bit_links, block_keys, cells, components, near_pairs, slices, spread_groups
from pagemill.runtime import materialize

TABLE = bytes(
    b if b >= 128 or b == 10 else ord("0") if 48 <= b < 58 else b | 32 if 65 <= b < 91 else b if 97 <= b < 123 else 32
    for b in range(256)
)
BLOCK = 4_096
BATCH_WORDS = 200_000
PIECE = 64
LANES = 4_096
PAIRS = 2_000
FEW = 16
STEP = 256


def normal_lines(text: bytes | None) -> list[list[bytes]]:
    """Words of each line."""
    return [line.split() for line in text.translate(TABLE).split(b"\n")] if text else []


def simhashes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """SimHash of each run of words; `sizes` are the runs' lengths, none zero. Bit counts
    exist for one block of words at a time."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    lengths = np.asarray(sizes, np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    made, at = np.empty(len(sizes), np.int64), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        if sizes[at] > BLOCK:  # one line, in parts
            counts = np.zeros((1, 64), np.int64)
            for part in range(int(starts[at]), int(ends[at]), BLOCK):
                some = hashes[part : min(part + BLOCK, int(ends[at]))]
                counts[0] += np.unpackbits(some.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            upto = at + 1
        else:
            bits = np.unpackbits(hashes[starts[at] : ends[upto - 1]].view(np.uint8))
            if lengths[at:upto].max() < 256:  # counts that fit a byte are added eight at a time
                counts = np.add.reduceat(bits.view(np.uint64).reshape(-1, 8), starts[at:upto] - starts[at], axis=0).view(np.uint8).astype(np.int32)
            else:
                counts = np.add.reduceat(bits.reshape(-1, 64), starts[at:upto] - starts[at], axis=0, dtype=np.int32)
        made[at:upto] = np.packbits(2 * counts > lengths[at:upto, None], axis=1).view(np.int64).ravel()
        at = upto
    return made


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, key) of documents with an id and a text."""
    text = F.col(text_col).cast("binary")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.md5(text).alias("key"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key, pos, n_lines, h, sim) of lines with a word: h names the normalised line,
    key the text, and n_lines counts such lines of the text."""
    source = _source(docs, id_col, text_col)

    def rows(ids: list[int], keys: list[str], positions: list[int], counts: list[int], names: list[int], words: list[bytes], sizes: list[int]) -> pa.RecordBatch:
        names_ = np.array(names, np.uint64).view(np.int64)
        arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(positions, pa.int32()), pa.array(counts, pa.int32()), pa.array(names_), pa.array(simhashes(words, sizes))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "key", "pos", "n_lines", "h", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, positions, counts, names, words, sizes = [], [], [], [], [], [], []
            for number, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = normal_lines(text.as_py())
                n_lines = sum(map(bool, lines))
                for pos, line in enumerate(lines):
                    if line:
                        ids.append(number)
                        keys.append(key)
                        positions.append(pos)
                        counts.append(n_lines)
                        names.append(xxhash.xxh3_64_intdigest(b" ".join(line)))
                        sizes.append(len(line))
                        words += line
                        if len(words) > BATCH_WORDS:
                            yield rows(ids, keys, positions, counts, names, words, sizes)
                            ids, keys, positions, counts, names, words, sizes = [], [], [], [], [], [], []
            if ids:
                yield rows(ids, keys, positions, counts, names, words, sizes)

    return source.mapInArrow(run, "id long, key string, pos int, n_lines int, h long, sim long")


def edit_distance(one, other) -> int:
    """Levenshtein distance of two texts or two lists of words, by bit vectors over the first."""
    same = len(commonprefix([one, other]))
    one, other = one[same:], other[same:]
    same = len(commonprefix([one[::-1], other[::-1]]))
    one, other = one[: len(one) - same], other[: len(other) - same]
    if not one or not other:
        return len(one) + len(other)
    places: dict = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    full, top, distance = (1 << len(one)) - 1, 1 << (len(one) - 1), len(one)
    up, down = full, 0
    for c in other:
        same = places.get(c, 0)
        carried = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (~(carried | up) & full), up & carried
        distance += bool(rises & top) - bool(falls & top)
        rises = ((rises << 1) | 1) & full
        up, down = ((falls << 1) | (~((same | down) | rises))) & full, rises & (same | down)
    return distance


def similar(one: str, other: str, least: float) -> bool:
    """Whether the edit distance is at most (1 - least) of the longer text. Replacing the words
    that differ, or editing the text word by word, bounds it and settles most pairs."""
    most = (1 - least) * max(len(one), len(other)) + 1e-9
    if abs(len(one) - len(other)) > most:
        return False
    words, others = one.split(" "), other.split(" ")
    if len(words) == len(others) and sum(max(len(a), len(b)) for a, b in zip(words, others, strict=True) if a != b) <= most:
        return True
    # A word that is replaced, added or left out costs its letters and a space at most.
    longest = max(map(len, words + others)) + 1
    if edit_distance(words, others) * longest <= most:
        return True
    return edit_distance(one, other) <= most


def apart(texts: list[str], one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For pairs of texts, given by their rows, whether a bound shows that they are more than `most` edits
    apart; where it does not, they may be. An alignment of few edits meets each piece of 64 characters
    near its own place in the other text, so the least edits of pieces to anything there add up to
    no more than the distance. Every second piece is asked first, the others where these leave it open."""
    rows, at = np.unique(np.concatenate([one, other]), return_inverse=True)
    used = [texts[row] for row in rows.tolist()]
    sizes = np.fromiter(map(len, used), np.int64, len(used))
    starts = np.cumsum(sizes) - sizes
    marks = np.frombuffer("".join(used).encode("utf-32-le"), np.uint32).astype(np.uint8) & 63
    one, other, most = at[: one.size], at[one.size :], most.astype(np.int64)
    pieces = -(-sizes[one] // PIECE)
    edits, pairs = np.zeros(one.size, np.int64), np.arange(one.size)
    for first in (0, 1):
        counts = (pieces[pairs] + 1 - first) // 2
        lane = np.repeat(pairs, counts)
        begin = PIECE * (first + 2 * (np.arange(lane.size) - np.repeat(np.cumsum(counts) - counts, counts)))
        for low in range(0, lane.size, LANES):
            pair, begins = lane[low : low + LANES], begin[low : low + LANES]
            widths = np.minimum(PIECE, sizes[one[pair]] - begins)
            left = np.maximum(0, begins - most[pair])
            right = np.maximum(left, np.minimum(sizes[other[pair]], begins + widths + most[pair]))
            found = piece_edits(marks, starts[one[pair]] + begins, widths, starts[other[pair]] + left, right - left)
            np.add.at(edits, pair, found)
        pairs = np.flatnonzero((edits <= most) & (4 * edits > most))
    return edits > most


def piece_edits(marks: np.ndarray, at: np.ndarray, widths: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each piece of at most 64 marks, the least edits to any run of marks within a span, by bit vectors."""
    n = at.size
    order = np.argsort(-lengths, kind="stable")  # those whose span has ended stand last
    at, widths, places, lengths = at[order], widths[order], places[order], lengths[order]
    masks, rows = np.zeros((n, 64), np.uint64), np.arange(n)
    for i in range(int(widths.max(initial=0))):
        some = rows[widths > i]
        masks[some, marks[at[some] + i]] |= np.uint64(1 << i)
    masks, base = masks.ravel(), rows * 64
    up, down = np.full(n, np.uint64(2**64 - 1)), np.zeros(n, np.uint64)
    top, one = (widths - 1).astype(np.uint64), np.uint64(1)
    score = widths.astype(np.int64)
    best = score.copy()
    for i, open_ in enumerate(np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left").tolist()):
        if open_ < top.size:
            base, places, up, down, top, score = (x[:open_] for x in (base, places, up, down, top, score))
        same = masks[base + marks[places + i]]
        vertical = same | down
        carried = (((same & up) + up) ^ up) | same
        rises, falls = down | ~(carried | up), up & carried
        score += ((rises >> top) & one).view(np.int64)
        score -= ((falls >> top) & one).view(np.int64)
        np.minimum(best[:open_], score, out=best[:open_])
        rises <<= one
        falls <<= one
        up, down = falls | ~(vertical | rises), rises & vertical
    found = np.empty(n, np.int64)
    found[order] = best
    return found


def text_links(prints: np.ndarray, texts: list[str], max_bits: int, least: float) -> list[tuple[int, int]]:
    """Links that connect the lines of one cell exactly as all its pairs within `max_bits` bits that are
    similar would. Lines already connected are not compared again. Some lines at a time meet all later
    ones, more while few are linked, and pairs that `apart` can tell are not compared in full."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    root, links, at, step = np.arange(prints.size), [], 0, 1
    while at < prints.size - 1:
        rows, later = np.arange(at, min(at + step, prints.size)), np.arange(at + 1, prints.size)
        near = np.bitwise_count(prints[rows, None] ^ prints[None, later]) <= max_bits
        near &= (root[rows, None] != root[None, later]) & (rows[:, None] < later[None, :])
        one, other = np.nonzero(near)
        one, other = one + at, other + at + 1
        most = (1 - least) * np.maximum(sizes[one], sizes[other]) + 1e-9
        close = np.abs(sizes[one] - sizes[other]) <= most
        one, other, most = one[close], other[close], most[close]
        before = len(links)
        for low in range(0, one.size, PAIRS):
            some = low + np.flatnonzero(root[one[low : low + PAIRS]] != root[other[low : low + PAIRS]])
            if some.size >= FEW:
                some = some[~apart(texts, one[some], other[some], most[some])]
            for i, j in zip(one[some].tolist(), other[some].tolist(), strict=True):
                if root[i] != root[j] and similar(texts[i], texts[j], least):
                    links.append((i, j))
                    root[root == root[j]] = root[i]
        at += step
        step = min(2 * step, STEP) if 4 * (len(links) - before) <= one.size else max(1, step // 2)
    return links


def _links(rows: DataFrame, key: str, max_bits: int, similarity: float | None) -> DataFrame:
    """Edges (a, b) over lines (h, sim[, norm]) that share a key; with a similarity,
    only those that the normalised texts confirm."""
    kept = ["cell", "h", "sim", *(["norm"] if similarity else [])]
    dealt = spread_groups(rows, key, F.col("h")).select(kept).repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in cells(batches):
            names = table.column("h").to_numpy()
            sims = table.column("sim").to_numpy().view(np.uint64)
            found_a, found_b = [], []
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                near = start + np.flatnonzero(near_pairs(sims[start:end], max_bits))
                if near.size < 2:
                    continue
                if similarity:
                    links = text_links(sims[near], table.column("norm").take(pa.array(near)).to_pylist(), max_bits, similarity)
                else:
                    links = bit_links(sims[near], max_bits, sims[near[:1]])
                links = np.array(links, int).reshape(-1, 2)
                found_a.append(names[near[links[:, 0]]])
                found_b.append(names[near[links[:, 1]]])
            if found_a:
                arrays = [pa.array(np.concatenate(x)) for x in (found_a, found_b)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _with_norm(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`wanted` (id, key, pos, h, sim, cluster) with the normalised text of each line."""
    lists = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("pos", "h", "sim", "cluster")).alias("wanted"))
    joined = _source(docs, id_col, text_col).join(lists, ["id", "key"]).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                lines = normal_lines(text.as_py())
                for line in asked.as_py():
                    if line["pos"] < len(lines):
                        out.append(line | {"norm": b" ".join(lines[line.pop("pos")]).decode()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("h", pa.int64()), ("sim", pa.int64()), ("cluster", pa.int64()), ("norm", pa.string())]))

    return joined.mapInArrow(run, "h long, sim long, cluster long, norm string")


def removed_lines(
    docs: DataFrame, max_bits: int = 3, agree: int = 1, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, key, n_lines, removed): lines with a word, and the positions, from 0, of those
    that repeat a line that stays; one row for each id and text (key is its md5 sum) with such a line.

    Copies meet in one row before anything is compared. Lines that share a SimHash
    block make clusters; texts are fetched for these only, and within a cluster the
    edit similarity decides. More `agree` means more, but far smaller, blocks.
    """
    lines = materialize(line_table(docs, id_col, text_col), "lines")
    distinct = lines.groupBy("h").agg(F.min("sim").alias("sim"), F.min(F.struct("id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct, "distinct-lines")
    keyed = distinct.select("h", "sim", F.explode(block_keys(F.col("sim"), max_bits, agree)).alias("key"))
    clusters = components(_links(keyed, "key", max_bits, None))
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = members.select(F.col("node").alias("h"), F.col("root").alias("cluster"))
    wanted = members.join(distinct, "h").select("first.id", "first.key", "first.pos", "h", "sim", "cluster")
    normal = materialize(_with_norm(docs, wanted, id_col, text_col), "candidate-lines")
    groups = components(_links(normal, "cluster", max_bits, similarity))
    in_group = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    grouped = in_group.select(F.col("node").alias("h"), "root").join(distinct.select("h", "first"), "h")
    stays = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    grouped = grouped.join(stays, "root").select("h", "keep")
    repeats = distinct.where("n > 1").join(grouped, "h", "left_anti").select("h", F.col("first").alias("keep"))
    doubled = lines.join(repeats.unionByName(grouped), "h").where(F.struct("id", "key", "pos") != F.col("keep"))
    removed = doubled.groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    counts = lines.groupBy("id", "key").agg(F.max(F.col("n_lines").cast("long")).alias("n_lines"))
    return counts.join(removed, ["id", "key"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the repeated lines of their texts; no row goes."""
    found = removed_lines(docs, id_col=id_col, text_col=text_col, **options).where(F.size("removed") > 0)
    found = found.select("id", "key", "removed")
    whole = docs.select(F.struct("*").alias("row"))
    whole = whole.select("row", F.col("row")[id_col].cast("long").alias("id"), F.md5(F.col("row")[text_col].cast("binary")).alias("key"))
    joined = whole.join(found, ["id", "key"], "left").select(*[F.col("row")[c].alias(c) for c in docs.columns], "removed")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            for i, removed in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if removed and texts[i]:
                    out = set(removed)
                    texts[i] = "\n".join([line for pos, line in enumerate(texts[i].split("\n")) if pos not in out])
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.remove(batch.num_columns - 1))

    return joined.mapInArrow(run, docs.schema)
