"""Conversation repair by weighted CYK parsing of turn sequences.

A conversation may read `(s?(ua)+)?`, by its roles' initials. The repair grammar has a
nonterminal for every pair of states of that language (start, after s, after u, after
a): [p, q] derives the spans that lead from p to q. Its rules are [p, q] -> [p, r] [r, q],
and [p, q] -> turn for each edit of a turn, closed under insertions on both sides. A cell
holds for each nonterminal the cheapest derivation of a span, as (cost, audit), audit
being the initials of the edits. Cells are combined bottom-up by span length.

Any split of a span leaves its derivations whole, since a path through the states can be
cut anywhere. So a chart needs one split for each span, and spans of doubling length
reach any conversation in n cells and log n rounds instead of n^2 cells: here, rounds
within a chunk of turns happen in one task, and rounds over chunks are joins. Equal
costs with one audit a proper prefix of the other cannot occur (the rest would be
insertions, which cost), so the least audit of a span is made of least audits.

Defined results: null ids make one conversation; a null turn comes before all others and
is no part of gaps; null roles and texts count as one space. Rows of one turn are in
order of role and of their text's md5 sum; texts of one md5 sum count as equal. Roles
whose initial is not s, u or a, and empty ones, are never kept as they are. Very long
conversations are cut into chunks everywhere but in their audit, and in `digest`, which
passes over one conversation's turns in order with bounded memory, as a digest must.
Repeated rows are duplicates; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import bounded_join, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
PAIRS = [(p, q) for p, q in product(range(4), repeat=2) if q != START or p == START if q != SYSTEM or p in (START, SYSTEM)]
SPLITS = {(p, q): [r for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS}
# A token names a turn's initial and fault: fine, truncated, or to be deleted.
INITIALS, FAULTS = "sua?", 3
TOKENS = "abcdefghijkl"
CHUNK_BITS = 10
SPACES = " \t\n\x0b\x0c\r"
CELLS = "array<struct<cost: long, audit: string>>"

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    made = {}
    for p, q in PAIRS:
        found = [
            (left[p, r][0] + right[r, q][0], left[p, r][1] + right[r, q][1])
            for r in SPLITS[p, q] if (p, r) in left and (r, q) in right
        ]
        if found:
            made[p, q] = min(found)
    return made


def insertions() -> Cell:
    """The empty span: what inserting turns alone derives."""
    made: Cell = {(p, p): (0, "") for p in range(4)}
    one = made | {step: (INSERT, "I") for step in (*STEPS["u"], *STEPS["a"])}
    for _ in range(3):
        made = combine(made, one)
    return made


def turn_cell(token: str) -> Cell:
    """The span of one turn, with insertions around it."""
    initial, fault = divmod(TOKENS.index(token), FAULTS)
    ways: list[tuple[tuple[int, int], tuple[int, str]]] = [((p, p), (DELETE, "D")) for p in range(4)]
    if fault < 2:
        more = TRUNCATED * fault
        ways += [(step, (REROLE + more, "R")) for role in "ua" for step in STEPS[role]]
        ways += [(step, (KEEP + more, "K")) for step in STEPS.get(INITIALS[initial], [])]
    cell: Cell = {}
    for pair, way in ways:
        cell[pair] = min(cell.get(pair, way), way)
    return combine(combine(insertions(), cell), insertions())


def parse(tokens: str, leaves: dict[str, Cell]) -> Cell:
    """The cell of a span of turns, by spans of doubling length."""
    cells = [leaves[token] for token in tokens]
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, present): `turns` with the damage of a benchmark of
    repairs, dealt by crc32 of `conv:turn`. Dropped rows stay, with present false."""
    names = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    kind = F.crc32(names) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    dealt = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    dealt = dealt.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    marks = F.regexp_replace("text", "[.!?]", "")
    dealt = dealt.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, marks).otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return dealt.withColumn("copy", copies).select("conv", "turn", "role", "text", (F.col("kind") != 0).alias("present"))


@dataclass(frozen=True)
class Repair:
    """`turns`: key, seq, role, text, edit, the repaired conversations. `report`: one row
    for each conversation, with conv, key, faults, cost and audit."""

    turns: DataFrame
    report: DataFrame


def _ordered(turns: DataFrame) -> DataFrame:
    """All turns in written order: `at` rises through every conversation, however many
    partitions it takes."""
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("key"), "turn", "role", "text", "present",
        F.md5(text.cast("binary")).alias("same"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["key", "turn", "role", "same", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), "turns")


def _flagged(rows: DataFrame) -> DataFrame:
    """Narrow rows (key, turn, at, initial, fault): the first fault of each present turn."""
    narrow = rows.where("present").select("key", "turn", "role", "same", "at", "blank", "open")
    repeated = narrow.where("NOT blank").groupBy("key", "role", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").drop("n")
    found = bounded_join(narrow, repeated, ["key", "role", "same"], F.col("at"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    initial = F.when(F.col("role").rlike("^[sua]"), F.left("role", F.lit(1))).otherwise("?")
    return found.select("key", "turn", "at", initial.alias("initial"), fault.alias("fault"))


def _spans(flagged: DataFrame) -> DataFrame:
    """(key, chunk, ats, tokens): the turns of each chunk of a conversation, in order."""
    kind = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    token = F.substr(F.lit(TOKENS), FAULTS * (F.instr(F.lit(INITIALS), F.col("initial")) - 1) + kind + 1, F.lit(1))
    rows = flagged.select("key", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.struct("at", token.alias("token")).alias("turn"))
    turns = rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("key", "chunk", F.col("turns.at").alias("ats"), F.array_join("turns.token", "").alias("tokens"))


def _chunk_cells(spans: DataFrame) -> DataFrame:
    """(key, chunk, cells, first, last, illegal) of each chunk; first and last are initials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, known = {token: turn_cell(token) for token in TOKENS}, {}
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            made, ends = [], []
            for tokens in batch.column(2).to_pylist():
                if tokens not in known:
                    if len(known) >= 4096:
                        known.clear()
                    cell = parse(tokens, leaves)
                    roles = "".join(INITIALS[TOKENS.index(t) // FAULTS] for t in tokens)
                    wrong = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
                    found = [{"cost": cell[pair][0], "audit": cell[pair][1]} if pair in cell else None for pair in PAIRS]
                    known[tokens] = found, (roles[0], roles[-1], wrong)
                made.append(known[tokens][0])
                ends.append(known[tokens][1])
            if made:
                first, last, wrong = zip(*ends, strict=True)
                arrays = [batch.column(0), batch.column(1), pa.array(made, kind), pa.array(first), pa.array(last), pa.array(wrong, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "chunk", "cells", "first", "last", "illegal"])

    source = spans.select("key", "chunk", "tokens")
    return source.mapInArrow(run, f"key string, chunk long, cells {CELLS}, first string, last string, illegal long")


def _joined_cells(left: Column, right: Column) -> Column:
    """`combine` as an expression over the cells' arrays."""
    at = {pair: i for i, pair in enumerate(PAIRS)}

    def way(p: int, r: int, q: int) -> Column:
        one, two = left[at[p, r]], right[at[r, q]]
        both = F.struct((one["cost"] + two["cost"]).alias("cost"), F.concat(one["audit"], two["audit"]).alias("audit"))
        return F.when(one.isNotNull() & two.isNotNull(), both)

    ways = {(p, q): [way(p, r, q) for r in SPLITS[p, q]] for p, q in PAIRS}
    return F.array(*[F.least(*found) if len(found) > 1 else found[0] for found in ways.values()])


def _parsed(cells: DataFrame) -> DataFrame:
    """(key, cells, illegal) of whole conversations: chunks are combined two by two, in as
    many rounds as doubling takes to the longest conversation."""
    number = F.row_number().over(Window.partitionBy("key").orderBy("chunk")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    many = materialize(cells.select("key", "chunk").select("*", number.alias("part"), size.alias("parts")).where("parts > 1"), "parts")
    longest = many.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
    whole = cells.join(many.select("key").distinct(), "key", "left_anti").select("key", "cells", "illegal")
    if not longest:
        return whole
    level = cells.join(many.drop("parts"), ["key", "chunk"]).drop("chunk")
    while longest > 1:
        left, right = level.where("part % 2 = 0"), level.where("part % 2 = 1").withColumn("part", F.col("part") - 1)
        joined = left.alias("l").join(right.alias("r"), ["key", "part"], "left")
        alone, legal = F.col("r.cells").isNull(), F.concat("l.last", "r.first").isin("su", "ua", "au")
        level = joined.select(
            "key", (F.col("part") / 2).cast("int").alias("part"),
            F.when(alone, F.col("l.cells")).otherwise(_joined_cells(F.col("l.cells"), F.col("r.cells"))).alias("cells"),
            F.col("l.first"), F.coalesce("r.last", "l.last").alias("last"),
            F.when(alone, F.col("l.illegal")).otherwise(F.col("l.illegal") + F.col("r.illegal") + (~legal).cast("long")).alias("illegal"),
        )
        level, longest = materialize(level, "cells"), (longest + 1) // 2
    return whole.unionByName(level.select("key", "cells", "illegal"))


def _edits(spans: DataFrame, best: DataFrame) -> DataFrame:
    """(key, at, seq, edit, role) of the turns that stay, with no role for kept ones and no
    `at` for inserted ones."""
    sizes = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", F.size("ats").alias("n")))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An audit to the parts of its chunks; the last takes the insertions at the end."""
        for batch in batches:
            for key, audit, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                made = len(audit) - audit.count("D")
                at, seq, rows = 0, 0, []
                for part in parts:
                    end, left = at, part["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    end = len(audit) if part is parts[-1] else end
                    rows.append((key, part["chunk"], audit[at:end], seq, made % 2))
                    seq += end - at - audit.count("D", at, end)
                    at = end
                names = ["key", "chunk", "edits", "seq", "odd"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "at", "seq", "edit", "role"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for key, ats, edits, seq, odd in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                turns = iter(ats)
                for edit in edits:
                    at = None if edit == "I" else next(turns)
                    if edit != "D":
                        # Only with a system turn in front is the number of turns odd.
                        role = ("user", "assistant")[(seq - odd) % 2]
                        rows.append((key, at, seq, edit, None if edit == "K" else role))
                        seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = best.join(sizes, "key").select("key", "audit", "parts").mapInArrow(cut, "key string, chunk long, edits string, seq long, odd int")
    dealt = parts.join(spans.drop("tokens"), ["key", "chunk"]).select("key", "ats", "edits", "seq", "odd")
    return dealt.mapInArrow(apply, "key string, at long, seq long, edit string, role string")


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of every conversation in rows (conv, turn, role, text, present).
    Rows that are not present only name their conversation."""
    kind = dict(turns.dtypes)["conv"]
    rows = _ordered(turns)
    flagged = materialize(_flagged(rows), "flagged")
    spans = materialize(_spans(flagged), "spans")
    cells = materialize(_chunk_cells(spans), "cells")
    at = {pair: i for i, pair in enumerate(PAIRS)}
    ends = F.least(F.col("cells")[at[START, START]], F.col("cells")[at[START, ASSISTANT]])
    best = materialize(_parsed(cells).select("key", "illegal", ends.alias("best")).select("key", "illegal", "best.*"), "audits")
    edits = materialize(_edits(spans, best), "edits")
    stay = rows.select("at", F.col("role").alias("was"), "text").join(edits.where("at IS NOT NULL"), "at")
    stay = stay.select("key", "seq", F.coalesce("role", "was").alias("role"), "text", "edit")
    made = edits.where("at IS NULL").select("key", "seq", "role", F.lit("").alias("text"), "edit")

    # By turn first, so that a long conversation is summed in many tasks.
    faults = ["blank", "duplicate", "truncated"]
    sums = flagged.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == name).alias(name) for name in faults])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    sums = sums.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(name).alias(name) for name in faults])
    report = rows.select("key").distinct().join(sums, "key", "left").join(best, "key", "left")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("gaps", *faults, "illegal", "cost")]
    conv = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias("conv")
    return Repair(stay.unionByName(made), report.select(conv, "key", *counts, F.coalesce("audit", F.lit("")).alias("audit")))


def digest(repaired: Repair) -> DataFrame:
    """The report by conv_id, with the SHA-256 of each repaired conversation's lines."""
    lines = repaired.turns.select("key", "seq", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "seq").select("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key == now:
                    state.update(b"\n")
                else:
                    done += [(now, state.hexdigest())] if now is not None else []
                    now, state = key, hashlib.sha256()
                state.update(line.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "sha"])

    found = repaired.report.join(lines.mapInArrow(run, "key string, sha string"), "key", "left")
    sha = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)
