"""Encoding and decoding with a given SentencePiece BPE model, without its encoder.

Merge-type models choose, of all ways to cut a text, the only one in which every two
adjacent tokens would come out unchanged if the two were merged again from their
characters. The encoder finds it by backtracking: Aho-Corasick gives the longest piece
at each position; a piece is taken if it fits its left neighbour, else the next
shorter one is tried; positions from which nothing fits are marked in a bitfield and
never tried again.

Pieces with equal scores leave the order of merges to positions; the few parts of a text
that hold such a piece are merged as the definition says, by a heap.

Defined results: null and empty texts have no tokens and decode to the empty text; a
null stays one row. Characters that no piece has become byte pieces. Very long texts are
coded whole, unit by unit; repeated rows and ids, and null ids, come back as they stand;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
CACHED_UNITS = 80_000
CACHED_CHARS = 48


class _Filled(dict):
    """A dictionary that computes what it lacks. When full, it becomes the old
    generation, from which entries still in use come back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Pieces and tables of one model file. Only BPE models with byte fallback, a dummy
    prefix and identity normalisation are taken; others raise ValueError."""

    def __init__(self, model_file: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        fits = trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
        fits = fits and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        if not fits or norm.precompiled_charsmap or any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("only BPE models with byte fallback and identity normalisation")
        self.pieces = [p.piece for p in model.pieces]
        self.bytes = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_ids = {value: i for i, value in self.bytes.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.unknown_surface = trained.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        chars = {c for piece in self.ids for c in piece}
        self.chars = {c for c in chars if c in self.ids}
        #: No piece has a space mark after another character, so texts fall into units there.
        self.by_space = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        #: Equal scores leave the order of merges to positions; such pieces are merged as a whole.
        once: set[float] = set()
        tied = {s for s in self.score.values() if s in once or once.add(s)}
        self.tied = {piece for piece, s in self.score.items() if s in tied and len(piece) > 1}
        self.has_tied = re.compile("|".join(map(re.escape, sorted(self.tied))) or "(?!)").search
        #: No merge crosses two characters that no piece has side by side.
        self.joined = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.fits_memo: dict[tuple[str, str], bool] = {}
        self._tables()
        self.part = _Filled(self._coded_part)
        self.unit = _Filled(self._unit)
        self.word = _Filled(lambda word: self._unit(SPACE + word))

    def _tables(self) -> None:
        self.longest, self.shorter = ahocorasick.Automaton(), {}
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {piece: i for i, piece in enumerate(order)}
        #: The two parts that the last merge of a piece puts together.
        self.last_merge: dict[str, tuple[str, str]] = {}
        known = []
        for piece in self.ids:
            parts = [piece] if len(piece) == 1 else [] if piece in self.tied else self.merge(piece, 2)
            if len(parts) == 2 and self.merge(piece) == [piece]:
                self.last_merge[piece] = (parts[0], parts[1])
                known.append(piece)
            elif len(piece) == 1:
                known.append(piece)
        usable = set(known)
        for piece in known:
            self.longest.add_word(piece, piece)
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in usable), None)
        self.longest.make_automaton()

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The definition: merge the adjacent pair of the best score, leftmost first, until
        `least` parts are left."""
        parts, score = list(text), self.score
        while len(parts) > least:
            pairs = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in pairs if s is not None), default=None)
            if best is None:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two side by side leaves them as they are.

        Their last merges are undone, the later one first. Where the pieces then met must
        not be a piece that would have been merged before that: at equal rank the one
        further left, which is the joint unless the left piece itself was merged.
        """
        rank, last, limit = self.rank, self.last_merge, len(self.rank) + 1
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            one, other = last.get(left), last.get(right)
            if one and (not other or rank[left] > rank[right]):
                limit, left = rank[left], one[1]
            elif other:
                limit, right = rank[right] + 1, other[0]
            else:
                return True

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text that has known characters only and no tied piece."""
        n, shorter, memo = len(text), self.shorter, self.fits_memo
        if len(memo) >= 4 * CACHED_UNITS:
            memo.clear()
        longest = {end + 1 - len(piece): piece for end, piece in self.longest.iter_long(text)}
        open_at = bytearray(b"\x01") * (n + 1)
        taken: list[str] = []
        at, piece, last = 0, longest[0], None
        while at < n:
            if piece is None:
                open_at[at] = 0
                at -= len(last)
                piece = shorter[taken.pop()]
                last = taken[-1] if taken else None
                continue
            if open_at[at + len(piece)]:
                fits = True if last is None else memo.get((last, piece))
                if fits is None:
                    fits = memo[last, piece] = self.compatible(last, piece)
                if fits:
                    taken.append(piece)
                    last = piece
                    at += len(piece)
                    if at < n:
                        piece = longest.get(at)
                        if piece is None:
                            piece = longest[at] = next(self.longest.iter_long(text, at))[1]
                    continue
            piece = shorter[piece]
        return taken

    def _parts(self, unit: str) -> list[str]:
        """The unit cut wherever no piece can reach across."""
        joined, parts, start = self.joined, [], 0
        for at in range(1, len(unit)):
            if unit[at - 1 : at + 1] not in joined:
                parts.append(unit[start:at])
                start = at
        parts.append(unit[start:])
        return parts

    def _coded_part(self, part: str) -> tuple[str, str]:
        if len(part) == 1 and part not in self.chars:
            ids = [self.byte_ids[b] for b in part.encode()]
        else:
            ids = [self.ids[p] for p in (self._merge_runs(part) if self.has_tied(part) else self._cut(part))]
        return ",".join(map(str, ids)), self.decode(ids, strip=False)

    def _merge_runs(self, run: str) -> list[str]:
        """A run with tied pieces, merged by a linked list and a heap."""
        from heapq import heapify, heappop, heappush

        parts, n = list(run), len(run)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else n
            if b < n:
                score = self.score.get(parts[a] + parts[b])
                if score is not None:
                    heappush(heap, (-score, a, len(parts[a]), len(parts[b])))

        for a in range(n - 1):
            offer(a)
        heapify(heap)
        while heap:
            _, a, one, other = heappop(heap)
            b = after[a] if alive[a] else n
            if b >= n or len(parts[a]) != one or len(parts[b]) != other:
                continue
            parts[a] += parts[b]
            alive[b] = False
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [p for p, here in zip(parts, alive, strict=True) if here]

    def units(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        if not self.by_space:
            return [marked] if marked else []
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)

    def _unit(self, unit: str) -> tuple[str, str]:
        parts = [self.part[part] for part in self._parts(unit)]
        return parts[0] if len(parts) == 1 else (",".join([ids for ids, _ in parts]), "".join([text for _, text in parts]))

    def coded(self, text: str) -> list[tuple[str, str]]:
        """For each unit, its decimal ids joined by commas, and the text that these decode to."""
        if text and self.by_space and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            word = self.word
            return [word[part] for part in text.split(" ")]
        return [self.unit[unit] for unit in self.units(text)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.coded(text) for i in ids.split(",")]

    def round_trip(self, text: str) -> tuple[str, str]:
        """The decimal ids of the text, joined by commas, and what they decode to:
        characters never cross units, so decoding goes unit by unit."""
        coded = self.coded(text)
        again = "".join([text for _, text in coded])
        return ",".join([ids for ids, _ in coded]), again[1:] if again.startswith(" ") else again

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Text of any ids: bytes that form no UTF-8 become replacement characters."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if i in self.unknown:
                out.append(self.unknown_surface)
            elif i not in self.hidden:
                piece = self.pieces[i]
                if strip and piece.startswith(SPACE) and not any(out):
                    piece = piece[1:]
                    strip = False
                out.append(piece.replace(SPACE, " "))
        if pending:
            out.append(_utf8(bytes(pending)))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Decoded, with one replacement character for each byte that fits nowhere."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def same_as_library(model_file: str, texts: list[str]) -> bool:
    """Whether this codec gives the library's ids and texts."""
    own, library = Codec(model_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [library.encode(t) for t in texts]
    return [own.encode(t) for t in texts] == ids and [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def codec(model_file: str) -> Codec:
    """One codec for each worker process and model. The functions here travel by value, so a
    global of theirs would be new in each task; the library's module stays."""
    loaded = sentencepiece.__dict__.setdefault("_pagemill_codecs", {})
    if model_file not in loaded:
        loaded[model_file] = Codec(model_file)
    return loaded[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, tokens array<int>): one for each row of `docs`. The model file must be
    at the same path on every executor."""
    kinds = [pa.list_(pa.int32())]
    return _each(docs, model_file, id_col, text_col, "tokens array<int>", kinds, lambda model, text: (model.encode(text),))


def decode(rows: DataFrame, model_file: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (id, text) of columns of token ids; null tokens give the empty text."""
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_file)
        for batch in batches:
            texts = [model.decode(t.as_py() or []) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids
    decoded again, and both digested, without the ids leaving the task."""

    def digests(model: Codec, text: str) -> tuple[int, str, str]:
        ids, again = model.round_trip(text)
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest()

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _each(docs, model_file, id_col, text_col, schema, [pa.int64(), pa.string(), pa.string()], digests)


def _each(docs: DataFrame, model_file: str, id_col: str, text_col: str, schema: str, kinds: list, make) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_file)
        for batch in batches:
            made = [make(model, text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return source.mapInArrow(run, f"id long, {schema}")
