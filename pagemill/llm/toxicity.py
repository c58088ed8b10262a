"""Toxicity by noisy-channel deobfuscation.

A token that may hide a word (letters with digits or symbols among them, long runs of
one letter, single letters with spaces between) is a lattice of letters: each character
stands for itself, for the letters it resembles, or for nothing, and a run for one or two
letters. The Viterbi path under a character model is the restored token. The model's bigrams
come from all words of the corpus, and its trigrams from the learned toxic terms.
Terms are words, word beginnings and repeated word beginnings that labelled toxic texts have and others lack; a
document's score is the noisy-or of the terms it holds.

Defined results: null, empty and blank texts hold no term and get the score of texts
without one; null ids keep their row; labels that are null are no labels, and of
several labels of an id the highest counts; without labels no term is learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices
from pagemill.runtime import materialize

# Letters that digits and symbols are written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
STEM_LENGTHS = range(4, 9)
EDGES = ".,;:!?\"'`()[]{}<>*#%&|-_=+~/\\…«»“”‘’"
ALPHABET_END = 0x250
MAX_TERMS = 5000
CACHED_TOKENS = 60_000  # in each of two generations
COUNTED_WORDS = 150_000
TRIPLE = re.compile(r"(.)\1\1").search
SPACED_RUN = 4
LONGEST_TERM = 24


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size is bounded by the alphabet and MAX_TERMS."""

    words: dict[str, float]
    stems: dict[str, float]
    repeats: dict[str, float]
    floor: float
    bigrams: dict[str, float] = field(repr=False)
    trigrams: dict[str, float] = field(repr=False)


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (gram, n): pairs of letters within all words, "^" before the first and "$"
    after the last. Letters beyond the Latin blocks count as "?", so there are at most about
    300,000 pairs."""
    source = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            grams: Counter = Counter()
            for text in batch.column(0):
                words.update((text.as_py() or "").lower().split())
                if len(words) > COUNTED_WORDS:
                    _count(words, grams)
                    words.clear()
            _count(words, grams)
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    return source.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _count(words: Counter, grams: Counter) -> None:
    for word, n in words.items():
        word = word.strip(EDGES)
        if word.isalpha():
            marked = f"^{word}$" if word.isascii() else "^" + "".join(c if ord(c) < ALPHABET_END else "?" for c in word) + "$"
            for i in range(len(marked) - 1):
                grams[marked[i : i + 2]] += n


def document_terms(text: str) -> set[str]:
    """What a text may be told by: its words, marked "="; their beginnings, marked "^"; and
    beginnings of two different words or more, marked "+"."""
    words = {w for token in set(text.lower().split()) if (w := token.strip(EDGES)).isalpha()}
    stems = Counter(w[:n] for w in words for n in STEM_LENGTHS if n <= len(w))
    return {"=" + w for w in words} | {"^" + s for s in stems} | {"+" + s for s, n in stems.items() if n > 1}


def _term_counts(texts: DataFrame, among: set[str] | None) -> DataFrame:
    """Rows (term, toxic, n): in how many texts of each label a term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                terms = document_terms(text.as_py() or "")
                counts.update((t, toxic) for t in (terms if among is None else terms & among))
            rows = list(counts)
            columns = [pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int32()), pa.array([counts[r] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "n"])

    return texts.mapInArrow(run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, least_docs: int = 3, least_share: float = 0.9,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on at most `max_labelled` labelled rows, chosen by a hash of the id; the
    character model counts all of `docs`. A term may be kept if at least `least_docs` toxic
    texts have it and they are `least_share` of those that do; see _covering for which are."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").select("text", "toxic")
    texts = materialize(texts.dropDuplicates(["text"]), "labelled")
    toxic = _term_counts(texts.where("toxic = 1"), None).where(F.col("n") >= least_docs)
    held = {r["term"]: r["n"] for r in toxic.orderBy(F.desc("n"), "term").limit(4 * MAX_TERMS).collect()}
    clean = {r["term"]: r["n"] for r in _term_counts(texts.where("toxic = 0"), set(held)).collect()}
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    share = {t: (n + 0.1) / (n + clean.get(t, 0) + 0.2) for t, n in held.items() if n >= least_share * (n + clean.get(t, 0))}
    kinds: dict[str, dict[str, float]] = {"=": {}, "^": {}, "+": {}}
    for term in _covering(texts.where("toxic = 1"), share, least_docs):
        kinds[term[0]][term[1:]] = share[term]
    total = sum(sizes.values())
    base = sizes.get(1, 0) / total if total else 0.0
    counts = {r["gram"]: r["n"] for r in letter_counts(docs, text_col).collect()}
    model = _character_model(counts, [word for terms in kinds.values() for word in terms])
    return Model(kinds["="], kinds["^"], kinds["+"], min(0.5, base) / 2, *model)


def _covering(texts: DataFrame, share: dict[str, float], least_gain: int) -> list[str]:
    """Terms by which most texts are told from others: each next one has the most texts
    that no earlier one has, until none adds `least_gain`. Rare words that happen to
    stand in a few copies of one toxic text thus stay out."""
    terms = set(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(document_terms(text.as_py() or "") & terms) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    whole = [r["terms"] for r in texts.select("text").mapInArrow(run, "terms array<string>").collect()] if terms else []
    rows = [set(row) for row in whole]
    gains = Counter(t for row in rows for t in row)
    chosen: list[str] = []
    while gains and len(chosen) < MAX_TERMS:
        best = max(gains, key=lambda t: (gains[t] * share[t] ** 2, len(t), t))
        if gains[best] < least_gain:
            break
        chosen.append(best)
        for row in rows:
            if best in row:
                gains.subtract(row)
                row.clear()
        gains = +gains
    # Terms as frequent as these are no accident either, though the same texts have them.
    often = Counter(t for row in whole for t in row)
    bar = max(5, max((often[t] for t in chosen), default=0) / 3)
    for term in sorted((t for t in often if often[t] >= bar), key=lambda t: (-often[t] * share[t] ** 2, -len(t), t)):
        if len(chosen) < MAX_TERMS and not any(term[1:].startswith(c[1:]) or c[1:].startswith(term[1:]) for c in chosen):
            chosen.append(term)
    return chosen


def _character_model(counts: dict[str, int], terms: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Log probabilities of bigrams, and of trigrams inside the terms."""
    first, second = Counter(), {}
    for gram, n in counts.items():
        first[gram[0]] += n
    for gram, n in counts.items():
        second[gram] = math.log((n + 0.5) / (first[gram[0]] + 150))
    third, before = Counter(), Counter()
    for term in terms:
        marked = f"^^{term}$"
        for i in range(len(marked) - 2):
            third[marked[i : i + 3]] += 1
            before[marked[i : i + 2]] += 1
    return second, {gram: math.log(n / (before[gram[:2]] + 0.5)) for gram, n in third.items()}


class Scorer:
    """Token scores of one model, cached in each worker."""

    def __init__(self, model: Model):
        self.model = model
        # When the cache is full it becomes the old one, from which tokens in use come back.
        self.cache: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def letter(self, before: str, last: str, char: str) -> float:
        if ord(char) >= ALPHABET_END:
            char = "?"
        two = self.model.bigrams.get(last + char, -12.0) + math.log(0.5)
        three = self.model.trigrams.get(before + last + char)
        return two if three is None else max(two, three + math.log(0.5))

    def restore(self, token: str) -> str:
        """The likeliest letters behind a lower-case token."""
        token = re.sub(r"(.)\1{2,}", r"\1\1\1", token)
        # States are the last two letters; a value is (log probability, letters so far).
        states = {("^", "^"): (0.0, "")}
        runs = [(m.group(1), len(m.group(0))) for m in re.finditer(r"(.)\1*", token)]
        for char, times in runs:
            options = [char] if char.isalpha() else list(LOOKALIKES.get(char, ""))
            spelled = [(o * k, -0.2 * (times > 2) - (0.0 if o == char else 1.0) * k) for o in options for k in range(1, min(times, 2) + 1) if times > 2 or k == times]
            if not char.isalpha():
                spelled.append(("", -9.0 * times if char in LOOKALIKES else -0.5))
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for (before, last), (value, letters) in states.items():
                for added, cost in spelled:
                    a, b, total = before, last, value + cost
                    for c in added:
                        total += self.letter(a, b, c)
                        a, b = b, c
                    if (a, b) not in following or total > following[a, b][0]:
                        following[a, b] = (total, letters + added)
            states = following or states
        ends = [(value + self.letter(a, b, "$"), letters) for (a, b), (value, letters) in states.items()]
        return max(ends, default=(0.0, ""))[1]

    def plain(self, word: str) -> tuple[float, list[str]]:
        """The strongest term in a word, and beginnings that count when repeated."""
        model, doubled = self.model, []
        best = model.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if n > len(word):
                break
            best = max(best, model.stems.get(word[:n], 0.0))
            if word[:n] in model.repeats:
                doubled.append(word[:n])
        return best, doubled

    def token(self, token: str) -> tuple[float, list[str]] | None:
        """As plain(), over all readings; None if there is nothing."""
        if token in self.old:
            answer = self.old[token]
        else:
            found = [self.plain(word) for word in self.readings(token)]
            value, doubled = max(v for v, _ in found), sorted({s for _, stems in found for s in stems})
            answer = (value, doubled) if value or doubled else None
        if len(self.cache) >= CACHED_TOKENS:
            self.old, self.cache = self.cache, {}
        self.cache[token] = answer
        return answer

    def readings(self, token: str) -> list[str]:
        """The token without symbols around it and, if it may hide a word, restored."""
        core = token.strip(EDGES)
        found = [core]
        if core.isalpha():
            if TRIPLE(core):
                found.append(self.restore(core))
            return found
        if any(c.isalpha() for c in core):
            found.append(self.restore(core))
            bare = core.strip("$@€£0123456789")
            if bare != core:
                found.append(self.restore(bare))
            edged = token.strip(".,;:?\"'")
            if edged != core and len(edged) <= len(core) + 2:
                found.append(self.restore(edged))
        return found

    def spaced(self, tokens: list[str]) -> list[str]:
        """Letters of runs of one-character tokens, joined."""
        marks = "".join(["1" if len(t) == 1 else "0" for t in tokens])
        return ["".join(tokens[m.start() : m.end()]) for m in re.finditer("1" * SPACED_RUN + "+", marks)]

    def inside(self, letters: str) -> float:
        """The strongest term anywhere in letters whose word ends are lost."""
        words, stems, best = self.model.words, self.model.stems, 0.0
        for i in range(len(letters)):
            for j in range(i + min(STEM_LENGTHS), min(len(letters), i + LONGEST_TERM) + 1):
                part = letters[i:j]
                best = max(best, words.get(part, 0.0), stems.get(part, 0.0))
        return best

    def document(self, text: str) -> tuple[float, int]:
        """Score, and how many different terms it rests on."""
        tokens = text.lower().split()
        cache, token = self.cache, self.token
        found = [v for t in set(tokens) if (v := cache[t] if t in cache else token(t))]
        values = [value for value, _ in found if value]
        stems = Counter(stem for _, doubled in found for stem in doubled)
        values += [self.model.repeats[stem] for stem, n in stems.items() if n > 1]
        for letters in self.spaced(tokens):
            values.append(self.inside(letters if letters.isalpha() else self.restore(letters)))
        missed = 1.0 - self.model.floor
        for value in values:
            missed *= 1.0 - value
        return 1.0 - missed, sum(v > 0 for v in values)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, n_terms), one for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            made = [scorer.document(text.as_py() or "") for text in batch.column(1)]
            columns = [batch.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([n for _, n in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "n_terms"])

    return source.mapInArrow(run, "id long, score double, n_terms long")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """`docs` without those that score `least` or more. Texts are scored where they
    are, so no row moves, and rows with null or repeated ids are judged by their own texts."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in slices(batches):
            keep = [scorer.document(text.as_py() or "")[0] < least for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
