"""Masked pseudo-likelihood: every word is predicted from its neighbours on both sides.

Words are counted over the whole corpus and dealt to classes of about equal frequency. A small
network, trained in numpy, predicts the class of a word from the classes of the `WINDOW`
words before and after it; within a class a word has its corpus share. A document's
score is the sum of the log probabilities of all its words, each given all its neighbours.
Every word of every text is trained on in each round.

The most frequent words come to the driver and get classes by their frequency. All others are dealt
to the remaining classes by a hash, and their counts are joined, so no task holds them all.

Defined results: null, blank and empty texts have no tokens, a sum of zero and a null mean;
an empty table gives no rows. Very long texts are read whole, in blocks; rows that repeat an id, or
have none, are trained on and scored one by one; ties in frequency go to the smaller word; other
columns are ignored. Weights are averaged over the tasks of a round, so scores depend a little on
how the input is split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import materialize

WINDOW = 2
BLOCK = 2_048
BATCH = 512
WORDS_HELD = 200_000
MOST_COUNTED = 300_000


@dataclass
class Vocabulary:
    """The most frequent words with their classes; other words have the classes from first_rest."""

    words: dict[str, int]
    class_of: np.ndarray
    log_inside: np.ndarray
    log_prior: np.ndarray
    log_sums: np.ndarray
    first_rest: int


def rest_class(word: str, first: int, classes: int) -> int:
    return first + xxhash.xxh64_intdigest(word.encode()) % (classes - first)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over all texts, in lower case; counted in the tasks first."""
    source = docs.select(F.col(text_col).cast("string").alias("text"))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").lower().split())
                if len(counts) > MOST_COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int, classes: int) -> Vocabulary:
    """`size` words come to the driver; of the rest, only the sums of their classes. The rest has
    a share of the classes that fits its share of the corpus."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    words = {r["word"]: i for i, r in enumerate(top)}
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = sum(r["n"] for r in top)
    n_rest = min(classes - 1, max(1, round(classes * (total - known) / total))) if total > known else 0
    first_rest, at, filled, class_of = classes - n_rest, 0, 0.0, []
    for r in top:  # frequent words get classes of their own, others share
        class_of.append(at)
        filled += r["n"]
        if filled >= known * (at + 1) / first_rest and at < first_rest - 1:
            at += 1
    class_of, n = np.array(class_of, np.int32), np.array([r["n"] for r in top], np.float64)
    sums = np.bincount(class_of, n, classes)
    if n_rest:
        shared = counts.sparkSession.sparkContext.broadcast(set(words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = [0] * classes
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if word not in shared.value:
                        part[rest_class(word, first_rest, classes)] += n
            yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(part, pa.int64())], ["class", "n"])

        parts = counts.select("word", "n").mapInArrow(run, "class int, n long")
        for r in parts.groupBy("class").agg(F.sum("n").alias("n")).collect():
            sums[r["class"]] += r["n"]
    log_sums = np.log(np.maximum(sums, 1))
    prior = np.log((sums + 1) / (sums.sum() + classes))
    return Vocabulary(words, class_of, np.log(n) - log_sums[class_of], prior, log_sums, first_rest)


class Network:
    """Class embeddings for each place of the window, a rectified hidden layer, and a softmax over classes."""

    def __init__(self, classes: int, hidden: int, weights: np.ndarray):
        places, cut = 2 * WINDOW, 2 * WINDOW * (classes + 1) * hidden
        self.embed = weights[:cut].reshape(places, classes + 1, hidden)
        self.bias = weights[cut : cut + hidden]
        self.out = weights[cut + hidden : cut + hidden + hidden * classes].reshape(hidden, classes)
        self.out_bias = weights[cut + hidden + hidden * classes :]

    @staticmethod
    def start(prior: np.ndarray, hidden: int) -> np.ndarray:
        classes, rng = prior.size, np.random.default_rng(0)
        embed = rng.normal(0, 0.3, 2 * WINDOW * (classes + 1) * hidden)
        out = rng.normal(0, 0.1, hidden * classes)
        return np.concatenate([embed, np.full(hidden, 0.1), out, prior]).astype(np.float32)

    def hidden(self, contexts: list[np.ndarray]) -> np.ndarray:
        h = self.embed[0].take(contexts[0], axis=0)
        for place in range(1, len(contexts)):
            h += self.embed[place].take(contexts[place], axis=0)
        h += self.bias
        return np.maximum(h, 0, out=h)

    def logits(self, h: np.ndarray) -> np.ndarray:
        made = h @ self.out
        made += self.out_bias
        made -= made.max(axis=1, keepdims=True)
        return made

    def log_prob(self, contexts: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        logits = self.logits(self.hidden(contexts))
        chosen = logits[np.arange(target.size), target]
        return chosen - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))

    def step(self, contexts: list[np.ndarray], target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss of a batch."""
        n, each = target.size, np.float32(rate / target.size)
        h = self.hidden(contexts)
        p = self.logits(h)
        np.exp(p, out=p)
        p *= (each / (p @ np.ones(p.shape[1], np.float32)))[:, None]
        p[np.arange(n), target] -= each
        back = p @ self.out.T
        back *= h > 0
        every = np.ones(n, np.float32)
        self.out -= h.T @ p
        self.out_bias -= every @ p
        self.bias -= every @ back
        places, classes, width = self.embed.shape
        hits = np.zeros((places, classes, n), np.float32)
        for place, context in enumerate(contexts):
            hits[place, context, np.arange(n)] = 1
        self.embed -= (hits.reshape(-1, n) @ back).reshape(places, classes, width)


def _windows(codes: pa.Array, classes: int, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: their numbers of words, the classes of the words with `pad` around each
    text, and the places of the words among these."""
    kind, at = code_type(classes), 0
    sizes = np.array([len(text) // kind.itemsize for text in codes.to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    while at < sizes.size:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + WORDS_HELD, "right")))
        some = sizes[at:upto]
        places = np.arange(some.sum()) + np.repeat(2 * WINDOW * np.arange(some.size) + WINDOW, some)
        padded = np.full(places.size + 2 * WINDOW * some.size, pad)
        padded[places] = np.frombuffer(b"".join(codes.slice(at, upto - at).to_pylist()), kind)
        yield some, padded, places
        at = upto


def code_type(classes: int) -> np.dtype:
    return np.dtype(np.uint8 if classes <= 256 else np.uint16 if classes <= 65_536 else np.uint32)


def _around(padded: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [padded.take(at + d) for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1))]


def coded(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, codes, part, rest), one for each row of `docs`: the classes of its words, the
    logs of their shares of these but for the counts of the words in `rest`."""
    classes = words.log_prior.size
    shared = docs.sparkSession.sparkContext.broadcast(astuple(words))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = Vocabulary(*shared.value), code_type(classes)
        get = known.words.get
        for batch in batches:
            sizes, codes, parts, ends, rest_words, rest_counts = [], [], [], [0], [], []
            for text in batch.column(1):
                tokens = (text.as_py() or "").lower().split()
                places = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
                rare = np.flatnonzero(places < 0)
                rest = [tokens[i] for i in rare.tolist()]
                found = np.zeros(places.size, kind)
                frequent = places[places >= 0]
                found[places >= 0] = known.class_of[frequent]
                found[rare] = [rest_class(word, known.first_rest, classes) for word in rest]
                parts.append(float(known.log_inside[frequent].sum()) - float(known.log_sums[found[rare]].sum()))
                counted = Counter(rest)
                rest_words += counted
                rest_counts += counted.values()
                ends.append(len(rest_words))
                sizes.append(places.size)
                codes.append(found.tobytes())
            rest = pa.StructArray.from_arrays([pa.array(rest_words, pa.string()), pa.array(rest_counts, pa.int64())], ["word", "k"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(parts, pa.float64()), rest]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "codes", "part", "rest"])

    return source.mapInArrow(run, "id long, n_tokens long, codes binary, part double, rest array<struct<word: string, k: long>>")


def train(coded: DataFrame, prior: np.ndarray, hidden: int, rounds: int, stride: int, rate: float) -> np.ndarray:
    """Weights after `rounds` of parallel descent: every task starts from the same weights, learns from
    all words of its part (or one in `stride` of each text), and the results are averaged by their
    number of words, in Spark. What trains grows with the corpus; what comes back doesn't."""
    classes, weights = prior.size, Network.start(prior, hidden)
    for number in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], number=number, shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()
            network, seen = Network(classes, hidden, own), 0
            held = np.empty((2 * WINDOW + 1, 0), np.int64)

            def learn(least: int) -> None:
                """Steps over what is held; fewer than `least` windows are kept for later."""
                nonlocal held, seen
                at, size = 0, held.shape[1]
                while size - at >= least:
                    *around, target = held[:, at : at + BATCH]
                    network.step(around, target, rate)
                    seen += target.size
                    at += target.size
                held = held[:, at:].copy()

            for batch in batches:
                for sizes, padded, at in _windows(batch.column(0), classes, classes):
                    if stride > 1:
                        first = np.where(sizes > stride, (sizes + number) % stride, 0)
                        own_place = np.arange(at.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        wanted = own_place - np.repeat(first, sizes)
                        at = at[(wanted >= 0) & (wanted % stride == 0)]
                    held = np.concatenate([held, [*_around(padded, at), padded[at]]], axis=1)
                    learn(BATCH)
            if held.size:
                learn(1)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float32())), pa.array([seen], pa.int64())], ["w", "n"])

        parts = coded.select("codes").mapInArrow(run, "w array<float>, n long").select("n", F.posexplode("w").alias("i", "w"))
        mean = parts.groupBy("i").agg((F.sum(F.col("w").cast("double") * F.col("n")) / F.sum("n")).alias("w"))
        found = mean.collect()
        if found:
            weights = np.array([r["w"] for r in sorted(found)], np.float32)
    return weights


def score(
    docs: DataFrame, size: int = 8192, classes: int = 64, hidden: int = 32, rounds: int = 2, stride: int = 1, rate: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_tokens, log_prob, mean_log_prob), one for each row of `docs`."""
    counts = materialize(word_counts(docs, text_col), "word-counts")
    words = vocabulary(counts, size, classes)
    # Written once: two rounds of training and the scores read the classes of the words, not the
    # texts, and row numbers hold.
    made = coded(docs, words, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    made = materialize(made, "lm-codes")
    shared = docs.sparkSession.sparkContext.broadcast(train(made, words.log_prior, hidden, rounds, stride, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(classes, hidden, shared.value)
        for batch in batches:
            sums = []
            for sizes, padded, places in _windows(batch.column(3), classes, classes):
                probs = np.zeros(places.size)
                for start in range(0, places.size, BLOCK):
                    at = places[start : start + BLOCK]
                    probs[start : start + BLOCK] = network.log_prob(_around(padded, at), padded[at])
                own, some = np.zeros(sizes.size), sizes > 0
                if some.any():
                    own[some] = np.add.reduceat(probs, (np.cumsum(sizes) - sizes)[some])
                sums += own.tolist()
            part = pc.add(batch.column(4), pa.array(sums, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], part], ["row", "id", "n_tokens", "part"])

    scored = made.select("row", "id", "n_tokens", "codes", "part").mapInArrow(run, "row long, id long, n_tokens long, part double")
    rare = made.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.k").alias("k"))
    logs = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("k") * F.log("n")).alias("rare"))
    log_prob = F.col("part") + F.coalesce("rare", F.lit(0.0))
    joined = scored.join(logs, "row", "left")
    mean = F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens"))
    return joined.select("id", "n_tokens", log_prob.alias("log_prob"), mean.alias("mean_log_prob"))
