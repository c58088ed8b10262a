"""License scan by ordered signature rules.

A text becomes its words (ASCII letters in lower case; digits, letters and all that is
not ASCII), with single spaces between. Base phrases are counted at every place and
always label the text. The rules of `license_rules` follow, each only where one of its
keywords occurs. Their detections are intervals of words: those of higher priority come
first, longer ones first within a rule, and one that lies within an interval kept
already is suppressed. The score is the chance that at least one label is right, were
the labels' best weights independent.

Defined results: null, empty and wordless texts have zero words and places, null first and
last word, empty labels and score 0. Texts are read whole, whatever their length: an
expression looks ahead a bounded number of words. Each row is judged by itself, so
repeated rows, null ids and other columns change nothing; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.license_rules import BASE, WEIGHTS, rules

# Bytes to bytes: A-Z to a-z, and all other ASCII that is no digit or letter to space.
WORD_BYTES = bytes(b | 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
SPAN = "struct<label: string, form: string, first: long, last: long>"
SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    f"labels array<string>, score double, spans array<{SPAN}>"
)


def whole_words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


class Kept:
    """Intervals, none within another, that tell whether one of them holds a given interval."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        # Ends rise with starts, so the last interval that starts in time ends last.
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end

    def add(self, start: int, end: int) -> None:
        # Those within the new one go: it answers for them.
        low = bisect_left(self.starts, start)
        high = bisect_right(self.ends, end, lo=low)
        del self.starts[low:high], self.ends[low:high]
        insort(self.starts, start)
        insort(self.ends, end)


class Scanner:
    def __init__(self):
        self.base = [(phrase.encode(), label, whole_words(phrase)) for phrase, label in BASE]
        self.rules = [(rule, tuple(k.encode() for k in rule.keywords), whole_words(rule.pattern)) for rule in rules()]
        # Keywords by a part that they share, which is looked for first.
        self.keywords: dict[bytes, list[bytes]] = {}
        for keyword in sorted({k for _, keywords, _ in self.rules for k in keywords}):
            part = b" licen" if keyword.startswith(b"licen") else max((b" " + w for w in keyword.split()), key=len)
            self.keywords.setdefault(part, []).append(keyword)

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score, spans."""
        words = (text or b"").translate(WORD_BYTES).split()
        joined = b" ".join(words)
        found = [(m.start(), m.end(), label, "base") for phrase, label, pattern in self.base if phrase in joined for m in pattern.finditer(joined)]
        n_base, base_labels = len(found), sorted({label for _, _, label, _ in found})
        best = dict.fromkeys(base_labels, WEIGHTS["base"])
        marked = b" " + joined
        present = {k for part, keywords in self.keywords.items() if part in marked for k in keywords if b" " + k in marked}
        kept = Kept()
        for rule, keywords, pattern in self.rules if present else ():
            if not present.isdisjoint(keywords):
                for start, end in sorted((m.span() for m in pattern.finditer(joined)), key=lambda s: (s[0] - s[1], s[0])):
                    if not kept.holds(start, end):
                        kept.add(start, end)
                        found.append((start, end, rule.label, rule.form))
                        best[rule.label] = max(best.get(rule.label, 0.0), rule.weight)
        if not found:
            return len(words), 0, None, None, [], [], 0.0, []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        found.sort()
        first = np.searchsorted(spaces, [f[0] for f in found]).tolist()
        last = np.searchsorted(spaces, [f[1] for f in found]).tolist()
        spans = [{"label": f[2], "form": f[3], "first": a, "last": b} for f, a, b in zip(found, first, last, strict=True)]
        base = [s["first"] for s in spans if s["form"] == "base"]
        doubt = 1.0
        for label in sorted(best):
            doubt *= 1 - best[label]
        return len(words), n_base, min(base, default=None), max(base, default=None), base_labels, sorted(best), 1 - doubt, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one for
    each row of `docs`. Spans are the kept detections in order, by their first and last word."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    long, texts = pa.int64(), pa.list_(pa.string())
    types = [long, long, long, long, texts, texts, pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            if batch.num_rows:
                made = zip(*[scanner.scan(text.as_py()) for text in batch.column(1)], strict=True)
                arrays = [pa.array(list(column), kind) for column, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *names])

    return source.mapInArrow(run, SCHEMA)
