"""Conversation repair, lexical search and license scan: against brute force, and on awkward rows."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import conversation_repair as repairs
from pagemill.llm import lexical_search as lexical
from pagemill.llm import license_scan as licenses
from pagemill.llm.license_rules import BASE, rules
from tests.llm.test_operators import AWKWARD, DOCS

TURNS = "conv_id long, turn int, role string, text string, key string, seq string, at string"
LEAVES = {token: repairs.turn_cell(token) for token in repairs.TOKENS}


def token(initial, fault=0):
    return repairs.TOKENS[3 * repairs.INITIALS.index(initial) + fault]


def cheapest(tokens):
    """The least (cost, audit) over all edit sequences, by uniform-cost search over whole audits."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        if at == len(tokens) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (at, roles, audit) in done or len(roles) > len(tokens) + 3:
            continue
        done.add((at, roles, audit))
        for role in "ua":
            heapq.heappush(queue, (cost + 3, audit + "I", at, roles + role))
        if at < len(tokens):
            initial, fault = divmod(repairs.TOKENS.index(tokens[at]), 3)
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, roles))
            if fault < 2:
                more = 3 * fault
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + repairs.INITIALS[initial]))
                for role in "ua":
                    heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, roles + role))


def whole_chart(tokens):
    """The textbook chart: every span, every split."""
    n = len(tokens)
    chart = {(i, i + 1): LEAVES[tokens[i]] for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = {}
            for k in range(i + 1, i + size):
                for pair, found in repairs.combine(chart[i, k], chart[k, i + size]).items():
                    cell[pair] = min(cell.get(pair, found), found)
            chart[i, i + size] = cell
    return chart[0, n]


def best_of(cell):
    return min(cell[0, 0], cell[0, 3])


def test_parse_is_the_cheapest_and_the_least_of_all_edit_sequences():
    rng = random.Random(1)
    for _ in range(150):
        tokens = "".join(rng.choice(repairs.TOKENS) for _ in range(rng.randrange(1, 5)))
        assert best_of(repairs.parse(tokens, LEAVES)) == cheapest(tokens), tokens


def test_one_split_for_each_span_equals_the_whole_chart():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 16, 25):
        tokens = "".join(rng.choice(repairs.TOKENS) for _ in range(n))
        assert repairs.parse(tokens, LEAVES) == whole_chart(tokens)


def turn_rows(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No.", "", " \n", f"Text {turn}.", f"Cut {turn}", "Wow!"])
            rows.append((conv, turn if rng.random() > 0.1 else None, role, text))
    return rows


def repaired_plainly(rows):
    """Report and lines of one conversation's rows (turn, role, text)."""
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2])))
    seen, tokens, faults = set(), "", Counter()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        tokens += token(initial, 1 if fault == "truncated" else 2 if fault else 0)
    cost, audit = best_of(whole_chart(tokens))
    source, lines = iter(rows), []
    odd = (len(audit) - audit.count("D")) % 2
    for edit in audit:
        row = None if edit == "I" else next(source)
        if edit != "D":
            role = row[1] if edit == "K" else ("user", "assistant")[(len(lines) - odd) % 2]
            lines.append(f"{role}:{row[2] if row else ''}")
    two = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(x not in ("su", "ua", "au") for x in two)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("chunk_bits", [1, 10])
def test_repairs_equal_a_plain_chart_whatever_the_chunks(spark, monkeypatch, chunk_bits):
    monkeypatch.setattr(repairs, "CHUNK_BITS", chunk_bits)
    rng = random.Random(3)
    rows = turn_rows(rng, 12, 9) + [(99, t, r, x) for _, t, r, x in turn_rows(rng, 1, 2) * 3 + turn_rows(rng, 1, 60)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "true AS present")
    got = {r[0]: tuple(r)[1:] for r in repairs.digest(repairs.repair(turns)).collect()}
    want = {conv: repaired_plainly([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert got == want


def test_damage_and_repair_of_awkward_conversations(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (5, 0, "user", "Hi."), (5, 0, "user", "Hi."), (6, 2**31 - 1, "", ""),
        (6, -(2**31), "system", "Be brief."), (7, 1, "user", "long. " * 40_000), (7, 2, "assistant", "Ok."),
    ]
    turns = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    found = repairs.digest(repairs.repair(repairs.damage(turns)))
    got = found.collect()
    assert {r.conv_id for r in got} == {None, 5, 6, 7} and len(got) == 4
    assert all(r.gaps >= 0 and r.cost >= 0 for r in got)
    assert dict(found.dtypes)["conv_id"] == "bigint"
    assert repairs.digest(repairs.repair(repairs.damage(turns.limit(0)))).count() == 0
    gone = turns.selectExpr("conv_id AS conv", "CAST(turn AS long) AS turn", "role", "text", "false AS present")
    empty = hashlib.sha256().hexdigest()
    assert {tuple(r)[1:] for r in repairs.digest(repairs.repair(gone)).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}


def searched_plainly(docs, queries, k):
    """Every document scored for every query."""
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    counts = [(number, Counter(split(text))) for number, text in docs]
    counts = [(number, c, c.total()) for number, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    found = []
    for item, text in queries:
        scores = []
        for number, c, n in counts:
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for t in split(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, number is None, number or 0))
        found += [(item, i + 1, None if none else number, -score) for i, (score, none, number) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=str)


def made_texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "Straße", "42", "a-b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=int(rng.expovariate(1 / 40)) + 1)) for _ in range(n)]


@pytest.mark.parametrize("query_terms", [5, 50_000])
def test_search_equals_scoring_every_document(spark, query_terms):
    rng = random.Random(4)
    texts = made_texts(rng, 300)
    docs = [(i, text) for i, text in enumerate(texts)]
    docs += [(1000 - i, texts[7]) for i in range(40)] + [(3, texts[3]), (None, texts[9]), (None, None), (2000, ""), (2001, "?!"), (2002, "rare " + texts[5])]
    queries = [(0, texts[7]), (1, "w1 w1 w50 Rare"), (1, "w1"), (2, None), (3, " , "), (None, "W40 w41 w42 été"), (4, "unheard of")]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string").repartition(5)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = lexical.rank(table, asked, k=10, query_terms=query_terms)
    assert sorted(map(tuple, got.collect()), key=str) == searched_plainly(docs, queries, 10)


def test_bounds_never_fall_below_scores(monkeypatch):
    rng = random.Random(5)
    texts = [text.encode() for text in made_texts(rng, 200)]
    block = lexical.Block(64)
    monkeypatch.setattr(lexical, "BITS", 2)  # a crowded matrix, with many false bits
    crowded = lexical.Block(64)
    for i, text in enumerate(texts):
        for made in (block, crowded):
            made.add(str(i), Counter(lexical.terms(text)), len(lexical.terms(text)))
    asked = lexical.Queries([(i, lexical.terms(text)) for i, text in enumerate(texts[:20])])
    df = Counter(t for text in texts for t in set(lexical.terms(text)))
    asked.weigh(len(texts), sum(len(lexical.terms(t)) for t in texts), df)
    for made in (block.row(), crowded.row()):
        for number, bound in asked.bounds(made):
            exact = [next(asked.score(lexical.terms(text), [number]))[1] for text in texts]
            assert (bound >= np.array(exact)).all()


def test_awkward_and_empty_tables_of_search_and_scan(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    queries = spark.createDataFrame([(1, "word line"), (2, None)], "item_id long, text string")
    found = lexical.rank(docs, queries)
    assert [tuple(r)[:3] for r in found.orderBy("rank").collect()] == [(1, 1, 5), (1, 2, 4), (1, 3, 4)]
    assert lexical.rank(docs, queries.limit(0)).count() == 0
    assert lexical.rank(docs.limit(0), queries).count() == 0
    scanned = licenses.scan(docs)
    assert scanned.count() == len(AWKWARD) and scanned.where("score = 0 AND size(labels) = 0").count() == len(AWKWARD)
    assert scanned.where("n_words = 30000 AND first_word IS NULL").count() == 2
    assert licenses.scan(docs.limit(0)).count() == 0


CASES = {
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "Released under the MIT License.": {"mit"},
    "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
    "see https://www.gnu.org/licenses/lgpl-2.1.html": {"lgpl-2.1"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": {"mit"},
    "Copyright (c) 2021 Somebody. All rights reserved.": {"copyright-notice", "reserved"},
    "Mozilla Public License v2.0 or the Eclipse Public License": {"mpl-2.0", "epl"},
    "Licensed under the Frobnication License": {"license-reference"},
    "Ich gehe mit der Lizenz nach Hause": set(),
    "permit license; submit licenses": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_labels(text):
    assert set(licenses.Scanner().scan(text.encode())[5]) == CASES[text]


def test_every_rule_is_found_by_its_keywords():
    """No expression matches a text that its keywords do not let through."""
    made = rules()
    assert len(made) > 300 and len({(r.form, r.pattern) for r in made}) == len(made)
    scanner = licenses.Scanner()
    gates = {(rule.form, rule.pattern): keywords for rule, keywords, _ in scanner.rules}
    for text in CASES:
        joined = b" ".join(text.encode().translate(licenses.WORD_BYTES).split())
        for rule in made:
            if licenses.whole_words(rule.pattern).search(joined):
                assert any(b" " + k in b" " + joined for k in gates[rule.form, rule.pattern]), (rule, text)


def test_base_places_by_brute_force():
    rng = random.Random(6)
    scanner = licenses.Scanner()
    for _ in range(200):
        text = "".join(rng.choice(["CC", "by", "General", "public", "license", "all", "rights", "reserved", "é", "x"]) + rng.choice([" ", " ", "-", "\n", "", "."]) for _ in range(60))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        places = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        n_words, n_base, first, last, base, labels, score, spans = scanner.scan(text.encode())
        assert (n_words, n_base) == (len(words), len(places))
        assert (first, last) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert base == sorted({label for _, label in places}) and set(base) <= set(labels) and 0 <= score <= 1


def test_suppression_by_brute_force():
    """What is kept: each detection, by priority, unless one kept before holds it."""
    rng = random.Random(7)
    scanner = licenses.Scanner()
    pieces = list(CASES) + ["gpl 3", "apache", "mit license", "the terms of the license", "under", "cc by sa 4 0"]
    for _ in range(60):
        joined = b" ".join(" ".join(rng.choices(pieces, k=6)).encode().translate(licenses.WORD_BYTES).split())
        kept = []
        for rule, keywords, pattern in scanner.rules:
            if any(b" " + k in b" " + joined for k in keywords):
                for start, end in sorted((m.span() for m in pattern.finditer(joined)), key=lambda s: (s[0] - s[1], s[0])):
                    if not any(a <= start and end <= b for a, b, *_ in kept):
                        kept.append((start, end, rule.label, rule.form))
        place = lambda at: joined.count(b" ", 0, at)
        want = sorted((place(a), place(b), label, form) for a, b, label, form in kept)
        spans = scanner.scan(joined)[7]
        assert sorted((s["first"], s["last"], s["label"], s["form"]) for s in spans if s["form"] != "base") == want


def test_scan_returns_one_row_for_each_document(spark):
    docs = spark.createDataFrame([(1, "All rights reserved, all rights reserved"), (1, "x " * 50_000 + "cc-by"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r)[:6] for r in licenses.scan(docs).collect() if r.id)
    assert got == [(1, 6, 2, 0, 3, ["reserved"]), (1, 50_002, 1, 50_000, 50_000, ["cc-by"])]
