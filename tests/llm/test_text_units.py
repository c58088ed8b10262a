"""Operators' inner parts against definitions written out plainly."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

from pagemill.llm import common, line_dedup, lm_score, substring, toxicity
from pagemill.llm.common import bit_links
from pagemill.llm.sentencepiece_codec import Codec
from pagemill.llm.simhash import fingerprint, pivots

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_and_similarity():
    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randint(0, len(b)), rng.choice("abd ")) if rng.random() < 0.6 or not b else b.pop(rng.randrange(len(b)))
        b = "".join(b)
        assert line_dedup.edit_distance(a, b) == distance(a, b)
        assert line_dedup.similar(a, b, 0.8) == (distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_line_simhash_is_a_majority_of_word_hashes():
    lines = [[b"a", b"b", b"c"], [b"x"] * 5 + [b"y"], [b"w%d" % i for i in range(250_000)], [b"z"]]
    got = line_dedup.simhashes([w for line in lines for w in line], [len(line) for line in lines]).view(np.uint64)
    for line, value in zip(lines, got, strict=True):
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(w) for w in line], np.uint64).view(np.uint8)).reshape(-1, 64)
        assert np.packbits(2 * bits.sum(axis=0) > len(line)).view(np.uint64)[0] == value


def test_fingerprint_definition():
    def plain(text):
        words = text.lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes) > 0)
        return value - (1 << 64) if value >> 63 else value

    for text in (b"", b" \n\t", b"one", b"One two THREE", b"a b c d", b"a b c d " * 7, "É é x y z w v".encode(), None):
        assert fingerprint(text, 4) == plain(text or b"")


def test_pivot_links_connect_as_all_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(40):
        centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        prints = np.unique([c ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)).tolist()))) for c in centres for _ in range(12)])
        root = {i: i for i in range(prints.size)}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(prints.size):
            for b in range(a):
                if int(prints[a] ^ prints[b]).bit_count() <= 4:
                    root[find(a)] = find(b)
        links = bit_links(prints, 4, pivots(16))
        assert all(int(prints[a] ^ prints[b]).bit_count() <= 4 for a, b in links)
        assert len(links) == prints.size - len({find(i) for i in root})


@pytest.fixture(scope="module")
def codecs():
    return Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_the_library(codecs):
    own, library = codecs
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "\n\n", "▁a▁▁b", "<s></s><unk><0x41>", "a\x00b", "naïve 中文 😀!", " " * 37 + "x", "ab" * 400]
    texts += ["".join(rng.choice(" ▁\n abcdetheing中😀.,é") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.round_trip(text) == (",".join(map(str, ids)), library.decode(ids))
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 3, 130, 258, 259, rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_chains_are_the_best_of_all():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 9)
        right = sorted(rng.sample(range(60), n))
        left = [rng.randrange(60) for _ in range(n)]
        best = [float(substring.K)] * n
        for i in range(n):
            for j in range(i):
                if left[j] < left[i]:
                    gap = substring.GAP * (left[i] - left[j] + right[i] - right[j])
                    best[i] = max(best[i], substring.K + best[j] - gap)
        chain = substring.chains(left, right)[0]
        got = substring.K * len(chain) - substring.GAP * sum(
            left[b] - left[a] + right[b] - right[a] for a, b in zip(chain, chain[1:], strict=False))
        assert abs(got - max(best)) < 1e-6
        assert all(left[a] < left[b] and right[a] < right[b] for a, b in zip(chain, chain[1:], strict=False))


def test_hidden_words_are_restored():
    counts = {g: 50 for w in ("^the$", "^thing$", "^other$", "^idea$") for g in (w[i : i + 2] for i in range(len(w) - 1))}
    model = toxicity.Model({"idiot": 0.99}, {"stupi": 0.99}, {}, 0.05, *toxicity._character_model(counts, ["idiot", "stupi"]))
    scorer = toxicity.Scorer(model)
    for text in ("an 1d10t", "so stuuuuupid", "st*pid!!", "s-t-u-p-i-d", "an i d i o t here", "IDIOT."):
        assert scorer.document(text)[0] > 0.7, text
    for text in ("", "a b c d e", "the 1000 things", "$$$ *** ###", "x" * 5000, "555-2186"):
        assert scorer.document(text)[0] < 0.7, text


def test_pieces_stand_side_by_side_exactly_where_merging_leaves_them():
    model = Codec(MODEL)
    rng = random.Random(8)
    pieces = sorted(model.shorter)
    short = [p for p in pieces if len(p) <= 3]
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(1500)] + [(rng.choice(short), rng.choice(short)) for _ in range(1500)]
    pairs += [(p, p) for p in rng.sample(pieces, 200)]
    assert all(model.compatible(a, b) == (model.merge(a + b) == [a, b]) for a, b in pairs)


def test_simhashes_of_lines_beyond_byte_counts():
    rng = random.Random(11)
    sizes = [1, 254, 255, 256, 3, 700, 5_000, 2]
    words = [b"%d" % rng.randrange(6) for _ in range(sum(sizes))]
    for some in (sizes, [n for n in sizes if n < 256]):
        got, at = line_dedup.simhashes(words[: sum(some)], some).view(np.uint64).tolist(), 0
        for n, value in zip(some, got, strict=True):
            hashes = [xxhash.xxh64_intdigest(w) for w in words[at : at + n]]
            bits = [2 * sum(h >> bit & 1 for h in hashes) > n for bit in range(64)]
            assert value == sum(on << bit for bit, on in enumerate(bits))
            at += n


def test_batches_of_texts_are_cut_into_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_500))], ["x"])
    cut = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert [b.num_rows for b in cut] == [1000, 1000, 500, 3]
    assert pa.Table.from_batches(cut).column("x").to_pylist() == [*range(2_500), 0, 1, 2]


def test_windows_do_not_cross_texts():
    codes = [[1, 2, 3], [], [4], [0, 5]]
    column = pa.array([np.array(c, np.uint8).tobytes() for c in codes], pa.binary())
    (sizes, padded, at), = lm_score._windows(column, 9, 9)
    assert sizes.tolist() == [3, 0, 1, 2] and padded[at].tolist() == [1, 2, 3, 4, 0, 5]
    around = np.stack(lm_score._around(padded, at), axis=1).tolist()
    assert around == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 9, 9], [9, 9, 5, 9], [9, 0, 9, 9]]


def edited(rng, text, share):
    out = []
    for c in text:
        if rng.random() >= share:
            out.append(c)
        elif rng.random() < 0.7:
            out += rng.choice("abñ語 ") if rng.random() < 0.5 else [c, rng.choice("xyz")]
    return "".join(out)


def test_no_bound_passes_the_edit_distance():
    rng, texts = random.Random(3), ["", "a", "b" * 64]
    for _ in range(60):
        base = "".join(rng.choice("abcdefgh éß語") for _ in range(rng.choice([3, 30, 63, 64, 65, 128, 200, 300])))
        texts += [base, edited(rng, base, rng.choice([0.02, 0.1, 0.2, 0.4])), edited(rng, base[rng.randint(0, 9) :], 0.1)]
    one, other = np.array([(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(600)] + [(i, i + 1) for i in range(len(texts) - 1)]).T
    most = np.array([0.2 * max(len(texts[i]), len(texts[j])) + 1e-9 for i, j in zip(one, other, strict=True)])
    far = line_dedup.apart(texts, one, other, most)
    truly = np.array([line_dedup.edit_distance(texts[i], texts[j]) > limit for i, j, limit in zip(one, other, most, strict=True)])
    assert not (far & ~truly).any() and (~truly).sum() > 60
    alike = np.array([abs(len(texts[i]) - len(texts[j])) <= limit for i, j, limit in zip(one, other, most, strict=True)])
    assert (far & alike).sum() > 0.8 * (truly & alike).sum() > 20


def test_lines_of_one_simhash_are_seldom_compared_in_full(monkeypatch):
    """Frequent words decide a SimHash, so unlike lines share it; their number of pairs is a square."""
    rng, texts = random.Random(4), []
    for _ in range(250):
        line = "".join(rng.choice("abcdefghijk ") for _ in range(rng.randint(150, 200)))
        texts += [line, edited(rng, line, 0.03)] if rng.random() < 0.2 else [line]
    prints = np.full(len(texts), 7, np.uint64)
    prints[::3] ^= np.uint64(3)
    prints[::5] ^= np.uint64(12)
    compared = []
    monkeypatch.setattr(line_dedup, "similar", lambda a, b, least, plain=line_dedup.similar: compared.append(1) or plain(a, b, least))
    links = line_dedup.text_links(prints, texts, 3, 0.8)
    assert len(compared) < 4 * len(texts)  # of 40,000 pairs
    monkeypatch.undo()
    near = [(i, j) for i in range(len(texts)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    expected = [(i, j) for i, j in near if abs(len(texts[i]) - len(texts[j])) <= 40 and line_dedup.edit_distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-9]

    def groups(pairs):
        root = list(range(len(texts)))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return {frozenset(k for k in range(len(texts)) if root[k] == r) for r in root}

    assert len(expected) > 30 and groups(links) == groups(expected)
