"""Whole operators on small tables: against brute force, and on awkward rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import (
    line_dedup, lm_score, mixing, quality, sentencepiece_codec, simhash, substring, toxicity, url_filter, vector_search,
)
from pagemill.llm.queries import MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, cell string"
AWKWARD = [
    (1, None, None, None, None, 1, "x", "c"), (2, "", "en", "s", 0, 2, None, None), (None, "some words here", None, "s", 3, 3, "", ""),
    (3, " \n\t ", "en", None, 4, 4, "h", "c"), (4, "word " * 30_000, "en", "t", 5, 5, "h", "c"), (4, "word " * 30_000, "en", "t", 5, 5, "h", "c"),
    (5, "a line of text\n" * 3, "en", "s", 6, 6, "h", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta zeta iota".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_and_empty_tables(spark, awkward, empty):
    docs = awkward.limit(0) if empty else awkward
    n = 0 if empty else len(AWKWARD)
    labels = spark.createDataFrame([(5, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).where("score BETWEEN 0 AND 1").count() == n
    assert toxicity.drop_toxic(docs, model).count() == n
    assert quality.judge(docs).count() == n
    assert quality.keep_good(docs).count() == (1 if n else 0)
    assert lm_score.score(docs).count() == n
    assert sentencepiece_codec.round_trip(docs, MODEL).count() == n
    coded = sentencepiece_codec.encode(docs, MODEL)
    assert sentencepiece_codec.decode(coded, MODEL).where("text IS NOT NULL").count() == n
    assert mixing.mix(docs).count() == n
    assert mixing.apply_mix(docs).columns == docs.columns
    found = simhash.near_duplicates(docs)
    assert found.count() == n and found.where("print = 0 AND component <> 1").count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == ([] if empty else [0, 1, 4, 4, 5])
    lines = line_dedup.drop_lines(docs)
    assert lines.columns == docs.columns and lines.count() == n
    assert substring.passages(docs).count() == 0


def test_simhash_components_by_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        words = sentence(rng, rng.randint(30, 300)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    prints = [simhash.fingerprint(t.encode(), 4) % (1 << 64) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["component"] for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_lines_keep_one_of_each_group(spark):
    rng = random.Random(4)
    common = sentence(rng, 60)
    changed = common.replace(common.split()[30], "other", 1)
    docs = spark.createDataFrame([
        (1, sentence(rng, 40) + "\n" + common), (2, changed + "\n" + sentence(rng, 40)), (3, common.upper() + "!\n\n" + common + "\nown line"),
    ], "doc_id long, text string")
    found = {r["id"]: r["removed"] for r in line_dedup.removed_lines(docs, max_bits=12).collect()}
    assert found == {1: [], 2: [0], 3: [0, 2]}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, max_bits=12).collect()}
    assert texts[3] == "\nown line" and texts[1].endswith(common)
    exact = {r["id"]: r["removed"] for r in line_dedup.removed_lines(docs, similarity=1.0).collect()}
    assert exact == {1: [], 2: [], 3: [0, 2]}


def test_passages_are_found_with_their_ends(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))] for _ in range(40)]
    passage = [f"p{rng.randrange(3000)}" for _ in range(70)]
    places = {}
    for i in range(12):
        at, mine = rng.randrange(len(base[i])), list(passage)
        if i % 2:
            mine[20], mine[45] = f"edit{i}", f"edit{i}x"
        base[i][at:at] = mine
        places[i] = (at, at + 70)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(base)], "doc_id long, text string")
    spans = substring.repeated_spans(substring.passages(docs)).collect()
    assert {r["id"] for r in spans} == set(places)
    assert all((r["start"], r["end"]) == places[r["id"]] for r in spans)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(1, 30)), rng.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, budgets=(0.2, 0.6, 1.0)).withColumn("c", F.col("copies"))
    by_source = mixed.groupBy("source", "source_size", "target").agg(
        *[F.sum(F.col("size") * F.col("c")[i]).alias(f"t{i}") for i in range(3)]).collect()
    assert len(by_source) == 3
    for r in by_source:
        assert r["target"] <= 3 * r["source_size"]
        assert all(abs(r[f"t{i}"] - part * r["target"]) <= 40 for i, part in enumerate((0.2, 0.6, 1.0)))
    assert mixed.where("c[0] > c[1] OR c[1] > c[2] OR c[2] > 3").count() == 0
    taken = mixing.apply_mix(docs).groupBy("doc_id").count()
    assert taken.join(mixed.select(F.col("id").alias("doc_id"), F.col("c")[2].alias("n")), "doc_id").where("count <> n").count() == 0


def test_trees_find_the_nearest(spark, monkeypatch):
    rng = random.Random(7)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i) for i in range(1500)]
    vectors += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [None] * 8, 0), (2050, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (3, vectors[3][1], 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, shard int")
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 400)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 10)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    whole = {i: v for i, v, _ in vectors[:1500]}
    best = {q: sorted(((-cosine(whole[q], v), i) for i, v in whole.items() if i != q))[:5] for q in whole if q % 50 == 0}
    found = vector_search.nearest(table, F.col("id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in found} == {(q, n + 1, i) for q, near in best.items() for n, (_, i) in enumerate(near)}
    loose = vector_search.nearest(table, F.col("id") % 50 == 0, factor=0.7).collect()
    hits = len({(r["query_id"], r["id"]) for r in loose} & {(r["query_id"], r["id"]) for r in found})
    assert hits >= 0.9 * len(found)


def test_ties_go_to_the_smallest_ids(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        rows.append((i, [rng.gauss(0, 1) for _ in range(24)]))
    one = [rng.gauss(0, 1) for _ in range(24)]
    copies = sorted(rng.sample(range(1500), 200))
    for n, i in enumerate(copies):  # of one direction: equal vectors, and others by powers of two
        rows[i] = (i, [x * (2.0 ** (n % 100) if n % 2 else 1.0) for x in one])
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 2000)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = vector_search.nearest(table, F.col("id").isin(copies)).collect()
    got = {(r["query_id"], r["rank"]): r["id"] for r in found}
    for q in copies:
        assert [got[q, n] for n in range(1, 6)] == [c for c in copies[:6] if c != q][:5]


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://H.example/{'spam' if i % 2 else 'news'}/{i}", i) for i in range(60)]
    rows += [(100, None, 0), (101, "no-host", 0), (102, "http://h.example", 0), (103, "http://h.example/spam/9/deep/er/and/deeper?q#f", 0), (104, "http://h.example/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    labels = pages.where("page_id < 40").select("url", (F.col("page_id") % 2).alias("bad"))
    got = {r["id"]: r for r in url_filter.judge(pages, [("allow", "example/news/4")], labels).collect()}
    assert got[41]["verdict"] == "block" and got[42]["verdict"] == "allow" and got[40]["rule"] == "example/news/4"
    assert got[100]["host"] == got[101]["path"] == "" and got[102]["path"] == ""
    assert len(got) == 65 and url_filter.judge(pages.limit(0), []).count() == 0


def test_a_label_deep_in_a_path_decides(spark):
    """Branches far below the root are told apart, and one long path takes no rounds of its own."""
    rows = [(i, f"http://h.example/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}/x") for i in range(40)] + [(99, "http://h.example/" + "deep/" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.where("page_id < 30").select("url", (F.col("page_id") % 2).alias("bad"))
    got = {r["id"]: r for r in url_filter.judge(pages, [], labels).collect()}
    assert got[31]["verdict"] == "block" and got[32]["verdict"] == "allow" and len(got) == 41
    assert got[99]["verdict"] == "allow" and got[99]["template"].count("/deep") == 499


def test_hosts_are_rejected_by_their_failures(spark):
    rng = random.Random(8)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if rng.random() < 0.95 else "short", f"h{i % 20}") for i in range(1000)]
    rows += [(2000 + i, good if i % 10 == 0 else "few words", "bad") for i in range(100)] + [(3000, good, None)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r[0] for r in judged.where("host_rejected").select("host").distinct().collect()} == {"bad"}
    assert judged.where("id = 3000 AND kept").count() == 1


def test_training_raises_the_likelihood(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{a} {a}2" for a in rng.choices("red blue green pink grey".split(), k=200))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = [lm_score.score(docs, classes=12, rounds=n, stride=2).agg(F.sum("log_prob")).first()[0] for n in (0, 2)]
    assert 0 > sums[1] > 0.9 * sums[0]


def test_rare_words_score_by_their_counts(spark):
    # One frequent word comes to the driver; "rare" and "scarce" stand in the one class of all others.
    texts = ["the rare the", "the scarce the", "the rare the rare the rare the"] + ["the the the the"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["log_prob"] for r in lm_score.score(docs, size=1, classes=2, hidden=4).collect()}
    assert abs(got[0] - got[1] - math.log(4 / 1)) < 1e-4


def test_training_reaches_all_words_of_short_texts(spark):
    rng = random.Random(9)
    rows = [(i, "start " + " ".join(f"{a} {a}2" for a in rng.choices("red blue green pink grey".split(), k=6))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = [lm_score.score(docs, classes=12, rounds=n).agg(F.sum("log_prob")).first()[0] for n in (0, 2)]
    assert 0 > sums[1] > 0.9 * sums[0]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(10)
    texts = [sentence(rng, 80) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(100 + i, texts[i], "en", "s0", len(texts[i])) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(corpus_pipeline.STAGES) == 5
    ids = {r["doc_id"] for r in out}
    assert len(ids & set(range(100, 110))) <= 1 and all(r["n_tokens"] >= 0 for r in out)


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    """A line goes from the row whose line it is, whatever other rows have its id."""
    shared = "a line that two documents share word for word"
    docs = spark.createDataFrame(
        [(1, shared, "x", 0), (2, shared + "\nsecond own line here", "x", 0), (2, "a unique first line of text\nsecond own line here", "y", 0)],
        "doc_id long, text string, _id string, toxic int",
    )
    got = sorted(tuple(r)[:3] for r in line_dedup.drop_lines(docs).collect())
    once = {text for _, text, _ in got}
    assert (1, shared, "x") in got and len(got) == 3
    assert any("a unique first line of text" in text for text in once) and sum("second own line here" in text for text in once) == 1
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, toxicity.learn(docs, labels)).columns == docs.columns


def test_pipeline_stages_on_awkward_and_empty_documents(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and very long texts, more columns."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, id int, toxic string, key string, removed int"
    odd = [(*r[:5], r[5], "x", "y", 1) for r in AWKWARD] + [(None, None, None, None, None, None, None, None, None)] * 2
    for name, rows in (("odd", odd), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows, kind).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(5, 1), (None, 0), (4, None)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs, stages = spark.read.parquet(str(folder / "documents.parquet")), []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == corpus_pipeline.COLUMNS
            stages.append(docs.count())
        # No document goes for its lines, and copies of a text become one.
        assert stages[0] == stages[1] and stages[2] <= stages[1]
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == bool(rows)


def test_words_are_split_once_to_train_and_score(spark):
    """Two rounds of training and the scores read the classes of the words; texts are read to count and to code them."""
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return "one two three four " * (i % 5)

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(text, "string")("id").alias("text"))
    got = {r["id"]: r["n_tokens"] for r in lm_score.score(docs, classes=5, hidden=4).collect()}
    assert got == {i: 4 * (i % 5) for i in range(40)}
    assert read.value == 2 * 40


def test_near_duplicates_go_without_moving_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "other words than these")], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]
