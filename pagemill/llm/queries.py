"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import conversation_repair, lexical_search, license_scan, line_dedup, lm_score, mixing, quality, sentencepiece_codec, simhash, substring, toxicity, url_filter, vector_search
from pagemill.llm import oracles as sql

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark, sf_dir):
    return lm_score.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_quality(spark, sf_dir):
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "host_rejected")


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op4_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = line_dedup.removed_lines(docs).select(F.col("id").alias("doc_id"), "key", "n_lines", "removed")
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(found, ["doc_id", "key"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))


def op5_substring(spark, sf_dir):
    found = substring.repeated_spans(substring.passages(_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("other", "other_id")


def op6_toxicity(spark, sf_dir):
    docs, held_out = _table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_vector_search(spark, sf_dir):
    found = vector_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")[0]).alias("taken")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


# The rules of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_filter(spark, sf_dir):
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template")


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op11_conversation_repair(spark, sf_dir):
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repair(damaged))


def op12_lexical_search(spark, sf_dir):
    found = lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_license_scan(spark, sf_dir):
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    joined = [F.array_join(name, ",").alias(name) for name in ("base_labels", "labels")]
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


ALL = [op1_lm_score, op2_quality, op3_simhash, op4_line_dedup, op5_substring, op6_toxicity, op7_vector_search, op8_mixing, op9_url_filter, op10_sentencepiece, op11_conversation_repair, op12_lexical_search, op13_license_scan, pipeline]


def registry() -> dict:
    return {query.__name__: query for query in ALL}


def oracles() -> dict[str, str]:
    return sql.registry()
