"""A corpus from raw documents to tokens, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and
returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import line_dedup, mixing, sentencepiece_codec, simhash, toxicity
from pagemill.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Labels of ids whose crc32 leaves 1 when divided
    by 3 are held out, as in the operator's own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels)).select(COLUMNS)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that repeat one that stays."""
    shorter = line_dedup.drop_lines(docs)
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 4 bits over 4-word shingles: the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3; a document that is taken twice makes two rows."""
    return mixing.apply_mix(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic_filter), ("line dedup", line_filter), ("SimHash near-dedup", near_dedup), ("source mix", source_mix), ("SentencePiece", tokens),
]

# Neither fingerprints, Viterbi decoding nor tokenization can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
