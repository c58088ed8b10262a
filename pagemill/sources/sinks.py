"""Append sinks: crawl log, item lines, outbox.

An append is a run: its files are staged in a folder of their own, and one commit record,
written last, names that folder. Readers read through the records, so a job that was
killed leaves nothing behind that counts, and a job that is run again under its run id
gives each line once: a committed run is not written again, and of two attempts that
both committed the record with the smaller name stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where and how an envelope is delivered.
ENDPOINT_PATH = "/api/1.0"
CONTENT_TYPE = "application/json"

_COMMITS = T.StructType([T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt): the attempt that stands for each committed run."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).json(f"{path}/commits").groupBy("run").agg(F.min("attempt").alias("attempt"))


def stage_only(rows: DataFrame, path: str) -> None:
    """An append as far as a job gets that is killed before its commit."""
    _stage(rows, path, uuid.uuid4().hex, [])


def _stage(rows: DataFrame, path: str, attempt: str, by: list[str]) -> None:
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).text(f"{path}/data/attempt={attempt}")


def _append(rows: DataFrame, path: str, run_id: str | None, by: list[str]) -> None:
    spark = rows.sparkSession
    run, attempt = run_id or uuid.uuid4().hex, uuid.uuid4().hex
    if run_id is not None and not _commits(spark, path).where(F.col("run") == run).isEmpty():
        return
    _stage(rows, path, attempt, by)
    spark.createDataFrame([(run, attempt)], _COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")


def _committed(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Lines of the committed attempts; the folders of others are pruned, not read."""
    attempts = [row.attempt for row in _commits(spark, path).select("attempt").toLocalIterator()]
    if not attempts:
        return spark.createDataFrame([], columns)
    lines = spark.read.schema(columns + ", attempt string").text(f"{path}/data")
    return lines.where(F.col("attempt").isin(attempts)).drop("attempt")


def append_crawl_log(visited: DataFrame, path: str, run_id: str | None = None) -> None:
    """One URL per line, one folder per site. Rebalancing by site keeps the number of
    files low, and lets AQE split a site that holds much of the rows over many tasks."""
    rows = (
        visited.select("site_key", F.col("url").alias("value"))
        .hint("rebalance", F.col("site_key"))
        .sortWithinPartitions("site_key")
    )
    _append(rows, path, run_id, ["site_key"])


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    lines = _committed(spark, path, "value string, site_key string")
    return lines.select("site_key", F.col("value").alias("url"))


def append_item_lines(envelopes: DataFrame, path: str, run_id: str | None = None) -> None:
    _append(envelopes.select(F.col("body").alias("value")), path, run_id, [])


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    fields = "mkey string, subKey string, data map<string,string>"
    return _committed(spark, path, "value string").select("value", F.from_json("value", fields).alias("e")).select(
        F.col("value").alias("body"), "e.*"
    )


def outbox(envelopes: DataFrame, server: str) -> DataFrame:
    """Every envelope with its delivery target; other columns are kept."""
    kept = [c for c in envelopes.columns if c in ("site_key", "page_id", "url")]
    return envelopes.select(
        *kept,
        F.lit(server + ENDPOINT_PATH).alias("endpoint"),
        F.lit(CONTENT_TYPE).alias("content_type"),
        "body",
    )
