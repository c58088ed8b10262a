"""Shared scratch space, and joins that broadcast only what has been measured."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Session settings the engine is meant to run with; the caller applies them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages differ in size by orders of magnitude: bound Python batches by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Call sites of every expression cost time on the driver.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
ARROW_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
CLEARING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
SALT_BUCKETS = 16


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is started meanwhile."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def recommended(spark: SparkSession, *keys: str) -> dict[str, str]:
    """RECOMMENDED_CONF for those of `keys` that the session does not name."""
    return {key: RECOMMENDED_CONF[key] for key in keys if spark.conf.get(key, None) is None}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder,
    kept in the session so that later calls find the same one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pagemill.scratch.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="pagemill-")
    spark.conf.set("pagemill.scratch.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage is cut, and losing
    an executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_parsed(df: DataFrame, name: str) -> DataFrame:
    """`materialize` for parsed pages: workers get them in the recommended batches unless
    the session names others, so a worker's memory does not grow with the rows of its task."""
    with settings(df.sparkSession, recommended(df.sparkSession, *ARROW_BATCHES)):
        return materialize(df, name)


def materialize_clearing(df: DataFrame, name: str) -> DataFrame:
    """`materialize`, and the shuffle files made for it go once it is written. Otherwise they stay on
    the workers' disks until the driver happens to collect its garbage."""
    with settings(df.sparkSession, {CLEARING: "true"}):
        return materialize(df, name)


def materialize_measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`materialize`, plus the size in bytes of the rows as JSON text."""
    seen = Observation()
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64), F.lit(0))
    table = materialize(df.observe(seen, size.alias("bytes")), name)
    return table, seen.get["bytes"]


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Shuffled equi-join in which a hot key of `left` is spread over
    SALT_BUCKETS tasks; `right` is repeated once per bucket."""
    buckets = F.array(*[F.lit(i) for i in range(SALT_BUCKETS)])
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT_BUCKETS)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(buckets))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def bounded_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Equi-join that measures `right` first: broadcast below BROADCAST_LIMIT_BYTES,
    salted above."""
    right, size = materialize_measured(right, "build")
    if size <= BROADCAST_LIMIT_BYTES:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, spread, how)
