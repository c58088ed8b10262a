"""Scratch space: what a step leaves behind."""

from pyspark.sql import functions as F

from pagemill import runtime


def test_shuffle_files_go_once_a_step_is_written(spark):
    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {path for path in files.split("\n") if "/shuffle_" in path}

    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    joined = rows.repartition("k").join(rows.groupBy("k").agg(F.count("id").alias("n")), "k")
    before, setting = shuffled(), spark.conf.get(runtime.CLEARING)
    kept = runtime.materialize_clearing(joined, "cleared")
    assert not shuffled() - before
    assert spark.conf.get(runtime.CLEARING) == setting
    assert kept.count() == 1000 and kept.agg(F.sum("n")).first()[0] == joined.agg(F.sum("n")).first()[0]
