"""Append sinks give each line of a run once, whatever becomes of a job."""

import pytest
from pyspark.sql import functions as F

from pagemill.sources import sinks


@pytest.fixture
def log(spark):
    return spark.createDataFrame([("a", "http://a/1"), ("a", "http://a/2"), ("b", "http://b/1")], "site_key string, url string")


def lines(spark, path):
    return sorted(tuple(r) for r in sinks.read_crawl_log(spark, path).collect())


def test_a_run_that_runs_again_adds_nothing(spark, log, tmp_path):
    path, want = str(tmp_path / "log"), sorted(tuple(r) for r in log.collect())
    assert lines(spark, path) == []
    for _ in range(2):
        sinks.append_crawl_log(log, path, run_id="monday")
        assert lines(spark, path) == want
    sinks.append_crawl_log(log.where("site_key = 'b'"), path, run_id="tuesday")
    sinks.append_crawl_log(log.where("site_key = 'b'"), path)
    assert lines(spark, path) == sorted(want + [("b", "http://b/1")] * 2)


def test_a_killed_job_leaves_nothing_that_counts(spark, log, tmp_path, monkeypatch):
    """It dies once with all its files written, and once in the middle of writing them."""
    path, want = str(tmp_path / "log"), sorted(tuple(r) for r in log.collect())
    stage = sinks._stage

    def killed(*a):
        stage(*a)
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks, "_stage", killed)
    with pytest.raises(RuntimeError):
        sinks.append_crawl_log(log, path, run_id="r")
    monkeypatch.setattr(sinks, "_stage", stage)
    broken = log.withColumn("url", F.when(F.col("site_key") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="killed"):
        sinks.append_crawl_log(broken, path, run_id="r")
    assert lines(spark, path) == []
    sinks.append_crawl_log(log, path, run_id="r")
    assert lines(spark, path) == want


def test_of_two_attempts_that_committed_one_stands(spark, log, tmp_path, monkeypatch):
    path, want = str(tmp_path / "log"), sorted(tuple(r) for r in log.collect())
    empty = spark.createDataFrame([], "run string, attempt string")
    commits = sinks._commits
    monkeypatch.setattr(sinks, "_commits", lambda *a: empty)  # neither sees the other's record
    for _ in range(2):
        sinks.append_crawl_log(log, path, run_id="r")
    monkeypatch.setattr(sinks, "_commits", commits)
    assert lines(spark, path) == want


def test_item_lines_come_back_as_written(spark, tmp_path):
    body = '{"mkey":"d","subKey":"s","data":{"title":"Dréi"}}'
    envelopes = spark.createDataFrame([(body,)], "body string")
    sinks.append_item_lines(envelopes, str(tmp_path / "items"), run_id="x")
    sinks.append_item_lines(envelopes, str(tmp_path / "items"), run_id="x")
    assert [(r.body, r.mkey, r.data) for r in sinks.read_item_lines(spark, str(tmp_path / "items")).collect()] == [(body, "d", {"title": "Dréi"})]
