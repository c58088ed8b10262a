"""Run registered queries against their SQL: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import oracles, queries
from pagemill.runtime import RECOMMENDED_CONF


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagemill-compare-"))
        .config(map=RECOMMENDED_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# How each engine names the same type.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str:
    """Empty when rows, column names and types agree, else what differs."""
    got = queries.registry()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = Counter(tuple(r) for r in got.select(*columns).collect())
    result = con.execute(oracles.registry()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    wrong = {c: (t, types[c]) for c, t in got.dtypes if TYPES[t] != types[c]}
    if wrong:
        return f"types {wrong}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    if rows == want:
        return ""
    extra, lacking = rows - want, want - rows
    return f"{len(extra)} extra {list(extra)[:3]}, {len(lacking)} lacking {list(lacking)[:3]}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(folder)
    for query in sys.argv[2:] or queries.registry():
        began = time.time()
        try:
            outcome = compare(spark, con, query, folder)
        except Exception as e:  # report and go on with the next query
            outcome = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if not outcome else 'FAIL'} {query} {time.time() - began:.1f}s {outcome}", flush=True)
