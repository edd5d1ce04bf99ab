"""Every query of the dataflow operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sparkbags import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = _rows(df.columns, df.collect())
    if name in queries.ORACLE:
        want = con.execute(queries.ORACLE[name])
        cols = [x[0] for x in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == _rows(cols, want.fetchall())
    else:
        assert got


def test_windows_hold_all_events(spark, con):
    """The newest windows too, which no watermark passes."""
    df = queries.stream_windows(spark, DATA)
    days, n = con.execute("select count(distinct date_trunc('day', ts)), count(ts) from events").fetchone()
    assert df.agg({"n": "sum"}).first()[0] == n
    assert df.select("day").distinct().count() == days


def test_counts_over_several_drains(spark, tmp_path):
    """A group that a later drain changes has its last count, and is there once."""
    from pyspark.sql import functions as F

    from sparkbags.streaming import consume

    src, want = str(tmp_path / "in"), {}
    for k in range(3):
        spark.range(10 * (k + 1)).select(F.expr("timestamp'2024-01-01 12:00:00'").alias("ts"), F.lit("a").alias("key")).write.mode("append").parquet(src)
        want = {"a": want.get("a", 0) + 10 * (k + 1)}
        counts = consume.windowed_counts(consume.stream(spark, src, "ts timestamp, key string"), "ts", "key")
        counts = counts.select(F.col("window.start").alias("day"), "key", "n")
        got = consume.drain_counts(counts, ["day", "key"], str(tmp_path / "out"), str(tmp_path / "cursor"))
        assert {r.key: r.n for r in got.collect()} == want and got.count() == 1


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["word", "n"]
