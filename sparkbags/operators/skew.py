"""Skew: two-phase aggregation, salted joins, and a report of key sizes.

Adaptive execution cuts skewed partitions of shuffle joins by itself; these operators
serve where it can't (aggregates that don't combine, joins that feed an aggregation on
the same key) and make the cut explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings under which adaptive execution divides skewed partitions sooner.
EAGER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def salt(df: DataFrame, salts: int, row: Column | None = None, name: str = "_salt") -> DataFrame:
    """Adds a number in [0, salts), from a hash of ``row`` (all columns if not given),
    so that a retried task deals its rows out as before."""
    row = row if row is not None else F.struct(*df.columns)
    return df.withColumn(name, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))


def two_phase(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 16) -> DataFrame:
    """Aggregate by key and salt, then the partial results by key: clones of a task
    and their merge."""
    part = salt(df, salts).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys with more than a share of the rows: 1/share at most."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * share).drop("total")  # total: one row


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", share: float = 0.01, salts: int = 16) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) whose hot left keys are dealt out
    over ``salts`` partitions; only the right rows of hot keys are repeated."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side is repeated: only joins that keep left rows")
    hot = hot_keys(left, on, share).select(F.col(on).alias("_hot"))  # at most 1/share rows
    l_ = left.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    l_ = l_.withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(0)).drop("_hot")
    r = right.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    all_ = F.sequence(F.lit(0), F.lit(salts - 1))
    r = r.withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), all_).otherwise(F.array(F.lit(0))))).drop("_hot")
    return l_.join(r, [on, "_salt"], how).drop("_salt")


def report(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, rows, largest and mean group, and the largest group's share."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("largest"), F.avg("n").alias("mean"), (F.max("n") / F.sum("n")).alias("share"))
