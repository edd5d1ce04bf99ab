"""Seeded generators.  Rows depend on the seed and the row number alone, so any
partitioning, retry or cluster gives the same rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the filler text (a fixed list).
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def _unit(seed: int, *salt: int) -> Column:
    """A number in [0, 1) for each row id: 53 bits of a hash."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), *[F.lit(s) for s in salt]), 11)
    return h.cast("double") * F.lit(1.0 / (1 << 53))


def zero(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(0).cast("long").alias("value"))


def random(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Uniform 64-bit numbers."""
    return spark.range(n).select(F.xxhash64("id", F.lit(seed)).alias("value"))


def lorem(spark: SparkSession, n: int, words: int = 50, seed: int = 0) -> DataFrame:
    """Texts of whole words, one space apart."""
    pick = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.element_at(F.array(*map(F.lit, LOREM)), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), i), F.lit(len(LOREM))) + 1).cast("int")))
    return spark.range(n).select(F.array_join(pick, " ").alias("text"))


def uniform(spark: SparkSession, lo: int, hi: int, n: int, seed: int = 0) -> DataFrame:
    """Integers from lo to hi, both included."""
    if hi < lo:
        raise ValueError("hi is below lo")
    return spark.range(n).select((F.floor(_unit(seed) * F.lit(hi - lo + 1)) + F.lit(lo)).cast("int").alias("value"))


def distribution(spark: SparkSession, quantile, n: int, seed: int = 0) -> DataFrame:
    """Integers of any distribution: ``quantile`` maps an array of numbers in [0, 1) to
    integers (the inverse of its cumulative distribution)."""

    @F.pandas_udf("int")
    def draw(u: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(quantile(u.to_numpy())).astype(np.int32))

    return spark.range(n).select(draw(_unit(seed)).alias("value"))


def table_quantile(weights: np.ndarray, first: int = 0):
    """The quantile function of integers from ``first`` on with these weights."""
    total = np.cumsum(np.asarray(weights, np.float64))
    total /= total[-1]
    return lambda u: np.minimum(np.searchsorted(total, u, "right"), len(total) - 1) + first


def poisson(spark: SparkSession, mean: float, n: int, seed: int = 0) -> DataFrame:
    if mean <= 0:
        raise ValueError("the mean must be positive")
    top = int(mean + 12 * math.sqrt(mean) + 30)
    k = np.arange(top + 1)
    log_p = k * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
    return distribution(spark, table_quantile(np.exp(log_p)), n, seed)


def zipf(spark: SparkSession, size: int, exponent: float, n: int, seed: int = 0) -> DataFrame:
    """Integers from 1 to ``size``, the k-th with weight k^-exponent."""
    return distribution(spark, table_quantile(np.arange(1, size + 1, dtype=np.float64) ** -exponent, 1), n, seed)
