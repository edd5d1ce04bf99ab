"""Keyed aggregation.

Ready aggregates are Spark's own, which combine before the shuffle.  ``group_apply``
runs a Python state for each key; ``group_merge`` does so for aggregates that can be
merged, in two steps, so that one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salt


def group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def group_value(df: DataFrame, key: Column, value: Column, **aggs: Callable[[Column], Column]) -> DataFrame:
    """Parse each row into a key and a value, then aggregate the values."""
    kv = df.select(key.alias("key"), value.alias("value"))
    return kv.groupBy("key").agg(*[f(F.col("value")).alias(n) for n, f in aggs.items()])


def group_apply(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function over all rows of a key at once; keys must fit into a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def group_merge(df: DataFrame, keys: list[str], update: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, salts: int = 32) -> DataFrame:
    """``update`` makes one partial row from the rows of a key in each of some shares (by
    a hash of the row, so a retried task deals out the same), ``merge`` one row from the
    partial rows of a key (same schema)."""
    salted = salt(df, salts)
    partial = salted.groupBy(*keys, "_salt").applyInPandas(lambda p: update(p.drop(columns="_salt")), schema)
    return partial.groupBy(*keys).applyInPandas(merge, schema)


def distinct_sketch(df: DataFrame, keys: list[str], value: str, name: str = "sketch") -> DataFrame:
    """A mergeable sketch of the distinct values of each key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value).alias(name))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", name: str = "n_distinct") -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(name))
