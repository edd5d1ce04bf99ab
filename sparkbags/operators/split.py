"""Partitioning operators: split, fan-out, union, parallelize."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW = "_flow"


def split_by(df: DataFrame, k: int, flow: Column, check: bool = True) -> DataFrame:
    """Adds the flow of each row, from 0 to k-1; others are an error."""
    flow = flow.cast("int")
    if check:
        ok = (flow >= 0) & (flow < k)
        flow = F.when(ok, flow).otherwise(F.raise_error(F.concat(F.lit("flow out of range: "), F.coalesce(flow.cast("string"), F.lit("null")))).cast("int"))
    return df.withColumn(FLOW, flow)


def exchange(df: DataFrame, k: int, flow: Column) -> DataFrame:
    """Rows of one flow in one partition."""
    return split_by(df, k, flow).repartition(k, FLOW)


def write_flows(df: DataFrame, path: str) -> None:
    """One pass over the rows; a folder for each flow, which readers can prune."""
    df.write.mode("overwrite").partitionBy(FLOW).parquet(path)


def to_bags(df: DataFrame, bags: Sequence) -> None:
    """Append the rows of flow i to bag i.  The rows are written once, by flow, to a
    table beside the bags, and read from there."""
    path = f"{bags[0].root}/_flows-{bags[0].name}"
    write_flows(df, path)
    flows = df.sparkSession.read.schema(df.schema).parquet(path)
    for i, bag in enumerate(bags):
        bag.write(flows.where(F.col(FLOW) == i).drop(FLOW))


def union(*dfs: DataFrame) -> DataFrame:
    """All rows of all, duplicates too."""
    return reduce(DataFrame.unionByName, dfs)


def parallelize(df: DataFrame, k: int) -> DataFrame:
    """Rows dealt round-robin to k partitions, for skewed or few inputs."""
    return df.repartition(k)


def rebalance(df: DataFrame, *cols: str) -> DataFrame:
    """Let adaptive execution cut large and join small partitions."""
    return df.hint("rebalance", *cols)
