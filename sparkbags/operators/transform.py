"""Record operators: map, filter, flat map, batch transform."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **cols: Column) -> DataFrame:
    """One row to one row, by column expressions."""
    return df.select(*[c.alias(n) for n, c in cols.items()])


def map_udf(df: DataFrame, f: Callable, schema: str, col: str = "value") -> DataFrame:
    """One value to one value by a Python function, in Arrow batches."""
    name, kind = schema.split(None, 1)
    g = F.udf(f, kind, useArrow=True)
    return df.select(g(F.col(col)).alias(name))


def filter_rows(df: DataFrame, cond: Column | str) -> DataFrame:
    return df.where(cond)


def flat_map(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """A row for each item of an array expression."""
    return df.select(*keep, F.explode(items).alias(name))


def transform(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` once for each Arrow batch.  How rows fall into batches is not defined, so
    results must not depend on it."""

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            got = f(b)
            yield from [got] if isinstance(got, pa.RecordBatch) else got

    return df.mapInArrow(run, schema)
