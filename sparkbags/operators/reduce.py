"""Elementwise folds over several bags (positional reduce)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_bags(bags: list[DataFrame], pos: str = "pos", value: str = "value") -> DataFrame:
    """(bag, pos, value) of all bags; positions are columns, as rows have no order."""
    out = None
    for i, b in enumerate(bags):
        b = b.select(F.lit(i).alias("bag"), F.col(pos).cast("long").alias("pos"), F.col(value).alias("value"))
        out = b if out is None else out.unionByName(b)
    return out


def zip_reduce(parts: DataFrame, f: Callable[[Column, Column], Column] | None = None, zero=0, keys: tuple[str, ...] = (), bag: str = "bag", pos: str = "pos", value: str = "value", outer: bool = False) -> DataFrame:
    """Fold the values at each position in the order of their bags: ``f(f(zero, a), b)``.

    Without ``f`` values are summed, which combines before the shuffle.  Positions
    that some bag doesn't reach are left out (as if zipped), or kept with ``outer``.
    The values of a position are as many as there are bags.
    """
    by = [*keys, pos]
    if f is None:
        folded = F.sum(value)
    else:
        # ties of a bag index are ordered by value, so the result is determined
        each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(bag).alias("b"), F.col(value).alias("v")))), lambda x: x["v"])
        folded = F.aggregate(each, F.lit(zero).cast(parts.schema[value].dataType), f)
    out = parts.groupBy(*by).agg(folded.alias(value), F.count("*").alias("_n"))
    if not outer:
        total = parts.groupBy(*keys).agg(F.count_distinct(bag).alias("_bags"))
        out = out.join(total, list(keys)) if keys else out.crossJoin(F.broadcast(total))  # one row
        out = out.where("_n = _bags").drop("_bags")
    return out.drop("_n")
