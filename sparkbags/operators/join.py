"""Lookup and other joins of a stream of rows with a build side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def checked_unique(build: DataFrame, on: list[str]) -> DataFrame:
    """The build side; a repeated key is an error when it is read."""
    w = Window.partitionBy(*on)
    n = F.count("*").over(w)
    return build.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("repeated build key")).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def lookup(probe: DataFrame, build: DataFrame, on: list[str], how: str = "inner", cardinality: str | None = None, defaults: dict | None = None) -> DataFrame:
    """Join by equal keys (inner, left, left_semi, left_anti).  Spark broadcasts the
    build side only while its size is below the session's threshold.  With
    ``cardinality="n:1"`` a repeated build key is an error.  ``defaults`` fill the
    build columns of rows without a match."""
    if cardinality == "n:1":
        build = checked_unique(build, on)
    out = probe.join(build, on, how)
    return out.fillna(defaults) if defaults else out


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order: a probe that remembers the keys it has
    offered.  Rows combine before they are sent, so a key may hold any share of them."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order, *[c for c in df.columns if c not in order])).alias("_row"))
    return first.select("_row.*")


def running(df: DataFrame, keys: list[str], order: list[str], **states: Column) -> DataFrame:
    """Adds to each row the state of its key after it, in an order: aggregates over the
    rows up to it.  The order must tell rows apart for the states to be determined."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[c.over(w).alias(n) for n, c in states.items()])


def theta(left: DataFrame, right: DataFrame, cond: Column, how: str = "inner") -> DataFrame:
    """Any condition; put an equality into it wherever there is one."""
    return left.join(right, cond, how)


def as_of(probe: DataFrame, build: DataFrame, by: list[str], at: str, build_at: str, cols: list[str]) -> DataFrame:
    """For each probe row the last build row of its keys at or before its time.  One
    sort by key and time: build rows flow into the probe rows after them."""
    tie = F.struct(*[F.col(c) for c in cols])
    p = probe.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(build.select(tie).schema[0].dataType)).withColumn("_p", F.struct(*[F.col(c) for c in probe.columns]))
    b = build.select(*by, F.col(build_at).alias("_t"), tie.alias("_v"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    both = b.unionByName(p.select(*by, "_t", "_v", "_p"))
    w = Window.partitionBy(*by).orderBy("_t", F.col("_p").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_p").isNotNull())
    return got.select("_p.*", *[F.col("_v")[c].alias(c) for c in cols])


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Points in [lo, hi) by equal buckets of some width, not a nested loop."""
    p = points.withColumn("_b", F.floor(F.col(point) / F.lit(width)))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / F.lit(width)), F.floor(F.col(hi) / F.lit(width)))))
    return p.join(r, (p._b == r._b) & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)), how).drop("_b")


def partitioned(left: DataFrame, right: DataFrame, on: str, k: int, how: str = "inner") -> DataFrame:
    """Both sides dealt to k partitions by the key, then joined there: one exchange
    for each side, which the join reuses."""
    return left.repartition(k, on).join(right.repartition(k, on), on, how)
