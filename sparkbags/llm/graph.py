"""Connected components of a link table, in rounds of joins and aggregates.

Alternates the large-star and small-star steps: every node hands its larger (then
its smaller) neighbours to the least node it sees, until each component is a star
around its least node.  Rounds grow with the logarithm of the longest path.

Before the rounds each task replaces the links it holds by stars with the same
components, so a large group sends no more links than each task sees nodes.  Each round
is a table in the shared folder, and the last one's goes; the driver sees two sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settle, tidied

#: Links that a task holds at a time.
_MOST = 1 << 20


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches over the links i, j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        go = root[i] != root[j]
        i, j = i[go], j[go]
    return root


def _stars(it):
    """Stars with the components of the links that a task holds at a time."""

    def star(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = roots(at[: len(a)], at[len(a) :], len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["a", "b"])

    held, n = [], 0
    for x in it:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += len(x)
        if n >= _MOST:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of ``links`` with the least node it reaches.

    Nodes are longs.  Self-links only name a node.  Repeated links and either direction
    do no harm; links with a null end are left out.  Nodes without links don't appear.
    """
    spark = links.sparkSession
    e = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    names = settle(e.mapInArrow(tidied(_stars), "a long, b long"))  # (node, a root of its own task's)
    e = names.where("a <> b").distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        seen = Observation()
        e = settle(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")))
        now = (seen.get.get("n"), seen.get.get("h"))
        if now == before or not now[0]:
            break
        before = now
    out = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return names.select(F.col("a").alias("node"), F.col("a").alias("component")).unionByName(out).groupBy("node").agg(F.min("component").alias("component"))
