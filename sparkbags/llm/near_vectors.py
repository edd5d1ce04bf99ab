"""Near-duplicate vectors by collision counting over one-dimensional projections.

All vectors are normed and projected on ``PROJECTIONS`` random directions.  On each
direction the projections are sorted, and the window around each value holds the
vectors it collides with there.  Of a pair at the threshold, a known share of
directions collides; a pair is a candidate if its count reaches the level that all but
``MISS`` of such pairs reach (the binomial quantile), and candidates are verified by
cosine in double precision.

Windows of single directions hold a fixed share of all vectors, so sorting and counting
are confined to cells.  In each of several tables the vectors are dealt out by the signs
of ``bits`` other projections; ``bits`` grows with the logarithm of the number of
vectors, so that cells stay small, and the number of tables is set so that a pair at
the threshold shares a cell with probability ``1 - MISS``.  A pair is counted in the
first table only in which it shares a cell.

A cell over ``BLOCK`` vectors becomes pairs of blocks, each a task's unit, so no cell is
too large for a task.  A unit sends a number of links for each vector and a spanning
forest of its links, never the pairs.  Equal vectors (by 128 bits of hash) are one node
with a weight, so copies take no more work than one vector.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different length don't link with each other.  Rows are what is
counted, whatever their keys: repeated keys are rows of their own, and a row without a
key links like any other, but ``component_id`` is the least key there is (null if its
component has none).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, settle, tidied
from .graph import components, roots
from .pieces import spread

THRESHOLD = 0.9
PROJECTIONS = 32
WINDOW = 1.0  # half width, in distances of a pair at the threshold
MISS = 0.02
CELL = 256
BLOCK = 1024
SEED = 5


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, cell: int = CELL) -> tuple[int, int]:
    """Bits of a cell and number of tables for n vectors."""
    bits = max(0, round(math.log2(max(1, n / cell))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(miss) / math.log(1 - share))


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The count that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for k in range(projections + 1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail > miss:
            return k
    return projections


def _normed(x: np.ndarray) -> np.ndarray:
    """Of length one; no row is zero."""
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length, normed, in double precision."""
    flat = np.asarray(col.flatten()).astype(np.float64)
    return _normed(flat.reshape(len(col), -1))


def _cells(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    if bits == 0:
        return np.zeros((len(x), 1), np.int64)
    signs = (x @ _directions(x.shape[1], bits * tables, SEED + 1) > 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _counted(p: np.ndarray, left: np.ndarray, right: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of places in left and right) that collide on at least so many of the
    directions, the columns of ``p``."""
    n = len(right)
    count = np.zeros(len(left) * n, np.int16)
    for a, b in zip(p[left].T, p[right].T, strict=True):
        order = np.argsort(b)
        lo, hi = np.searchsorted(b[order], a - window), np.searchsorted(b[order], a + window, "right")
        size = hi - lo
        at = np.repeat(np.arange(len(left)) * n, size) + order[spread(lo, size)]
        count[at] += 1  # each pair once on a direction
    found = np.flatnonzero(count >= least)
    return found // n, found % n


def _unit(x: np.ndarray, weight: np.ndarray, left, right, table: int, bits: int, tables: int, threshold: float, window: float, least: int):
    """Links between rows ``left`` and ``right`` (or within, if the same): for each row
    the weight of what it links with, and the root of a spanning forest."""
    i, j = _counted(x @ _directions(x.shape[1], PROJECTIONS, SEED), left, right, window, least)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        cells = _cells(x, bits, tables)[:, :table]
        fresh = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            fresh[k : k + (1 << 16)] = (cells[i[k : k + (1 << 16)]] != cells[j[k : k + (1 << 16)]]).all(1)
        i, j = i[fresh], j[fresh]
    close = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        close[k : k + (1 << 16)] = (x[i[k : k + (1 << 16)]] * x[j[k : k + (1 << 16)]]).sum(1) >= threshold
    i, j = i[close], j[close]
    n = (np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))).astype(np.int64)
    return n, roots(i, j, len(x))


def _nodes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows (k, h) with the identity of their vector, null if it links with nothing, and
    distinct vectors (id, h, v, d, w, m): length, weight and least key."""
    v = F.col(vector)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        v = v.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("k"), v.alias("v"), F.when(fine, identity(v)).alias("h"))
    nodes = rows.where("h is not null").groupBy("h").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("k").alias("m"))
    nodes = settle(nodes.select(F.monotonically_increasing_id().alias("id"), "h", "v", F.size("v").alias("d"), "w", "m"))
    return rows.select("k", "h"), nodes


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept): a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows, nodes = _nodes(vectors, key, vector)
    bits, tables = plan(nodes.count(), threshold, miss, cell)
    window, least = WINDOW * math.sqrt(2 - 2 * threshold), least_count(miss=miss)

    def places(it):
        for b in it:
            size = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                own = b.filter(pa.array(size == dim))
                c = _cells(_matrix(own.column(1)), bits, tables)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(own), dim, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.int64()))], ["id", "d", "c"])

    placed = nodes.select("id", "v").mapInArrow(tidied(places), "id long, d int, c array<long>").select("id", "d", F.posexplode("c").alias("t", "cell"))
    placed = settle(placed)
    sizes = placed.groupBy("d", "t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("d", "t", "cell", F.ceil(F.col("n") / block).alias("blocks"))
    # where each vector meets others, then the vector itself, once
    where = placed.join(sizes, ["d", "t", "cell"]).groupBy("id").agg(F.collect_list(F.struct("t", "cell", "blocks")).alias("at"))  # at most one for each table
    units = nodes.select("id", "d", "v", "w").join(where, "id").select("id", "d", "v", "w", F.explode("at").alias("p")).select("id", "d", "v", "w", "p.*")
    # a vector goes to each pair of blocks that its own block is part of
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    units = units.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["d", "t", "cell", "i", "j"]
    units = units.select(*by, "own", "id", "w", "v").repartition(n, *by).sortWithinPartitions(*by)

    def links(it):
        held: list[pa.RecordBatch] = []
        at = None

        def done():
            b = pa.Table.from_batches(held).combine_chunks()
            ids, weight = b.column("id").to_numpy(), b.column("w").to_numpy()
            x = _matrix(b.column("v").combine_chunks())
            _, t, _, i, j = at
            if i == j:
                left = right = np.arange(len(ids))
            else:
                own = b.column("own").to_numpy()
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            count, root = _unit(x, weight, left, right, t, bits, tables, threshold, window, least)
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(count[some])], ["id", "r", "n"])

        for b in it:
            keys = np.stack([b.column(i).to_numpy() for i in range(len(by))], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if z == a:
                    continue
                if at != tuple(keys[a].tolist()):
                    if held:
                        yield done()
                    held, at = [], tuple(keys[a].tolist())
                held.append(b.slice(a, z - a))
        if held:
            yield done()

    found = settle(units.mapInArrow(tidied(links), "id long, r long, n long"))
    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    of = components(found.select(F.col("id").alias("src"), F.col("r").alias("dst"))).withColumnRenamed("node", "id")
    all_ = nodes.select("id", "h", "w", "m").join(count, "id", "left").join(of, "id", "left")
    all_ = settle(all_.select("h", F.coalesce("component", "id").alias("c"), "m", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    least_key = all_.groupBy("c").agg(F.min("m").alias("component_id"))
    links_of = settle(all_.join(least_key, "c").select("h", "n_links", "component_id", F.lit(True).alias("known")))
    out = rows.join(links_of, "h", "left")
    out = out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("k")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
