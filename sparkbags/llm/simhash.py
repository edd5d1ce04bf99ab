"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is set if it is set in more than half of the XXH64 values of the
text's word shingles.  Every distinct fingerprint emits its variants within half the
radius; two fingerprints that emit the same variant meet in a shuffle, and the pair is
verified by counting its differing bits.  Variants travel in packed buckets, each as
what it differs in (two bytes) from its fingerprint, which a bucket's record holds once
for all its variants there: ten bytes for a variant at most, whatever the number of
buckets.

Half of radius three is one bit for one of a pair and two for the other.  Parity tells
them apart: fingerprints three bits apart differ in the parity of their bits, so only
those of odd parity emit variants two bits away.  Of three differing bits two are in
the same half of the fingerprint, so these two-bit variants stay within a half: 1057
variants for a fingerprint of odd parity and 65 for one of even parity find every pair,
where whole balls on both sides would take 2081 and 65.

Pairs meet at several variants.  Each is taken at one place only (``_middle``), so no
pair is made twice.  A variant has 2081 fingerprints within two bits at most, whatever
the number of documents.  Equal fingerprints are one node, so copies never form pairs;
a fingerprint's documents hang on the smallest id among them.

Null and empty texts, and texts of white space only, have fingerprint zero and link
like any other.  Rows with equal ids are kept apart only by their columns; rows without
an id have the smallest id of their class, null if no row of it has one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, settle, tidied
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
_MOST = 1 << 18
_SLICE = 1 << 20
#: Variants that meet in one place at a time.
_BUCKET = 1 << 20
#: Marks the first of a fingerprint's variants in a record.
_NEW = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and 9-13 and 32 only
    if not words:
        return 0
    one = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(one, seed), "big")
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    ones = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    spans = list(zip(start[:n].tolist(), end[shingle - 1 :].tolist(), strict=True))
    for k in range(0, n, _MOST):
        h = b"".join([digest(one[a:b], seed) for a, b in spans[k : k + _MOST]])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): the 64 bits as a signed long."""

    def run(it):
        for b in (part for b in it for part in chunks(b, "t", _SLICE)):
            fp = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidied(run), f"k {kind}, fp long").withColumnRenamed("k", key)


def _flips(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """What variants differ in, for fingerprints of even and of odd parity."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    few = np.concatenate((np.zeros(1, np.uint64), one[: 64 * (radius > 0)]))
    i, j = np.triu_indices(32, 1)
    two = one[i] | one[j] if radius == 3 else one[:0]
    return few, np.concatenate((few, two, two << np.uint64(32)))


def variants(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``fp``, place in the flips of odd parity, variant): the variants at which
    pairs may meet, of all ``fp``."""
    odd = np.bitwise_count(fp) % 2 == 1
    out = []
    for at, m in zip((np.flatnonzero(~odd), np.flatnonzero(odd)), _flips(radius), strict=True):
        out.append((np.repeat(at, len(m)), np.tile(np.arange(len(m), dtype=np.uint16), len(at)), (fp[at, None] ^ m).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed(fp: np.ndarray, radius: int, buckets: int) -> pa.RecordBatch:
    """(bucket, fps, flips): the variants of all ``fp``, a row for each bucket."""
    at, flip, v = variants(fp, radius)
    of = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(of.astype(np.uint16) if buckets < 1 << 16 else of, kind="stable")
    at, flip, of = at[order], flip[order], of[order]
    names, first = np.unique(of, return_index=True)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    runs = np.append(0, np.cumsum(new))
    cols = []
    for data, ends in ((fp[at[new]], runs[np.append(first, len(at))] * 8), (np.where(new, flip | np.uint16(_NEW), flip), np.append(first, len(at)) * 2)):
        cols.append(pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *cols], ["bucket", "fps", "flips"])


def _unpacked(fps: bytes, flips: bytes, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, variants) of a bucket's records, joined."""
    flip = np.frombuffer(flips, np.uint16)
    fp = np.frombuffer(fps, np.uint64)[np.cumsum(flip >= _NEW) - 1]
    return fp, fp ^ _flips(radius)[1][flip & np.uint16(_NEW - 1)]


def _lowest(x: np.ndarray) -> np.ndarray:
    return x & (~x + np.uint64(1))


def _middle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one variant at which a pair of fingerprints one to three bits apart is taken:
    the even one itself, the variant that differs from the smaller one in the lowest
    differing bit, or what the odd one becomes by the two lowest bits that differ in the
    same half (the lower half, if it has two)."""
    d = x ^ y
    n = np.bitwise_count(d)
    low = d & np.uint64(0xFFFFFFFF)
    half = np.where(np.bitwise_count(low) >= 2, low, d ^ low)
    first = _lowest(half)
    two = first | _lowest(half ^ first)
    odd = np.bitwise_count(x) % 2 == 1
    return np.where(n == 1, np.where(odd, y, x), np.where(n == 2, np.minimum(x, y) ^ _lowest(d), np.where(odd, x, y) ^ two))


def _meet(fp: np.ndarray, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet at their variants, each at one of them, verified."""
    order = np.argsort(v)
    fp, v = fp[order], v[order]
    at, out = np.flatnonzero(v[1:] == v[:-1]), []
    step = 1
    while len(at):
        x, y = fp[at], fp[at + step]
        near = (np.bitwise_count(x ^ y) <= radius) & (_middle(x, y) == v[at])
        out.append((x[near], y[near]))
        step += 1  # the variant's next one
        at = at[at + step < len(v)]
        at = at[v[at] == v[at + step]]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (fp[:0], fp[:0])


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): all pairs of distinct ``fp`` values within ``radius`` (0 to 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("variants within two bits cover a radius of 3 at most")
    spark = fps.sparkSession
    own = settle(fps.select("fp").distinct())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # variants spread evenly: a bucket of them fits a task whatever the number of rows
    buckets = max(n, math.ceil(own.count() * sum(map(len, _flips(radius))) / 2 / _BUCKET))

    def emit(it):
        for b in it:
            for k in range(0, len(b), 1024):
                yield _packed(b.column(0).to_numpy()[k : k + 1024].view(np.uint64), radius, buckets)

    def meet(it):
        held, at = [], None

        def pairs():
            x, y = _meet(*_unpacked(*(b"".join(c) for c in zip(*held, strict=True)), radius), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["src", "dst"])

        for b in it:
            for bucket, fps, flips in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if bucket != at and held:
                    yield pairs()
                    held = []
                at = bucket
                held.append((fps.as_py(), flips.as_py()))
        if held:
            yield pairs()

    rows = own.mapInArrow(tidied(emit), "bucket long, fps binary, flips binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return settle(rows.mapInArrow(tidied(meet), "src long, dst long"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, own: DataFrame | None = None) -> DataFrame:
    """(key, fingerprint, component_id): a row for each document with the smallest id
    it reaches over links.  ``own`` may hold the fingerprints, if known."""
    own = fingerprints(docs, text, key, shingle, seed) if own is None else own
    first = own.groupBy("fp").agg(F.min(key).alias("node"))
    links = ball_links(first, radius)
    node = components(links)
    # the component of fingerprints, then its smallest document
    of = first.join(node.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("c"))
    least = of.groupBy("c").agg(F.min("node").alias("component_id"))
    of = of.join(least, "c").select("fp", "component_id")
    return own.join(of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
