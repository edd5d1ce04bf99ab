"""Near-duplicate texts: Jaccard similarity of their sets of word shingles.

Each distinct set of five-word shingles (64-bit hashes) has a SimHash of 768 bits.
Two sets at similarity 0.8 differ in a bit with probability acos(8/9) / pi = 0.15 at
most, some 115 bits: far too many for balls in the whole fingerprint.  So the search is
ball hashing in several tables, each with a fingerprint of b fixed bits of the 768: it
emits every variant within half the radius of two, one bit, and two sets within two bits
meet at a variant.  b grows with the logarithm of the number of sets, so chance meetings
stay in proportion to it; the number of tables follows from b and the ``recall`` asked
for at the threshold.  A table's fingerprints are dealt out by some of their bits: each
goes to its own part, where its variants are made, and to the parts one bit away.  Of the
two variants at which fingerprints meet one counts (``_useful``).  What is written of a
part is each set once that meets another there, so the rows are in proportion to the sets
and not to their meetings; pairs are made and compared where a part is read.  Sets of
at most ``SHORT`` shingles, whose bits are coarse, also meet by prefix: two sets at the
threshold share one of the smallest n - ceil(least n) + 1 hashes, without exception.

Pairs that meet are dropped if their sizes or their differing bits rule the threshold
out (a binomial quantile), and what is left is verified with the sets themselves, so
no pair below the threshold links.  Components of verified pairs are the groups.
Each set is first compared with two of every place of a few tables where it meets others,
then with two of all places that hold more than one of the components found; of the
other pairs only those in different components are left to compare, since the rest
can't change the groups.

Rows are told apart by an identity of their own: null and repeated keys do no harm.
Texts without words have the empty set and are one group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, tidied, utf8
from .graph import components

SHINGLE = 5
LEAST = 0.8
RECALL = 0.99
SEED = 42
WORDS = 12  # of 64 bits
SHORT = 24
#: Bits in which a table's fingerprints may differ; variants are within half of it.
RADIUS = 2
#: Tables whose meetings are compared before all others.
FIRST = 3
#: Differing bits of a place's sets that are compared with two of it.
_FEW = 10
#: Bits of a table at most; variants of a part, on average at most; pairs compared at a time.
_BITS, _PART, _BLOCK = 40, 1 << 22, 1 << 17
_Q_SHORT = 0.2  # of differing bits, for short sets at the threshold
_MOST = 1 << 14
_ROW = "_near_row"


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of a text's word shingles; a text of fewer words is
    one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bits_of(own: np.ndarray) -> np.ndarray:
    """The set's fingerprint as 64-bit words."""
    ones = np.zeros(64 * WORDS, np.int64)
    step = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(own), _MOST):
        h = _mix(own[k : k + _MOST, None] + step)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(own)).view(np.uint64)


def apart(least: float = LEAST) -> float:
    """The share of differing bits of two equally large sets at the threshold, which
    is the most for any sizes."""
    return math.acos(2 * least / (1 + least)) / math.pi


def radius(q: float, sigmas: float = 2.6) -> int:
    """Bits that all but a half percent of pairs at the threshold stay within."""
    bits = 64 * WORDS
    return math.ceil(bits * q + sigmas * math.sqrt(bits * q * (1 - q)))


def tables(n: int, least: float = LEAST, recall: float = RECALL) -> np.ndarray:
    """A row of bit positions for each table, for ``n`` sets."""
    b = min(_BITS, max(16, math.ceil(math.log2(max(2, n))) + 13))  # a chance meeting for one set in 16 to 32 in a table
    q = apart(least)
    meet = sum(math.comb(b, k) * q**k * (1 - q) ** (b - k) for k in range(RADIUS + 1))
    most = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    rng = np.random.default_rng(SEED)
    apart_ = np.arange(64 * WORDS // b * b).reshape(-1, b)  # as many as there are without common bits
    return np.stack([*apart_[:most], *(rng.permutation(64 * WORDS)[:b] for _ in range(most - len(apart_)))])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """(row, s, n, w0...): the set's hash, size and fingerprint, and for a short one
    its prefix."""
    words = [f"w{i}" for i in range(WORDS)]

    def run(it):
        for b in it:
            s, n, w, head = [], [], [], []
            for t in b.column(1):
                own = shingles(t.as_py())
                s.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(len(own))
                w.append(bits_of(own))
                head.append(own[: len(own) - math.ceil(LEAST * len(own) - 1e-9) + 1].view(np.int64) if 0 < len(own) <= SHORT else [])
            w = np.array(w, np.uint64).reshape(-1, WORDS)
            cols = [b.column(0), _signed(np.array(s, np.uint64)), pa.array(n, pa.int64()), pa.array(head, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *(_signed(np.ascontiguousarray(w[:, i])) for i in range(WORDS))], ["row", "s", "n", "head", *words])

    kind = "row long, s long, n long, head array<long>, " + ", ".join(f"{w} long" for w in words)
    return rows.select(F.col(_ROW).alias("row"), F.col(text).alias("t")).mapInArrow(tidied(run), kind)


def variants(x: np.ndarray, part: int, split: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``x``, differing bit or -1, variant): all variants within a bit of the
    fingerprints ``x`` whose low ``split`` bits are ``part``."""
    d = (x ^ part) & ((1 << split) - 1)
    own, near = np.flatnonzero(d == 0), np.flatnonzero((d > 0) & (np.bitwise_count(d) == 1))
    flip = np.concatenate(([-1], np.arange(split, bits))).astype(np.int64)
    mask = np.concatenate(([0], np.int64(1) << np.arange(split, bits, dtype=np.int64))).astype(np.int64)
    at = np.concatenate((np.repeat(own, len(flip)), near))
    f = np.concatenate((np.tile(flip, len(own)), np.log2(d[near].astype(np.float64)).astype(np.int64)))
    return at, f, np.concatenate(((x[own, None] ^ mask).ravel(), x[near] ^ d[near]))


def _useful(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Places of the rows that have a pair to be taken at their variant.  Equal
    fingerprints are taken where both are themselves.  Others meet at two variants, which
    differ in both fingerprints' differing bits: taken is the one whose lower such bit is 0."""
    order = np.argsort(v, kind="stable")
    new = np.ones(len(v), bool)
    new[1:] = v[order[1:]] != v[order[:-1]]
    size = np.diff(np.append(np.flatnonzero(new), len(v)))
    order = order[np.repeat(size > 1, size)]
    if not len(order):
        return order
    size = size[size > 1]
    v, f, first = v[order], f[order], np.cumsum(size) - size
    zero = (f >= 0) & ((v >> np.maximum(f, 0)) & 1 == 0)
    of = np.repeat(np.arange(len(size)), size)
    least_zero = np.minimum.reduceat(np.where(zero, f, 64), first)[of]
    least, most = np.minimum.reduceat(f, first)[of], np.maximum.reduceat(f, first)[of]
    selves = np.add.reduceat((f < 0).astype(np.int64), first)[of]
    taken = np.where(f < 0, (selves > 1) | (least_zero < 64), (zero & ((least < 0) | (most > f))) | (least_zero < f))
    return order[taken]


def _places(x: np.ndarray, part: int, split: int, bits: int):
    """The ``_useful`` rows of a part's ``variants``; those of a large group in turns, by
    further bits."""
    more = min(bits - split, max(0, math.ceil(math.log2(max(1, len(x) * bits / (2 * _PART))))))
    for k in range(1 << more):
        i, f, v = variants(x, part | k << split, split + more, bits)
        go = _useful(v, f)
        yield i[go], f[go], v[go]


def _split(spark: SparkSession, n: int, where: np.ndarray) -> int:
    """The low bits of a table's fingerprints by which ``n`` of them are dealt out."""
    bits, parts = where.shape[1], int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(bits - 1, max(0, math.ceil(math.log2(max(1, n * bits / _PART, 2 * parts / len(where))))))


def _by_part(it):
    """((table, part), columns) of rows sorted by these two.  Places of prefixes are small,
    so several of them come at once."""
    held, at, n = [], None, 0
    for b in it:
        cols = [np.asarray(c) for c in b.columns]
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(b)], strict=True):
            to = cols[0][i], cols[1][i]
            if held and to != at and (at[0] >= 0 or to[0] >= 0 or n >= _MOST):
                yield at, [np.concatenate(c) for c in zip(*held, strict=True)]
                held, n = [], 0
            at, n = to, n + j - i
            held.append([c[i:j] for c in cols])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held, strict=True)]


def _meetings(nodes: DataFrame, where: np.ndarray, split: int) -> DataFrame:
    """(t, part, x, s): the sets that meet others in a part of a table, each once there,
    and their fingerprints in the table.  Table -1 has the hashes that prefixes share."""
    words = [f"w{i}" for i in range(WORDS)]
    bits, parts = where.shape[1], int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(it):
        for b in it:
            w = np.stack([np.asarray(b.column(1 + i)).view(np.uint64) for i in range(WORDS)], axis=1)
            s = np.asarray(b.column(0))
            all_ = np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(len(b), -1), axis=1)
            for k, pos in enumerate(where):
                x = all_[:, pos].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                low = x & ((1 << split) - 1)
                to = np.concatenate([low, *(low ^ (1 << i) for i in range(split))])
                order = np.argsort(to, kind="stable")
                names, at = np.unique(to[order], return_index=True)
                of = order % len(x)
                ends = pa.py_buffer((np.append(at, len(of)) * 8).astype(np.int32))
                cols = [pa.Array.from_buffers(pa.binary(), len(names), [None, ends, pa.py_buffer(c[of])]) for c in (x, s)]
                yield pa.RecordBatch.from_arrays([pa.array(names + (k << split)), *cols], ["part", "x", "s"])

    def meet(it):
        held, at = [], None

        def met():
            x, s = (np.frombuffer(b"".join(c), np.int64) for c in zip(*held, strict=True))
            t, part = at >> split, at & ((1 << split) - 1)
            i = np.unique(np.concatenate([i for i, _, _ in _places(x, part, split, bits)]))
            for k in range(0, len(i), _MOST):
                some = i[k : k + _MOST]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), y)) for y in (t, part)] + [pa.array(x[some]), pa.array(s[some])], ["t", "part", "x", "s"])

        for b in it:
            for part, x, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if part != at and held:
                    yield from met()
                    held = []
                at = part
                held.append((x.as_py(), s.as_py()))
        if held:
            yield from met()

    packed = nodes.where("n > 0").select("s", *words).mapInArrow(tidied(emit), "part long, x binary, s binary")
    by_bits = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidied(meet), "t long, part long, x long, s long")
    heads = nodes.where(F.size("head") > 0).select(F.explode("head").alias("x"), "s")
    several = heads.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x")
    return by_bits.unionByName(heads.join(several, "x").select(F.lit(-1).cast("long").alias("t"), F.col("x").alias("part"), "x", "s"))


def _once(v: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs of rows are taken at this place, of a table's two (see ``_useful``)."""
    low, high = np.minimum(f[a], f[b]), np.maximum(f[a], f[b])
    bit = np.maximum(np.where(low < 0, high, low), 0)
    return np.where(low == high, low < 0, (v[a] >> bit) & 1 == 0)


def _with_ends(v: np.ndarray, f: np.ndarray, c: np.ndarray, s: np.ndarray, i: np.ndarray):
    """Rows with two of each place, the first and last by component and then by the set
    alone: a large group meets the same few sets at most of its places, so pairs are in
    proportion to the sets, and join most of the group.  Of a part's places those of a set
    itself and of a few differing bits are used."""
    order = np.lexsort((s[i], c[i], v))
    new = np.ones(len(v), bool)
    new[1:] = v[order[1:]] != v[order[:-1]]
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    few = f[order] < _FEW
    ends = np.concatenate((order[first[of]][few], order[np.append(first[1:], len(v))[of] - 1][few]))
    a, b = i[np.tile(order[few], 2)], i[ends]
    go = c[a] != c[b]
    pair = np.unique(np.minimum(a, b)[go] * len(s) + np.maximum(a, b)[go])
    for k in range(0, len(pair), _BLOCK):
        yield np.divmod(pair[k : k + _BLOCK], len(s))


def _across(v: np.ndarray, f: np.ndarray, c: np.ndarray, s: np.ndarray, i: np.ndarray):
    """All pairs of different components, where they are taken."""
    order = np.lexsort((c[i], v))
    v, f, i = v[order], f[order], i[order]
    last = np.ones(len(v), bool)
    last[:-1] = (v[1:] != v[:-1]) | (c[i[1:]] != c[i[:-1]])
    runs = np.flatnonzero(last) + 1
    after = runs[np.cumsum(last) - last]  # the next row that isn't of the same place and component
    count = np.searchsorted(v, v, "right") - after
    total = np.append(0, np.cumsum(count))
    k = 0
    while k < len(v):
        to = max(k + 1, int(np.searchsorted(total, total[k] + _BLOCK, "right")) - 1)
        m = count[k:to]
        a = np.repeat(np.arange(k, to), m)
        b = np.arange(len(a)) + np.repeat(after[k:to] - (total[k:to] - total[k]), m)
        go = _once(v, f, a, b)
        yield i[a[go]], i[b[go]]
        k = to


def _pairs(met: DataFrame, of: DataFrame | None, where: np.ndarray, split: int, some: bool) -> DataFrame:
    """(x, y): sets of different components ``of`` (none: each its own) that meet and may
    be at the threshold; all of them or, with ``some``, those with two of each place."""
    words, bits = [f"w{i}" for i in range(WORDS)], where.shape[1]
    masks = np.zeros((len(where), 64 * WORDS), np.uint8)
    masks[np.arange(len(where))[:, None], where] = 1
    masks = np.packbits(masks, axis=1).view(np.uint64)
    most = radius(_Q_SHORT, 4.0), radius(apart())

    def run(it):
        for (t, part), (_, _, x, s, c, n, *w) in _by_part(it):
            w = np.stack(w, axis=1).view(np.uint64)
            places = [(np.arange(len(x)), np.full(len(x), -1), x)] if t < 0 else _places(x, part, split, bits)
            for a, b in (pair for i, f, v in places for pair in (_with_ends if some else _across)(v, f, c, s, i)):
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                go = small >= large * LEAST - 1e-6
                a, b, small = a[go], b[go], small[go]
                d = w[a] ^ w[b]
                go = np.bitwise_count(d).sum(1) <= np.where(small <= SHORT, *most)
                a, b, d = a[go], b[go], d[go]
                for mask in masks[: 0 if some else max(0, t)]:  # a pair is taken in the first table where it meets
                    go = np.bitwise_count(d & mask).sum(1) > RADIUS
                    a, b, d = a[go], b[go], d[go]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[a], s[b])), pa.array(np.maximum(s[a], s[b]))], ["x", "y"])

    if of is None:
        rows = met.withColumn("c", F.col("s"))
    else:
        rows = met.join(of.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("component", "s"))
    dealt = rows.select("t", "part", "x", "s", "c", "n", *words).repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "part")
    return dealt.sortWithinPartitions("t", "part").mapInArrow(tidied(run), "x long, y long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(src, dst): the pairs whose sets are at the threshold or above."""
    def sets(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["s", "own"])

    def check(it):
        for b in it:
            held = [utf8(b.column(i)) for i in (2, 3)]
            ok = [jaccard(*(np.frombuffer(raw[off[k] : off[k + 1]].tobytes(), np.uint64) for raw, off in held)) >= LEAST - 1e-12 for k in range(len(b))]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    used = pairs.select(F.col("x").alias("s")).union(pairs.select(F.col("y").alias("s"))).distinct()
    texts = nodes.select("s", "row").join(used, "s").join(rows.select(F.col(_ROW).alias("row"), F.col(text).alias("t")), "row").select("s", "t")
    own = settle(texts.mapInArrow(tidied(sets), "s long, own binary"), rows=200)
    both = pairs.join(own.select(F.col("s").alias("x"), F.col("own").alias("a")), "x").join(own.select(F.col("s").alias("y"), F.col("own").alias("b")), "y")
    return both.select(F.col("x").alias("src"), F.col("y").alias("dst"), "a", "b").mapInArrow(tidied(check), "src long, dst long")


def _links(nodes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(src, dst): links that connect all that the verified pairs connect."""
    n, words = nodes.count(), [f"w{i}" for i in range(WORDS)]
    where = tables(n)
    split = _split(nodes.sparkSession, n, where)
    met = settle(_meetings(nodes, where, split), rows=2000)
    met = settle(met.join(nodes.select("s", "n", *words), "s"))
    first = settle(_pairs(met.where(F.col("t") < FIRST), None, where, split, some=True))
    done = settle(_verified(first, nodes, rows, text), rows=200)
    of = settle(components(done))
    more = settle(_pairs(met, of, where, split, some=True).join(first, ["x", "y"], "left_anti"))
    stars = of.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    done = settle(stars.unionByName(_verified(more, nodes, rows, text)), rows=200)
    of = settle(components(done))
    rest = settle(_pairs(met, of, where, split, some=False).join(first.unionByName(more), ["x", "y"], "left_anti"))
    stars = of.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return settle(stars.unionByName(_verified(rest, nodes, rows, text)), rows=200)


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest key (rows with null
    keys come last, and of rows with equal keys one is kept)."""
    rows = settle(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    own = settle(_sets(rows, text), rows=500)
    nodes = settle(own.groupBy("s").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("head").alias("head"), *(F.first(f"w{i}").alias(f"w{i}") for i in range(WORDS))))
    of = settle(components(_links(nodes, rows, text))).withColumnRenamed("node", "s")
    order = F.struct(F.col("key").isNull().alias("no_key"), F.col("key"), F.col("row"))
    ids = rows.select(F.col(_ROW).alias("row"), F.col(key).alias("key"))
    groups = own.select("row", "s").join(of, "s", "left").join(ids, "row").groupBy(F.coalesce("component", "s").alias("c"))
    kept = settle(groups.agg(F.min(order).alias("o")).select(F.col("o.row").alias(_ROW)))
    return rows.join(kept, _ROW, "left_semi").select(docs.columns)
