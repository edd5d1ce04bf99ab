"""Benchmark decontamination with suffix arrays over the training texts.

The words of a shard of training documents (what a task reads at a time) become
64-bit numbers, and the shard's suffixes are sorted as sequences of them.  Every
suffix of every benchmark item is then binary-searched in that array, one word
deeper at a time, all suffixes at once: the depth it reaches is its longest verbatim
match, the interval it ends in holds the places.  Words inside any occurrence of a
window are hit; documents with a hit are contaminated.

Only suffixes that can match enter the array: those whose first words begin, in that
order, some window (``PREFIX`` words, or the whole window if it is shorter).  Equal
windows are one query.  Matches are compared byte by byte in the end.  Items are a query set searched
against all rows: they are broadcast in blocks of at most ``BLOCK_BYTES`` of text,
one pass over the documents for each block.  Nothing is shuffled with one block.

Words are maximal runs of 0-9, a-z (after A-Z became lower case) and anything beyond
ASCII.  Null texts have no words; items without words are never hit.  With an empty
item table all documents are clean.  Equal item ids count as one item; items without
an id make hits, but don't appear in the list of items.  Documents with equal or null
keys have each their own row.
"""

from __future__ import annotations

import itertools
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, identity, settle, tidied, utf8
from .pieces import spread

WINDOW = 10
PREFIX = 4
BLOCK_BYTES = 16 << 20
_SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: A random 64-bit value for each byte.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n + (1 << 16), base, np.uint64))))
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts: numbers, places, and the text each is in."""

    def __init__(self, col: pa.Array):
        raw, off = utf8(col)
        self.data = _LOWER[raw]
        inside = _IS_WORD[self.data]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * up[:-1], out=total[1:])
        self.hash = _mix((total[self.end] - total[self.start]) * down[self.start])
        self.text_at = np.searchsorted(self.start, off)  # first word of each text, and the end


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each word on (shorter at the end)."""
    out = h.copy()
    for k in range(1, min(n, len(h))):
        out[: len(h) - k] = _mix(out[: len(h) - k] * np.uint64(3) + h[k:])
    return out


class Items:
    """A block of benchmark items, ready to be searched for.  Equal windows are one
    query, whatever the number of items that hold it."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        w = Words(texts)
        self.words, self.window = w, window
        n = np.diff(w.text_at)
        item = np.repeat(np.arange(len(ids)), n)
        left = w.text_at[1:][item] - np.arange(len(w.hash))  # words up to the item's end
        need = np.minimum(window, n[item])
        all_ = np.flatnonzero(left >= need)  # suffixes that a window begins
        same = _equal_windows(w, all_, need[all_])
        first, of = np.unique(same, return_inverse=True)
        self.query = all_[first]
        self.need, self.left = need[self.query], left[self.query]
        # the items of each query, each once, in order
        names = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}))}
        self.names = list(names)
        code = np.array([names.get(x, -1) for x in ids], np.int64)[item[all_]]
        pairs = np.unique(np.stack((of, code), 1)[code >= 0], axis=0) if len(all_) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        # the first words of queries, by how many tell a suffix apart
        start = np.minimum(PREFIX, self.need)
        self.prefixes = [(int(k), Known(_grams(w.hash, int(k))[self.query[start == k]])) for k in np.unique(start)]


def _equal_windows(w: Words, at: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each window the place (in ``at``) of the first one with the same words."""
    out = np.arange(len(at))
    for n in np.unique(need):
        some = np.flatnonzero(need == n)
        _, first, back = np.unique(_grams(w.hash, int(n))[at[some]], return_index=True, return_inverse=True)
        to = first[back]
        words = np.arange(n)
        equal = (w.hash[at[some][:, None] + words] == w.hash[at[some][to][:, None] + words]).all(1)
        out[some[equal]] = some[to[equal]]
    return out


class Known:
    """A set of numbers with a bitmap in front."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = max(16, int(len(self.values)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.values >> self.shift).astype(np.int64)] = True

    def places(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(x >> self.shift).astype(np.int64)])
        return at[np.isin(x[at], self.values)]


def search(items: Items, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of at least a window: (word of the text, query, length), the longest
    verbatim match of that suffix with the item the query was taken from."""
    none = np.zeros(0, np.int64)
    if not len(items.query) or not len(w.hash):
        return none, none, none
    at = np.unique(np.concatenate([known.places(_grams(w.hash, k)) for k, known in items.prefixes]))
    if not len(at):
        return none, none, none
    text = np.searchsorted(w.text_at, at, "right") - 1
    room = w.text_at[text + 1] - at
    depth = items.window

    def word(k: int) -> np.ndarray:  # the k-th word of each suffix; 0: beyond its text
        return np.where(room > k, w.hash[np.minimum(at + k, len(w.hash) - 1)] | np.uint64(1), np.uint64(0))

    keys = [word(k) for k in range(depth)]
    order = np.lexsort(keys[::-1])
    at, room = at[order], room[order]
    keys = [k[order] for k in keys]
    # binary search, one word deeper at a time, of all item suffixes at once
    lo, hi = np.zeros(len(items.query), np.int64), np.full(len(items.query), len(at), np.int64)
    for k in range(depth):
        go = np.flatnonzero((items.need > k) & (lo < hi))
        want = items.words.hash[items.query[go] + k] | np.uint64(1)
        for side in (0, 1):
            a, b = lo[go].copy(), hi[go].copy()
            while len(open_ := np.flatnonzero(a < b)):
                mid = (a[open_] + b[open_]) >> 1
                got = keys[k][mid]
                right = got <= want[open_] if side else got < want[open_]
                a[open_] = np.where(right, mid + 1, a[open_])
                b[open_] = np.where(right, b[open_], mid)
            if side:
                new_hi = a
            else:
                new_lo = a
        lo[go], hi[go] = new_lo, new_hi
    n = np.maximum(hi - lo, 0)
    q = np.repeat(np.arange(len(n)), n)
    start, room = at[spread(lo, n)], room[spread(lo, n)]
    # equal numbers are very likely equal words; make sure
    same = np.concatenate([np.ones(0, bool), *(_same_words(w, start[k : k + 4096], items.words, items.query[q[k : k + 4096]], items.need[q[k : k + 4096]]) for k in range(0, len(q), 4096))])
    q, start, room = q[same], start[same], room[same]
    length, j = items.need[q].copy(), items.query[q]
    most = np.minimum(room, items.left[q])
    go = np.arange(len(q))
    while len(go := go[length[go] < most[go]]):
        go = go[w.hash[start[go] + length[go]] == items.words.hash[j[go] + length[go]]]
        length[go] += 1
    return start, q, length


def _same_words(w: Words, a: np.ndarray, v: Words, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from a on are, byte by byte, those from b on."""
    i, j, of = spread(a, n), spread(b, n), np.repeat(np.arange(len(n)), n)
    size = w.end[i] - w.start[i]
    bad = np.zeros(len(n), bool)
    fits = size == v.end[j] - v.start[j]
    bad[of[~fits]] = True
    i, j, of, size = i[fits], j[fits], of[fits], size[fits]
    differ = w.data[spread(w.start[i], size)] != v.data[spread(v.start[j], size)]
    bad[np.repeat(of, size)[differ]] = True
    return ~bad


def _spans(docs: DataFrame, items: Items):
    """A function of batches of (key, text) that makes a row for each document: its
    number of words, its spans of hit words, its items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                w, own = Words(part.column(1)), shared.value
                start, q, length = search(own, w)
                of = np.searchsorted(w.text_at, start, "right") - 1
                order = np.lexsort((start, of))
                first = (start - w.text_at[of])[order]
                at = np.searchsorted(of[order], np.arange(len(part) + 1))
                kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(first + length[order])], fields=list(kind)))
                # each item of a document once
                met = np.unique(np.stack((of, q), 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
                names: list[list[str]] = []
                cuts = np.searchsorted(met[:, 0], np.arange(len(part) + 1)).tolist()
                for x, y in itertools.pairwise(cuts):
                    some = met[x:y, 1]
                    got = np.unique(own.item[spread(own.item_at[some], own.item_at[some + 1] - own.item_at[some])]) if y > x else []
                    names.append([own.names[i] for i in got])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.text_at)), spans, pa.array(names, pa.list_(pa.string()))], ["k", "n_words", "spans", "items"])

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents without a hit, as they are.  Equal texts share their lot."""
    mark = docs.select(identity(F.col(text)).alias("id"), F.col(text).alias(text))
    gone = settle(contamination(mark, items, text=text, key="id", **settings).where("contaminated").select("id").distinct())
    return docs.join(gone, identity(F.col(text)) == gone["id"], "left_anti")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, spans, items, contaminated): a row
    for each document.  ``spans`` are merged runs of hit words, ``items`` sorted ids.
    Rows are told apart by an identity of their own, whatever ``key`` holds."""
    q = items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = q.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if blocks > 1:  # what the blocks find of a row meets by the row's own identity
        ids = settle(rows.select(F.monotonically_increasing_id().alias("row"), "k", "t"))
        rows = ids.select(F.col("row").alias("k"), "t")
    found = None
    for i in range(blocks):
        got = q.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i).orderBy("k", "t").toArrow()  # of bounded size
        search_block = _spans(docs, Items(got.column(0).to_pylist(), got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.string()), window))
        if blocks == 1:
            break
        one = rows.mapInArrow(tidied(search_block), f"k long, n_words long, spans array<struct<a:long,b:long>>, items array<string>")
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("k").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = found.withColumnRenamed("k", "row").join(ids.select("row", "k"), "row")

    def run(it):
        for b in it:
            hit, merged, names, sha = [], [], [], []
            for spans, ids in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                hit.append(sum(y - x for x, y in runs))
                merged.append([{"a": x, "b": y} for x, y in runs])
                names.append(sorted(set(ids)))
                sha.append(sha256(",".join(names[-1]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()), pa.array(merged, b.schema.field(2).type), pa.array(names, pa.list_(pa.string())), pa.array([x > 0 for x in hit], pa.bool_())], [f.name for f in schema])

    schema = docs.sparkSession.createDataFrame([], f"k {kind}, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<a:long,b:long>>, items array<string>, contaminated boolean").schema
    if blocks == 1:  # one Python step
        return rows.mapInArrow(tidied(lambda it: run(search_block(it))), schema).withColumnRenamed("k", key)
    return found.select("k", "n_words", "spans", "items").mapInArrow(tidied(run), schema).withColumnRenamed("k", key)
