"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else
as well, in the same document or another.  Strings never cross documents.

1. Every window of ``LENGTH`` bytes picks an anchor: of the ``GRAM``-byte strings in
   it, the one with the least hash.  Equal windows pick the same anchor at the same
   place, so a window can only repeat where its anchor does.  Runs of windows with
   one anchor make a context: the bytes these windows cover.
2. Contexts whose anchor occurs once are done.  Equal contexts are one text with a
   weight (those that a task reads together are combined before they are sent); of
   weight two or more, all its windows are repeated.
3. The other contexts of repeated anchors, with the texts of their anchor's heavier
   contexts, are dealt out by anchor.  Some shards of them are suffix-sorted and
   turned into Burrows-Wheeler transforms.  The transforms of all shards are merged:
   starting from the order of single symbols, the interleaving of the shards' sorted
   suffixes is refined until it reflects ``LENGTH`` symbols, each turn comparing the
   blocks of the last one at the place reached over the last-to-first mapping, so
   that the depth doubles.  Within a shard the order stands; a turn merges sorted
   runs.  Blocks of the last turn are the intervals of suffixes with a common prefix
   of at least ``LENGTH``: those of weight two or more are repeated strings.
4. Anchors with more than ``MOST_CONTEXTS`` different contexts would make a large
   group; the windows of these are counted by a 128-bit hash instead, in a shuffle
   that combines before it sends.

Each window start belongs to one context, so nothing is counted twice.  Anchors carry
64 bits of hash, contexts 128 bits more; other windows are compared as they are.

Null texts are empty.  Documents shorter than ``LENGTH`` lose nothing.  Rows are told
apart by a 128-bit identity of key and text, whatever the key holds: rows with equal or
null keys have each their own result, rows that agree in both lose the same bytes.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, identity, settle, tidied, utf8

LENGTH = 200
GRAM = 48
MOST_CONTEXTS = 16_384
#: Bytes of contexts merged at a time, and in one shard: their arrays stay in a core's cache.
MERGE_BYTES, SHARD_BYTES = 125_000, 31_250
_SLICE = 1 << 20
_ODD, _ODD_TOO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) <= n:
        got = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n + (1 << 16), base, np.uint64))))
        if n < 16 << 20:
            _powers[base] = got
    return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all strings within some bytes (of each, a multiply and a mix)."""

    def __init__(self, raw: np.ndarray, odd: int = _ODD):
        n = len(raw)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _power(odd, n)[:n], out=self.sum[1:])
        self.back = _power(pow(odd, -1, 1 << 64), n)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sum[b] - self.sum[a]) * self.back[a])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x if step == width else np.minimum(x[: len(x) - (width - step)], x[width - step :])


def contexts(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of all texts: first window, number of windows, anchor hash, two context hashes."""
    none = np.zeros(0, np.int64)
    big = np.flatnonzero(np.diff(off) >= length)
    if not len(big):
        return none, none, *[none.astype(np.uint64)] * 3
    h = Hashes(raw)
    n = len(raw)
    g = _mix((h.sum[gram:] - h.sum[:-gram]) * h.back[: n - gram + 1])
    # the high half of the hash decides, then the leftmost place
    least = _sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & _LOW
    mark = np.zeros(n + 1, np.int32)
    mark[off[big]] += 1
    np.subtract.at(mark, off[big + 1] - length + 1, 1)
    s = np.flatnonzero(np.cumsum(mark)[: len(least)] > 0)  # windows within a text
    at = least[s].astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(s) != 1)) + 1
    first = s[np.concatenate(([0], cut))]
    count = np.diff(np.concatenate(([0], cut, [len(s)])))
    # two texts that follow each other may share an anchor number by chance of place
    end = first + count - 1 + length
    return first, count, g[at[np.concatenate(([0], cut))]], h.of(first, end), Hashes(raw, _ODD_TOO).of(first, end)


def _local(a: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal contexts combined before anything is sent: the first of each has their
    number, the others 0; all of those with others are known to be repeated."""
    order = np.lexsort((d, c, a))
    new = np.ones(len(a), bool)
    new[1:] = np.diff(np.stack((a, c, d))[:, order]).any(0)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(a)))
    n, known = np.zeros(len(a), np.int32), np.empty(len(a), bool)
    n[order[at]] = size
    known[order] = np.repeat(size > 1, size)
    return n, known


def shard_transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of some texts (symbols are bytes plus one, 0 ends
    a text, ends are ordered as the texts), and which text's end precedes each row
    that holds a 0: that row is the text as a whole."""
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m) + 1
    end = np.cumsum(size) - 1
    n = int(size.sum())
    sym = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[end] = False
    sym[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    last = np.repeat(end, size)
    left = last - np.arange(n)

    def ahead(x, k):  # what stands k places on in the same text, else ends
        out = np.zeros(n, np.int64)
        out[: n - k] = x[k:]
        out[left < k] = 0
        return out

    key = (sym << 9) | ahead(sym, 1)
    key = (key << 18) | ahead(key, 2)
    key = (key << 27) | ahead(key >> 9, 4)
    order = np.argsort(key, kind="stable")
    rank = _blocks(key[order])
    by_place = np.empty(n, np.int64)
    by_place[order] = rank
    by_place[end] = np.arange(m)  # the rows of ends come first, in the order of texts
    order[:m] = end
    rank[:m] = np.arange(m)
    h = 7
    while True:
        active = _shared(rank)
        if not len(active):
            break
        rows = order[active]
        key = rank[active] * n + by_place[np.minimum(rows + h, last[rows])]
        turn = np.argsort(key, kind="stable")
        order[active] = rows = rows[turn]
        rank[active] = _refined(key[turn], rank[active], active)
        by_place[rows] = rank[active]
        h *= 2
    text_of = np.repeat(np.arange(m), size)
    first = np.zeros(n, bool)
    first[end - size + 1] = True
    bwt = np.where(first[order], 0, sym[order - 1])
    return bwt.astype(np.int16), text_of[order[bwt == 0]]


def _blocks(keys: np.ndarray) -> np.ndarray:
    """For sorted keys the place of the first equal one."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _shared(rank: np.ndarray) -> np.ndarray:
    """Places whose block has another row."""
    same = np.zeros(len(rank) + 1, bool)
    same[1:-1] = rank[1:] == rank[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def _refined(keys: np.ndarray, rank: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Block starts after sorting within blocks; active places are whole blocks."""
    return active[_blocks(keys)]


class Merged:
    """The merge of several transforms, refined to a depth."""

    def __init__(self, shards: list[np.ndarray], length: int = LENGTH):
        n = sum(map(len, shards))
        kind = np.int32 if n < 2**31 - 1 else np.int64  # of rows; many arrays of them are alive at once
        sym, nxt = np.empty(n, np.int16), np.empty(n, kind)
        at = 0
        self.base = []
        for b in shards:
            order = np.argsort(b, kind="stable")  # row f begins with symbol b[order[f]]
            sym[at : at + len(b)] = b[order]
            nxt[at : at + len(b)] = order + at
            ends = np.flatnonzero(sym[at : at + len(b)] == 0) + at
            nxt[ends] = ends
            self.base.append(at)
            at += len(b)
        self.next = nxt
        sym = sym.astype(np.int64)
        two = nxt.take(nxt)
        four = two.take(two)
        key = (sym << 9) | sym.take(nxt)
        key = (key << 18) | key.take(two)
        key = (key << 27) | (key >> 9).take(four)
        jump = {7: four.take(two.take(nxt))}
        del two, four
        order = np.argsort(key, kind="stable").astype(kind)  # merges the shards' sorted runs
        rank = _blocks(key[order]).astype(kind)
        by_row = np.empty(n, kind)
        by_row[order] = rank
        del sym, key
        h = 7
        while h < length:
            step = min(h, length - h)
            if step == h and step not in jump:
                half = jump[step // 2]
                jump[step] = half.take(half)
            active = _shared(rank)
            if not len(active):
                break
            rows = order[active]
            key = rank[active].astype(np.int64) * n + by_row.take(self._reached(rows, step, jump))
            turn = np.argsort(key, kind="stable")
            order[active] = rows = rows[turn]
            rank[active] = _refined(key[turn], rank[active], active)
            by_row[rows] = rank[active]
            h += step
        self.block = by_row  # equal: a common prefix of ``length`` symbols or up to an end

    def _reached(self, x: np.ndarray, step: int, jump: dict[int, np.ndarray]) -> np.ndarray:
        """The rows ``step`` symbols on from some rows."""
        for k in sorted(jump, reverse=True):
            while step >= k:
                x, step = jump[k].take(x), step - k
        for _ in range(step):
            x = self.next.take(x)
        return x


def repeated_starts(texts: list[bytes], weights: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text the starts of windows that, with the texts' weights, occur twice
    or more."""
    shards, who, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= shard_bytes or i == len(texts) - 1:
            b, ends = shard_transform([texts[j] for j in held])
            shards.append(b)
            who.append((np.flatnonzero(b == 0), np.array(held)[ends]))
            held, size = [], 0
    merged = Merged(shards, length)
    row = np.empty(len(texts), merged.next.dtype)
    for base, b, (zeros, ids), in zip(merged.base, shards, who, strict=True):
        row[ids] = zeros + base
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    seen = np.zeros(len(merged.next), np.int64)
    walk, live, x = [], np.flatnonzero(windows > 0).astype(row.dtype), row[windows > 0]
    for t in range(int(windows.max(initial=0))):
        keep = windows[live] > t
        live, x = live[keep], x[keep]
        blocks = merged.block[x]
        np.add.at(seen, blocks, weights[live])
        walk.append((live, blocks))
        x = merged.next[x]
    out: list[list[int]] = [[] for _ in texts]
    for t, (live, blocks) in enumerate(walk):
        for i in live[seen[blocks] > 1].tolist():
            out[i].append(t)
    return [np.array(x, np.int64) for x in out]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(x) != 1) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(x, cut)] if len(x) else []


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(k, a, b): byte ranges of repeated strings, overlapping, a few for each place."""
    spark = docs.sparkSession
    kind = "struct<hi:bigint,lo:bigint>"
    rows = docs.select(identity(F.col(key), F.col(text)).alias("k"), F.col(text).alias("t"))
    gram = min(gram, length)

    def find(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                raw, off = utf8(part.column(1))
                first, count, a, c, d = contexts(raw, off, length, gram)
                of = np.searchsorted(off, first, "right") - 1
                n, known = _local(a, c, d)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array((first - off[of]).astype(np.int32)), pa.array(count.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (a, c, d)), pa.array(n), pa.array(known)], ["k", "lo", "w", "a", "c", "d", "n", "known"])

    all_ = settle(rows.mapInArrow(tidied(find), f"k {kind}, lo int, w int, a long, c long, d long, n int, known boolean"))
    # tables, not plans: a join then deals out both sides anew, and Spark can divide an
    # anchor that a large part of the rows has
    often = settle(all_.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"))
    some = settle(all_.where("n > 0").join(often, "a", "left_semi"))
    # one row for each different context of a repeated anchor
    each = settle(some.groupBy("a", "c", "d").agg(F.sum("n").alias("n"), F.min(F.struct("k", "lo", "w")).alias("r")))
    per = each.groupBy("a").agg(F.count("*").alias("m"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("ones"))
    open_ = each.join(settle(per.where("m > 1 and ones > 0")), "a").select("a", "n", F.col("r.k").alias("k"), F.col("r.lo").alias("lo"), F.col("r.w").alias("w"), (F.col("m") > most_contexts).alias("large"))
    wanted = open_.groupBy("k").agg(F.collect_list(F.struct("a", "n", "lo", "w", "large")).alias("wanted"))  # bounded by the document

    def cut(it):
        unzip = zstandard.ZstdDecompressor()
        for b in it:
            for k, z, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = unzip.decompress(z)
                for i in range(0, len(wanted), 2000):
                    some = wanted[i : i + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([x["a"] for x in some], pa.int64()), pa.array([x["n"] for x in some], pa.int64()), pa.array([k] * len(some), b.schema.field(0).type), pa.array([x["lo"] for x in some], pa.int32()), pa.array([x["large"] for x in some], pa.bool_()), pa.array([raw[x["lo"] : x["lo"] + x["w"] - 1 + length] for x in some], pa.binary())], ["a", "n", "k", "lo", "large", "s"])

    pieces = _packed(rows).join(wanted, "k").select("k", "z", "wanted").mapInArrow(tidied(cut), f"a long, n long, k {kind}, lo int, large boolean, s binary")
    pieces = settle(pieces, rows=200)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merge(it):
        held, size = [], 0

        def done(upto):
            own = held[:upto]
            starts = repeated_starts([x[4] for x in own], np.array([x[1] for x in own]), length)
            got = [(x[2], x[3] + p, x[3] + q + length) for x, s in zip(own, starts, strict=True) if x[1] == 1 for p, q in _runs(s)]
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["k", "a", "b"])

        for b in it:
            key_type = b.schema.field(2).type
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= MERGE_BYTES and x[0] != held[-1][0]:
                    yield done(len(held))
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield done(len(held))

    merged = pieces.where("not large").drop("large").repartition(n, "a").sortWithinPartitions("a").mapInArrow(tidied(merge), f"k {kind}, a int, b int")

    def count(it):
        for b in it:
            for part in chunks(b, "s", _SLICE):
                raw, off = utf8(part.column(4))
                windows = np.diff(off) - length + 1
                of = np.repeat(np.arange(len(part)), windows)
                at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                s = off[of] + at
                h = [Hashes(raw, odd).of(s, s + length) for odd in (_ODD, _ODD_TOO)]
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(of)), pa.array((part.column(3).to_numpy()[of] + at).astype(np.int32)), part.column(1).take(pa.array(of)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))], ["k", "at", "n", "h", "i"])

    hashed = pieces.where("large").select("a", "n", "k", "lo", "s").mapInArrow(tidied(count), f"k {kind}, at int, n long, h long, i long")
    twice = hashed.groupBy("h", "i").agg(F.sum("n").alias("m")).where("m > 1").select("h", "i")
    counted = hashed.where("n = 1").join(twice, ["h", "i"], "left_semi").select("k", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    heavy = all_.where("known").select("k", "lo", "w").unionByName(some.where("not known").join(each.where("n > 1").select("a", "c", "d"), ["a", "c", "d"], "left_semi").select("k", "lo", "w"))
    heavy = heavy.select("k", F.col("lo").alias("a"), (F.col("lo") + F.col("w") - 1 + length).alias("b"))
    return heavy.unionByName(merged).unionByName(counted)


def _packed(rows: DataFrame) -> DataFrame:
    """Texts ``t`` in zstandard frames ``z``, for the shuffle, beside the other columns."""

    more = rows.columns[2:]

    def pack(it):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in (part for b in it for part in chunks(b, "t", _SLICE)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zip_.compress(("" if t is None else t).encode()) for t in b.column(1).to_pylist()], pa.binary()), *b.columns[2:]], ["k", "z", *more])

    return rows.mapInArrow(tidied(pack), ", ".join([f"k {rows.schema['k'].dataType.simpleString()}", "z binary", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[2:])]))


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, whole: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256): a row for each document.

    With ``whole`` also ``kept``, the text that is left without the bytes of
    characters that were cut apart, and ``row``, the other columns as a struct.
    """
    found = spans(docs, text, key, length, gram, most_contexts).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("r"))  # bounded by the document
    others = [f"`{c}`" for c in docs.columns if c != text]
    rows = docs.select(identity(F.col(key), F.col(text)).alias("k"), F.col(text).alias("t"), F.col(key).alias("key"), *([F.struct(*others).alias("row")] if whole else []))

    def cut(it):
        unzip = zstandard.ZstdDecompressor()
        for b in (b.slice(k, 64) for b in it for k in range(0, len(b), 64)):
            out = []
            for z, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = unzip.decompress(z)
                at, removed, parts, n = 0, 0, [], 0
                for x, y in sorted((s["a"], s["b"]) for s in r or []):
                    if x > at or not n:
                        parts.append(raw[at:x])
                        n += 1
                        removed -= x
                        removed += y
                        at = y
                    elif y > at:
                        removed += y - at
                        at = y
                parts.append(raw[at:])
                left = b"".join(parts)
                out.append((len(raw), removed, n, sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] if whole else [])))
            cols = list(zip(*out, strict=True)) if out else [[]] * (4 + whole)
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False)), *b.columns[3:]], names)

    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "row"] if whole else [])]
    kind = docs.schema[key].dataType.simpleString()
    more = f", kept string, row {rows.schema['row'].dataType.simpleString()}" if whole else ""
    joined = _packed(rows).join(found, "k", "left").select("z", "r", "key", *(["row"] if whole else []))
    return joined.mapInArrow(tidied(cut), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}").withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str | None = None, **settings) -> DataFrame:
    """The documents with repeated strings cut from their texts; all columns stay, and
    ``n_chars``, if named, is counted anew.  No document goes, even if nothing is left."""
    out = remove(docs, text, key, whole=True, **settings)
    cols = [F.col("kept").alias(c) if c == text else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*cols)
