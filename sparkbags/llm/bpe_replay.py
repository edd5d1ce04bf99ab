"""Byte-level BPE encoding by replaying merges over an inverted index, and decoding.

Texts are reduced to their distinct words (matches of the split pattern) that haven't
been merged yet.  All of them are one array of symbols with links to the neighbours.
An inverted index leads from each merge (by its rank) to the positions of the pairs it
joins, in whatever word they are.  The ranks are replayed once, from the lowest up:
each applies its merge at all positions at once, and only the two pairs that a merged
symbol touches are looked up again and entered in the index.

The index covers the words of some ``_BLOCK`` bytes of a task's texts at a time, as
much as a worker's memory should hold; merges in different words don't affect each
other, so ids don't depend on it.  Words already merged are remembered up to a bound.
Nothing is shuffled.

Equal ranks apply from left to right.  A vocabulary may have a merge of lower rank than
the one that brings its pair about; a word where that happens leaves the replay and is
merged on its own (``replay_long``), lowest rank first at every step, which is what
the rule means.  A word that is itself a token is that token.  Null texts are empty:
no tokens.  Rows with equal or null keys are encoded like any others, each a row.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, tidied, utf8
from .pieces import Codes, Table, split, split_by, spread

#: Bytes of text in one array, and bytes whose new words are replayed together.
_SLICE, _BLOCK = 1 << 20, 4 << 20
#: Words remembered by a worker before it starts anew.
MEMORY = 1 << 20
#: Ranks whose index is sorted at a time.
_SPAN = 512
NONE = np.int32(2**31 - 1)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def replay_long(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word, with a heap over ranks and lists of positions: a long
    word takes n log n steps."""
    sym: list[bytes | None] = []
    before: list[int] = []
    after: list[int] = []
    word_of: list[int] = []
    index: dict[int, list[int]] = {}
    heads = []
    for w, word in enumerate(words):
        at = len(sym)
        heads.append(at)
        if word in ranks or len(word) < 2:
            sym.append(word)
            before.append(-1)
            after.append(-1)
            word_of.append(w)
            continue
        n = len(word)
        sym += [word[i : i + 1] for i in range(n)]
        before += [-1, *range(at, at + n - 1)]
        after += [*range(at + 1, at + n), -1]
        word_of += [w] * n
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                index.setdefault(r, []).append(at + i)
    heap = list(index)
    heapq.heapify(heap)
    get = ranks.get
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        held = -1  # a word in which a lower rank has turned up
        for p in places:
            left = sym[p]
            q = after[p]
            if left is None or q < 0:
                continue
            both = left + sym[q]
            if get(both) != r:
                continue
            if word_of[p] == held:
                if r not in index:
                    heapq.heappush(heap, r)
                index.setdefault(r, []).append(p)
                continue
            sym[p] = both
            sym[q] = None
            q = after[q]
            after[p] = q
            if q >= 0:
                before[q] = p
                s = get(both + sym[q])
                if s is not None:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(heap, s)
                    index[s].append(p)
                    if s < r:
                        held = word_of[p]
            q = before[p]
            if q >= 0:
                s = get(sym[q] + both)
                if s is not None:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(heap, s)
                    index[s].append(q)
                    if s < r:
                        held = word_of[p]
    out = []
    for at in heads:
        ids = []
        while at >= 0:
            if sym[at]:
                ids.append(ranks[sym[at]])
            at = after[at]
        out.append(ids)
    return out


class Merges:
    """Every pair of tokens that merges and its rank, in a hash table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.zeros(256, np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32 | b) + 1)
                    values.append(rank)
        self.table = Table()
        self.table.add(np.array(keys, np.uint64), np.array(values, np.int32))
        self.top = max(ranks.values()) + 1
        pair = np.arange(256).repeat(256)
        self.first = self.rank(self.byte[pair], np.tile(self.byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)
        return self.table.get(key, int(NONE))


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word, one after the other, and their number."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    head = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = merges.byte[raw]
    m = len(raw)
    # neighbours; place m is beyond every word
    kind = np.int32 if m < 2**31 - 1 else np.int64
    after, before = np.arange(1, m + 1, dtype=kind), np.arange(-1, m, dtype=kind)
    tail = head + size - 1
    after[tail[size > 0]] = m
    before[:m][head[size > 0]] = m
    rank = np.full(m + 1, NONE, np.int32)  # of the pair that begins at a place
    rank[: max(0, m - 1)] = merges.first[raw[:-1], raw[1:]]
    rank[tail[size > 0]] = NONE
    whole = {i: merges.ranks[w] for i, w in enumerate(words) if len(w) > 1 and w in merges.ranks}
    if whole:  # tokens as they are
        some = np.fromiter(whole, np.int64, len(whole))
        rank[spread(head[some], size[some])] = NONE
    sym = np.append(sym, 0)
    dead = np.zeros(m + 1, bool)
    odd: list[np.ndarray] = []  # places of words that meet a lower rank than the current one
    place = np.flatnonzero(rank != NONE).astype(kind)
    waiting = [(rank[place], place)]
    for low in range(0, merges.top, _SPAN):
        # the index of the next ranks: their positions in order, and where each begins
        r, p = (np.concatenate(x) for x in zip(*waiting, strict=True))
        now = r < low + _SPAN
        waiting = [(r[~now], p[~now])]
        order = np.lexsort((p[now], r[now]))
        r, p = r[now][order], p[now][order]
        start = np.searchsorted(r, np.arange(low, low + _SPAN + 1)).tolist()
        late: dict[int, list[int]] = {}  # entries that came while their span was at work
        for k in range(_SPAN):
            own = p[start[k] : start[k + 1]]
            if more := late.pop(low + k, None):
                own = np.unique(np.concatenate((own, np.array(more, own.dtype))))
            elif not len(own):
                continue
            _apply(own, low + k, low, merges, sym, rank, before, after, dead, waiting, late, odd)
    live = ~dead[:m]
    left = np.add.reduceat(np.append(live, False), head, dtype=np.int64) * (size > 0)
    for i, token in whole.items():
        live[head[i] + 1 : head[i] + size[i]] = False
        sym[head[i]] = token
        left[i] = 1
    ids = sym[:m][live]
    if odd:
        again = np.unique(np.searchsorted(head + size, np.concatenate(odd), "right")).tolist()
        each = np.split(ids, np.cumsum(left)[:-1])
        for i, x in zip(again, replay_long([words[i] for i in again], merges.ranks), strict=True):
            each[i] = np.array(x, np.int32)
            left[i] = len(x)
        ids = np.concatenate(each)
    return ids, left


def _apply(own, r, low, merges, sym, rank, before, after, dead, waiting, late, odd) -> None:
    """Merge ``r`` at its places, and the new pairs into the index."""
    own = own[rank[own] == r]
    if not len(own):
        return
    if len(own) > 1:
        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        chained = after[own[:-1]] == own[1:]
        if chained.any():  # pairs that overlap: of a chain every second one, from the left
            first = np.concatenate(([True], ~chained))
            nth = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            own = own[nth % 2 == 0]
    gone = after[own]
    beyond = after[gone]
    sym[own] = r
    after[own] = beyond
    before[beyond] = own
    dead[gone] = True
    rank[gone] = NONE
    m = len(dead) - 1
    ahead = before[own]
    touched = np.concatenate((own, ahead))
    touched = touched[touched < m]
    to = after[touched]
    new = merges.rank(sym[touched], sym[to])
    new[to == m] = NONE
    rank[touched] = new
    some = new != NONE
    if not some.any():
        return
    touched, new = touched[some], new[some]
    if (early := new <= r).any():
        odd.append(touched[early])
        touched, new = touched[~early], new[~early]
    if (soon := new < low + _SPAN).any():
        for x, y in zip(new[soon].tolist(), touched[soon].tolist(), strict=True):
            late.setdefault(x, []).append(y)
        touched, new = touched[~soon], new[~soon]
    waiting.append((new, touched))


class Encoder:
    """Encodes blocks of texts; one for each worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from public_tokenizers import PATTERN

        self.find = None if pattern == PATTERN else regex.compile(pattern).findall
        merges = Merges(ranks)
        vocab = [b""] * merges.top
        for token, i in ranks.items():
            vocab[i] = token
        self.bytes = Pieces(vocab)
        self.decimal = Pieces([b"%d," % i for i in range(len(vocab))])
        self.codes = Codes(lambda words: replay(words, merges), MEMORY)

    def block(self, cols: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each array of texts the ids, and where each text's begin (and the last
        one's end)."""
        parts, offs = [], []
        for col in cols:
            raw, off = utf8(col)
            parts.append((raw, split(raw, off) if self.find is None else split_by(self.find, col.to_pylist(), off)))
            offs.append(off)
        out = []
        for (_, start), code, off in zip(parts, self.codes.of(parts), offs, strict=True):
            ids, n = self.codes.encoded(code)
            out.append((ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, off)]))
        return out


class Pieces:
    """Short byte strings by number, to be joined in bulk."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all ids, and where in them those of each text begin."""
        n = self.size[ids]
        return self.data[spread(self.at[ids], n)], np.concatenate(([0], np.cumsum(n)))[starts]


_encoders: dict[tuple, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(data), pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = False, digests: bool = True) -> DataFrame:
    """(key, n_tokens [, ids][, ids_sha256, decoded_sha256]) of every row.

    ``ranks`` is the content of a rank file; it is broadcast, and its size is that
    of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def coded(parts, enc):
        for part, (got, at) in zip(parts, enc.block([x.column(1) for x in parts]), strict=True):
            cols = {"k": part.column(0), "n_tokens": pa.array(np.diff(at))}
            if ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got))
            if digests:
                data, d = enc.decimal.join(got, at)
                cols["ids_sha256"] = pa.array([sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in itertools.pairwise(d.tolist())], pa.string())
                data, d = enc.bytes.join(got, at)
                cols["decoded_sha256"] = pa.array([sha256(data[a:b]).hexdigest() for a, b in itertools.pairwise(d.tolist())], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    def run(it):
        enc = encoder(shared.value, pattern)
        held, size = [], 0
        for b in it:
            for part in chunks(b, "t", _SLICE):
                held.append(part)
                size += part.column(1).nbytes
                if size >= _BLOCK:
                    yield from coded(held, enc)
                    held, size = [], 0
        if held:
            yield from coded(held, enc)

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidied(run), f"k {kind}, n_tokens long{more}").withColumnRenamed("k", key)


def decode(tokens: DataFrame, ranks: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text that a column of ids stands for (invalid UTF-8 is replaced)."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        vocab = {i: t for t, i in load_ranks(shared.value).items()}
        return col.map(lambda x: None if x is None else b"".join(map(vocab.__getitem__, x)).decode("utf-8", "replace"))

    return tokens.withColumn(out, text(ids))
