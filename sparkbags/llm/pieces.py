"""Words of texts as arrays: splitting by the pattern of byte-level vocabularies, and
codes of words that are remembered.

``split`` finds the matches of the pattern in the bytes of many texts at once.  The
pattern's alternatives come down to runs of letters, numbers, white space and other
characters, with three rules at their edges: a space before a run of another kind
belongs to it; of white space before a run, the last character stands apart; and an
apostrophe that begins a match takes an English ending with it.

``Codes`` numbers distinct words.  Words meet by a 64-bit hash in a table of arrays and
are compared byte by byte, so a collision costs time but never a wrong result.
"""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_ODD = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
_FREE = np.uint64(0)
_kinds: list[np.ndarray] = []
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _kind_of() -> np.ndarray:
    """The kind of each code point."""
    if not _kinds:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        for first, last in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(first, last)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, text):
                    out[first + m.start() : first + m.end()] = kind
        _kinds.append(out)
    return _kinds[0]


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 is part of."""
    table = _kind_of()
    out = table[:128][raw & 127]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = raw[lead].astype(np.int64)
        size = np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
        code = np.where(b < 0xE0, b & 31, np.where(b < 0xF0, b & 15, b & 7))
        top = len(raw) - 1
        for k in range(1, 4):
            code = np.where(size > k, code << 6 | (raw[np.minimum(lead + k, top)] & 63), code)
        kind = table[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            some = size > k
            out[np.minimum(lead[some] + k, top)] = kind[some]
    return out


def split(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first byte of every match, in order; matches cover all bytes, and each
    text begins one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds(raw)
    head = np.zeros(n + 1, bool)
    head[off] = True  # a text's first byte
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | head[1:-1]
    # runs: first bytes and kinds
    run = np.flatnonzero(new)
    of = kind[run]
    joined = np.zeros(len(run), bool)  # the run before, of white space in the same text, ends here
    joined[1:] = (of[:-1] == SPACE) & (of[1:] != SPACE) & ~head[run[1:]]
    last = run[joined] - 1  # of that white space, the last character's last byte
    first = last.copy()
    while len(back := np.flatnonzero((raw[first] & 0xC0) == 0x80)):
        first[back] -= 1
    start = np.zeros(n + 1, bool)
    start[run] = True
    start[first] = True
    blank = raw[first] == 32
    start[last[blank] + 1] = False
    # an apostrophe of its own before letters
    at = run[(of == OTHER) & (raw[run] == 39)]
    at = at[start[at] & (at + 1 < n)]
    at = at[(kind[at + 1] == LETTER) & ~head[at + 1]]
    if len(at):
        b = raw[at + 1]
        two = (at + 2 < n) & ~head[np.minimum(at + 2, n)]
        c = np.where(two, raw[np.minimum(at + 2, n - 1)], 0)
        long = ((b == 114) & (c == 101)) | ((b == 118) & (c == 101)) | ((b == 108) & (c == 108))
        short = np.isin(b, np.frombuffer(b"stmd", np.uint8))
        start[at[short | long] + 1] = False
        for mark, width in ((short, 2), (long, 3)):
            rest = at[mark] + width
            rest = rest[(rest < n)]
            rest = rest[(kind[rest] == LETTER) & ~head[rest]]
            start[rest] = True
    return np.flatnonzero(start[:n])


def split_by(find, texts: list[str | None], off: np.ndarray) -> np.ndarray:
    """The same for any pattern whose matches cover a text; ``find`` lists them."""
    out = []
    for t, a in zip(texts, off.tolist(), strict=False):
        if t:
            size = np.fromiter((len(w.encode()) for w in find(t)), np.int64)
            out.append(a + np.cumsum(size) - size)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _powers[k] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n + (1 << 16), base, np.uint64))))
    up, down = _powers[0][:n], _powers[1][:n]
    if n > 8 << 20:  # of a very long text; not kept
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return up, down


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number above 0 for each word."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(h ^ (h >> np.uint64(29)), np.uint64(1))


class Table:
    """64-bit numbers above 0 to 32-bit numbers, by open addressing in arrays."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._resize(bits)

    def _resize(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """New keys, each once."""
        self.n += len(key)
        if 2 * self.n > len(self.keys):
            old = self.keys != _FREE
            key, value = np.concatenate((self.keys[old], key)), np.concatenate((self.values[old], value))
            self._resize(int(self.n).bit_length() + 1)
        at = self._slot(key)
        while len(key):  # linear probing; of those that want one slot, one gets it
            free = self.keys[at] == _FREE
            self.keys[at[free]] = key[free]
            won = self.keys[at] == key
            self.values[at[won]] = value[won]
            key, value, at = key[~won], value[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def get(self, key: np.ndarray, missing: int = -1) -> np.ndarray:
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], np.int32(missing))
        todo = np.flatnonzero((got != key) & (got != _FREE))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[at[todo]]
            out[todo] = np.where(got == key[todo], self.values[at[todo]], np.int32(missing))
            todo = todo[(got != key[todo]) & (got != _FREE)]
        return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Codes:
    """Numbers of distinct words and the ids each one has.  ``learn`` gives, for a list
    of words (bytes), the ids one after the other and their number for each word."""

    def __init__(self, learn, memory: int = 1 << 20):
        self.learn, self.memory = learn, memory
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.data = np.zeros(0, np.uint8)  # the words' bytes
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)  # where the ids of each word begin

    def _add(self, words: list[bytes]) -> np.ndarray:
        ids, n = self.learn(words)
        known = len(self.at) - 1
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.data = np.concatenate((self.data, np.frombuffer(b"".join(words), np.uint8)))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        self.ids = np.concatenate((self.ids, np.asarray(ids, np.int32)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n)))
        return np.arange(known, known + len(words), dtype=np.int64)

    def of(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """A code for each word of each part (bytes, first byte of each word)."""
        if len(self.at) > self.memory:
            self.forget()
        seen, fresh = [], {}
        for raw, start in parts:
            end = np.append(start[1:], len(raw))
            h = hashes(raw, start, end)
            code = self.table.get(h)
            miss = np.flatnonzero(code < 0)
            own, place = np.unique(h[miss], return_index=True)
            data, place = raw.tobytes(), miss[place]
            for k, i, j in zip(own.tolist(), start[place].tolist(), end[place].tolist(), strict=True):
                if k not in fresh:
                    fresh[k] = data[i:j]
            seen.append((code, h[miss]))
        if fresh:
            self.table.add(np.array(list(fresh), np.uint64), self._add(list(fresh.values())).astype(np.int32))
        out = []
        for (raw, start), (code, h) in zip(parts, seen, strict=True):
            code = code.astype(np.int64)
            code[code < 0] = self.table.get(h)
            size = np.diff(start, append=len(raw))
            end = start + size
            wrong = np.flatnonzero(size != self.at[code + 1] - self.at[code])
            same = np.setdiff1d(np.arange(len(code)), wrong, assume_unique=True) if len(wrong) else slice(None)
            differ = raw[spread(start[same], size[same])] != self.data[spread(self.at[code[same]], size[same])]
            if len(wrong) or differ.any():  # equal hashes of different words
                some = np.repeat(np.arange(len(code))[same], size[same])[differ]
                wrong = np.union1d(wrong, some)
                words = [raw[start[i] : end[i]].tobytes() for i in wrong.tolist()]
                each = sorted(set(words))
                code[wrong] = self._add(each)[np.searchsorted(np.array(each, object), np.array(words, object))]
            out.append(code)
        return out

    def encoded(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and their number for each word."""
        n = self.first[code + 1] - self.first[code]
        return self.ids[spread(self.first[code], n)], n
