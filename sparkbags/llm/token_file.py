"""Token ids in files of patched frame-of-reference blocks.

Format of a file (numbers are little-endian):

    "SBTF" u32 version   u64 ids before this file in its partition   u32 partition
    u64 ids   u32 documents   u32 blocks   u32 block size
    block starts: u32 for each block, from the first block's start
    document keys: i64 each        document lengths in ids: u32 each
    blocks, each:
        u32 minimum   u8 width   u16 exceptions   u16 ids
        the ids less the minimum, packed at ``width`` bits, lowest bits first
        positions of the exceptions: u16 each     their high bits: u32 each

The width of a block is the one a percentile of its values fits (the percentile, of
those tried, that makes the block smallest); of values that don't fit, the low bits
are packed and the rest is an exception.  Blocks run on over document ends.  Files
follow each other in ascending order of the key and hold about ``FILE_IDS`` ids (a
single longer document makes a longer file).
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, chunks, settle, tidied, utf8, work_dir
from .files import read_files, write_bytes
from .pieces import Codes, split

BLOCK = 1024
FILE_IDS = 1 << 20
#: Stands for a null key in a file.
NO_KEY = -(1 << 63)
PERCENTILES = (80, 90, 95, 99, 100)
_HEAD = struct.Struct("<4sIQIQIII")
_BLOCK = struct.Struct("<IBHH")
_SLICE = 1 << 20


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ids, the last one shorter."""
    full = len(ids) // BLOCK * BLOCK
    out = _pack(ids[:full].reshape(-1, BLOCK)) if full else []
    return out + (_pack(ids[full:][None]) if full < len(ids) else [])


def _pack(ids: np.ndarray) -> list[bytes]:
    low = ids.min(1)
    v = ids - low[:, None]
    n = v.shape[1]
    ordered = np.sort(v, 1)
    cost = np.full(len(v), 1 << 40)
    width = np.zeros(len(v), np.int64)
    for p in PERCENTILES:
        w = np.ceil(np.log2(ordered[:, -(-n * p // 100) - 1].astype(np.float64) + 1)).astype(np.int64)
        c = w * n + 48 * (v >= (np.int64(1) << w)[:, None]).sum(1)
        better = c < cost
        cost[better], width[better] = c[better], w[better]
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for some in np.split(rows, range(64, len(rows), 64)):
            x = v[some]
            byte = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(len(some), n, 4)
            bits = np.unpackbits(byte, axis=2, count=w, bitorder="little") if w else np.zeros((len(some), n, 0), np.uint8)
            packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            high = (x.astype(np.uint64) >> np.uint64(w)).astype("<u4")
            for k, i in enumerate(some.tolist()):
                more = np.flatnonzero(high[k])
                out[i] = _BLOCK.pack(int(low[i]), w, len(more), n) + packed[k].tobytes() + more.astype("<u2").tobytes() + high[k][more].tobytes()
    return out


def unpack_blocks(data: memoryview, at: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at these places, one block after the other."""
    heads = [_BLOCK.unpack_from(data, x) for x in at]
    n = np.array([h[3] for h in heads], np.int64)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), "<u4")
    for width, size in sorted({(h[1], h[3]) for h in heads}):
        rows = [k for k, h in enumerate(heads) if (h[1], h[3]) == (width, size)]
        packed = -(-width * size // 8)
        for some in (rows[k : k + 64] for k in range(0, len(rows), 64)):
            raw = np.stack([np.frombuffer(data, np.uint8, packed, at[k] + _BLOCK.size) for k in some])
            value = np.zeros((len(some), size), np.uint32)
            if width:
                place = np.arange(size, dtype=np.int64) * width  # of a value's first bit
                raw = np.pad(raw, ((0, 0), (0, 8))).astype(np.uint64)
                for k in range((width + 14) // 8):  # bytes that a value may lie in
                    value |= ((raw[:, (place >> 3) + k] << np.uint64(8 * k)) >> (place & 7).astype(np.uint64)).astype(np.uint32)
                value &= np.uint32((1 << width) - 1)
            for k, v in zip(some, value, strict=True):
                low, _, n_out, _ = heads[k]
                if n_out:
                    x = at[k] + _BLOCK.size + packed
                    v[np.frombuffer(data, "<u2", n_out, x)] |= (np.frombuffer(data, "<u4", n_out, x + 2 * n_out).astype(np.uint64) << np.uint64(width)).astype("<u4")
                out[first[k] : first[k] + size] = v + np.uint32(low)
    return out


def pack_file(partition: int, before: int, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks[:-1])])[: len(blocks)]
    return b"".join([_HEAD.pack(b"SBTF", 1, before, partition, len(ids), len(keys), len(blocks), BLOCK), starts.astype("<u4").tobytes(), keys.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), *blocks])


class TokenFile:
    """Reads a file; any run of ids without the blocks before it."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, version, self.before, self.partition, self.n_ids, n_docs, n_blocks, self.block = _HEAD.unpack_from(self.data)
        if magic != b"SBTF" or version != 1:
            raise ValueError("not a token file of version 1")
        at = _HEAD.size
        self.starts = np.frombuffer(self.data, "<u4", n_blocks, at).astype(np.int64)
        self.keys = np.frombuffer(self.data, "<i8", n_docs, at := at + 4 * n_blocks)
        self.lengths = np.frombuffer(self.data, "<u4", n_docs, at := at + 8 * n_docs).astype(np.int64)
        self.first = at + 4 * n_docs

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        i = a // self.block
        got = unpack_blocks(self.data, (self.first + self.starts[i : -(-b // self.block)]).tolist())
        return got[a - i * self.block : b - i * self.block]

    def documents(self):
        """(key, ids before it in its partition, ids) of each document."""
        at, ids = 0, self.ids(0, self.n_ids)
        for k, n in zip(self.keys.tolist(), self.lengths.tolist(), strict=True):
            yield k, self.before + at, ids[at : at + n]
            at += n


class LibraryEncoder:
    """Encodes with a ``tokenizers`` file.

    For a byte-level vocabulary the pieces of all texts are found at once, and the
    library merges each distinct one once, many in a call; a text in which an added
    token's string occurs goes to the library whole, which treats it as that token.
    With any other vocabulary every text does.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(data)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.merging = self._merging()
        self.codes = Codes(self.learn)

    def _merging(self):
        """A tokenizer that only merges pieces; None if pieces aren't byte-level."""
        from tokenizers import Tokenizer

        made = json.loads(self.tok.to_str())
        pre = made["pre_tokenizer"] or {}
        if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        # each byte stands for itself if it prints, the others follow from 256 on; no
        # UTF-8 has the byte 255, which keeps pieces apart
        self.letter = np.zeros(256, "<u4")
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter[prints] = prints
        others = np.setdiff1d(np.arange(256), prints)
        self.letter[others] = 256 + np.arange(len(others))
        self.letter[255] = 10
        self.between = max(made["model"]["vocab"].values()) + 1 + len(made["added_tokens"])
        made["model"]["vocab"]["\n"] = self.between
        made |= {"pre_tokenizer": {"type": "Split", "pattern": {"String": "\n"}, "behavior": "MergedWithPrevious", "invert": False}, "post_processor": None, "decoder": None, "added_tokens": []}
        return Tokenizer.from_str(json.dumps(made))

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(pieces), 4000):
            some = pieces[k : k + 4000]
            text = self.letter[np.frombuffer(b"\xff".join(some), np.uint8)].tobytes().decode("utf-32-le")
            got = np.array(self.merging.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.concatenate(([-1], np.flatnonzero(got == self.between), [len(got)]))
            sizes.append(np.diff(cuts) - 1)
            ids.append(got[got != self.between])
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` last in each, and their number by text."""
        raw, off = utf8(col)
        if self.merging is None:
            whole = np.arange(len(col))
            raw, off = raw[:0], np.zeros_like(off)
        else:
            whole = self._with_added(raw, off)
        start = split(raw, off)
        ids, n = self.codes.encoded(self.codes.of([(raw, start)])[0]) if len(start) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, off)]
        size = np.diff(ends) + 1
        out = np.full(size.sum(), end_id, np.int64)
        mine = np.ones(len(out), bool)
        mine[np.cumsum(size) - 1] = False
        out[mine] = ids
        if len(whole):
            texts = np.split(out, np.cumsum(size)[:-1])
            for i in whole.tolist():
                texts[i] = np.array([*self.tok.encode(col[i].as_py() or "", add_special_tokens=False).ids, end_id], np.int64)
                size[i] = len(texts[i])
            out = np.concatenate(texts)
        return out, size

    def _with_added(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The texts in which an added token's string occurs."""
        data, found = raw.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                found.add(i)
                if at + len(token) > off[i + 1]:  # runs over the text's end
                    found.discard(i)
                    at = data.find(token, at + 1)
                else:
                    at = data.find(token, int(off[i + 1]))
        return np.array(sorted(found), np.int64)


_encoders: dict[int, LibraryEncoder] = {}


def write(docs: DataFrame, tokenizer: bytes, end_id: int, path: str, text: str = "text", key: str = "doc_id", file_ids: int = FILE_IDS) -> None:
    """Encode all texts (null: empty), append ``end_id`` to each, and write the ids in
    ascending order of ``key`` (an integer; null comes first, as ``NO_KEY``; equal keys
    stay neighbours)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.col(text).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k")

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if (h := hash(shared.value)) not in _encoders:
            _encoders.clear()
            _encoders[h] = LibraryEncoder(shared.value)
        enc = _encoders[h]
        before, size, held, keys, lengths = 0, 0, [], [], []

        def file():
            nonlocal before
            ids = np.concatenate(held).astype(np.int64)
            data = pack_file(part, before, np.array(keys, np.int64), np.array(lengths, np.int64), ids)
            before += len(ids)
            held.clear(), keys.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for b in it:
            for some in chunks(b, "t", _SLICE):
                ids, n = enc.encode(some.column(1), end_id)
                at = 0
                for k, m in zip(some.column(0).to_pylist(), n.tolist(), strict=True):
                    keys.append(k)
                    lengths.append(m)
                    held.append(ids[at : at + m])
                    at += m
                    size += m
                    if size >= file_ids:
                        yield file()
                        size = 0
        if keys:
            yield file()

    with batches(spark, 1000):
        write_bytes(rows.mapInArrow(tidied(run), "data binary"), F.col("data"), path, "\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, partition, at, ids) from all files of a folder; ``at`` counts the ids
    before a document in its partition."""

    def run(it):
        for b in it:
            for data in b.column(0):
                rows = [(k, f.partition, at, ids) for f in [TokenFile(data.as_py())] for k, at, ids in f.documents()]
                for i in range(0, len(rows), 256):
                    k, p, at, ids = zip(*rows[i : i + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int32()), pa.array(at, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["key", "part", "at", "ids"])

    return read_files(spark, path).select("content").mapInArrow(tidied(run), "key long, part int, at long, ids binary")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files: ``start`` counts the ids of
    all documents before, over all files."""

    def run(it):
        for b in it:
            for data in b.column(0):
                f = TokenFile(data.as_py())
                raw = memoryview(f.ids(0, f.n_ids).astype("<u4").tobytes())
                ends = np.cumsum(f.lengths)
                at = ends - f.lengths
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.keys), pa.array(np.full(len(at), f.partition, np.int32)), pa.array(f.before + at), pa.array(f.lengths), pa.array(crc, pa.int64())], ["key", "part", "at", "n_tokens", "ids_crc32"])

    files = read_files(spark, path).select("content")
    rows = settle(files.mapInArrow(tidied(run), "key long, part int, at long, n_tokens long, ids_crc32 long"), rows=4)  # files
    # one row for each partition of the range, as many as Spark keeps tasks of anyway
    totals = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    order = sorted(totals)
    base = dict(zip(order, itertools.accumulate([0, *(totals[p] for p in order)]), strict=False))
    base = spark.createDataFrame([(p, n) for p, n in base.items()] or [], "part int, base long")
    return rows.join(F.broadcast(base), "part").select(F.nullif(F.col("key"), F.lit(NO_KEY)).alias("key"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: bytes, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the files to a new folder in the shared one, and read them back."""
    path = work_dir(docs.sparkSession)
    write(docs, tokenizer, end_id, path, text, key)
    return documents(docs.sparkSession, path).withColumnRenamed("key", key)
