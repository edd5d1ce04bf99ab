"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder of the cluster.

    ``spark.checkpoint.dir`` names the folder all machines share.  Only a session
    whose tasks all run in the driver's process (as in tests) may leave it unset: a
    temporary folder takes its place there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="sparkbags-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        base = f"file://{_own_dir[0]}"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int = 10_000, size: int = 16 << 20):
    """Bounds Arrow batches by rows and bytes for what is written inside; the session's
    own settings come back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(df: DataFrame, compression: str = "zstd", rows: int = 10_000, size: int = 16 << 20, outer: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors.  Within ``scratch`` the
    table goes when the block ends, or with ``outer`` when the block around it does.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    with batches(spark, rows, size):
        df.write.option("compression", compression).parquet(path)
    if len(_scratch) > outer:
        _scratch[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables settled inside are deleted at the end, so nothing that reads them may
    leave the block unsettled."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


def identity(*cols: Column) -> Column:
    """128 bits of the values (null is a value too).  Rows that agree in all of them
    are one to whoever asks by it, and recomputed rows keep it."""
    given = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *given).alias("hi"), F.xxhash64(F.lit(2), *given).alias("lo"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without copying, and n+1 offsets into
    them.  Nulls come out empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, name: str, most: int):
    """Slices of a batch whose ``name`` texts hold about ``most`` bytes (one row at
    least, so a longer text is a slice of its own)."""
    _, off = utf8(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def crc32_of(col: str):
    """crc32 of a value's decimal text, as a long."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def tidied(f):
    """A function of Arrow batches that gives free memory back to the system as it
    goes; idle workers would keep it from their neighbours."""

    def release():
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def fed(it):
        for i, b in enumerate(it):
            yield b
            if i % 8 == 7:
                release()

    def run(it):
        try:
            yield from f(fed(it))
        finally:
            release()

    return run
