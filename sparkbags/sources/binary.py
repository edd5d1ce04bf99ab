"""Fixed-width binary records, text, and sequence files.

Records are packed back to back.  Reading maps whole records of each file; bytes
after the last whole record are left out.  Pairs of ints are little-endian, all else
is big-endian.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats: numpy fields in file order, and the Spark schema.
FORMATS: dict[str, tuple[list[tuple[str, str]], str]] = {
    "int": ([("value", ">i4")], "value int"),
    "long": ([("value", ">i8")], "value bigint"),
    "float": ([("value", ">f4")], "value float"),
    "double": ([("value", ">f8")], "value double"),
    "byte": ([("value", "i1")], "value tinyint"),
    "short": ([("value", ">i2")], "value smallint"),
    "char": ([("value", ">u2")], "value string"),
    "int_pair": ([("_1", "<i4"), ("_2", "<i4")], "_1 int, _2 int"),
}


def register(name: str, fields: list[tuple[str, str]], schema: str) -> None:
    """Add a record format: numpy fields in file order, and its Spark schema."""
    FORMATS[name] = (fields, schema)


def decode(data: bytes, name: str) -> list[np.ndarray]:
    kind = np.dtype(FORMATS[name][0])
    rows = np.frombuffer(data, kind, len(data) // kind.itemsize)
    cols = [rows[f].astype(rows.dtype[f].newbyteorder("=")) for f in rows.dtype.names]
    return [np.array([chr(c) for c in cols[0].tolist()], object)] if name == "char" else cols


def encode(cols: list[np.ndarray], name: str) -> bytes:
    kind = np.dtype(FORMATS[name][0])
    rows = np.empty(len(cols[0]), kind)
    for f, c in zip(kind.names, cols, strict=True):
        rows[f] = [ord(x) for x in c] if name == "char" else c
    return rows.tobytes()


def read_binary(spark: SparkSession, path: str, name: str, rows: int = 65536) -> DataFrame:
    """Records of all files below a path."""
    fields, schema = FORMATS[name]

    def run(it):
        for b in it:
            for data in b.column(0):
                cols = decode(data.as_py(), name)
                for i in range(0, len(cols[0]), rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + rows]) for c in cols], [f for f, _ in fields])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, schema)


def write_binary(df: DataFrame, path: str, name: str) -> None:
    """Rows as Hadoop sequence-free binary files: one for each partition, by Spark's
    text writer, which passes bytes on; every file ends with one line feed that is no
    whole record (formats of one byte can't be told from it and are refused)."""
    fields, schema = FORMATS[name]
    if np.dtype(fields).itemsize == 1:
        raise ValueError("one-byte records need write_sequence")

    def run(it):
        got = [b for b in it if len(b)]
        if got:
            t = pa.Table.from_batches(got)
            cols = [np.asarray(c) if name != "char" else np.array(c.to_pylist(), object) for c in t.columns]
            yield pa.RecordBatch.from_arrays([pa.array([encode(cols, name)], pa.binary())], ["data"])

    df.select(*[f for f, _ in fields]).mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_text(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """(value): records that end with ``sep`` only, so a carriage return is text."""
    return spark.read.option("lineSep", sep).text(path)


def write_text(df: DataFrame, path: str, col: str = "value", sep: str = "\n", replication: int | None = None) -> None:
    """Each value followed by ``sep``; ``replication`` is that of the file system."""
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("dfs.replication")
    if replication:
        conf.set("dfs.replication", str(replication))
    try:
        df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").option("lineSep", sep).text(path)
    finally:
        if replication:
            conf.set("dfs.replication", before) if before else conf.unset("dfs.replication")


def write_sequence(df: DataFrame, path: str, key: str, value: str) -> None:
    """A Hadoop sequence file of two columns, for programs that need one."""
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)


def read_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
