"""Binary files written and read by Spark itself, so on any file system it knows.

The text writer passes bytes on as they are, so a table of byte strings becomes
files of those strings, each followed by a line end the caller chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(df: DataFrame, col: Column, path: str, end: str, rows_per_file: int = 0) -> None:
    """One file for each partition (and every ``rows_per_file`` rows, if given), of
    the values of ``col`` (binary) in the order of the rows, each followed by ``end``."""
    w = df.select(col.cast("string").alias("value")).write.option("lineSep", end).option("compression", "none")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): a row for each file that is not empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0).select("path", "content")
