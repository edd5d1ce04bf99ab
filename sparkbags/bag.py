"""Bags: named, schema-carrying collections kept as Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Bag:
    """A multiset of rows with a name and a schema; rows have no order."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, schema: T.StructType | str | None = None):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name or str(uuid.uuid4())
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path)

    def create(self) -> Bag:
        fs, path = self._fs()
        fs.mkdirs(path)
        return self

    @property
    def df(self) -> DataFrame:
        """All rows; a bag that nothing was written to is empty if its schema is known."""
        if not self.exists() or not self._files():
            if self.schema is None:
                raise FileNotFoundError(f"bag {self.name} is empty and has no schema")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(self.path)

    def _files(self) -> int:
        fs, path = self._fs()
        return len([s for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))])

    def chunks(self) -> list[str]:
        """The files of the bag in the order of their names: places to read from."""
        fs, path = self._fs()
        names = [s.getPath() for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]
        return sorted(p.toString() for p in names)

    def chunk(self, at: int) -> DataFrame:
        """The rows of one chunk, without reading the others."""
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(self.chunks()[at])

    def write(self, df: DataFrame, mode: str = "append") -> Bag:
        """Add rows (or replace them).  A bag can't be replaced by what reads it."""
        if self.schema is not None and [f.name for f in self.schema] != df.columns:
            df = df.select(*[f.name for f in self.schema])
        df.write.mode(mode).parquet(self.path)
        return self

    def truncate(self) -> Bag:
        fs, path = self._fs()
        fs.delete(path, True)
        return self.create()

    def view(self, name: str | None = None) -> DataFrame:
        """Register the bag for SQL."""
        self.df.createOrReplaceTempView(name or self.name)
        return self.df

    def size(self) -> int:
        """Bytes on disk."""
        fs, path = self._fs()
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0
