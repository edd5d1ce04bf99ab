"""Consume-once reading of bags with Structured Streaming.

A reader's cursor is a checkpoint folder: files it has read are not handed out again;
a new folder rewinds.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> dict:
    """Write what is new since the checkpoint to a Parquet folder, exactly once; the
    progress of the last batch is returned."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    p = q.lastProgress
    return {"rows": sum(x["numInputRows"] for x in q.recentProgress), "last": p}


def consume(bag, checkpoint: str, into: str) -> DataFrame:
    """The rows of a bag that this cursor hasn't handed out yet.  A batch that is tried
    again replaces its own folder, so every row comes once."""
    target, done = f"{into.rstrip('/')}/{uuid.uuid4()}", set()
    schema = bag.schema or bag.df.schema

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/{batch}")
        done.add(batch)

    q = stream(bag.spark, bag.path, schema).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return bag.spark.createDataFrame([], schema)
    return bag.spark.read.schema(schema).parquet(*[f"{target}/{b}" for b in sorted(done)])


def drain_counts(counts: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """The last count of every group, open windows included: a watermark never passes
    the newest windows, so each batch writes the groups it changed (a batch that is
    tried again replaces its own folder) and a group's newest batch holds its count."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    spark = counts.sparkSession
    rest = [c for c in counts.columns if c not in keys]
    try:
        got = spark.read.schema(T.StructType([*counts.schema, T.StructField("batch", T.LongType())])).parquet(out)
    except AnalysisException:  # nothing was ever counted
        return spark.createDataFrame([], counts.schema)
    last = got.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*keys, *(f"last.{c}" for c in rest))


def rewind(checkpoint: str) -> str:
    """A new cursor: a checkpoint folder beside the old one."""
    return f"{checkpoint.rstrip('/')}-{uuid.uuid4().hex[:8]}"


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each key and window of event time; later rows than ``late`` are dropped
    by the watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
