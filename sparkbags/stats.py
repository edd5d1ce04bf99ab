"""Counts and timings of actions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Statistics:
    rows: int
    seconds: float
    bytes_written: int = 0

    @property
    def bandwidth(self) -> float:
        """MB written in a second."""
        return self.bytes_written / 1e6 / self.seconds if self.seconds else 0.0

    def __str__(self) -> str:
        return f"{self.rows} rows, {self.bytes_written / 1e6:.1f} MB in {self.seconds:.2f} s ({self.bandwidth:.1f} MB/s)"


def measured_write(df: DataFrame, bag, mode: str = "append") -> Statistics:
    """Write to a bag and count the rows on the way, in the same job."""
    seen, before, began = Observation(), bag.size() if mode == "append" else 0, time.monotonic()
    bag.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), mode)
    return Statistics(seen.get["rows"], time.monotonic() - began, bag.size() - before)


def progress(spark) -> float:
    """Share of the tasks of all running stages that are done; 1 if none runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    total = sum(s.numTasks for s in stages)
    return sum(s.numCompletedTasks for s in stages) / total if total else 1.0
