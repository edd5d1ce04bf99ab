"""Hash and partition expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flow_of(key: Column | str, k: int, hashed: bool = False) -> Column:
    """A flow number in [0, k): the key modulo k, or its hash modulo k."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key) if hashed else key.cast("long"), F.lit(k).cast("long")).cast("int")
