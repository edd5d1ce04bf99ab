"""Session factory, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "sparkbags", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and ANSI mode on.

    ``master`` and further settings are only applied where given, so that
    ``spark-submit`` and cluster defaults stay in force.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(suffix="-sparkbags.zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(name)
        atexit.register(Path(name).unlink, missing_ok=True)
        _shipped.add(sc.applicationId)
    return spark


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all machines share.
    Only a session whose tasks all run in the driver's process may leave that unset: a
    temporary folder takes its place there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="sparkbags-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        base = f"file://{_own_dir[0]}"
    return f"{base.rstrip('/')}/bags-{uuid.uuid4().hex}"
