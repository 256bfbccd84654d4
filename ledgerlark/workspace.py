"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    """Remove the scratch folders of this driver; what a session that has ended left behind stays."""
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path, removed when the driver ends, below spark.checkpoint.dir; below a temporary folder where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: scratch data needs a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        _own[app] = base
    path = f"{base.rstrip('/')}/ledgerlark-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path
