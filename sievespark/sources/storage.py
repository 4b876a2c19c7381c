"""Where files are written: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder if the master is local, else an error."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not root:
        _own = _own or "file://" + tempfile.mkdtemp(prefix="sievespark-")
        root = _own
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
