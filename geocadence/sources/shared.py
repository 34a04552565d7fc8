"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
