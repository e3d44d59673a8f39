"""A folder for tables that only live as long as a query's result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: str | None = None


def scratch(spark: SparkSession, tag: str) -> str:
    """Under ``spark.checkpoint.dir``, which executors share; under a folder of our own where that is unset and Spark runs in one process."""
    global _OWN
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN = _OWN or tempfile.mkdtemp(prefix="sparrowlake-tables-")
        base = _OWN
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
