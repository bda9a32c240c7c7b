"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import EngineError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder if driver and executors are one process, and an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("INVALID_ARGUMENT", "spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
