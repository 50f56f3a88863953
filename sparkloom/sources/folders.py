"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession


_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which goes when this process ends; a local one only where Spark runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, folder))
    return folder


@atexit.register
def _clean() -> None:
    for spark, folder in _MADE:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue
