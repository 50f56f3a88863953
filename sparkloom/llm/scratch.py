"""Tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

Every table is plain Parquet on storage that all executors share, so a lost
executor costs at most the tasks that it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that Spark sends to a Python worker at once, at most (about; a single row may have more).
BATCH_BYTES = 8 << 20
_LIVE: dict[str, SparkSession] = {}
#: The folders made inside each open ``released``, innermost last.
_OPEN: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder; one is chosen here only if none is set and Spark runs in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/{os.getpid()}"
    return f"{folder.rstrip('/')}/sparkloom"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of a batch for Python workers to BATCH_BYTES, and keeps a lower one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = "".join(c for c in spark.conf.get(name) if c.isdigit())  # like 67108864b
    if not 0 < int(found or 0) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Spark then removes a query's shuffle files when the query is done; nothing reads them once its result is written.
_SHUFFLES_END_WITH_THE_QUERY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Written tables of one operator call: ``put`` writes and rereads, ``drop`` deletes.

    Tables that a returned DataFrame still reads are kept until the process
    ends, or until the end of the ``released`` block that the call stands in.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _LIVE[self.base] = spark
        for made in _OPEN:
            made.append(self.base)
        bound_batches(spark)

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.base}/{tag}"
        with settings(self.spark, _SHUFFLES_END_WITH_THE_QUERY):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            _delete(self.spark, f"{self.base}/{tag}")


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables of operators that were called inside; for callers that have written the results."""
    _OPEN.append([])
    try:
        yield
    finally:
        for base in _OPEN.pop():
            if base in _LIVE:
                _delete(_LIVE.pop(base), base)


@atexit.register
def _clean() -> None:
    for base, spark in _LIVE.items():
        try:
            _delete(spark, base)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue
