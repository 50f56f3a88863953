"""Session settings and table registration."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Settings that every query can rely on; all can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "sparkloom") -> SparkSession:
    """A session in this process, for tests and the shell."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """A temporary view over each Parquet table of ``folder``."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
