"""A bounded run of a stream over Parquet files: an extension, as the dialect has no streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.folders import shared_folder


def daily_totals(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """(event_type, day, n, total) of an events table read as a stream, once all of it has been read.

    Watermarked windows are written as they close, and the rest when the
    bounded stream ends; state and output are in the shared folder.
    """
    schema = spark.read.parquet(path).schema
    base = shared_folder(spark, "stream")
    source = spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")  # a pattern may be a file or a folder
    counted = (
        source.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        .groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))
    )
    name = f"daily_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{name}")

    run = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/{name}")
