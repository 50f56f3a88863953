"""The query that fingerprints documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import imatch
from sparkloom.llm.queries import query, table


@query()
def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
