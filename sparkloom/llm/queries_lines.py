"""The query that removes fuzzy repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup
from sparkloom.llm.queries import query, table


@query()
def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
