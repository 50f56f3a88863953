"""A training corpus from raw documents: five stages, each an operator applied to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and rereads it for the next one. All but the last return the
columns of the documents. Null or empty texts and repeated rows pass as each
stage's docstring says; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from sparkloom.llm.scratch import Scratch, released

#: Less like its language's profile than this, a text is in none of the languages (see language_id.Profiles.predict).
LEAST_SCORE = 0.2


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside doc_id and text, so that no other column's name matters."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The rows with a new text, and n_chars to match where there is one."""
    row = F.col("_row").withField("text", F.col(text))
    if "n_chars" in docs.schema["_row"].dataType.names:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return docs.select(row.alias("_row")).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language. Null and letterless texts go, and texts that are like no profile."""
    profiles = language_id.learn(docs)
    found = language_id.identify(_packed(docs), profiles, keep=["_row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are repeated or nearly so; documents that lose all their text go, others stay."""
    found = line_dedup.line_dedup(_packed(docs))
    left = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return _with_text(left, "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of linked documents; texts without words link with nothing and stay. Rows that repeat doc_id and text become one."""
    found = jaccard_join.jaccard_join(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    rows = _packed(docs).join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]).select("_row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with passages of the benchmark."""
    found = decontaminate.find(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select("_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; a row per piece (see packing.pack)."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("lines", lines), ("near copies", near_copies), ("benchmark", clean), ("packing", sequences)]

#: SimHash, learned profiles and tokenization are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        tag = name.replace(" ", "-")
        with released():
            docs = scratch.put(stage(spark, docs, sf_dir), tag)
        if before:
            scratch.drop(before)
        before = tag
    return docs
