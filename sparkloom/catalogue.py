"""The registry of the relational queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.relational import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLE_SQL[key] = oracle
        return f

    return put


def sql_query(name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = (), keys: dict[str, tuple[str, ...]] | None = None) -> None:
    """Registers a query given as SQL that Spark runs; DuckDB runs the same text unless ``oracle`` differs.

    ``keys``: the columns that large tables are joined by, in the same order for each.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = {t: table(spark, sf_dir, t) for t in tables}
        return spark.sql(text, **(spread(inputs, keys) if keys else inputs)) if tables else spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    bare = text
    for t in tables:
        bare = bare.replace("{" + t + "}", t)
    ORACLE_SQL[name] = oracle or bare


from sparkloom.plans import queries_dialect, queries_engine, queries_relational, queries_scalar  # noqa: E402, F401
