"""Relational operators as functions from DataFrames to DataFrames. Catalyst chooses the physical strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.dialect import nulls_last

JOINS = ("inner", "left", "right", "full", "left_semi", "left_anti")
#: About so many rows of a table go to one task of a spread join.
TASK_ROWS = 1 << 19


def values_one_row(spark) -> DataFrame:
    """The row that a SELECT without FROM is evaluated on."""
    return spark.range(1).select()


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def project_known(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist."""
    known = set(df.columns)
    return df.select(*[n for n in names if n in known])


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; false and unknown drop."""
    return df.where(condition)


def key_range(df: DataFrame, key: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Rows whose key lies in a closed, open or half-open range; None is unbounded. Bounds reach the scan."""
    c = F.col(key)
    if low is not None:
        df = df.where(c >= low if include_low else c > low)
    if high is not None:
        df = df.where(c <= high if include_high else c < high)
    return df


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def ordered_scan(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(nulls_last(F.col(key)))


def extrema(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def joined(left: DataFrame, right: DataFrame, condition: Column | list[str] | None, how: str = "inner") -> DataFrame:
    """A join of any kind; a list of names is USING, None a cross product. NULL keys never match."""
    if condition is None:
        return left.crossJoin(right)
    if how not in JOINS:
        raise ValueError(f"unknown join: {how}")
    return left.join(right, condition, how)


def spread(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """A query's tables, those with keys dealt out by them to as many tasks as the rows of the largest table need.

    Left alone, the number of tasks does not follow the input, and Spark broadcasts a side by the
    size of its compressed columns, a small part of what its rows take. Small tables stay as they are.
    """
    rows = max(t.count() for t in tables.values())  # Parquet footers have it
    if rows <= TASK_ROWS:
        return tables
    any_table = tables[next(iter(keys))]
    parts = max(any_table.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return tables | {t: tables[t].repartition(parts, *by).hint("merge") for t, by in keys.items()}


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return joined(left, right, shared or None, how)


def grouped(df: DataFrame, keys: list[Column | str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """GROUP BY with aggregates (none: distinct keys; no keys: one row, also over no rows), then HAVING."""
    columns = [c.alias(n) for n, c in aggregates.items()]
    out = df.groupBy(*keys).agg(*columns) if keys and columns else df.agg(*columns) if columns else df.select(*keys).distinct()
    return out if having is None else out.where(having)


def _order(keys) -> list[Column]:
    return [nulls_last(F.col(c) if isinstance(c, str) else c, d) for c, d in keys]


def sorted_by(df: DataFrame, *keys: tuple[str | Column, bool]) -> DataFrame:
    """ORDER BY (column, descending) pairs, NULLs last."""
    return df.orderBy(*_order(keys))


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """OFFSET, then LIMIT; a limit of 0 is no rows."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def placed_page(df: DataFrame, limit: int, *keys: tuple[str | Column, bool], place: str = "place") -> DataFrame:
    """The first rows of an order with their places in it: row_number() over the whole table, ORDER BY the same, LIMIT.

    The rows that the limit keeps are the ones of the places up to it, so tasks pass on
    their first rows and only those are numbered; the whole table in one task never is.
    """
    return page(sorted_by(df, *keys), limit).withColumn(place, F.row_number().over(Window.orderBy(*_order(keys))).cast("bigint"))


def in_subquery(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    return df.join(other.select(F.col(other_column).alias("_in")), F.col(column) == F.col("_in"), "left_semi")
