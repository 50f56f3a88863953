"""Arrow record batches: rows in and out, batch-wise operators, and a scan-filter-project pipeline on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

from sparkloom.operators.relational import project_known

ROWS = 2048


def from_rows(names: list[str], rows: list[list[Any]]) -> pa.RecordBatch:
    """A batch; each column's type is that of its values."""
    return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})


def to_rows(batch: pa.RecordBatch) -> list[list[Any]]:
    return [list(r.values()) for r in batch.to_pylist()]


def take(batch: pa.RecordBatch, selection: list[int]) -> pa.RecordBatch:
    """The rows of a selection vector."""
    return batch.take(pa.array(selection, pa.int64()))


def add(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sums; null where either is null."""
    return pc.add(a, b)


def greater(a: pa.Array, scalar: Any) -> list[int]:
    """Indices of the values over a scalar."""
    return pc.indices_nonzero(pc.fill_null(pc.greater(a, scalar), False)).to_pylist()


def scan(names: list[str], rows: list[list[Any]], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    for first in range(0, max(len(rows), 1), size):
        yield from_rows(names, rows[first : first + size])


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """f(batch) -> batch on every Arrow batch, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, schema)


def pipeline(source: DataFrame, predicate: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Scan, filter, project; unknown column names are left out."""
    out = source if predicate is None else source.where(predicate)
    return out if columns is None else project_known(out, columns)


def execute_pipeline(spark: SparkSession, names: list[str], rows: list[list[Any]], predicate: Column | None = None, columns: list[str] | None = None) -> list[list[Any]]:
    source = spark.createDataFrame(pa.Table.from_batches([from_rows(names, rows)]))
    return [list(r) for r in pipeline(source, predicate, columns).collect()]
