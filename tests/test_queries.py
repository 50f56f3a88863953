"""Every relational query against its SQL on DuckDB, at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.catalogue import ORACLE_SQL, QUERIES
from sparkloom.session import TABLES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(rows):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = normal(tuple(r) for r in df.select(*columns).collect())
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    assert ours == normal(theirs)


@pytest.mark.parametrize("name", ["composite_key_join", "exists_corr", "full_join", "inner_join", "left_join", "not_exists_corr", "outer_join_filter", "right_join"])
def test_large_joins_are_spread(spark, duck, monkeypatch, name):
    monkeypatch.setattr("sparkloom.operators.relational.TASK_ROWS", 1000)
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == (1 if "exists" in name else 2) and plan.count("Exchange") == 2
    assert all(", 6), " in line for line in plan.splitlines() if "Exchange" in line)  # 6,000 rows of lineitem
    test_query(spark, duck, name)


def test_entry_imports_and_counts():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
