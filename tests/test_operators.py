"""Dialect columns, relational operators, shards, batches and the replicated journal on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dialect as D
from sparkloom.operators import relational as R
from sparkloom.operators.shards import Coordinator, HashPartitioner
from sparkloom.plans import replication as P
from sparkloom.plans.database import Database
from sparkloom.sources import batches as B


def test_floor_mod_and_division(spark):
    df = spark.createDataFrame([(-7, 3), (7, -3), (7, 3), (-7, -3), (6, 3), (5, 0), (None, 2)], "a int, b int")
    got = [tuple(r) for r in df.select(D.floor_mod(F.col("a"), F.col("b")), D.safe_divide(F.col("a"), F.col("b"))).collect()]
    assert [g[0] for g in got] == [2, -2, 1, -1, 0, None, None]
    assert got[5][1] is None and got[4][1] == 2.0


def test_casts_rounding_names(spark):
    df = spark.createDataFrame([("3",), ("3.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(D.to_integer(F.col("s"))).collect()] == [3, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "d double").select(D.round_half_even(F.col("d"))).collect()] == [0.0, 2.0, 2.0, -2.0]
    assert [r[0] for r in df.select(D.type_name(F.col("s"))).collect()] == ["text", "text", "text", "null"]


def test_three_valued_predicates_and_joins(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert R.joined(a, a.select("k"), ["k"]).count() == 1
    assert R.joined(a, a.select(F.col("k").alias("j")), F.col("k") == F.col("j"), "full").count() == 3
    with pytest.raises(ValueError):
        R.joined(a, a, ["k"], "sideways")
    assert [r[0] for r in R.sorted_by(a, ("k", True)).collect()] == [1, None]
    assert R.grouped(a, [], n=F.count("k")).first()[0] == 1
    assert R.key_range(spark.range(100), "id", 10, 20).count() == 11
    assert R.key_range(spark.range(100), "id", 10, 20, False, False).count() == 9


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = R.key_range(spark.read.parquet(str(tmp_path / "t")), "id", 10, 20).select("twice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "unused" not in plan


def test_partitioner_matches_its_column(spark):
    shards = HashPartitioner(["a", "b", "c"])
    keys = [f"user_{i}" for i in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", shards.column(F.col("k"))).collect()
    assert all(s == shards.get_shard(k) for k, s in got)
    assert shards.get_shard("user_100") == ["a", "b", "c"][int(hashlib.md5(b"user_100").hexdigest(), 16) % 3]


def test_two_phase_commit_and_gather(spark, tmp_path):
    nodes = {n: Database(str(tmp_path / n), spark) for n in ("n1", "n2")}
    for db in nodes.values():
        db.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT)")
    c = Coordinator("n1", nodes)
    assert c.execute_2pc("t1", {"n1": "INSERT INTO users VALUES (1, 'Alice')", "n2": "INSERT INTO users VALUES (2, 'Bob')"})
    assert sorted(c.execute_scatter_gather("SELECT * FROM users").rows) == [[1, "Alice"], [2, "Bob"]]
    assert c.execute_scatter_gather("SELECT COUNT(*) FROM users").rows == [[2]]
    assert not c.execute_2pc("t2", {"n1": "INSERT INTO users VALUES (3, 'Eve')", "n2": "INSERT INTO users VALUES (2, 'again')"})
    assert c.execute_scatter_gather("SELECT COUNT(*) FROM users").rows == [[2]] and c.phases == {"t1": "committed", "t2": "aborted"}


def test_batches(spark):
    batch = B.from_rows(["id", "score", "name"], [[1, 95.5, "Alice"], [2, None, "Bob"], [3, 92.3, "Charlie"]])
    assert B.to_rows(B.take(batch, [0, 2])) == [[1, 95.5, "Alice"], [3, 92.3, "Charlie"]]
    import pyarrow as pa

    assert B.greater(pa.array([5, 15, 25, None, 30]), 10) == [1, 2, 4]
    assert B.add(pa.array([1, None]), pa.array([2, 3])).to_pylist() == [3, None]
    rows = [[1, 25, "Alice"], [2, 35, "Bob"], [3, 18, "Charlie"], [4, 42, "David"]]
    assert sorted(B.execute_pipeline(spark, ["id", "age", "name"], rows, F.col("age") > 20, ["name", "age", "none"])) == [["Alice", 25], ["Bob", 35], ["David", 42]]
    assert [b.num_rows for b in B.scan(["a"], [[i] for i in range(5000)])] == [2048, 2048, 904]


def carry(leader, others):
    for r in others:
        for _ in range(10):
            answer = r.on_append(leader.append_for(r.name))
            leader.on_answer(r.name, answer)
            if answer.ok:
                break


def test_journal_election_replication_and_conflict():
    done = {n: [] for n in "abc"}
    a, b, c = (P.Replica(n, [m for m in "abc" if m != n], done[n].append) for n in "abc")
    for peer, request in a.stand().items():
        a.on_vote(peer, {"b": b, "c": c}[peer].on_vote_request(request))
    assert a.role == P.LEADER and b.vote == "a"
    assert not b.on_vote_request(P.VoteRequest(1, "c", 0, 0)).ok
    assert a.propose("x") == 1 and b.propose("y") is None
    carry(a, [b])
    assert a.committed == 1 and done["a"] == ["x"]
    carry(a, [b])
    assert done["b"] == ["x"]
    a.propose("lost")
    for peer, request in b.stand().items():
        if peer == "c":
            b.on_vote(peer, c.on_vote_request(request))
    assert b.role == P.LEADER
    b.propose("kept")
    carry(b, [a, c])
    carry(b, [a, c])
    assert done["a"] == done["b"] == done["c"] == ["x", "kept"] and a.role == P.FOLLOWER
    assert not c.on_vote_request(P.VoteRequest(9, "z", 0, 0)).ok


def test_tasks_of_a_large_join_follow_its_rows(spark, tmp_path):
    from collections import Counter

    from sparkloom.catalogue import QUERIES

    rows = spark.range(3 * R.TASK_ROWS).selectExpr("id DIV 4 AS l_orderkey", "CAST(id % 3 AS INT) AS l_linenumber")
    rows.union(spark.createDataFrame([(None, 1), (1, None)], rows.schema)).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["composite_key_join"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).cache()
    try:
        assert out.groupBy("task").agg(F.sum(F.sqrt("n")).alias("rows")).agg(F.max("rows")).first()[0] < 1.2 * R.TASK_ROWS
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        # four rows to an order, of three numbers: one number twice, so four pairs of it and one of each other
        assert Counter({r["n"]: r["count"] for r in out.groupBy("n").count().collect()}) == {1: 2 * 3 * R.TASK_ROWS // 4, 4: 3 * R.TASK_ROWS // 4}
    finally:
        out.unpersist()


def test_places_of_a_page_are_numbered_after_the_limit(spark, tmp_path):
    from sparkloom.catalogue import QUERIES

    rows = [(k, "P" if k % 3 else "OF"[k % 2]) for k in range(1000)] + [(k, None) for k in (2000, 2001)] + [(7000, "O"), (7000, "O"), (None, "O")]
    folder = str(tmp_path / "all")
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string").repartition(7).write.parquet(f"{folder}/orders.parquet")
    out = QUERIES["order_desc_nulls_last"](spark, folder)
    expected = sorted(((k, None if s == "P" else s) for k, s in rows), key=lambda r: (r[1] is None, -ord(r[1] or "A"), r[0] is None, r[0] or 0))
    assert [tuple(r) for r in out.collect()] == [(*r, i) for i, r in enumerate(expected[:100], 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Limit")  # the limit is below
    few = [(None, "P"), (5, None), (3, "P"), (5, "O"), (None, "O")]
    spark.createDataFrame(few, "o_orderkey bigint, o_orderstatus string").write.parquet(str(tmp_path / "few" / "orders.parquet"))
    got = [tuple(r) for r in QUERIES["order_desc_nulls_last"](spark, str(tmp_path / "few")).collect()]
    assert got == [(5, "O", 1), (None, "O", 2), (3, None, 3), (5, None, 4), (None, None, 5)]
