"""Tables with versions and transactions, shards, Arrow batches and a stream, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue import query, sql_query, table
from sparkloom.operators.shards import HashPartitioner
from sparkloom.sources import batches
from sparkloom.sources.folders import shared_folder
from sparkloom.sources.store import Store


def _store(spark, sf_dir, name: str, **rules) -> Store:
    """A new store with a copy of one table."""
    store = Store(spark, shared_folder(spark, "store"))
    rows = table(spark, sf_dir, name)
    txn = store.begin()
    store.create(txn, name, rows.schema, **rules)
    store.append(txn, name, rows)
    store.commit(txn)
    return store


def _now(store: Store, name: str):
    txn = store.begin()
    store.commit(txn)
    return store.read(txn, name)


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation")
def insert_rows(spark, sf_dir):
    store = _store(spark, sf_dir, "nation", not_null=["n_nationkey"], unique=[["n_nationkey"]])
    txn = store.begin()
    more = store.read(txn, "nation").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name"), "n_regionkey")
    store.append(txn, "nation", more)
    store.commit(txn)
    return _now(store, "nation")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark, sf_dir):
    store = _store(spark, sf_dir, "customer")
    txn = store.begin()
    store.update(txn, "customer", {"c_acctbal": "0", "c_mktsegment": "'DEBT'"}, "c_acctbal < 0")
    store.commit(txn)
    return _now(store, "customer")


@query("SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 500, FALSE)")
def delete_rows(spark, sf_dir):
    store = _store(spark, sf_dir, "customer")
    txn = store.begin()
    store.delete(txn, "customer", "c_acctbal < 500")
    store.commit(txn)
    return _now(store, "customer")


@query("SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, count(DISTINCT id) AS ids FROM (SELECT row_number() OVER () AS id FROM part)")
def autoincrement(spark, sf_dir):
    store = Store(spark, shared_folder(spark, "store"))
    txn = store.begin()
    rows = table(spark, sf_dir, "part").select("p_name")
    store.create(txn, "names", rows.select(F.lit(0).cast("bigint").alias("id"), "p_name").schema, autoincrement="id")
    store.append(txn, "names", rows)
    store.commit(txn)
    return _now(store, "names").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("ids"))


@query("SELECT (SELECT count(*) FROM nation) AS reader, (SELECT count(*) FROM nation) AS again, 0 AS writer, 0 AS later")
def mvcc_snapshot_read(spark, sf_dir):
    """A reader keeps its snapshot while a writer empties the table and commits."""
    store = _store(spark, sf_dir, "nation")
    reader, writer = store.begin(), store.begin()
    before = store.read(reader, "nation").agg(F.count(F.lit(1)).alias("reader"))
    store.delete(writer, "nation", None)
    own = store.read(writer, "nation").agg(F.count(F.lit(1)).cast("int").alias("writer"))
    store.commit(writer)
    after = store.read(reader, "nation").agg(F.count(F.lit(1)).alias("again"))
    later = _now(store, "nation").agg(F.count(F.lit(1)).cast("int").alias("later"))
    return before.crossJoin(after).crossJoin(own).crossJoin(later)  # one row each


@query("SELECT * FROM nation")
def txn_rollback(spark, sf_dir):
    store = _store(spark, sf_dir, "nation")
    txn = store.begin()
    store.update(txn, "nation", {"n_name": "'gone'"}, None)
    store.rollback(txn)
    return _now(store, "nation")


def _oracle_shard(key: str, n: int) -> str:
    parts = [f"('0x' || substr(md5(CAST({key} AS VARCHAR)), {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    number = "0::BIGINT"
    for p in parts:
        number = f"((({number}) * {(1 << 32) % n} + {p}) % {n})"
    return number


_SHARDS = ["s0", "s1", "s2"]


@query(f"SELECT c_custkey, 's' || {_oracle_shard('c_custkey', 3)} AS shard FROM customer")
def shard_route(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", HashPartitioner(_SHARDS).column(F.col("c_custkey")).alias("shard"))


@query(f"SELECT 's' || {_oracle_shard('c_custkey', 3)} AS shard, count(*) AS n FROM customer GROUP BY 1")
def shard_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(HashPartitioner(_SHARDS).column(F.col("c_custkey")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000")
def scatter_gather(spark, sf_dir):
    """Every shard's rows, asked in one scan: what is asked works row by row, so shards need no scan of their own."""
    marked = table(spark, sf_dir, "customer").withColumn("shard", HashPartitioner(_SHARDS).column(F.col("c_custkey")))
    return marked.where(F.col("shard").isin(_SHARDS) & (F.col("c_acctbal") > 1000)).select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def scatter_gather_agg(spark, sf_dir):
    """Partial sums by shard, merged: the aggregate of the whole, not a row per shard."""
    rows = table(spark, sf_dir, "customer").withColumn("shard", HashPartitioner(_SHARDS).column(F.col("c_custkey")))
    partial = rows.groupBy("shard", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    return partial.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 AND c_nationkey <= 10")
def vector_pipeline(spark, sf_dir):
    return batches.pipeline(table(spark, sf_dir, "customer"), (F.col("c_acctbal") > 100) & (F.col("c_nationkey") <= 10), ["c_custkey", "c_acctbal", "missing"])


@query("SELECT p_partkey, p_size + p_partkey AS total FROM part")
def vector_add(spark, sf_dir):
    """Sums by Arrow kernels, batch by batch."""
    import pyarrow as pa

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    return batches.map_batches(rows, lambda b: pa.RecordBatch.from_arrays([b.column(0), batches.add(b.column(0), b.column(1))], ["p_partkey", "total"]), "p_partkey long, total long")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_totals(spark, sf_dir):
    """The events as a stream, in daily windows with a watermark; an extension."""
    from sparkloom.streaming.windows import daily_totals

    return daily_totals(spark, f"{sf_dir}/events.parquet")


sql_query("heap_count", "SELECT count(*) AS n FROM {lineitem}", tables=("lineitem",))
