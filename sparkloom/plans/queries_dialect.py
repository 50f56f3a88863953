"""Queries that run through the dialect's front door: statements given to ``Database``, each over a whole table.

Tables of the folder are views named ``in_...`` there, from which statements
insert; results that are not rows of a table (messages, plans, counters) are
returned as small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.catalogue import query, table
from sparkloom.operators.shards import Coordinator
from sparkloom.plans import replication
from sparkloom.plans.database import Database
from sparkloom.sources import batches
from sparkloom.sources.folders import shared_folder
from sparkloom.sources.store import ConflictError, ConstraintError, Store


def _database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    db = Database(shared_folder(spark, "database"), spark)
    for name in tables:
        db.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"in_{name}")
    return db


def _told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_NATION = "CREATE TABLE nation (id INTEGER PRIMARY KEY, name VARCHAR(25) NOT NULL, region INTEGER); INSERT INTO nation (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM in_nation"


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey BETWEEN 1 AND 3")
def dialect_create_insert_select(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION)
    return db.query("SELECT id, name, region FROM nation WHERE region BETWEEN 1 AND 3")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity / (l_linenumber - 2) END AS quotient, CASE WHEN l_linenumber = 3 THEN NULL ELSE ((-l_orderkey % (l_linenumber - 3)) + (l_linenumber - 3)) % (l_linenumber - 3) END AS rest, CAST(round_even(CAST(l_linenumber AS DOUBLE) * 0.5, 0) AS DOUBLE) AS half FROM lineitem")
def dialect_arithmetic(spark, sf_dir):
    """Division by zero is NULL, % takes the divisor's sign, ROUND is half-even."""
    db = _database(spark, sf_dir, "lineitem")
    return db.query("SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 2) AS quotient, -l_orderkey % (l_linenumber - 3) AS rest, ROUND(l_linenumber * 0.5) AS half FROM in_lineitem")


@query("SELECT c_custkey, CASE WHEN c_mktsegment ILIKE 'b%' THEN 'b' WHEN c_acctbal < 0 THEN 'debt' END AS kind, upper(substr(c_name, 1, 3)) || '!' AS head, CAST(length(c_name) AS INTEGER) AS n FROM customer WHERE c_mktsegment ILIKE '%u%' OR c_acctbal < 0")
def dialect_like_case(spark, sf_dir):
    db = _database(spark, sf_dir, "customer")
    return db.query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'b%' THEN 'b' WHEN c_acctbal < 0 THEN 'debt' END AS kind, UPPER(SUBSTR(c_name, 1, 3)) || '!' AS head, LENGTH(c_name) AS n FROM in_customer WHERE c_mktsegment LIKE '%U%' OR c_acctbal < 0")


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS none, CAST(c_custkey AS VARCHAR) AS t FROM customer")
def dialect_casts(spark, sf_dir):
    db = _database(spark, sf_dir, "customer")
    return db.query("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS whole, CAST(c_name AS INTEGER) AS none, CAST(c_custkey AS TEXT) AS t FROM in_customer")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL HAVING count(*) > 1")
def dialect_group_by_ordinal(spark, sf_dir):
    db = _database(spark, sf_dir, "orders")
    return db.query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM in_orders GROUP BY 1, 2 HAVING COUNT(*) > 1")


@query("SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def dialect_joins_and_subqueries(spark, sf_dir):
    db = _database(spark, sf_dir, "nation", "region", "customer")
    return db.query("SELECT n_name, r_name, (SELECT COUNT(*) FROM in_customer WHERE c_nationkey = n_nationkey) AS customers FROM in_nation JOIN in_region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM in_customer)")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name, CAST(CASE WHEN n_regionkey = 2 THEN n_regionkey + 10 ELSE n_regionkey END AS BIGINT) AS region FROM nation WHERE n_regionkey <> 4")
def dialect_update_delete(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION + "; UPDATE nation SET name = LOWER(name), region = region + 10 WHERE region = 2; DELETE FROM nation WHERE region = 4")
    return db.query("SELECT * FROM nation")


@query("SELECT n_name AS label, CAST(n_nationkey AS DOUBLE) / 2 AS half FROM nation")
def dialect_drop_and_create_again(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION + "; DROP TABLE nation; DROP TABLE IF EXISTS nation; CREATE TABLE IF NOT EXISTS nation (label TEXT, half FLOAT); CREATE TABLE IF NOT EXISTS nation (other INTEGER); INSERT INTO nation SELECT n_name, n_nationkey / 2.0 FROM in_nation")
    return db.query("SELECT label, half FROM nation")


def _refused(db: Database, sql: str) -> bool:
    try:
        db.execute(sql)
    except ConstraintError:
        return True
    return False


@query("SELECT * FROM (VALUES ('by the index', TRUE), ('by the key', TRUE), ('none', FALSE)) t(what, refused) CROSS JOIN (SELECT count(*) + 1 AS n FROM nation)")
def dialect_unique_index(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION + "; CREATE UNIQUE INDEX by_name ON nation (name); CREATE INDEX IF NOT EXISTS by_region ON nation (region)")
    told = [("by the index", _refused(db, "INSERT INTO nation SELECT 900, MIN(n_name), 1 FROM in_nation")), ("by the key", _refused(db, "INSERT INTO nation VALUES (0, 'new', 1)")), ("none", _refused(db, "INSERT INTO nation VALUES (900, 'new', 1)"))]
    n = db.query("SELECT COUNT(*) AS n FROM nation").first()["n"]
    return _told(spark, [(*t, n) for t in told], "what string, refused boolean, n long")


@query("SELECT * FROM (VALUES ('not null', TRUE), ('check', TRUE), ('child without parent', TRUE), ('parent of a child', TRUE), ('parent without child', FALSE)) t(what, refused)")
def dialect_constraints(spark, sf_dir):
    db = _database(spark, sf_dir, "nation", "region")
    db.execute_many("CREATE TABLE region (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE nation (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER REFERENCES region(id), CHECK (id >= 0))")
    db.execute_many("INSERT INTO region SELECT r_regionkey, r_name FROM in_region; INSERT INTO region VALUES (77, 'empty'); INSERT INTO nation SELECT n_nationkey, n_name, n_regionkey FROM in_nation")
    tried = [("not null", "INSERT INTO nation VALUES (100, NULL, 1)"), ("check", "INSERT INTO nation VALUES (-1, 'x', 1)"), ("child without parent", "INSERT INTO nation VALUES (100, 'x', 55)"), ("parent of a child", "DELETE FROM region WHERE id = 1"), ("parent without child", "DELETE FROM region WHERE id = 77")]
    return _told(spark, [(what, _refused(db, sql)) for what, sql in tried], "what string, refused boolean")


@query("SELECT * FROM (VALUES ('SELECT', TRUE, TRUE), ('INSERT', TRUE, TRUE), ('UPDATE', TRUE, TRUE), ('DELETE', TRUE, TRUE), ('EXPLAIN', TRUE, TRUE)) t(statement, planned, filtered) CROSS JOIN (SELECT count(*) AS n FROM nation)")
def dialect_explain(spark, sf_dir):
    """Every kind of statement has a plan, and none of them ran."""
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION)
    asked = {"SELECT": "SELECT * FROM nation WHERE region > 2", "INSERT": "INSERT INTO nation SELECT id + 100, name, region FROM nation WHERE region > 2", "UPDATE": "UPDATE nation SET region = 0 WHERE region > 2", "DELETE": "DELETE FROM nation WHERE region > 2"}
    plans = {k: db.explain(v) for k, v in asked.items()}
    plans["EXPLAIN"] = "\n".join(r[0] for r in db.execute("EXPLAIN SELECT * FROM nation WHERE region > 2").rows)
    n = db.query("SELECT COUNT(*) AS n FROM nation").first()["n"]
    return _told(spark, [(k, "Physical Plan" in p, "Filter" in p, n) for k, p in plans.items()], "statement string, planned boolean, filtered boolean, n long")


@query("SELECT * FROM (VALUES ('rolled back', 0), ('committed', 5)) t(what, least)")
def dialect_transactions(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION + "; BEGIN; UPDATE nation SET region = region + 5; ROLLBACK")
    first = db.query("SELECT MIN(region) AS m FROM nation").first()["m"]
    db.execute_many("BEGIN TRANSACTION; UPDATE nation SET region = region + 5; COMMIT")
    second = db.query("SELECT MIN(region) AS m FROM nation").first()["m"]
    return _told(spark, [("rolled back", first), ("committed", second)], "what string, least int")


@query("SELECT * FROM (VALUES (0, 'CREATE TABLE t'), (1, 'INSERT 3'), (2, 'UPDATE 2'), (3, 'DELETE 1')) t(place, message)")
def dialect_scripts(spark, sf_dir):
    """A script's statements, one result each."""
    db = _database(spark, sf_dir)
    done = db.execute_many("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2), (3); -- two of them\n UPDATE t SET a = a * 10 WHERE a > 1; DELETE FROM t WHERE a = 30")
    return _told(spark, [(i, r.message) for i, r in enumerate(done)], "place int, message string")


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation GROUP BY 1")
def dialect_reopened(spark, sf_dir):
    """A folder that one object closed, with a transaction open, has what was committed for the next one."""
    db = _database(spark, sf_dir, "nation")
    with db:
        db.execute_many(_NATION + "; BEGIN; DELETE FROM nation")
    with Database(db.path, spark) as again:
        return again.query("SELECT region, COUNT(*) AS n FROM nation GROUP BY region")


@query("SELECT * FROM (VALUES ('tables', 1), ('folders before', 2), ('folders deleted', 1), ('folders after', 1), ('active', 0)) t(what, n)")
def dialect_stats_and_checkpoint(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION + "; UPDATE nation SET region = 0")
    before = db.get_stats()
    gone = db.checkpoint(keep_s=0)
    after = db.get_stats()
    return _told(spark, [("tables", len(after["tables"])), ("folders before", before["table_versions"]), ("folders deleted", gone), ("folders after", after["table_versions"]), ("active", after["transactions"]["active"])], "what string, n int")


@query("SELECT * FROM (VALUES ('first', TRUE), ('second', FALSE)) t(writer, committed) CROSS JOIN (SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0)")
def txn_conflict(spark, sf_dir):
    """Of two writers of one table the first to commit wins; the other's rows are not there."""
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION)
    with Database(db.path, spark) as other:
        db.execute("BEGIN; DELETE FROM nation WHERE region = 0")
        other.execute("BEGIN; DELETE FROM nation WHERE region = 1")
        done = []
        for who in (db, other):
            try:
                who.execute("COMMIT")
                done.append(True)
            except ConflictError:
                done.append(False)
    n = db.query("SELECT COUNT(*) AS n FROM nation").first()["n"]
    return _told(spark, [("first", done[0], n), ("second", done[1], n)], "writer string, committed boolean, n long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation")
def recover_after_crash(spark, sf_dir):
    """Rows that were staged and never committed are not there for whoever opens the folder next; manifests count up."""
    db = _database(spark, sf_dir, "nation")
    db.execute_many(_NATION)
    txn = db.store.begin()
    db.store.delete(txn, "nation", "id < 10")
    version, _ = db.store.latest()
    again = Store(spark, db.store.base)
    if again.latest()[0] != version:
        raise AssertionError("a manifest that nobody published")
    return again.read(again.begin(), "nation").select("id")


@query("SELECT * FROM (VALUES ('both', TRUE, 'committed'), ('one fails', FALSE, 'aborted')) t(txn, done, phase) CROSS JOIN (SELECT count(*) AS n FROM nation)")
def two_phase_commit(spark, sf_dir):
    nodes = {name: _database(spark, sf_dir, "nation") for name in ("a", "b")}
    for db in nodes.values():
        db.execute("CREATE TABLE nation (id INTEGER PRIMARY KEY, name TEXT)")
    all_of = Coordinator("a", nodes)
    done = [all_of.execute_2pc("both", {name: f"INSERT INTO nation SELECT n_nationkey, n_name FROM in_nation WHERE n_nationkey % 2 = {i}" for i, name in enumerate(nodes)})]
    done.append(all_of.execute_2pc("one fails", {"a": "INSERT INTO nation VALUES (901, 'x')", "b": "INSERT INTO nation VALUES (1, 'twice')"}))
    n = all_of.execute_scatter_gather("SELECT COUNT(*) AS n FROM nation").rows[0][0]
    return _told(spark, [(t, d, all_of.phases[t], n) for t, d in zip(("both", "one fails"), done, strict=True)], "txn string, done boolean, phase string, n long")


def _cluster(rows: list) -> tuple[dict, dict]:
    """Three replicas, of which one is elected and replicates ``rows``; and what each applied."""
    names, applied = ["x", "y", "z"], {n: [] for n in ("x", "y", "z")}
    nodes = {n: replication.Replica(n, [p for p in names if p != n], applied[n].append) for n in names}
    for peer, request in nodes["x"].stand().items():
        nodes["x"].on_vote(peer, nodes[peer].on_vote_request(request))
    for row in rows:
        nodes["x"].propose(row)
    for _ in range(2):  # the second round tells the followers what is committed
        for peer in ("y", "z"):
            nodes["x"].on_answer(peer, nodes[peer].on_append(nodes["x"].append_for(peer)))
    return nodes, applied


@query("SELECT * FROM (VALUES ('x', 'leader', 1, TRUE), ('y', 'follower', 1, FALSE), ('z', 'follower', 1, FALSE)) t(replica, role, term, proposes)")
def raft_election(spark, sf_dir):
    """One leader in a term; a vote is given once, and only to a candidate whose journal is no older."""
    nodes, _ = _cluster(["a"])
    late = replication.VoteRequest(1, "z", 9, 1)
    if nodes["y"].on_vote_request(late).ok:
        raise AssertionError("a second vote in one term")
    return _told(spark, [(n, r.role, r.term, r.propose("b") is not None) for n, r in nodes.items()], "replica string, role string, term int, proposes boolean")


@query("SELECT replica, CAST(n_nationkey AS BIGINT) AS command FROM nation CROSS JOIN (VALUES ('x'), ('y'), ('z')) t(replica)")
def raft_replication(spark, sf_dir):
    """What the leader proposes is applied by every replica, in order."""
    keys = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    _, applied = _cluster(keys)
    if any(x != keys for x in applied.values()):
        raise AssertionError("replicas disagree")
    return _told(spark, [(n, k) for n, got in applied.items() for k in got], "replica string, command long")


@query("SELECT * FROM (VALUES (0, 'CREATE TABLE t'), (1, 'INSERT 2'), (2, 'a | b   '), (3, '--+-----'), (4, '1 | x   '), (5, '2 | NULL'), (6, '(2 rows)'), (7, 't')) t(line, text)")
def shell_session(spark, sf_dir):
    """What the shell prints for a session: messages, a table of rows, a dot command."""
    from sparkloom.shell import run

    shown: list[str] = []
    run(_database(spark, sf_dir), ["CREATE TABLE t\n", "(a INTEGER, b TEXT);\n", "INSERT INTO t VALUES (1, 'x'), (2, NULL);\n", "SELECT * FROM t ORDER BY a;\n", ".tables\n", ".quit\n"], shown.append)
    return _told(spark, list(enumerate("\n".join(shown).split("\n"))), "line int, text string")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def vector_greater(spark, sf_dir):
    """Selection vectors by an Arrow kernel, and the rows that they pick, batch by batch."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return batches.map_batches(rows, lambda b: batches.take(b.select(["c_custkey"]), batches.greater(b.column(1), 5000.0)), "c_custkey long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def batch_scan_and_rows(spark, sf_dir):
    """Rows to batches of a few and back."""
    rows = [list(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    back = [r for b in batches.scan(["n_nationkey", "n_name"], rows, 4) for r in batches.to_rows(b)]
    return _told(spark, [tuple(r) for r in back], "n_nationkey long, n_name string")


@query("SELECT o_orderkey, o_orderkey AS place FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def ordered_load(spark, sf_dir):
    """A table that an index puts in order: a range reads its files by their statistics."""
    db = _database(spark, sf_dir, "orders")
    db.execute_many("CREATE TABLE orders (k INTEGER PRIMARY KEY, total FLOAT); INSERT INTO orders SELECT o_orderkey, o_totalprice FROM in_orders; CREATE INDEX by_key ON orders (k)")
    return db.query("SELECT k AS o_orderkey, k AS place FROM orders WHERE k BETWEEN 100 AND 2000")


@query("SELECT * FROM (VALUES ('unknown column', TRUE), ('ambiguous column', TRUE), ('known column', FALSE)) t(what, refused)")
def column_lookup(spark, sf_dir):
    db = _database(spark, sf_dir, "nation")
    told = []
    for what, sql in (("unknown column", "SELECT nonsense FROM in_nation"), ("ambiguous column", "SELECT n_name FROM in_nation a JOIN in_nation b ON a.n_nationkey = b.n_nationkey"), ("known column", "SELECT N_NAME FROM in_nation")):
        try:
            db.query(sql)
            told.append((what, False))
        except Exception:  # noqa: BLE001  the parser's and the analyser's errors have many types
            told.append((what, True))
    return _told(spark, told, "what string, refused boolean")


@query("SELECT l_orderkey, o_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def sort_merge_join(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").hint("merge")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select("l_orderkey", "o_custkey", "l_linenumber")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def small_side_join(spark, sf_dir):
    """The choice of the algorithm is Spark's, by the size of the sides; a table of this size is broadcast."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("c_custkey", "n_name")
