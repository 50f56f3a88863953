"""Statements end to end."""

import pytest

from sparkloom.plans.database import Database
from sparkloom.sources.store import ConflictError, ConstraintError


def rows(db, sql):
    return db.execute(sql).rows


def test_create_insert_select_where(db):
    db.execute("CREATE TABLE users (id INTEGER, name TEXT, age INTEGER)")
    assert db.execute("INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob', 25), (3, 'Charlie', 35)").affected_rows == 3
    result = db.execute("SELECT name FROM users WHERE age > 28 ORDER BY name")
    assert result.columns == ["name"] and result.rows == [["Alice"], ["Charlie"]]


def test_order_limit_offset_distinct(db):
    db.execute("CREATE TABLE nums (val INTEGER); INSERT INTO nums VALUES (3), (1), (2), (1), (NULL)")
    assert rows(db, "SELECT val FROM nums ORDER BY val") == [[1], [1], [2], [3], [None]]
    assert rows(db, "SELECT val FROM nums ORDER BY val DESC") == [[3], [2], [1], [1], [None]]
    assert rows(db, "SELECT DISTINCT val FROM nums ORDER BY val LIMIT 2 OFFSET 1") == [[2], [3]]
    assert rows(db, "SELECT val FROM nums LIMIT 0") == []


def test_aggregates_having(db):
    db.execute("CREATE TABLE sales (dept TEXT, amount INTEGER); INSERT INTO sales VALUES ('A',100),('B',200),('A',150),('B',250),('C',NULL)")
    assert rows(db, "SELECT dept, SUM(amount) AS s, COUNT(amount) AS n FROM sales GROUP BY dept ORDER BY dept") == [["A", 250, 2], ["B", 450, 2], ["C", None, 0]]
    assert rows(db, "SELECT dept FROM sales GROUP BY dept HAVING SUM(amount) > 300") == [["B"]]
    assert rows(db, "SELECT COUNT(*), AVG(amount) + 1 FROM sales") == [[5, 176.0]]


def test_joins(db):
    db.execute("CREATE TABLE users (id INTEGER, name TEXT); CREATE TABLE orders (id INTEGER, user_id INTEGER, total INTEGER)")
    db.execute("INSERT INTO users VALUES (1,'Alice'),(2,'Bob'),(3,'Eve'); INSERT INTO orders VALUES (1,1,100),(2,1,200),(3,2,150),(4,9,1)")
    assert len(rows(db, "SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id")) == 3
    assert rows(db, "SELECT u.name, o.id FROM users u LEFT JOIN orders o ON u.id = o.user_id ORDER BY u.id, o.id") == [["Alice", 1], ["Alice", 2], ["Bob", 3], ["Eve", None]]
    assert len(rows(db, "SELECT u.id, o.id FROM users u FULL OUTER JOIN orders o ON u.id = o.user_id")) == 5
    assert len(rows(db, "SELECT * FROM users CROSS JOIN orders")) == 12
    assert rows(db, "SELECT a.name FROM users a JOIN users b ON a.id = b.id + 1 ORDER BY a.id") == [["Bob"], ["Eve"]]
    assert rows(db, "SELECT u.* FROM users u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id AND o.total > 160)") == [[1, "Alice"]]
    assert rows(db, "SELECT name FROM users WHERE id NOT IN (SELECT user_id FROM orders)") == [["Eve"]]


def test_dialect(db):
    assert rows(db, "SELECT 1 / 0, 7 / 2, -7 % 3, 7 % -3, 5 % 0, ROUND(2.5), ROUND(3.5)") == [[None, 3.5, 2, -2, None, 2.0, 4.0]]
    assert rows(db, "SELECT 10 - 6 / 2 * 3, 2 * 7 % 4, (1 + 5) / (4 - 1), 12 / 2 / 3") == [[1.0, 2, 2.0, 2.0]]
    assert rows(db, "SELECT CAST('3' AS INTEGER), CAST('3.5' AS INTEGER), CAST(3.7 AS INTEGER), CAST('x' AS FLOAT), CAST(5 AS TEXT)") == [[3, None, 3, None, "5"]]
    assert rows(db, "SELECT 'Alice' LIKE 'ali%', 'Bob' NOT LIKE 'B_b', 'a' || NULL, LENGTH('héllo'), TRIM('  x ')") == [[True, False, None, 5, "x"]]
    assert rows(db, "SELECT TYPEOF(1), TYPEOF(1.5), TYPEOF('a'), TYPEOF(NULL), TYPEOF(TRUE)") == [["integer", "real", "text", "null", "integer"]]
    assert rows(db, "SELECT CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END, CASE 2 WHEN 2 THEN 'two' END, 'it''s', COALESCE(NULL, 4), NULLIF(1, 1), SUBSTR('hello', 2, 3), REPLACE('abab', 'a', 'c')") == [["b", "two", "it's", 4, None, "ell", "cbcb"]]
    assert rows(db, "SELECT 1 IN (1, NULL), 2 IN (1, NULL), 3 BETWEEN 1 AND NULL, UPPER('a'), LOWER('B'), ABS(-3)") == [[True, None, None, "A", "b", 3]]


def test_update_delete_see_old_rows(db):
    db.execute("CREATE TABLE t (a INTEGER, b INTEGER); INSERT INTO t VALUES (1, 2), (3, 4), (NULL, 6)")
    assert db.execute("UPDATE t SET a = b, b = a WHERE a >= 1").affected_rows == 2
    assert rows(db, "SELECT a, b FROM t ORDER BY a") == [[2, 1], [4, 3], [None, 6]]
    assert db.execute("DELETE FROM t WHERE a > 2").affected_rows == 1
    assert db.execute("DELETE FROM t").affected_rows == 2
    assert rows(db, "SELECT COUNT(*) FROM t") == [[0]]


def test_defaults_autoincrement_types(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, s VARCHAR(3) DEFAULT 'abcdef', c CHAR(4), n INTEGER DEFAULT 7)")
    db.execute("INSERT INTO t (c) VALUES ('x  ')")
    db.execute("INSERT INTO t (id, s, c) VALUES (10, 'wxyz', 'longer')")
    db.execute("INSERT INTO t (n) VALUES (-5)")
    assert rows(db, "SELECT id, s, c, n FROM t ORDER BY id") == [[1, "abcdef", "x", 7], [10, "wxy", "long", 7], [11, "abcdef", None, -5]]


@pytest.mark.parametrize("sql", ["INSERT INTO t VALUES (1, 5, 1)", "INSERT INTO t VALUES (NULL, 5, 1)", "INSERT INTO t VALUES (3, -1, 1)", "INSERT INTO t VALUES (3, 5, 99)", "UPDATE t SET id = 1", "INSERT INTO t VALUES (4, 5, 1), (4, 6, 1)"])
def test_constraints_leave_the_table_alone(db, sql):
    db.execute("CREATE TABLE p (id INTEGER PRIMARY KEY); INSERT INTO p VALUES (1)")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER CHECK (v > 0), r INTEGER REFERENCES p(id)); INSERT INTO t VALUES (1, 1, 1), (2, 2, NULL)")
    with pytest.raises(ConstraintError):
        db.execute(sql)
    assert rows(db, "SELECT id FROM t ORDER BY id") == [[1], [2]]


def test_ddl(db):
    db.execute("CREATE TABLE t (id INTEGER)")
    db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER)")
    with pytest.raises(ValueError):
        db.execute("CREATE TABLE t (id INTEGER)")
    db.execute("INSERT INTO t VALUES (2), (1)")
    db.execute("CREATE UNIQUE INDEX i ON t (id)")
    assert db.indexes("t") == {"i": {"columns": ["id"], "unique": True}}
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1)")
    assert db.tables() == ["t"] and db.schema("t") == [("id", "INTEGER")]
    db.execute("DROP TABLE t")
    db.execute("DROP TABLE IF EXISTS t")
    with pytest.raises(Exception):
        db.execute("SELECT * FROM t")


def test_explain_does_not_run(db):
    db.execute("CREATE TABLE t (val INTEGER); INSERT INTO t VALUES (1)")
    assert "Filter" in db.explain("SELECT * FROM t WHERE val > 0")
    db.execute("EXPLAIN DELETE FROM t")
    assert rows(db, "SELECT COUNT(*) FROM t") == [[1]]


def test_transactions(db, spark):
    db.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1)")
    other = Database(db.path, spark)
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (2)")
    assert rows(db, "SELECT COUNT(*) FROM t") == [[2]]
    assert rows(other, "SELECT COUNT(*) FROM t") == [[1]]
    db.execute("ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM t") == [[1]]
    db.execute("BEGIN; UPDATE t SET a = 5")
    other.execute("UPDATE t SET a = 6")
    with pytest.raises(ConflictError):
        db.execute("COMMIT")
    assert rows(db, "SELECT a FROM t") == [[6]]
    other.close()


def test_reopen_garbage_stats(db, spark):
    db.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2)")
    (__import__("pathlib").Path(db.path) / "tables/t/half-written").mkdir()
    with Database(db.path, spark) as again:
        assert rows(again, "SELECT a FROM t ORDER BY a") == [[1], [2]]
        assert again.checkpoint() == 0  # all of it is young
        again.execute("UPDATE t SET a = a + 1")
        assert again.checkpoint(keep_s=0) == 3  # the half-written folder, and those of two inserts
        assert rows(again, "SELECT COUNT(*) FROM t") == [[2]]
        assert again.get_stats()["table_versions"] == 1


def test_garbage_spares_readers_elsewhere(db, spark):
    """A lazy frame, and another object's open transaction, outlive later writes and a checkpoint."""
    db.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2)")
    lazy = db.query("SELECT a FROM t ORDER BY a")
    with Database(db.path, spark) as other:
        other.execute("BEGIN")
        db.execute("DELETE FROM t WHERE a = 1; UPDATE t SET a = 7")
        db.checkpoint()
        assert [r[0] for r in lazy.collect()] == [1, 2]
        assert rows(other, "SELECT a FROM t ORDER BY a") == [[1], [2]]
        other.execute("ROLLBACK")
    assert rows(db, "SELECT a FROM t") == [[7]]


def test_inserts_add_folders_and_do_not_read_old_rows(db, spark, monkeypatch):
    from sparkloom.sources import store

    monkeypatch.setattr(store, "MOST_FOLDERS", 3)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT UNIQUE)")
    for n in range(5):
        db.execute(f"INSERT INTO t (name) VALUES ('a{n}'), ('b{n}')")
        if n == 1:
            assert len(db.store.latest()[1]["t"]["paths"]) == 2
    assert len(db.store.latest()[1]["t"]["paths"]) <= 3
    assert rows(db, "SELECT id FROM t ORDER BY id") == [[i] for i in range(1, 11)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t (name) VALUES ('a0')")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t (name) VALUES ('new'), ('new')")
    assert rows(db, "SELECT count(*) FROM t") == [[10]]


def test_parents_of_rows_cannot_go(db, spark):
    db.execute("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p(id), up INTEGER)")
    db.execute("INSERT INTO p VALUES (1), (2), (3); INSERT INTO c VALUES (10, 1, NULL), (11, NULL, NULL)")
    for sql in ("DELETE FROM p WHERE id = 1", "UPDATE p SET id = 5 WHERE id = 1", "DELETE FROM p"):
        with pytest.raises(ConstraintError):
            db.execute(sql)
    db.execute("DELETE FROM p WHERE id = 2; UPDATE p SET id = 4 WHERE id = 3")
    assert rows(db, "SELECT id FROM p ORDER BY id") == [[1], [4]]
    # a key checked in one transaction and its parent deleted in another do not both commit
    with Database(db.path, spark) as other:
        db.execute("BEGIN; INSERT INTO c VALUES (12, 4, NULL)")
        other.execute("DELETE FROM p WHERE id = 4")
        with pytest.raises(ConflictError):
            db.execute("COMMIT")
    assert rows(db, "SELECT count(*) FROM c") == [[2]]


def test_explain_of_every_statement(db):
    db.execute("CREATE TABLE t (a INTEGER, b TEXT); INSERT INTO t VALUES (1, 'x')")
    for sql, head in (("INSERT INTO t SELECT a + 1, b FROM t WHERE a > 0", "Insert into t"), ("INSERT INTO t (a) VALUES (5)", "Insert into t"), ("UPDATE t SET a = a + 1 WHERE b LIKE 'X'", "Update t"), ("DELETE FROM t WHERE a > 0", "Delete from t")):
        text = db.explain(sql)
        assert text.startswith(head) and "Physical Plan" in text
    assert "Filter" in db.explain("DELETE FROM t WHERE a > 0")
    assert rows(db, "SELECT a, b FROM t") == [[1, "x"]]


def test_result_table(db):
    text = db.execute("SELECT 1 AS a, NULL AS b").to_table_string()
    assert text.splitlines()[0].split(" | ") == ["a", "b   "] and "NULL" in text and text.endswith("(1 row)")


def test_quoted_names_comments_and_scripts(db):
    results = db.execute_many("SELECT 1 AS \"two words\"; -- a comment; still\n /* and ; this */ SELECT 'a;b' AS s")
    assert results[0].columns == ["two words"] and results[1].rows == [["a;b"]]


def test_shell(db):
    from sparkloom.shell import run

    shown = []
    run(db, [".tables\n", "CREATE TABLE t\n", "(a INTEGER);\n", "INSERT INTO t VALUES (1);\n", "SELECT * FROM t;\n", "SELECT nonsense FROM t;\n", ".schema t\n", ".quit\n", "SELECT 2;\n"], shown.append)
    assert shown[0] == "no tables" and "(1 row)" in shown[3] and shown[4].startswith("Error") and shown[5] == "a INTEGER" and len(shown) == 6
