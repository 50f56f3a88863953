"""The dialect's scalar functions, operators, casts and CASE."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue import query, sql_query, table
from sparkloom.functions import dialect as D

sql_query("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, -c_acctbal AS neg FROM {customer}", tables=("customer",))
sql_query("fn_upper_lower", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l FROM {customer}", tables=("customer",))
sql_query("fn_length", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, CAST(length(p_type || p_brand) AS BIGINT) AS m FROM {part}", tables=("part",))
sql_query("fn_coalesce_nullif", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'F'), NULLIF(o_orderpriority, '1-URGENT'), 'none') AS x FROM {orders}", tables=("orders",))
sql_query("fn_substr", "SELECT c_custkey, substr(c_name, 3) AS a, substring(c_name, 2, 4) AS b, substr(c_name, 500) AS c FROM {customer}", tables=("customer",))


@query("SELECT p_partkey, replace(p_name, 'a', '__') AS r, regexp_replace('  ' || p_brand || chr(9) || chr(10), '^\\s+|\\s+$', '', 'g') AS t FROM part")
def fn_replace_trim(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.replace("p_name", F.lit("a"), F.lit("__")).alias("r"), D.trim_space(F.concat(F.lit("  "), "p_brand", F.lit("\t\n"))).alias("t"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, round_even(l_quantity / 4, 1) AS quarter FROM lineitem")
def fn_round_half_even(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", D.round_half_even(t.l_quantity / 2).alias("half"), D.round_half_even(t.l_quantity / 4, 1).alias("quarter"))


@query("SELECT o_orderkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE 'text' END AS d, 'integer' AS e FROM orders")
def fn_typeof(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    named = {"a": t.o_orderkey, "b": t.o_totalprice, "c": t.o_orderpriority, "d": F.nullif(t.o_orderstatus, F.lit("F")), "e": t.o_orderkey > 5}
    return t.select("o_orderkey", *[D.type_name(c).alias(n) for n, c in named.items()])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE l_quantity / (l_linenumber - 3) END AS q, CASE WHEN l_linenumber = 2 THEN NULL ELSE 7 / CAST(l_linenumber - 2 AS DOUBLE) END AS s FROM lineitem")
def safe_divide(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", D.safe_divide(t.l_quantity, t.l_linenumber - 3).alias("q"), D.safe_divide(F.lit(7), t.l_linenumber - 2).alias("s"))


@query("SELECT n_nationkey, CASE WHEN b = 0 THEN NULL ELSE ((a % b) + b) % b END AS m FROM (SELECT n_nationkey, n_nationkey - 12 AS a, n_regionkey - 2 AS b FROM nation)")
def floor_mod(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", D.floor_mod(t.n_nationkey - 12, t.n_regionkey - 2).alias("m"))


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS s, n_name || NULLIF(n_name, n_name) AS n FROM nation")
def concat_op(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", D.concat_op(t.n_name, F.lit("/"), t.n_regionkey).alias("s"), D.concat_op(t.n_name, F.nullif(t.n_name, t.n_name)).alias("n"))


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS i, TRY_CAST(substr(c_name, 10) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bad, CAST(c_custkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) AS s, c_custkey <> 0 AS b FROM customer""")
def cast_family(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", D.to_integer(t.c_acctbal).alias("i"), D.to_integer(F.substring(t.c_name, 10, 99)).alias("n"), D.to_integer(F.concat(F.lit("x"), t.c_name)).alias("bad"), D.to_real(t.c_custkey).alias("d"), D.to_text(t.c_custkey).alias("s"), D.to_boolean(t.c_custkey).alias("b"))


sql_query("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE WHEN p_size > 45 THEN 1 END AS n FROM {part}", tables=("part",))
sql_query("case_simple", "SELECT o_orderkey, CASE NULLIF(o_orderstatus, 'P') WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN NULL THEN 'never' ELSE 'other' END AS c FROM {orders}", tables=("orders",))
