"""Scans, filters, joins, aggregates, sorting and subqueries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalogue import query, sql_query, table
from sparkloom.functions.dialect import like_ci
from sparkloom.operators import relational as R

_ORDERKEYS = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey",)}


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    out = R.grouped(
        t, ["l_returnflag", "l_linestatus"], sum_qty=F.round(F.sum("l_quantity"), 2), sum_base=F.round(F.sum("l_extendedprice"), 2),
        sum_disc=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), avg_qty=F.round(F.avg("l_quantity"), 4), avg_disc=F.round(F.avg("l_discount"), 4), n=F.count(F.lit(1)),
    )
    return R.sorted_by(out, ("l_returnflag", False), ("l_linestatus", False))


# scans and projections
sql_query("scan_all", "SELECT * FROM {region}", tables=("region",))
sql_query("project_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_quantity AS neg, l_linenumber * 2 - 1 AS odd FROM {lineitem}", tables=("lineitem",))
sql_query("select_no_from", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'it''s' AS s, TRUE AS t, FALSE AS f, CAST(1.5 AS DOUBLE) AS d, CAST(2e3 AS DOUBLE) AS e, CAST(NULL AS BIGINT) AS n")
sql_query("derived_table", "SELECT a.o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, o_totalprice * 2 AS dbl FROM {orders}) a WHERE a.dbl > 100000 GROUP BY a.o_orderstatus", tables=("orders",))
sql_query("qualified_star", "SELECT n.* FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey < 3", tables=("nation", "region"))


@query("SELECT c_custkey, c_name FROM customer")
def project_known_columns(spark, sf_dir):
    return R.project_known(table(spark, sf_dir, "customer"), ["c_custkey", "no_such_column", "c_name"])


# predicates
sql_query("filter_compare", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 25 AND l_quantity <> 30 AND l_discount < 0.05 AND l_linenumber != 2 AND l_tax <= 0.06 AND l_extendedprice > 1000", tables=("lineitem",))
sql_query("filter_bool_logic", "SELECT o_orderkey FROM {orders} WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000) AND (NULLIF(o_orderstatus, 'O') = 'P' OR o_custkey % 2 = 0)", tables=("orders",))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def range_scan_closed(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 2000)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 2000")
def range_scan_open(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 2000, False, False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 900")
def range_scan_unbounded(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 900)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, sf_dir):
    return R.point(table(spark, sf_dir, "orders"), "o_orderkey", 77)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey = 55")
def point_lookup_all(spark, sf_dir):
    return R.point(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_partkey", 55)


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 77")
def key_contains(spark, sf_dir):
    return R.point(table(spark, sf_dir, "orders"), "o_orderkey", 77).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def min_max_key(spark, sf_dir):
    return R.extrema(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def ordered_key_scan(spark, sf_dir):
    """The ordered scan, with each row's place made visible: rank = rows of smaller keys, here from range partitions' counts."""
    keys = R.ordered_scan(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").withColumn("_at", F.monotonically_increasing_id())
    split = keys.select("p_partkey", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return split.join(before, "_part").select("p_partkey", (F.col("_before") + F.col("_row") + 1).cast("bigint").alias("place"))


sql_query("between", "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT BETWEEN 5 AND 50", tables=("part",))
sql_query("between_null", "SELECT count(*) AS n FROM {part} WHERE p_size BETWEEN 10 AND NULLIF(p_size, p_size)", tables=("part",))
sql_query("in_list", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 3, 5, 7)", tables=("part",))
sql_query("not_in_list", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus NOT IN ('F', 'P')", tables=("orders",))
sql_query("not_in_null", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus NOT IN ('F', CAST(NULL AS STRING))", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', NULL)", tables=("orders",))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER%1_' AND NOT c_mktsegment ILIKE '%ing%'")
def like_ci_filter(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return R.filtered(t, like_ci(t.c_name, "CUSTOMER%1_") & ~like_ci(t.c_mktsegment, "%ing%")).select("c_custkey", "c_name")


sql_query("is_null", "SELECT count(*) AS n_all, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE x IS NOT NULL) AS n_some FROM (SELECT NULLIF(o_orderstatus, 'F') AS x FROM {orders})", tables=("orders",))

# subqueries
sql_query("in_subquery", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)", tables=("customer", "orders"))
sql_query("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})", tables=("customer", "orders"))
sql_query("exists_corr", "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)", tables=("orders", "lineitem"), keys={"lineitem": ("l_orderkey",)})
sql_query("not_exists_corr", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)", tables=("orders", "lineitem"), keys={"lineitem": ("l_orderkey",)})
sql_query("scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM {orders}), 2) AS above FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})", tables=("orders",))
sql_query("scalar_subquery_corr", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c", tables=("customer", "orders"))

# joins
_PAIR = "o.o_orderkey, l.l_linenumber, l.l_quantity FROM {orders} o %s JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 10"
for _kind in ("inner", "left", "right", "full"):
    sql_query(f"{_kind}_join", "SELECT " + _PAIR % ("FULL OUTER" if _kind == "full" else _kind.upper()), tables=("orders", "lineitem"), keys=_ORDERKEYS)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(spark, sf_dir):
    """Every pair, which is what a cross join is; nation and region do not grow with the data."""
    return R.joined(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), None)


sql_query("comma_join", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey", tables=("nation", "region"))
sql_query("theta_join", "SELECT a.n_nationkey AS a, r.r_regionkey AS b FROM {nation} a JOIN {region} r ON a.n_nationkey > r.r_regionkey * 4 AND a.n_regionkey <> r.r_regionkey", tables=("nation", "region"))


@query("SELECT k, o_orderkey, c_name FROM (SELECT o_custkey AS k, o_orderkey FROM orders) JOIN (SELECT c_custkey AS k, c_name FROM customer) USING (k)")
def using_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return R.joined(left, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), ["k"])


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def natural_join(spark, sf_dir):
    return R.natural_join(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name"), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"))


sql_query("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", tables=("nation",))
sql_query("multi_join", "SELECT r.r_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY r.r_name", tables=("region", "nation", "customer", "orders"))
sql_query("composite_key_join", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber", tables=("lineitem",), keys={"lineitem": ("l_orderkey", "l_linenumber")})
sql_query("null_keys_join", "SELECT count(*) AS n FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM {nation}) a JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM {region}) b ON a.k = b.k", tables=("nation", "region"))
sql_query("outer_join_filter", "SELECT o.o_orderkey, l.l_quantity FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL AND o.o_totalprice > 1000", tables=("orders", "lineitem"), keys=_ORDERKEYS)

# aggregates
sql_query("group_agg", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM {orders} GROUP BY o_orderstatus", tables=("orders",))
sql_query("global_agg", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem}", tables=("lineitem",))
sql_query("empty_global_agg", "SELECT count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS a, min(l_quantity) AS lo, max(l_returnflag) AS hi FROM {lineitem} WHERE l_quantity < 0", tables=("lineitem",))
sql_query("count_nonnull", "SELECT count(*) AS n_rows, count(x) AS n FROM (SELECT NULLIF(o_orderstatus, 'O') AS x FROM {orders})", tables=("orders",))
sql_query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers FROM {lineitem} GROUP BY l_returnflag", tables=("lineitem",))
sql_query("agg_in_expr", "SELECT o_orderstatus, CAST(count(*) * 2 + 1 AS BIGINT) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM {orders} GROUP BY o_orderstatus", tables=("orders",))
sql_query("group_by_expr", "SELECT CAST(p_size % 10 AS INT) AS bucket, count(*) AS n FROM {part} GROUP BY CAST(p_size % 10 AS INT)", tables=("part",))
sql_query("group_nulls", "SELECT NULLIF(o_orderstatus, 'F') AS s, count(*) AS n FROM {orders} GROUP BY NULLIF(o_orderstatus, 'F')", tables=("orders",))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def group_without_agg(spark, sf_dir):
    return R.grouped(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


sql_query("having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1000", tables=("orders",))
sql_query("having_only_agg", "SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING max(o_totalprice) > 150000", tables=("orders",))


# sorting and paging; ranks make the order visible
@query("SELECT o_orderkey, x, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey) AS BIGINT) AS place FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS x FROM orders) ORDER BY x DESC NULLS LAST, o_orderkey LIMIT 100")
def order_desc_nulls_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("x"))
    return R.placed_page(rows, 100, ("x", True), ("o_orderkey", False))


sql_query("order_hidden_col", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", tables=("orders",))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 7")
def limit_offset(spark, sf_dir):
    return R.page(R.sorted_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ("o_orderkey", False)), 10, 7)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey"), 0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return R.page(R.sorted_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", True), ("o_orderkey", False)), 20)


sql_query("distinct_rows", "SELECT DISTINCT c_mktsegment FROM {customer} ORDER BY c_mktsegment", tables=("customer",))
sql_query("order_by_alias", "SELECT c_custkey, round(c_acctbal * 2, 2) AS twice FROM {customer} ORDER BY twice DESC NULLS LAST, c_custkey LIMIT 15", tables=("customer",))
sql_query("order_by_ordinal", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY 2 NULLS LAST, 1 LIMIT 15", tables=("customer",))
sql_query("group_by_alias", "SELECT o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY s", tables=("orders",))
