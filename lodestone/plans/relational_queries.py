"""Registered queries over the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import semantics as S
from lodestone.operators import relational as R

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (t) under its name, where t(table, *columns) scans a table."""

    def register(f):
        def run(spark, sf_dir):
            return f(lambda name, *columns: R.scan(spark, f"{sf_dir}/{name}.parquet", list(columns) or None))

        Q[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return register


col = F.col


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(t):
    return t("orders", "o_orderkey", "o_totalprice")


@query("SELECT * FROM orders")
def select_star(t):
    return t("orders")


@query("SELECT 1 + 2 AS three, 'a' AS letter, 7 / 2.0 AS half, (SELECT count(*) FROM orders) AS n_orders")
def from_less(t):
    # a row without FROM, one of whose values is a scalar subquery
    orders = t("orders", "o_orderkey")
    return R.single_row(orders.sparkSession, three=F.lit(1) + F.lit(2), letter=F.lit("a"), half=S.divide(F.lit(7), F.lit(2)), n_orders=orders.agg(F.count(F.lit(1))).scalar())


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority <> '1-URGENT')")
def filter_and_or_not(t):
    o = t("orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return o.filter(((col("o_orderstatus") == "F") & (col("o_totalprice") > 200000)) | ~(col("o_orderpriority") != "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE NOT (o_orderkey > 500 AND c_acctbal < 0)")
def filter_null_3vl(t):
    j = R.join(t("customer", "c_custkey", "c_acctbal"), t("orders", "o_orderkey", "o_custkey", "o_totalprice").filter("o_totalprice > 300000"), col("c_custkey") == col("o_custkey"), "left")
    return j.filter(~((col("o_orderkey") > 500) & (col("c_acctbal") < 0))).select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more, -l_tax AS untaxed FROM lineitem WHERE l_quantity - 1 < 3")
def arith_ops(t):
    li = t("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    return li.filter(col("l_quantity") - 1 < 3).select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"), (col("l_quantity") + 1).alias("more"), (-col("l_tax")).alias("untaxed"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS DOUBLE) / l_linenumber AS ratio FROM lineitem WHERE l_linenumber <> 1 AND l_orderkey / (l_linenumber - 1) > 10000")
def int_division(t):
    li = t("lineitem", "l_orderkey", "l_linenumber")
    big = S.both(col("l_linenumber") != 1, lambda d: S.divide(col("l_orderkey"), d) > 10000, col("l_linenumber") - 1)
    return li.filter(big).select("l_orderkey", "l_linenumber", S.divide(col("l_orderkey"), col("l_linenumber")).alias("ratio"))


@query("SELECT o_orderkey, (o_orderkey - 3000) % 7 AS r FROM orders")
def modulo(t):
    return t("orders", "o_orderkey").select("o_orderkey", S.remainder(col("o_orderkey") - 3000, F.lit(7)).alias("r"))


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(t):
    c = t("customer", "c_custkey", "c_name", "c_mktsegment")
    return R.join(c, t("orders", "o_orderkey", "o_custkey", "o_totalprice"), col("c_custkey") == col("o_custkey")).filter(col("c_mktsegment") == "BUILDING").select("c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t):
    return R.join(t("customer", "c_custkey"), t("orders", "o_orderkey", "o_custkey"), col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON s_acctbal > n_nationkey * 400 AND s_nationkey < n_nationkey")
def join_theta(t):
    on = (col("s_acctbal") > col("n_nationkey") * 400) & (col("s_nationkey") < col("n_nationkey"))
    return R.join(t("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), t("nation", "n_nationkey"), on, "left").select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_acctbal > n_nationkey * 400 AND c_nationkey < n_nationkey")
def join_theta_inner(t):
    on = (col("c_acctbal") > col("n_nationkey") * 400) & (col("c_nationkey") < col("n_nationkey"))
    return R.join(t("customer", "c_custkey", "c_nationkey", "c_acctbal"), t("nation", "n_nationkey"), on).select("c_custkey", "n_nationkey")


@query("SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name")
def join_multiway(t):
    rn = R.join(t("region"), t("nation"), col("r_regionkey") == col("n_regionkey"))
    co = R.join(rn, t("customer", "c_custkey", "c_nationkey"), col("n_nationkey") == col("c_nationkey"))
    o = R.join(co, t("orders", "o_custkey"), col("c_custkey") == col("o_custkey"))
    return R.aggregate(o, {"r_name": col("r_name"), "n_name": col("n_name")}, {"n": S.count()})


@query("SELECT a.o_orderkey AS one, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey < b.o_orderkey")
def join_self(t):
    # two orders of a customer on one day
    a, b = (t("orders", "o_orderkey", "o_custkey", "o_orderdate").alias(x) for x in "ab")
    on = (col("a.o_custkey") == col("b.o_custkey")) & (col("a.o_orderdate") == col("b.o_orderdate"))
    return R.join(a, b, on).filter("a.o_orderkey < b.o_orderkey").select(col("a.o_orderkey").alias("one"), col("b.o_orderkey").alias("other"))


@query("SELECT count(*) AS n, count(l_tax) AS taxed, sum(l_quantity) AS qty, avg(l_discount) AS disc, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(t):
    li = t("lineitem", "l_tax", "l_quantity", "l_discount", "l_shipdate")
    return R.aggregate(li, {}, {"n": S.count(), "taxed": S.count(col("l_tax")), "qty": S.sum_or_zero(col("l_quantity")), "disc": F.avg("l_discount"), "lo": F.min("l_shipdate"), "hi": F.max("l_shipdate")})


@query("SELECT count(*) AS n, coalesce(sum(l_quantity), 0.0) AS qty, avg(l_quantity) AS mean, min(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0")
def agg_empty_sum_zero(t):
    li = t("lineitem", "l_quantity").filter("l_quantity < 0")
    return R.aggregate(li, {}, {"n": S.count(), "qty": S.sum_or_zero(col("l_quantity")), "mean": F.avg("l_quantity"), "lo": F.min("l_quantity")})


@query("SELECT l_returnflag, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag")
def agg_group(t):
    li = t("lineitem", "l_returnflag", "l_quantity", "l_discount").filter("l_discount < 0.05")
    return R.aggregate(li, {"l_returnflag": col("l_returnflag")}, {"sum_qty": S.sum_or_zero(col("l_quantity")), "n": S.count()})


@query("SELECT l_linenumber % 3 AS k, CAST(sum(l_orderkey + l_linenumber) AS DOUBLE) AS s FROM lineitem GROUP BY l_linenumber % 3")
def agg_group_expr(t):
    return R.aggregate(t("lineitem", "l_linenumber", "l_orderkey"), {"k": col("l_linenumber") % 3}, {"s": S.sum_or_zero(col("l_orderkey") + col("l_linenumber"))})


@query("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3")
def agg_order_by_hidden(t):
    g = R.aggregate(t("orders", "o_orderpriority"), {"o_orderpriority": col("o_orderpriority")}, {"_n": S.count()})
    return R.limit(g.orderBy(S.descending(col("_n")), "o_orderpriority"), 3).select("o_orderpriority")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS keys FROM orders GROUP BY o_orderstatus")
def agg_distinct(t):
    o = t("orders", "o_orderstatus", "o_custkey")
    return R.aggregate(o, {"o_orderstatus": col("o_orderstatus")}, {"customers": S.count(col("o_custkey"), distinct=True), "keys": S.sum_or_zero(col("o_custkey"), distinct=True)})


@query("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_without_aggregate(t):
    return R.aggregate(t("lineitem", "l_returnflag", "l_linestatus"), {"l_returnflag": col("l_returnflag"), "l_linestatus": col("l_linestatus")}, {})


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t):
    return t("customer", "c_mktsegment", "c_nationkey").distinct()


@query("SELECT c_mktsegment FROM (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1 ORDER BY c_acctbal LIMIT 2")
def distinct_hidden_order(t):
    return R.limit(R.distinct_ordered(t("customer", "c_mktsegment", "c_acctbal", "c_custkey"), ["c_mktsegment"], col("c_acctbal"), [col("c_custkey")]), 2)


@query("SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey ASC NULLS LAST, c_custkey DESC) AS place FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY place LIMIT 2000")
def sort_multi(t):
    # a top-k report: the first 2000 rows of the whole join, numbered in one task
    j = R.join(t("customer", "c_custkey"), t("orders", "o_orderkey", "o_custkey"), col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    top = R.limit(j.orderBy(S.ascending(col("o_orderkey")), S.descending(col("c_custkey"))), 2000)
    return top.withColumn("place", F.row_number().over(Window.orderBy(S.ascending(col("o_orderkey")), S.descending(col("c_custkey")))).cast("bigint"))


@query("SELECT c_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS large FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY large ASC NULLS LAST, c_custkey DESC, o_orderkey ASC NULLS LAST")
def sort_multi_all(t):
    # the whole join, sorted: Spark cuts it into ranges, so no task sorts it all
    j = R.join(t("customer", "c_custkey"), t("orders", "o_orderkey", "o_custkey", "o_totalprice"), col("c_custkey") == col("o_custkey"), "left")
    rows = j.select("c_custkey", "o_orderkey", F.when(col("o_totalprice") > 300000, col("o_totalprice")).alias("large"))
    return rows.orderBy(S.ascending(col("large")), S.descending(col("c_custkey")), S.ascending(col("o_orderkey")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return R.limit(R.sort_stable(t("orders", "o_orderkey", "o_totalprice"), [S.descending(col("o_totalprice"))], "o_orderkey"), 10)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(t):
    return R.limit(t("orders", "o_orderkey"), 0)


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_type) AS len, abs(p_size - 25) AS off, coalesce(CASE WHEN p_size > 10 THEN p_brand END, p_type) AS either FROM part")
def fn_upper_lower_length_abs_coalesce(t):
    p = t("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumn("big", F.when(col("p_size") > 10, col("p_brand")))
    return p.select("p_partkey", F.upper(S.text_only(p, "p_name")).alias("up"), F.lower("p_brand").alias("low"), S.utf16_length(S.text_only(p, "p_type")).alias("len"), F.abs(col("p_size") - 25).alias("off"), S.coalesce(p, "big", "p_type").alias("either"))
