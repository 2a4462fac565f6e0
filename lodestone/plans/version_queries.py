"""Registered queries over changed tables, each with its SQL.

The log of orders, made in one scan: at time 1 all rows come in, at 2 the price of finished orders rises by a tenth, at 3
those under 50,000 are deleted, at 4 two columns of what is left of status P are swapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import versions as V

Q: dict = {}
SQL: dict[str, str] = {}

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_ONE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_TWO = f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.1 ELSE o_totalprice END AS o_totalprice FROM ({_ONE})"
_THREE = f"SELECT * FROM ({_TWO}) WHERE NOT o_totalprice < 50000"
_FOUR = f"SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderkey ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM ({_THREE})"


def _orders(spark, sf_dir: str) -> DataFrame:
    return V.initial(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_COLUMNS), F.col("o_orderkey"))


def _log(spark, sf_dir: str) -> DataFrame:
    """Each order's versions, as change feeds deliver them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_COLUMNS)
    raised = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice"))
    gone = F.coalesce(raised < 50000, F.lit(False))
    version = lambda ts, key, cust, price, deleted=False: F.struct(key.alias("o_orderkey"), cust.alias("o_custkey"), F.col("o_orderstatus"), price.alias("o_totalprice"), F.lit(ts).cast("bigint").alias("_commit_ts"), F.lit(deleted).alias("_deleted"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    all_of = F.array(
        version(1, key, cust, F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", version(2, key, cust, raised)), F.when(gone, version(3, key, cust, raised, True)), F.when((F.col("o_orderstatus") == "P") & ~gone, version(4, cust, key, raised))
    )
    return o.select(F.col("o_orderkey").cast("bigint").alias("_row_id"), F.explode(F.filter(all_of, lambda v: v.isNotNull())).alias("v")).select("v.*", "_row_id").select(*_COLUMNS, *V.MARKS)


def query(sql: str):
    def register(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(_TWO)
def mvcc_snapshot(spark, sf_dir):
    return V.snapshot(_log(spark, sf_dir), 2)


@query(_FOUR)
def mvcc_compacted(spark, sf_dir):
    # the newest row of each key, all changes applied
    return V.snapshot(_log(spark, sf_dir))


@query(f"SELECT * FROM ({_TWO}) WHERE o_orderstatus = 'F'")
def update_result(spark, sf_dir):
    return V.updated(_orders(spark, sf_dir), {"o_totalprice": F.col("o_totalprice") * 1.1}, F.col("o_orderstatus") == "F", 1, 2).drop(*V.MARKS)


@query(f"SELECT o_orderkey FROM ({_TWO}) WHERE o_totalprice < 50000")
def delete_result(spark, sf_dir):
    return V.deleted(_log(spark, sf_dir), F.col("o_totalprice") < 50000, 2, 3).select("o_orderkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, NULL FROM customer")
def insert_result(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    log = V.initial(customer, F.col("c_custkey"))
    more = customer.select(F.col("c_custkey") + 1000000000, "c_name")
    return V.snapshot(log.unionByName(V.inserted(log, more, ["c_custkey", "c_name"], 2)))


@query(
    f"SELECT 'insert' AS statement, count(*) AS affected FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'update', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'delete', count(*) FROM ({_TWO}) WHERE o_totalprice < 50000"
)
def dml_counts(spark, sf_dir):
    """How many rows each kind of change affects."""
    log = _orders(spark, sf_dir)
    large = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 300000").select("o_orderkey", "o_totalprice")
    changes = {
        "insert": V.inserted(log, large, ["o_orderkey", "o_totalprice"], 2), "update": V.updated(log, {"o_totalprice": F.col("o_totalprice") * 1.1}, F.col("o_orderstatus") == "F", 1, 2),
        "delete": V.deleted(_log(spark, sf_dir), F.col("o_totalprice") < 50000, 2, 3),
    }
    counts = [c.agg(F.lit(name).alias("statement"), F.count(F.lit(1)).alias("affected")) for name, c in changes.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
