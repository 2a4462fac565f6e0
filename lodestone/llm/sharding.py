"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets a 60-bit hash of its key.  The directory is indexed by hash-prefix bits; a bucket over the byte limit
splits on one more bit, and only such buckets split.  The shard of a row is its shortest prefix whose rows fit.

Bytes are first summed into cells, a few bits finer than the number of shards calls for; all shorter prefixes are sums
of cells.  A prefix is a shard if it fits and the one that is a bit shorter, it and its sister, does not.  Cells that are
still too large are split again by a further round on their rows alone.  Tables of cells and shards grow with the data: they
are sent to every task only while their counted rows are few.

Defined results: null text has 0 bytes; very long texts count whole; a null key counts as the empty key; repeated rows
share a hash, so they share a shard, and ties decide nothing; a bucket of one hash value cannot split and stays whole even
if it is over the limit (a row longer than the limit, or repeated rows); an empty table gives an empty table; other input
columns are ignored (assign) or kept (write_shards), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, sided

HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _leaves(rows: DataFrame, done: int, depth: int, limit: int) -> DataFrame:
    """For each cell (prefix of depth bits): its shard, or null where the cell itself is too large."""
    cells = rows.groupBy(F.shiftright("h", HASH_BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    cells = materialize(cells)
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(done), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(lo, {HASH_BITS} - d)"))
    sums = levels.groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("c").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sisters = Window.partitionBy("d", F.shiftright("prefix", 1))
    fits = lambda b, lo, hi: (b <= limit) | (lo == hi)
    shorter = fits(F.sum("shard_bytes").over(sisters), F.min("lo").over(sisters), F.max("hi").over(sisters))
    first = sums.withColumn("first", (F.col("d") == done) | ~shorter).filter(F.col("first") & fits(F.col("shard_bytes"), F.col("lo"), F.col("hi")))
    shards = materialize(first.select("d", "prefix", "shard_bytes", "shard_docs"))
    leaf = F.struct("d", "prefix", "shard_bytes", "shard_docs").alias("leaf")
    placed = levels.select("cell", "d", "prefix").join(sided(shards, shards.count()), ["d", "prefix"]).select("cell", leaf)
    return cells.select("cell").join(placed, "cell", "left")


def assign(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text", spare_bits: int = 4) -> DataFrame:
    """key, n_bytes, shard_depth, shard_prefix, shard_bytes, shard_docs of every row of docs."""
    rows = docs.select(F.col(key_col).alias("k"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"))
    rows = materialize(rows.withColumn("h", key_hash(F.col("k"))))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, spare_bits + max(0, math.ceil(math.log2(max(1, total) / limit))))
    out, left, done = None, rows, 0
    while True:
        leaves = materialize(_leaves(left, done, depth, limit))
        placed = left.withColumn("cell", F.shiftright("h", HASH_BITS - depth)).join(sided(leaves, leaves.count()), "cell")
        whole = placed.filter("leaf IS NOT NULL").select("k", "n_bytes", "leaf")
        out = whole if out is None else out.unionByName(whole)
        if leaves.filter("leaf IS NULL").isEmpty():
            break
        left = materialize(placed.filter("leaf IS NULL").select("k", "n_bytes", "h"))
        done, depth = depth, min(HASH_BITS, depth + 8)
    return out.select(F.col("k").alias(key_col), "n_bytes", F.col("leaf.d").cast("bigint").alias("shard_depth"), F.col("leaf.prefix").alias("shard_prefix"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs"))


def write_shards(docs: DataFrame, path: str, limit: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs to one folder a shard; each shard is at most limit bytes of text, so it is one task's work.

    The folders are named by shard_depth and shard_prefix, with underscores behind while docs has columns of these names.
    """
    mark = ""
    while {f"shard_depth{mark}".lower(), f"shard_prefix{mark}".lower()} & {c.lower() for c in docs.columns}:
        mark += "_"
    by = [f"shard_depth{mark}", f"shard_prefix{mark}"]
    places = assign(docs, limit, key_col, text_col).select(F.struct(F.col(key_col).alias("k")).alias("at"), F.struct(F.col("shard_depth").alias("d"), F.col("shard_prefix").alias("p")).alias("to")).distinct()
    placed = docs.select(F.struct("*").alias("row"), F.struct(F.col(key_col).alias("k")).alias("own")).join(places, F.col("own.k").eqNullSafe(F.col("at.k")))
    placed.select("row.*", F.col("to.d").alias(by[0]), F.col("to.p").alias(by[1])).repartition(*by).write.partitionBy(*by).parquet(path)


def oracle_sql(limit: int, max_depth: int) -> str:
    """The same shards in SQL, if no prefix longer than max_depth is needed."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
lv AS (SELECT CAST(range AS BIGINT) AS depth FROM range({max_depth + 1})),
p AS (
  SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS b, count(*) AS c, min(h) AS lo, max(h) AS hi
  FROM d CROSS JOIN lv GROUP BY 1, 2),
f AS (SELECT * FROM p WHERE b <= {limit} OR lo = hi),
m AS (
  SELECT d.doc_id, d.n_bytes, f.depth, f.prefix, f.b, f.c,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY f.depth) AS k
  FROM d CROSS JOIN lv JOIN f ON f.depth = lv.depth AND f.prefix = d.h >> ({HASH_BITS} - lv.depth))
SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, CAST(b AS BIGINT) AS shard_bytes, CAST(c AS BIGINT) AS shard_docs
FROM m WHERE k = 1"""
