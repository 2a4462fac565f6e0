"""Spans derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are a trace; most spans hang below the user's event before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    duration = F.round(F.col("value") * 1000000).cast("bigint")
    value = F.struct(F.lit(None).cast("string").alias("s"), F.get_json_object("props", "$.k").cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("user_id")).alias("trace_id"), F.concat(F.lit("s"), F.col("event_id")).alias("span_id"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("s"), before)).alias("parent_span_id"), F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string")).alias("name"), F.col("event_type").alias("service_name"),
        start.alias("start_ns"), (start + duration).alias("end_ns"), duration.alias("duration_ns"), F.create_map(F.lit("k"), value).alias("attributes"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 2 == 0, "ok").otherwise("unset").alias("status_code"),
    )


#: The same rows for the SQL side.
SQL = """
SELECT event_id AS seq, 't' || user_id AS trace_id, 's' || event_id AS span_id,
       CASE WHEN event_id % 5 <> 0 THEN 's' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent_span_id,
       event_type || '-' || (event_id % 3) AS name, event_type AS service_name, epoch_us(ts) * 1000 AS start_ns,
       epoch_us(ts) * 1000 + CAST(round(value * 1000000) AS BIGINT) AS end_ns, CAST(round(value * 1000000) AS BIGINT) AS duration_ns,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'unset' END AS status_code
FROM events"""
