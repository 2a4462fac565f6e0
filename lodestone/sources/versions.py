"""Changes of a table as DataFrames: rows inserted, updated and deleted, and the newest row of each key.

A changed table is a log: its rows carry _row_id, _commit_ts and _deleted.  A change is a set of new row versions; a log is
the union of changes; a snapshot is the newest version of each row up to a time, without deleted ones, in one aggregate
over one scan of the log.  Storing the log is Spark's writer's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ["_row_id", "_commit_ts", "_deleted"]


def initial(rows: DataFrame, row_id: Column, commit_ts: int = 1) -> DataFrame:
    """A log with all rows inserted at one time."""
    return rows.withColumns({"_row_id": row_id.cast("bigint"), "_commit_ts": F.lit(commit_ts).cast("bigint"), "_deleted": F.lit(False)})


def newest(log: DataFrame, commit_ts: int | None = None) -> DataFrame:
    """The newest version of each row up to commit_ts, deleted ones too."""
    seen = log if commit_ts is None else log.filter(F.col("_commit_ts") <= commit_ts)
    values = [c for c in log.columns if c != "_row_id"]
    last = seen.groupBy("_row_id").agg(F.max_by(F.struct(*values), "_commit_ts").alias("v"))
    return last.select("v.*", "_row_id").select(*log.columns)


def snapshot(log: DataFrame, commit_ts: int | None = None) -> DataFrame:
    """What a reader at commit_ts sees: values only."""
    return newest(log, commit_ts).filter("NOT _deleted").drop(*MARKS)


def updated(log: DataFrame, values: dict[str, Column], where: Column, snapshot_ts: int, commit_ts: int) -> DataFrame:
    """New versions of the rows that match in the snapshot; every value is computed from the old row. Its count() is how
    many rows the update changes."""
    unknown = [c for c in values if c not in log.columns or c in MARKS]
    if unknown:
        raise ValueError(f"no columns {unknown}")
    rows = newest(log, snapshot_ts).filter("NOT _deleted").filter(where)
    new = [(values[c] if c in values else F.col(c)).cast(log.schema[c].dataType).alias(c) for c in log.columns if c not in MARKS]
    return rows.select(*new, "_row_id", F.lit(commit_ts).cast("bigint").alias("_commit_ts"), F.lit(False).alias("_deleted")).select(*log.columns)


def deleted(log: DataFrame, where: Column, snapshot_ts: int, commit_ts: int) -> DataFrame:
    """Marks for the rows that match in the snapshot. Its count() is how many rows the deletion takes."""
    rows = newest(log, snapshot_ts).filter("NOT _deleted").filter(where)
    return rows.withColumns({"_commit_ts": F.lit(commit_ts).cast("bigint"), "_deleted": F.lit(True)}).select(*log.columns)


def inserted(log: DataFrame, rows: DataFrame, columns: list[str], commit_ts: int) -> DataFrame:
    """New rows for the columns named, in order; as many as rows has, other columns are null. Its count() is how many rows
    come in.

    Row ids follow the log's largest, read in the same job; they leave gaps between partitions.
    """
    if len(columns) != len(rows.columns):
        raise ValueError(f"{len(columns)} columns for rows of {len(rows.columns)} values")
    unknown = [c for c in columns if c not in log.columns or c in MARKS]
    if unknown:
        raise ValueError(f"no columns {unknown}")
    named = rows.toDF(*columns)
    new = [(F.col(c) if c in columns else F.lit(None)).cast(log.schema[c].dataType).alias(c) for c in log.columns if c not in MARKS]
    last = log.agg(F.coalesce(F.max("_row_id"), F.lit(0)).alias("m")).scalar()
    ids = (F.monotonically_increasing_id() + F.lit(1) + last).alias("_row_id")
    return named.select(*new, ids, F.lit(commit_ts).cast("bigint").alias("_commit_ts"), F.lit(False).alias("_deleted")).select(*log.columns)
