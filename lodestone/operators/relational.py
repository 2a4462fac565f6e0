"""The relational operators, as thin DataFrame idioms with the dialect's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; a wanted column that it lacks is null."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c if c in df.columns else F.lit(None).alias(c) for c in columns])


def single_row(spark: SparkSession, **values: Column) -> DataFrame:
    """SELECT without FROM."""
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()])


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Inner or left outer, on any predicate; null keys never match. Spark takes hash, merge or nested loop by size."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} joins are not part of the dialect")
    return left.join(right, on, how)


def aggregate(df: DataFrame, keys: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """Grouped (also without aggregates: the distinct keys), or one row over everything without keys."""
    named = [v.alias(k) for k, v in values.items()]
    grouped = df.groupBy(*[c.alias(k) for k, c in keys.items()])
    if not named:
        return df.select(*[c.alias(k) for k, c in keys.items()]).distinct()
    return grouped.agg(*named)


def distinct_ordered(df: DataFrame, columns: list[str], order: Column, first: list[Column]) -> DataFrame:
    """Distinct values of columns, ordered by an expression that is not selected: of equal values the row that is first
    by `first` (ascending, nulls first) gives the order. An aggregate, so a frequent value is not sorted in one task."""
    places = [c.alias(f"k{i}") for i, c in enumerate(first)]
    kept = df.select(F.struct(*columns).alias("values"), F.struct(*places, order.alias("o")).alias("row")).groupBy("values").agg(F.min("row").alias("row"))
    return kept.orderBy(F.col("row.o").asc_nulls_last(), *[F.col(f"row.k{i}") for i in range(len(first))]).select("values.*")


def sort_stable(df: DataFrame, keys: list[Column], row_id: str) -> DataFrame:
    """Sorted by keys (with their null order), ties by row_id."""
    return df.orderBy(*keys, row_id)


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; n has to be a whole number."""
    if n != int(n) or n < 0:
        raise ValueError("LIMIT takes a whole number")
    return df.limit(int(n))
