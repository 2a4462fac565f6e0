"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round rewrites the edges so that nodes point at ever smaller nodes; after a number of rounds logarithmic in the
longest path, every edge is (node, smallest node of its component).  A round is joins and aggregates over edges, written
to the shared folder, so no component is ever gathered in one place.

Defined results: loops, repeated edges and edges with a null end are ignored; a node without an edge has no row; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, release


def _round(edges: DataFrame) -> DataFrame:
    """edges: distinct (x, y) with x > y."""
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
    least = large.groupBy("x").agg(F.min("y").alias("m"))
    small = large.join(least, "x")
    return small.filter("y != m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(least.select("x", F.col("m").alias("y"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one node, and those at none."""
    one = edges.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    return one and edges.join(edges.select(F.col("x").alias("n")), F.col("y") == F.col("n"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of edges (two columns of one type)."""
    a, b = edges.columns
    held = materialize(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    while not _settled(held):
        last, held = held, materialize(_round(held), held.count())
        release(last)
    smallest = held.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return held.select(F.col("x").alias("node"), F.col("y").alias("component")).unionAll(smallest)
