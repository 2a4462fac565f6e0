"""Changed tables: snapshots, updates, deletions, insertions."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import versions as V


def log_of(spark):
    return V.initial(spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, n long"), F.col("id"))


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "n").collect()), key=str)


def test_snapshots(spark):
    log = log_of(spark)
    log = log.unionByName(V.updated(log, {"n": F.col("n") + 1}, F.col("n") > 10, 1, 2))
    log = log.unionByName(V.deleted(log, F.col("id") == 1, 2, 3))
    assert rows(V.snapshot(log, 1)) == [(1, 10), (2, 20), (3, None)]
    assert rows(V.snapshot(log, 2)) == [(1, 10), (2, 21), (3, None)]
    assert rows(V.snapshot(log, 3)) == rows(V.snapshot(log)) == [(2, 21), (3, None)]


def test_assignments_see_the_old_row(spark):
    log = V.initial(spark.createDataFrame([(1, 10)], "id long, n long"), F.lit(7))
    swapped = V.updated(log, {"id": F.col("n"), "n": F.col("id")}, F.lit(True), 1, 2)
    assert rows(swapped) == [(10, 1)]
    with pytest.raises(ValueError, match="no columns"):
        V.updated(log, {"absent": F.lit(1)}, F.lit(True), 1, 2)


def test_insert(spark):
    log = log_of(spark)
    new = V.inserted(log, spark.createDataFrame([(9,), (8,)], "x long"), ["id"], 2)
    assert rows(V.snapshot(log.unionByName(new))) == [(1, 10), (2, 20), (3, None), (8, None), (9, None)]
    again = V.inserted(log.unionByName(new), spark.createDataFrame([(1, 1)], "a long, b long"), ["n", "id"], 3)
    assert V.snapshot(log.unionByName(new).unionByName(again)).count() == 6  # ids follow the largest
    assert new.count() == 2
    for columns in (["id", "n"], []):
        with pytest.raises(ValueError, match="values"):
            V.inserted(log, spark.createDataFrame([(9,)], "x long"), columns, 2)
    with pytest.raises(ValueError, match="no columns"):
        V.inserted(log, spark.createDataFrame([(9,)], "x long"), ["absent"], 2)


def test_insert_into_nothing(spark):
    log = log_of(spark).filter("id > 99")
    assert rows(V.snapshot(log.unionByName(V.inserted(log, spark.createDataFrame([(9, 1)], "x long, y long"), ["id", "n"], 2)))) == [(9, 1)]
