"""The dialect's own rules, on small tables."""

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import semantics as S
from lodestone.operators import relational as R

col = F.col


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Ada", 30), (2, "Grace", 40), (3, "Lonely", 50)], "id long, name string, age long")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 1, 100.0), (2, 1, 50.0), (3, 2, 75.0)], "oid long, user_id long, total double")


def ages(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, age long")


def test_joins(users, orders):
    on = col("id") == col("user_id")
    assert R.join(users, orders, on).count() == 3
    left = R.join(users, orders, on, "left").collect()
    assert len(left) == 4 and [r.total for r in left if r.name == "Lonely"] == [None]
    assert R.join(users, orders, col("total") > col("age")).count() == 8
    with pytest.raises(ValueError, match="right"):
        R.join(users, orders, on, "right")


def test_null_key_never_matches(spark, users):
    orders = spark.createDataFrame([(1, None, 9.0)], "oid long, user_id long, total double")
    assert R.join(orders, users, col("id") == col("user_id"), "left").first().name is None


def test_equi_and_theta_joins_agree(users, orders):
    equi = R.join(users, orders, col("id") == col("user_id"), "left")
    theta = R.join(users, orders, (col("id") <= col("user_id")) & (col("id") >= col("user_id")), "left")
    assert sorted(map(str, equi.collect())) == sorted(map(str, theta.collect()))


def test_aggregates(spark):
    total = {"n": S.count(), "c": S.count(col("age")), "s": S.sum_or_zero(col("age")), "a": F.avg("age"), "lo": F.min("age"), "hi": F.max("age")}
    assert R.aggregate(ages(spark, 10, None, 30), {}, total).first() == Row(n=3, c=2, s=40.0, a=20.0, lo=10, hi=30)
    assert R.aggregate(ages(spark, None, None), {}, total).first() == Row(n=2, c=0, s=0.0, a=None, lo=None, hi=None)
    empty = ages(spark, 1).filter("false")
    assert R.aggregate(empty, {}, total).first() == Row(n=0, c=0, s=0.0, a=None, lo=None, hi=None)
    assert R.aggregate(empty, {"age": col("age")}, total).count() == 0
    assert sorted(R.aggregate(ages(spark, 30, 30, 40, None, None), {"age": col("age")}, {"n": S.count()}).collect(), key=str) == sorted([Row(age=30, n=2), Row(age=40, n=1), Row(age=None, n=2)], key=str)
    assert R.aggregate(ages(spark, 5, 5, 7, None), {}, {"n": S.count(col("age"), True), "s": S.sum_or_zero(col("age"), True)}).first() == Row(n=2, s=12.0)
    assert R.aggregate(ages(spark, 5, 5, 7), {"age": col("age")}, {}).count() == 2


def test_sort_nulls_last_and_stable(spark):
    df = spark.createDataFrame([(5, 30), (3, 30), (1, None), (0, 10)], "id long, age long").withColumn("row", F.element_at(F.create_map(F.lit(5), F.lit(0), F.lit(3), F.lit(1), F.lit(1), F.lit(2), F.lit(0), F.lit(3)), col("id").cast("int")))
    assert [r.id for r in R.sort_stable(df, [S.ascending(col("age"))], "row").collect()] == [0, 5, 3, 1]
    assert [r.id for r in R.sort_stable(df, [S.descending(col("age"))], "row").collect()] == [5, 3, 0, 1]


def test_distinct_with_hidden_order(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 1, 2), ("a", 0, 3)], "v string, o long, id long")
    assert [r.v for r in R.distinct_ordered(df, ["v"], col("o"), [col("id")]).collect()] == ["b", "a"]


def test_limit(spark):
    assert R.limit(spark.range(1000), 5).count() == 5
    assert R.limit(spark.range(10), 0).count() == 0
    with pytest.raises(ValueError, match="whole"):
        R.limit(spark.range(10), 1.5)


def test_division(spark):
    df = spark.createDataFrame([(7, 2), (None, 0)], "a long, b long")
    assert [r[0] for r in df.select(S.divide(col("a"), col("b"))).collect()] == [3.5, None]
    zero = spark.createDataFrame([(1, 0)], "a long, b long")
    for f in (S.divide, S.remainder):
        with pytest.raises(ArithmeticException):
            zero.select(f(col("a"), col("b"))).collect()
    assert spark.range(1).select(S.remainder(F.lit(-7), F.lit(3))).first()[0] == -1


def test_guards_hold_in_any_order(spark):
    df = spark.createDataFrame([(0, 5), (2, 6), (None, 7)], "d long, x long")
    ok = S.both(col("d") != 0, lambda d: S.divide(col("x"), d) == 3, col("d"))
    assert [r.x for r in df.filter(ok).collect()] == [6]
    either = S.either(col("d") == 0, lambda d: S.divide(col("x"), d) == 3, col("d"))
    assert sorted(r.x for r in df.filter(either).collect()) == [5, 6]


def test_three_valued_logic(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")

    def k_and(a, b):
        return False if a is False or b is False else None if a is None or b is None else True

    def k_or(a, b):
        return True if a is True or b is True else None if a is None or b is None else False

    for r in df.select("a", "b", (col("a") & col("b")).alias("x"), (col("a") | col("b")).alias("y"), (~col("a")).alias("z")).collect():
        assert (r.x, r.y, r.z) == (k_and(r.a, r.b), k_or(r.a, r.b), None if r.a is None else not r.a)


def test_functions(spark):
    df = spark.createDataFrame([("ß😀", 1, "x")], "t string, n long, u string")
    assert df.select(S.utf16_length(col("t"))).first()[0] == 3
    assert df.select(F.upper(S.text_only(df, "t"))).first()[0] == "SS😀"
    assert df.select(S.coalesce(df, "t", "u")).first()[0] == "ß😀"
    for bad in (lambda: S.text_only(df, "n"), lambda: S.coalesce(df, "t", "n"), lambda: S.coalesce(df)):
        with pytest.raises(TypeError):
            bad()


def test_percentile_is_nearest_rank(spark):
    import math

    for n in (1, 2, 3, 10, 57):
        values = [(v * 7) % 101 for v in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for p in (0.5, 0.95, 0.99):
            want = sorted(values)[max(0, math.ceil(round(p * n, 9)) - 1)]
            assert df.agg(S.nearest_rank(col("v"), p)).first()[0] == want
    assert spark.range(0).agg(S.nearest_rank(col("id"), 0.5)).first()[0] == 0


def test_scan(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert R.scan(spark, f"{tmp_path}/t", ["id", "gone"]).first() == Row(id=0, gone=None) or R.scan(spark, f"{tmp_path}/t", ["id", "gone"]).filter("gone IS NULL").count() == 3
    assert R.single_row(spark, a=F.lit(1), b=F.lit("x")).collect() == [Row(a=1, b="x")]


def test_distinct_ordered_by_any_names(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 1, 2), ("a", 0, 3), (None, None, 4), ("b", 9, 5)], "_o string, values long, row long")
    got = R.distinct_ordered(df, ["_o"], F.col("values"), [F.col("row")]).collect()
    assert [r[0] for r in got] == ["b", "a", None]
