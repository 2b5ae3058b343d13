import pytest
from pyspark.sql import functions as F

from minegrove.functions.ids import clean_id, leading_year, month_of
from minegrove.functions.skew import hot_keys, salted_join
from minegrove.operators.skew import eager_join_aggregate, once_per_id, shares_of_groups, unpivot_keys


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_ids_and_years(spark):
    df = spark.createDataFrame([(" \t\r\na b\n", "2018-1"), ("  ", "201"), (None, None), (" ", "20x8"), ("x", "9999")], "i string, d string")
    got = [(r["i"], r["y"]) for r in df.select(clean_id("i").alias("i"), leading_year("d").alias("y")).collect()]
    assert got == [("a b", 2018), (None, None), (None, None), (" ", None), ("x", 9999)]


def test_month_ignores_the_zone(spark):
    df = spark.sql("select timestamp_ntz'2020-01-31 23:59:59' as t union all select null")
    assert [r[0] for r in df.select(month_of("t")).collect()] == ["2020-01", None]


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [(None,)] * 100 + [(f"x{i}",) for i in range(10)], "k string")
    assert rows(hot_keys(df, "k", 0.25), "k") == [("a",), ("b",)]
    assert rows(hot_keys(df.limit(0), "k", 0.25), "k") == []


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)] + [(999, None)], "id int, key string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "key", how)
        got = salted_join(left, right, "key", how=how, spread=F.col("id"), share=0.1)
        assert rows(got, *want.columns) == rows(want, *want.columns), how


def test_both_sides_of_a_hot_key_are_dealt_out(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(60)] + [(999, None)], "id int, key string")
    right = left.withColumnRenamed("id", "v")
    want = left.join(right, "key").where("id < v")
    got = salted_join(left, right, "key", how="inner", spread=F.col("id"), share=0.05, condition=F.col("id") < F.col("v"), right_spread=F.col("v"))
    assert rows(got, *want.columns) == rows(want, *want.columns)
    with pytest.raises(ValueError):
        salted_join(left, right, "key", how="left", spread=F.col("id"), right_spread=F.col("v"))


def test_parts_follow_the_key_and_not_the_cluster(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [("c",)] * 10, "k string")
    assert rows(hot_keys(df, "k", 0.125), "k", "_parts") == [("a", 5), ("b", 3)]


def test_shares_are_those_of_the_join(spark):
    df = spark.createDataFrame([("y", "a", 1.0)] * 7 + [("y", None, 2.0)] * 2 + [("z", "a", None), ("z", "b", 1.0), (None, "a", 1.0)], "y string, k string, s double")
    other = df.select("y")
    plain = df.join(other, "y").groupBy("y", "k").agg(F.count("*").alias("n_pairs"))
    got = shares_of_groups(df, ["y"], ["k"], measures=["s"])
    cast = {c: F.col(c).cast("bigint") for c in ("n_pairs", "n_all_pairs")}
    assert rows(got.withColumns(cast), "y", "k", "n_pairs") == rows(plain, "y", "k", "n_pairs")
    assert rows(got.withColumns(cast), "y", "k", "n_rows", "n_all_pairs", "sum_s", "count_s") == sorted(
        [("y", "a", 7, 81, 7.0, 7), ("y", None, 2, 81, 4.0, 2), ("z", "a", 1, 4, None, 0), ("z", "b", 1, 4, 1.0, 1)], key=str
    )
    assert shares_of_groups(df.limit(0), ["y"], ["k"], on_bound=5).count() == 0


def test_one_id_in_a_third_of_all_rows(spark):
    df = spark.range(0, 3000, 1, 6).selectExpr("if(id % 3 = 0, -1, id) as id", "cast(id % 3 as string) as a")
    made = once_per_id(df, "id")
    assert made.count() == 2001
    text = made._jdf.queryExecution().executedPlan().toString()
    # combined on both sides of the shuffle
    assert text.count("partial_min") == 1


def test_eager_aggregate_is_the_joined_aggregate(spark):
    left = spark.createDataFrame(
        [("a", "g1", 1.0, 0), ("a", "g1", None, 0), ("a", "g2", 3.0, 0), ("b", None, 4.0, 0), (None, "g1", 9.0, 0), ("lost", "g1", 5.0, 0)] + [("a", "g1", 2.0, 0)] * 50,
        "k string, g string, x double, extra int",
    )
    right = spark.createDataFrame([("a", "h1", 10), ("a", "h1", 10), ("a", "h2", None), ("b", "h1", 7), (None, "h1", 1)], "k string, h string, y int")
    plain = left.join(right, "k").groupBy("g", "h").agg(
        F.count("*").alias("n_rows"), F.sum("x").alias("sum_x"), F.count("x").alias("count_x"), F.sum("y").alias("sum_y"), F.count("y").alias("count_y")
    )
    for bound in (None, 10):
        got = eager_join_aggregate(left, right, ["k"], left_groups=["g"], right_groups=["h"], left_measures=["x"], right_measures=["y"], right_rows_bound=bound)
        cast = {c: F.col(c).cast("bigint") for c in ("n_rows", "count_x", "count_y", "sum_y")}
        assert rows(got.withColumns(cast), *plain.columns) == rows(plain, *plain.columns)
    empty = eager_join_aggregate(left.limit(0), right, ["k"], left_groups=["g"], left_measures=["x"])
    assert empty.count() == 0


def test_sums_beyond_a_bigint(spark):
    left = spark.createDataFrame([("a", 2**62)] * 3, "k string, x bigint").withColumn("x", F.when(F.col("x") > 0, F.lit(2**61)))
    right = spark.createDataFrame([("a",)] * 9, "k string")
    got = eager_join_aggregate(left, right, ["k"], left_measures=["x"]).first()
    assert int(got["sum_x"]) == 27 * 2**61 and int(got["n_rows"]) == 27


def test_once_per_id(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "a", 3), (2, None, 1), (None, "n", 1), (None, "n", 1)], "id int, a string, b int")
    assert rows(once_per_id(df, "id"), "id", "a", "b") == sorted([(1, "a", 3), (2, None, 1), (None, "n", 1), (None, "n", 1)], key=str)
    assert once_per_id(df.limit(0), "id").count() == 0


def test_unpivot(spark):
    df = spark.createDataFrame([("u", None, 1), (None, "b", 2), ("u", "b", 3)], "user string, item string, y int")
    assert rows(unpivot_keys(df, ["user", "item"], ["y"]), "field", "key_value", "y") == [("item", "b", 2), ("item", "b", 3), ("user", "u", 1), ("user", "u", 3)]
