"""Readers and reports."""

import json

from pyspark.sql import functions as F

from minegrove import sinks
from minegrove.operators import relational as R
from minegrove.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = write(tmp_path / "r.json", '{"user_id":"u","business_id":"b","stars":4.0,"date":"2018-01-01"}\n{"user_id":"v"}\n')
    rows = files.json_lines(spark, p, files.REVIEWS).collect()
    assert (rows[0]["stars"], rows[1]["user_id"], rows[1]["stars"]) == (4.0, "v", None)


def test_headed_csv(spark, tmp_path):
    p = write(tmp_path / "p.csv", 'user_id,business_id\nu,b\n"q",b\n')
    assert [tuple(r) for r in files.headed_csv(spark, p, files.PAIRS).collect()] == [("u", "b"), ('"q"', "b")]


def test_quoted_transactions(spark, tmp_path):
    p = write(tmp_path / "t.csv", '"TRANSACTION_DT","CUSTOMER_ID","A","B","C","PRODUCT_ID"\n"11/1/2000","01","x","y","z","0047"\n')
    assert [tuple(r) for r in files.quoted_transactions(spark, p).collect()] == [("11/1/2000-01", 47)]


def test_points(spark, tmp_path):
    p = write(tmp_path / "x.csv", "3,1,0.5,-2\n")
    assert [tuple(r) for r in files.points_csv(spark, p).collect()] == [(3, 1, [0.5, -2.0])]


def test_sampled_batches(spark, tmp_path):
    lines = files.id_lines(spark, write(tmp_path / "ids.txt", "\n".join(f"u{i}" for i in range(50))))
    drawn = files.sampled_batches(lines, 4, 25, seed=1)
    rows = drawn.collect()
    assert len(rows) == 100 and {r["batch"] for r in rows} == {1, 2, 3, 4} and len({r["value"] for r in rows}) > 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, files.sampled_batches(lines, 4, 25, seed=1).collect()))
    assert files.sampled_batches(lines.limit(0), 4, 25).count() == 0


def test_partition_layout(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    rows = R.partition_rows(R.repartition_by_first_letter(df, "k", 5), 5).orderBy("partition").collect()
    want = [0] * 5
    want[ord("a") % 5] += 2
    want[ord("b") % 5] += 1
    want[0] += 1
    assert [r["n"] for r in rows] == want


def test_relational_edges(spark):
    empty = spark.createDataFrame([], "u string, b string, d string")
    assert tuple(R.review_summary(empty, user="u", item="b", date="d", year="2018").first()) == (0, 0, 0, 0)
    some = spark.createDataFrame([("u", None, "2018-1"), (None, "b", None), ("u", "b", "2017")], "u string, b string, d string")
    assert tuple(R.review_summary(some, user="u", item="b", date="d", year="2018").first()) == (3, 1, 2, 2)
    assert [tuple(r) for r in R.top_k(some, "u", 5).collect()] == [("u", 2), (None, 1)]
    truth = some.select("u", F.lit(3.0).alias("a")).where("u is not null").distinct()
    report = R.error_report(truth.withColumn("p", F.lit(1.5)), truth, ["u"], predicted="p", actual="a").first()
    assert (report["n"], report["rmse"], report["from_1"]) == (1, 1.5, 1)
    assert R.error_report(truth.withColumn("p", F.lit(1.5)).limit(0), truth, ["u"], predicted="p", actual="a").first()["rmse"] is None


def test_average_by_group(spark):
    facts = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 4.0), ("c", 5.0), (None, 9.0)], "k string, v double")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", None)], "k string, g string")
    got = [tuple(r) for r in R.average_by_group(facts, groups, key="k", value="v", group="g").collect()]
    assert got == [("", 5.0), ("x", 3.0)]


def test_reports(spark, tmp_path):
    top = spark.createDataFrame([("u", 3), ("v", 2)], "k string, n int").coalesce(1)
    one = spark.createDataFrame([(7,)], "n int")
    report = json.loads(sinks.json_report(count=one, top=top).first()["value"])
    assert report == {"count": 7, "top": [["u", "3"], ["v", "2"]]}
    itemsets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["b", "a"], 2)], "items array<string>, size int")
    assert [r["line"] for r in sinks.itemset_lines(itemsets).collect()] == ["('a'),('b')", "('a', 'b')"]
    groups = spark.createDataFrame([(2, ["a", "b"]), (1, ["z"])], "size int, members array<string>")
    assert [r["line"] for r in sinks.community_lines(groups).collect()] == ["'z'", "'a', 'b'"]
    scored = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double")
    assert [r["line"] for r in sinks.betweenness_lines(scored).collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]
    held = spark.createDataFrame([(1, 0, "x", 100), (1, 20, "y", 100)], "batch int, slot int, value string, n int")
    assert tuple(sinks.reservoir_lines(held, (0, 20)).first()) == (100, "x", "y")
    sinks.write_csv(scored, str(tmp_path / "out"), line_end="\r", one_file=True)
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_bytes() == b"src,dst,betweenness\ra,b,1.0\ra,c,2.5\r"
    sinks.write_lines(sinks.betweenness_lines(scored), str(tmp_path / "lines"), one_file=True)


def test_dense_index(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("Z", 5), ("c", 6)], "value string, index int").repartition(4)
    got = {r["value"]: r["index"] for r in R.dense_index(df, "value").collect()}
    assert got == {"Z": 0, "a": 1, "b": 2, "c": 3}
    many = spark.range(0, 5000, 1, 7).selectExpr("id * 3 as v")
    assert all(r["value"] == 3 * r["index"] for r in R.dense_index(many, "v").collect())
    assert R.dense_index(df.limit(0), "value").count() == 0


def test_itemset_report(spark):
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "items array<string>, size int")
    lines = [r["line"] for r in sinks.itemset_report(sets, sets.where("size = 1")).collect()]
    assert lines == ["Candidates:", "('a'),('b')", "('a', 'b')", "Frequent Itemsets:", "('a'),('b')"]
