"""Whole jobs from files to reports."""

import csv
import json
import random

import pytest

from minegrove.__main__ import main, parser
from minegrove.jobs import JOBS


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def table_of(folder):
    rows = []
    for p in sorted(folder.glob("part-*")):
        rows += list(csv.DictReader(p.read_text().replace("\r", "\n").splitlines()))
    return rows


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("in"), random.Random(1)
    users, places = [f"u{i}" for i in range(20)], [f"b{i}" for i in range(8)]
    rated = {(u, b): float(rng.randrange(1, 6)) for u in users for b in places if rng.random() < 0.7}
    lines = [json.dumps({"user_id": u, "business_id": b, "stars": s, "date": f"201{rng.randrange(6, 9)}-01-01"}) for (u, b), s in rated.items()]
    (d / "review.json").write_text("\n".join(lines))
    (d / "business.json").write_text("\n".join(json.dumps({"business_id": b, "city": f"c{i % 3}", "stars": 3.0, "review_count": i}) for i, b in enumerate(places)))
    (d / "user.json").write_text("\n".join(json.dumps({"user_id": u, "review_count": i, "average_stars": 3.5}) for i, u in enumerate(users)))
    (d / "train.csv").write_text("user_id,business_id,stars\n" + "\n".join(f"{u},{b},{s}" for (u, b), s in rated.items()))
    (d / "pairs.csv").write_text("user_id,business_id\n" + "\n".join(f"{u},{b}" for u, b in rated))
    (d / "test.csv").write_text("user_id,business_id\nu1,b1\nu2,b2\nnew,b1\nu1,new\n")
    (d / "ids.txt").write_text("\n".join(users))
    (d / "points.csv").write_text("\n".join(f"{i},{i % 2},{rng.gauss(50 * (i % 2), 1)},{rng.gauss(0, 1)}" for i in range(200)))
    (d / "days.csv").write_text('"TRANSACTION_DT","CUSTOMER_ID","A","B","C","PRODUCT_ID"\n' + "\n".join(f'"1/{i % 5}","{i % 3}","x","y","z","{p:04d}"' for i in range(15) for p in (1, 2, i)))
    return d, rated


def run(spark, name, *arguments):
    main([name, *map(str, arguments)])


def test_exploration(spark, inputs, tmp_path):
    d, rated = inputs
    run(spark, "explore", d / "review.json", tmp_path / "a")
    report = json.loads(text_of(tmp_path / "a"))
    assert report["n_review"] == len(rated) and report["n_user"] == len({u for u, _ in rated})
    assert len(report["top_users"]) == 10 and report["top_users"][0][1] == str(max(sum(u == x for u, _ in rated) for x, _ in rated))
    run(spark, "partitions", d / "review.json", tmp_path / "b", "--buckets", 4)
    report = json.loads(text_of(tmp_path / "b"))
    assert sum(report["customized"]["n_items"]) == sum(report["default"]["n_items"]) == len(rated)
    assert report["customized"]["n_items"][ord("b") % 4] == len(rated)
    run(spark, "cities", d / "review.json", d / "business.json", tmp_path / "c")
    rows = table_of(tmp_path / "c")
    run(spark, "city-timings", d / "review.json", d / "business.json", tmp_path / "t")
    assert json.loads(text_of(tmp_path / "t"))["same"]
    assert len(rows) == 3 and sorted(rows, key=lambda r: -float(r["stars"])) == rows


def test_itemsets(spark, inputs, tmp_path):
    d, _ = inputs
    for case in (1, 2):
        run(spark, "frequent", d / "pairs.csv", tmp_path / f"f{case}", "--support", 6, "--case", case)
        lines = text_of(tmp_path / f"f{case}").splitlines()
        at = lines.index("Frequent Itemsets:")
        assert lines[0] == "Candidates:" and lines[1].startswith("('") and len(lines) > at + 1
        for own, more in zip(lines[at + 1 :], lines[1:at]):
            assert set(own.split("),(")) <= set(more.split("),(")) or set(own.strip("()").split("),(")) <= set(more.strip("()").split("),("))
    run(spark, "frequent-products", d / "days.csv", tmp_path / "p", "--support", 5, "--more-than", 1)
    assert "('1', '2')" in text_of(tmp_path / "p").rpartition("Frequent Itemsets:\n")[2].splitlines()


def test_predictions(spark, inputs, tmp_path):
    d, rated = inputs
    run(spark, "similar", d / "train.csv", tmp_path / "s", "--threshold", "2/5")
    assert all(float(r["similarity"]) >= 0.4 and r["business_id_1"] < r["business_id_2"] for r in table_of(tmp_path / "s"))
    run(spark, "predict-items", d / "train.csv", d / "test.csv", tmp_path / "i", "--corated", 3)
    run(spark, "predict-model", d / "train.csv", d / "test.csv", d / "user.json", d / "business.json", tmp_path / "m", "--trees", 2, "--depth", 2)
    run(spark, "predict-both", d / "train.csv", d / "test.csv", d / "user.json", d / "business.json", tmp_path / "h", "--corated", 3, "--trees", 2, "--depth", 2)
    for out in "imh":
        rows = table_of(tmp_path / out)
        assert len(rows) == 4 and all(0 <= float(r["prediction"]) <= 6 for r in rows)
    run(spark, "predict-items", d / "train.csv", d / "train.csv", tmp_path / "own", "--corated", 3)
    run(spark, "evaluate", tmp_path / "own", d / "train.csv", tmp_path / "e")
    assert json.loads(text_of(tmp_path / "e"))["n"] == len(rated)


def test_graphs(spark, inputs, tmp_path):
    d, _ = inputs
    run(spark, "propagate", d / "pairs.csv", tmp_path / "l", "--least", 5)
    run(spark, "betweenness", d / "pairs.csv", tmp_path / "b", tmp_path / "c", "--least", 5)
    scores = [float(line.rpartition(", ")[2]) for line in text_of(tmp_path / "b").splitlines()]
    assert scores and scores == sorted(scores, reverse=True)
    members = [set(line.split(", ")) for line in text_of(tmp_path / "c").splitlines()]
    other = [set(line.split(", ")) for line in text_of(tmp_path / "l").splitlines()]
    assert set.union(*members) == set.union(*other)


def test_streams(spark, inputs, tmp_path):
    d, _ = inputs
    run(spark, "bloom", d / "ids.txt", tmp_path / "b", "--batches", 5, "--size", 4)
    assert [r["Time"] for r in table_of(tmp_path / "b")] == list("01234")
    run(spark, "distinct", d / "ids.txt", tmp_path / "f", "--batches", 3)
    assert all(int(r["Ground Truth"]) == 20 and int(r["Estimation"]) > 0 for r in table_of(tmp_path / "f"))
    run(spark, "reservoir", d / "ids.txt", tmp_path / "r", "--batches", 4)
    assert [r["seqnum"] for r in table_of(tmp_path / "r")] == ["100", "200", "300", "400"]


def test_clusters(spark, inputs, tmp_path):
    d, _ = inputs
    run(spark, "bfr", d / "points.csv", tmp_path / "r", tmp_path / "a", "--clusters", 2)
    rows = {int(r["id"]): int(r["cluster"]) for r in table_of(tmp_path / "a")}
    assert len(rows) == 200 and len(table_of(tmp_path / "r")) == 5


def test_every_job_has_arguments():
    assert {a.dest for a in parser()._actions} >= {"job"}
    assert len(JOBS) == 17
