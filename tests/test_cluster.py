import numpy as np
import pytest

from minegrove.operators import cluster as B


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [40, 0, 0], [0, 40, 0]])
    rows = [(i, i % 3, [float(x) for x in centres[i % 3] + rng.normal(0, 1, 3)]) for i in range(900)]
    rows += [(1000 + i, -1, [500.0 + 90 * i, -300.0 * i, 700.0]) for i in range(3)]
    return spark.createDataFrame(rows, "id bigint, truth int, features array<double>").cache()


def test_summaries(spark, points):
    got = {r["label"]: r for r in B.summaries(points, "truth").collect()}
    for label in (0, 1, 2):
        x = np.array([r["features"] for r in points.where(f"truth = {label}").collect()])
        assert got[label]["n"] == len(x)
        assert np.allclose(got[label]["sum"], x.sum(0)) and np.allclose(got[label]["sumsq"], (x**2).sum(0))
    nulls = spark.createDataFrame([(None, [1.0]), (1, None)], "label int, features array<double>")
    assert B.summaries(nulls, "label").count() == 0


def test_distance():
    c = B.Cluster(2, np.array([2.0, 4.0]), np.array([4.0, 8.0]))  # points (0, 2) and (2, 2)
    assert B.distances(np.array([[3.0, 2.0]]), c)[0] == pytest.approx(2.0)
    assert np.isinf(B.distances(np.array([[1.0, 2.5]]), c)[0])
    wide = B.Cluster(2, np.array([0.0]), np.array([8.0]))
    assert B.distances(np.array([[4.0]]), wide, by_variance=True)[0] == pytest.approx(1.0)


def test_bfr(spark, points):
    made = B.bfr(points.withColumnRenamed("truth", "extra"), 3, least=5)
    assigned = {r["id"]: r["cluster"] for r in made.assignments.collect()}
    assert len(assigned) == points.count()
    truth = {r["id"]: r["truth"] for r in points.collect()}
    for label in (0, 1, 2):
        own = [assigned[i] for i, t in truth.items() if t == label]
        most = max(set(own), key=own.count)
        assert own.count(most) > 0.9 * len(own)
    assert all(assigned[i] == -1 for i, t in truth.items() if t == -1)
    last = made.rounds.orderBy("round").collect()[-1]
    assert last["ds_points"] + last["cs_points"] + last["rs_points"] == points.count()
    assert sum(c >= 0 for c in assigned.values()) == last["ds_points"]


def test_bfr_of_little(spark, points):
    assert B.bfr(points.limit(0), 3).assignments.count() == 0
    assert B.bfr(points.limit(2), 3).assignments.count() == 2


def test_summaries_with_nulls_and_two_labels(spark):
    rows = [("a", 1, [1.0, None]), ("a", 1, [2.0, 3.0]), ("b", 1, [4.0, 5.0]), ("b", None, [9.0, 9.0]), ("a", 1, None)]
    df = spark.createDataFrame(rows, "kind string, label int, features array<double>")
    got = {(r["kind"], r["label"]): (r["n"], r["sum"], [round(x, 9) for x in r["sumsq"]]) for r in B.summaries(df, ["kind", "label"]).collect()}
    assert got == {("a", 1): (2, [3.0, 3.0], [5.0, 9.0]), ("b", 1): (1, [4.0, 5.0], [16.0, 25.0])}
    assert B.summaries(df.limit(0), "label").count() == 0


def test_nearest(spark):
    clusters = {3: B.Cluster(2, np.array([0.0]), np.array([2.0])), 5: B.Cluster(2, np.array([20.0]), np.array([202.0]))}
    df = spark.createDataFrame([(1, [0.5]), (2, [9.5]), (3, [5.0]), (4, [500.0])], "id int, features array<double>")
    assert {r["id"]: r["label"] for r in B.nearest(df, clusters, 6.0).collect()} == {1: 3, 2: 5, 3: 3, 4: None}
    assert {r["label"] for r in B.nearest(df, {}, 6.0).collect()} == {None}


def test_mergers_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    clusters = {}
    for i in range(14):
        x = rng.normal(rng.integers(0, 4) * 6, 1, (5, 2))
        clusters[i] = B.Cluster(5, x.sum(0), (x**2).sum(0))
    plain, fresh = dict(clusters), 14
    while True:
        near = []
        for a in sorted(plain):
            for b in sorted(plain):
                if a < b:
                    d = min(B.distances(plain[a].centre[None], plain[b])[0], B.distances(plain[b].centre[None], plain[a])[0])
                    if d < 2.5:
                        near.append((d, a, b))
        if not near:
            break
        _, a, b = min(near)
        plain[fresh] = plain.pop(a).plus(plain.pop(b))
        fresh += 1
    own = dict(clusters)
    became, last = B._Mergers(2.5, False).merge(own, set(), 14)
    assert set(own) == set(plain) and last == fresh and set(became) == set(range(fresh)) - set(plain)
