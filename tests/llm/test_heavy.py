import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minegrove.llm.heavy import Summary, frequent_values, summarise


def check(summary, counts, k):
    n = sum(counts.values())
    assert summary.n == n
    assert summary.error <= n / (k + 1)
    held = dict(zip(summary.items.to_pylist(), summary.lower.to_pylist(), strict=True))
    assert len(held) <= k
    for item, n in counts.items():
        low = held.get(item, 0)
        assert low <= n <= low + summary.error


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijk") | st.none(), max_size=40), max_size=6), st.integers(1, 6))
def test_bounds_hold_however_summaries_are_merged(parts, k):
    made = []
    for part in parts:
        own = Summary(k)
        for at in range(0, len(part), 7):
            own.add(pa.array(part[at : at + 7], pa.string()))
        made.append((own, Counter(x for x in part if x is not None)))
        check(*made[-1], k)
    while len(made) > 1:
        (a, ca), (b, cb) = made.pop(), made.pop()
        a.merge(b.items, b.lower, b.n, b.error)
        made.insert(0, (a, ca + cb))
        check(a, ca + cb, k)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [("hot" if rng.random() < 0.3 else f"v{int(rng.paretovariate(0.6)) % 5000}", f"w{rng.randrange(4000)}" if rng.random() < 0.9 else None) for _ in range(20_000)]
    return out


def test_frequent_values(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string").repartition(13).withColumn("n", F.lit("clash"))
    got = {(r["field"], r["key_value"]): r for r in frequent_values(df, ["a", "b"], (1, 100), k=150).collect()}
    want = {}
    for i, f in enumerate("ab"):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        want |= {(f, v): (n, counts.total()) for v, n in counts.items() if n * 100 >= counts.total()}
    assert {k: (r["n"], r["total"]) for k, r in got.items()} == want
    assert all(r["lower"] <= r["n"] <= r["upper"] for r in got.values())


def test_one_summary_a_field(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string").repartition(20)
    made = {r["field"]: r for r in summarise(df, ["a", "b"], 50, fan_in=2).collect()}
    assert set(made) == {"a", "b"} and made["a"]["n"] == len(rows)
    assert all(len(r["items"]) <= 50 for r in made.values())


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "a string, b string")
    assert [(r["field"], r["key_value"], r["n"]) for r in frequent_values(df, ["a", "b"]).collect()] == [("b", "x", 2)]
    assert frequent_values(df.limit(0), ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        frequent_values(df, ["a"], (1, 100), k=100)


def test_ties_at_the_threshold(spark):
    df = spark.createDataFrame([(f"v{i % 100}",) for i in range(1000)], "a string")
    assert frequent_values(df, ["a"], (1, 100), k=500).count() == 100
