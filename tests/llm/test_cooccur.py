import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest

from minegrove.llm.cooccur import basket_items, collapse_baskets, pair_counts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(f"u{u}", f"b{min(rng.randrange(14), rng.randrange(14))}") for u in range(150) for _ in range(rng.randrange(1, 9))]
    out += [("hot", f"b{i}") for i in range(40)] * 5  # one basket with a third of the rows
    return out + out[:30] + [(None, "b1"), ("u1", None)]


def brute(rows, min_count, share, lift):
    baskets = {}
    for u, b in rows:
        if u is not None and b is not None:
            baskets.setdefault(u, set()).add(b)
    n, single, both = len(baskets), Counter(), Counter()
    for s in baskets.values():
        single.update(s)
        both.update(combinations(sorted(s), 2))
    return {
        p: (single[p[0]], single[p[1]], k, n)
        for p, k in both.items()
        if k >= min_count and k >= share * n and k * n >= lift * single[p[0]] * single[p[1]]
    }


@pytest.mark.parametrize(("block", "array_limit"), [(3, 10_000), (512, 10_000), (3, 6)])
@pytest.mark.parametrize(("least", "share", "lift"), [(1, 0, 0), (5, Fraction(5, 1000), Fraction(3, 2)), (2, 0.05, 1.0)])
def test_pair_counts(spark, rows, block, array_limit, least, share, lift):
    df = spark.createDataFrame([(u, b, 1, "x") for u, b in rows], "u string, b string, n1 int, basket string")
    got = pair_counts(df, "u", "b", min_count=least, min_share=share, min_lift=lift, block=block, array_limit=array_limit).collect()
    want = brute(rows, least, Fraction(str(share)), Fraction(str(lift)))
    assert {(r["item_1"], r["item_2"]): (r["n1"], r["n2"], r["n12"], r["baskets"]) for r in got} == want
    for r in got:
        assert r["lift"] == pytest.approx(r["n12"] * r["baskets"] / (r["n1"] * r["n2"]))
        if r["n12"] == r["n1"]:
            assert r["conviction"] is None
        else:
            assert r["conviction"] == pytest.approx((1 - r["n2"] / r["baskets"]) / (1 - r["n12"] / r["n1"]))


def test_collapsing_keeps_the_weight(spark, rows):
    df = spark.createDataFrame(rows, "u string, b string")
    collapsed = collapse_baskets(basket_items(df, "u", "b")).collect()
    assert sum(r["weight"] for r in collapsed) == len({u for u, b in rows if u and b})
    assert len({tuple(r["items"]) for r in collapsed}) == len(collapsed)


def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "u string, b string").limit(0)
    assert pair_counts(df, "u", "b", min_share=0.01).count() == 0
