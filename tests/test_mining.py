"""Itemsets, similar sets and predictions against brute force."""

import random
from fractions import Fraction
from itertools import combinations

import pytest

from minegrove.operators import itemsets as I
from minegrove.operators import recommend as C
from minegrove.operators import similarity as S
from minegrove.plans import mining, views


def random_pairs(seed, ids=25, tokens=12, hot=True):
    rng = random.Random(seed)
    rows = [(f"s{i}", f"t{rng.randrange(tokens)}") for i in range(ids) for _ in range(rng.randrange(1, 8))]
    if hot:
        rows += [(f"s{i}", "t0") for i in range(ids)]
    return rows


def sets_of(rows):
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b)
    return out


@pytest.fixture(scope="module")
def rows():
    return random_pairs(1)


def frame(spark, rows):
    return spark.createDataFrame(rows + [(None, "t1"), ("s1", None)] + rows[:5], "id string, token string")


def test_frequent_itemsets(spark, rows):
    sets = sets_of(rows)
    for support in (3, 6):
        want = {}
        for size in range(1, 8):
            for c in combinations(sorted({t for s in sets.values() for t in s}), size):
                n = sum(set(c) <= s for s in sets.values())
                if n >= support:
                    want[c] = n
        pairs = I.baskets(frame(spark, rows), "id", "token")
        got = {tuple(r["items"]): r["n"] for r in I.frequent_itemsets(pairs, support).collect()}
        assert got == want
        two = {tuple(r["items"]) for r in I.frequent_itemsets(pairs, support, max_size=2).collect()}
        assert two == {c for c in want if len(c) <= 2}
        son = {tuple(r["items"]) for r in I.son_candidates(pairs, support, len(sets)).collect()}
        assert son >= {c for c in want if len(c) <= 3}


def test_son_candidates_of_any_size(spark):
    rng = random.Random(7)
    sets = {f"s{i}": {f"t{t}" for t in range(8) if rng.random() < 0.8} | {f"t{rng.randrange(8, 20)}"} for i in range(200)}
    pairs = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s], "basket string, item string")
    items = sorted({i for s in sets.values() for i in s})
    want = {c for k in range(1, 8) for c in combinations(items, k) if sum(s.issuperset(c) for s in sets.values()) >= 40}
    assert max(map(len, want)) > 4
    made = I.son_candidates(pairs, 40, len(sets), per_part=50)
    got = {tuple(r["items"]): r["size"] for r in made.collect()}
    assert made.count() == len(got) and set(got) >= want
    assert all(len(c) == size and list(c) == sorted(set(c)) for c, size in got.items())
    capped = {tuple(r["items"]) for r in I.son_candidates(pairs, 40, len(sets), max_size=2, per_part=50).collect()}
    assert capped == {c for c in got if len(c) <= 2}


def test_son_query_holds_the_frequent_sets(spark, data):
    pairs = mining._small_baskets(spark, data)
    support = -(-pairs.select("basket").distinct().count() * mining.SUPPORT_PERCENT // 100)
    want = {tuple(r["items"]) for r in I.frequent_itemsets(pairs, support).collect()}
    assert max(map(len, want)) > 3
    assert {tuple(r["items"]) for r in mining.son_candidates(spark, data).collect()} >= want


def test_frequent_itemsets_against_brute_force(spark, data, duck):
    ids = ", ".join(map(views.sql_id, ("user_id", "business_id")))
    sets = sets_of(r for r in duck.sql(f"select {ids} from small2").fetchall() if None not in r)
    least = -(-len(sets) * mining.SUPPORT_PERCENT // 100)
    items = sorted({i for s in sets.values() for i in s})
    want, level = {}, [()]
    while level:
        longer = [(*c, i) for c in level for i in items if not c or i > c[-1]]
        counts = {c: sum(s.issuperset(c) for s in sets.values()) for c in longer}
        level = [c for c, n in counts.items() if n >= least]
        want |= {c: counts[c] for c in level}
    assert max(map(len, want)) > 3
    got = mining.frequent_itemsets(spark, data).collect()
    assert len(got) == len(want)
    assert {tuple(r["items"]): r["n"] for r in got} == want


def test_no_frequent_itemsets(spark, rows):
    pairs = I.baskets(frame(spark, rows), "id", "token")
    assert I.frequent_itemsets(pairs, 1000).count() == 0
    assert I.frequent_itemsets(pairs.limit(0), 1).count() == 0


def test_baskets_are_filtered(spark, rows):
    got = {r["basket"] for r in I.baskets(frame(spark, rows), "id", "token", more_than=3).collect()}
    assert got == {b for b, s in sets_of(rows).items() if len(s) > 3}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_overlap_pairs(spark, rows, least):
    sets = sets_of(rows)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    pairs = S.distinct_pairs(frame(spark, rows), "id", "token")
    assert {(r[0], r[1]): r[2] for r in S.overlap_pairs(pairs, least).collect()} == want


def test_lsh_finds_only_similar_pairs(spark, rows):
    sets = sets_of(rows)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    pairs = S.distinct_pairs(frame(spark, rows), "id", "token")
    signed = S.minhash_signatures(pairs)
    found = S.verify_jaccard(S.lsh_candidates(signed, 10, 2), pairs, Fraction(1, 2))
    got = {(r["id_1"], r["id_2"]) for r in found.collect()}
    assert got <= want
    equal = {(a, b) for a, b in want if sets[a] == sets[b]}
    assert equal <= got
    wanted = spark.createDataFrame(sorted(want), "id_1 string, id_2 string")
    assert S.recall(found, wanted, ["id_1", "id_2"]) >= 0.9


def test_predictions(spark):
    rng = random.Random(3)
    rated = {(f"u{rng.randrange(12)}", f"i{rng.randrange(6)}"): float(rng.randrange(1, 6)) for _ in range(60)}
    ratings = spark.createDataFrame([(u, i, s) for (u, i), s in rated.items()], "user string, item string, stars double")
    users = {u for u, _ in rated}
    items = sorted({i for _, i in rated})
    weight = {}
    for a, b in combinations(items, 2):
        both = [u for u in users if (u, a) in rated and (u, b) in rated]
        if len(both) < 3:
            continue
        x, y = [rated[u, a] for u in both], [rated[u, b] for u in both]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        sxy = sum((p - mx) * (q - my) for p, q in zip(x, y))
        sxx, syy = sum((p - mx) ** 2 for p in x), sum((q - my) ** 2 for q in y)
        weight[a, b] = sxy / (sxx * syy) ** 0.5 if sxx and syy else 0.0
    made = C.pearson(ratings, C.corated_items(ratings, 3))
    got = {(r["item_1"], r["item_2"]): r["weight"] for r in made.collect()}
    assert got == pytest.approx(weight)
    wanted = [("u0", i) for i in items] + [("new", "i0"), ("u0", "new"), ("new", "new"), ("u0", "i0")]
    predicted = C.predict_by_items(ratings, spark.createDataFrame(wanted, "user string, item string"), made, neighbours=2, default=2.5)
    result = {(r["user"], r["item"]): r["prediction"] for r in predicted.collect()}
    assert len(result) == len(set(wanted))

    def mean(values):
        values = list(values)
        return sum(values) / len(values) if values else None

    for u, i in set(wanted):
        um, im = mean(s for (a, _), s in rated.items() if a == u), mean(s for (_, b), s in rated.items() if b == i)
        near = sorted((-(weight.get((i, o), weight.get((o, i), 0.0))), o) for o in items if (u, o) in rated and o != i)
        near = [(-w, o) for w, o in near if -w > 1e-9][:2]
        if um is None or im is None:
            want = next(x for x in (um, im, 2.5) if x is not None)
        else:
            want = sum(w * rated[u, o] for w, o in near) / sum(w for w, _ in near) if near else im
        assert result[u, i] == pytest.approx(want), (u, i)


def test_trees_and_blend(spark):
    rng = random.Random(5)
    rows = [(f"u{k}", f"i{k % 9}", float(1 + (k % 9) % 5), k % 9, float(1 + (k % 9) % 5), 1, 3.0) for k in range(200)]
    rng.shuffle(rows)
    columns = "user string, item string, stars double, user_reviews int, user_stars double, item_reviews int, item_stars double"
    train = spark.createDataFrame(rows, columns)
    predicted = C.predict_by_trees(train, train.drop("stars"), depth=3, trees=5)
    joined = predicted.join(train.select("user", "item", "stars"), ["user", "item"]).collect()
    assert sum((r["prediction"] - r["stars"]) ** 2 for r in joined) / len(joined) < 0.1
    one = spark.createDataFrame([("u", "i", 4.0, 1), ("v", "i", 2.0, 4)], "user string, item string, prediction double, rated int")
    two = spark.createDataFrame([("u", "i", 1.0), ("v", "i", 1.0)], "user string, item string, prediction double")
    assert {r["user"]: r["prediction"] for r in C.blend(one, two).collect()} == {"u": 1.75, "v": 2.0}
