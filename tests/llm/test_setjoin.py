import random
from fractions import Fraction
from functools import partial
from itertools import combinations

import pytest

from minegrove.llm import queries
from minegrove.llm.setjoin import SimilarSets, meetings, needed_overlap, small_limit


def sets_of(rows):
    out = {}
    for a, b in rows:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    return out


def similar(a, b, t):
    return len(a & b) * t.denominator >= len(a | b) * t.numerator


def random_rows(seed, ids=60):
    """Sets of many sizes, with near copies, exact copies, a token that nearly all have, and one huge set."""
    rng = random.Random(seed)
    sets = []
    for _ in range(ids):
        if sets and rng.random() < 0.6:
            base = set(rng.choice(sets))
            for _ in range(rng.randrange(3)):
                base.discard(rng.choice(sorted(base))) if len(base) > 1 and rng.random() < 0.5 else base.add(f"t{rng.randrange(90)}")
        else:
            base = {f"t{rng.randrange(90)}" for _ in range(rng.choice([1, 2, 5, 5, 6, 7, 8, 9, 12, 20]))}
        if rng.random() < 0.7:
            base.add("hot")
        sets.append(base)
    sets.append({f"t{i}" for i in range(90)})
    sets.append({f"t{i}" for i in range(88)} | {"hot"})
    rows = [(f"s{i}", t) for i, s in enumerate(sets) for t in s]
    rows += rows[:40] + [(None, "t1"), ("s1", None), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "b string, u string, side string, tokens int")


@pytest.mark.parametrize(
    ("seed", "threshold", "least", "limit"),
    [(1, Fraction(1, 2), 5, 10**6), (2, Fraction(4, 5), 1, 10**6), (1, Fraction(1, 3), 2, 25)],
)
def test_within_one_table(spark, seed, threshold, least, limit):
    rows = random_rows(seed)
    sets = {k: s for k, s in sets_of(rows).items() if len(s) >= least}
    want = {
        (a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))
        for a, b in combinations(sorted(sets), 2)
        if similar(sets[a], sets[b], threshold)
    }
    made = SimilarSets(frame(spark, rows), "b", "u", threshold=threshold, min_size=least, array_limit=limit)
    got = made.pairs().collect()
    assert len(got) == len({(r["id_1"], r["id_2"]) for r in got})
    assert {(r["id_1"], r["id_2"]): (r["overlap"], r["size_1"], r["size_2"]) for r in got} == want
    classes = {r["id"]: r["class_id"] for r in made.classes().collect()}
    assert set(classes) == set(sets)
    for a, b in combinations(sorted(classes), 2):
        assert (classes[a] == classes[b]) == (sets[a] == sets[b])


def test_between_two_tables(spark):
    one, two = random_rows(3, 40), random_rows(4, 40)
    a, b = sets_of(one), sets_of(two)
    want = {(x, y) for x in a for y in b if len(a[x]) >= 2 and len(b[y]) >= 2 and similar(a[x], b[y], Fraction(1, 2))}
    for limit in (10**6, 20):
        made = SimilarSets(frame(spark, one), "b", "u", frame(spark, two), threshold=Fraction(1, 2), min_size=2, array_limit=limit)
        got = [(r["id_1"], r["id_2"]) for r in made.pairs().collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


@pytest.mark.parametrize("limit", [6, 25])
def test_classes_and_links_of_giants(spark, limit):
    rows = random_rows(1)
    rows += [("copy", t) for b, t in rows if b == "s60"]
    sets = {k: s for k, s in sets_of(rows).items() if len(s) >= 5}
    made = SimilarSets(frame(spark, rows), "b", "u", min_size=5, array_limit=limit)
    got = {r["id"]: (r["size"], r["class_id"]) for r in made.classes().collect()}
    least = {a: min(b for b in sets if sets[b] == sets[a]) for a in sets}
    assert got == {k: (len(s), least[k]) for k, s in sets.items()}
    links = [(r["id_1"], r["id_2"], r["overlap"], r["size_1"], r["size_2"]) for r in made.links().collect()]
    want = {
        (a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))
        for a, b in combinations(sorted(set(least.values())), 2)
        if similar(sets[a], sets[b], Fraction(1, 2))
    }
    assert len(links) == len(want) and set(links) == want


def test_classes_of_giants_in_two_tables(spark):
    rows = random_rows(3, 40) + [("copy", f"t{i}") for i in range(90)]
    made = SimilarSets(frame(spark, rows), "b", "u", frame(spark, rows), min_size=2, array_limit=20)
    sets = {k: s for k, s in sets_of(rows).items() if len(s) >= 2}
    want = {(side, a, min(b for b in sets if sets[b] == sets[a])) for side in (0, 1) for a in sets}
    assert {(r["side"], r["id"], r["class_id"]) for r in made.classes().collect()} == want


def test_p2_classes_has_giants(spark, data, monkeypatch):
    want = sorted(queries.p2_classes(spark, data).collect())
    monkeypatch.setattr(queries, "SimilarSets", partial(SimilarSets, array_limit=12))
    assert sorted(queries.p2_classes(spark, data).collect()) == want


def test_empty(spark):
    made = SimilarSets(frame(spark, []), "b", "u", threshold=Fraction(1, 2), min_size=5)
    assert made.pairs().count() == made.classes().count() == made.links().count() == 0
    with pytest.raises(ValueError):
        SimilarSets(frame(spark, []), "b", "u", threshold=Fraction(0))


def test_limits():
    assert needed_overlap(5, 5, Fraction(1, 2)) == 4
    assert needed_overlap(5, 10, Fraction(1, 2)) == 5
    assert small_limit(5, Fraction(1, 2), 70) == (4, 8)


@pytest.mark.parametrize(("least", "threshold"), [(5, Fraction(1, 2)), (1, Fraction(4, 5)), (1, Fraction(1, 2)), (2, Fraction(1, 3)), (3, Fraction(1))])
def test_sizes_meet_on_the_overlap_they_need(least, threshold):
    _, limit = small_limit(least, threshold, 70)
    met = meetings(least, limit, threshold)
    for a in range(least, limit + 1):
        for b in range(a, limit + 1):
            need = needed_overlap(a, b, threshold)
            shared = [m.overlap for m in met if (a in m.left and b in m.right) or (b in m.left and a in m.right)]
            assert (need in shared) == (need <= a)
            assert all(n >= need for n in shared)


def test_common_subsets_list_no_pair_in_vain(spark):
    """Four tokens that all sets have make no candidates of sets that need more."""
    rows = [(f"s{i}", t) for i in range(200) for t in ("w", "x", "y", "z", *(f"{i}-{j}" for j in range(4)))]
    made = SimilarSets(frame(spark, rows), "b", "u", min_size=5)
    assert made._by_subset().count() == 0 and made.pairs().count() == 0
