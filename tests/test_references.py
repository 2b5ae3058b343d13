from datetime import datetime

import pytest

from minegrove.operators.references import Reference, orphan_references, why_orphaned

T = datetime


def at(year):
    return T(year, 1, 1)


def orphans(spark, refs, target, match="simple", keys=None, times=True, hot_share=0.01):
    r = spark.createDataFrame(refs, "id bigint, k string, t timestamp_ntz, extra string")
    x = spark.createDataFrame(target, "key string, f timestamp_ntz, e timestamp_ntz, extra string")
    ref = Reference("x", x, keys or {"k": "key"}, match, "f" if times else None, "e" if times else None)
    found = orphan_references(r, ref, row_id="id", at="t", hot_share=hot_share)
    return ref, found


def ids(df):
    return sorted(r["id"] for r in df.collect())


TARGET = [
    ("a", None, None, "z"),
    ("b", at(2010), at(2015), "z"),
    ("b", at(2017), None, None),
    ("c", None, at(2012), None),
    ("d", at(2010), None, None),
    ("d", at(2010), at(2011), None),
    (None, None, None, None),
]


def test_validity(spark):
    refs = [
        (1, "a", at(1990), "e"),
        (2, "b", at(2009), None),
        (3, "b", at(2010), None),  # from is included
        (4, "b", at(2015), None),  # to is excluded
        (5, "b", at(2018), None),
        (6, "c", at(2011), None),
        (7, "c", at(2012), None),
        (8, "d", at(2012), None),  # of rows with the same start the longer counts
        (9, "nobody", at(2012), None),
        (10, "nobody", None, None),
        (11, "b", None, None),  # no time: having the key is enough
        (12, None, at(2012), None),
        (9, "nobody", at(2012), None),
    ]
    ref, found = orphans(spark, refs, TARGET)
    assert ids(found) == [2, 4, 7, 9, 9, 10]
    kinds = {r["id"]: r["kind"] for r in why_orphaned(found, ref, at="t").collect()}
    assert kinds == {2: "later", 4: "deleted", 7: "deleted", 9: "missing", 10: "missing"}
    assert set(found.columns) == {"id", "k", "t", "extra", "ref_table"}


def test_hot_keys_are_spread_and_kept(spark):
    refs = [(i, "a" if i % 3 else "gone", at(2000), None) for i in range(300)]
    _, found = orphans(spark, refs, TARGET)
    assert ids(found) == [i for i in range(300) if i % 3 == 0]


def test_empty_sides(spark):
    assert ids(orphans(spark, [], TARGET)[1]) == []
    assert ids(orphans(spark, [(1, "a", None, None), (2, None, None, None)], [])[1]) == [1]


@pytest.mark.parametrize(
    ("match", "wanted"), [("simple", [5]), ("partial", [5, 7]), ("full", [2, 3, 4, 5, 7])]
)
def test_composite_keys_with_partial_nulls(spark, match, wanted):
    refs = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, "gone"), (5, "a", "y"), (6, None, None), (7, None, "never")],
        "id bigint, k1 string, k2 string",
    )
    target = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "gone")], "k1 string, k2 string")
    ref = Reference("t", target, {"k1": "k1", "k2": "k2"}, match)
    assert ids(orphan_references(refs, ref, row_id="id")) == wanted


def test_partial_match_uses_any_row_that_agrees(spark):
    refs = spark.createDataFrame([(1, None, "gone"), (2, None, "never")], "id bigint, k1 string, k2 string")
    target = spark.createDataFrame([(None, "gone")], "k1 string, k2 string")
    found = orphan_references(refs, Reference("t", target, {"k1": "k1", "k2": "k2"}, "partial"), row_id="id")
    assert ids(found) == [2]


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        orphans(spark, [], [], match="fuzzy")


def test_references_are_grouped_by_null_mask(spark):
    """Those with a time and those without are joined apart, each without a condition on nulls of its key."""
    refs = [(1, "b", at(2009), None), (2, "b", None, None), (3, "nobody", None, None), (4, None, None, None)]
    _, found = orphans(spark, refs, TARGET)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    anti = [line for line in text.splitlines() if "Join LeftAnti" in line]
    assert len(anti) == 2
    assert sum("_from" in line for line in anti) == 1
    assert not any("isnull(t#" in line for line in anti)
    assert ids(found) == [1, 3]


def test_composite_keys_with_times(spark):
    refs = spark.createDataFrame(
        [(1, "a", "x", at(2011)), (2, "a", None, at(2011)), (3, "a", None, at(2009)), (4, "a", "y", None), (5, "a", "x", None), (6, None, None, at(2011))],
        "id bigint, k1 string, k2 string, t timestamp_ntz",
    )
    target = spark.createDataFrame([("a", "x", at(2010), None)], "k1 string, k2 string, f timestamp_ntz, e timestamp_ntz")
    for match, wanted in (("simple", [4]), ("partial", [3, 4]), ("full", [2, 3, 4])):
        ref = Reference("t", target, {"k1": "k1", "k2": "k2"}, match, "f", "e")
        assert ids(orphan_references(refs, ref, row_id="id", at="t")) == wanted
