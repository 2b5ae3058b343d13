"""Sketches: the relational form against sequential algorithms, and the live form against both."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from minegrove.functions.hashing import bytes_modulo, coefficients
from minegrove.operators import sketches as K
from minegrove.streaming import live


def number(value, prime):
    return int.from_bytes(value.encode(), "big") % prime


def hashes(value, prime, slots, functions):
    x = number(value, prime)
    return [((a % prime * x + b % prime) % prime) % slots for a, b in coefficients(functions)]


@pytest.fixture(scope="module")
def elements():
    rng = random.Random(11)
    return [(1 + i // 20, i + 1, f"user-{rng.randrange(60)}é") for i in range(300)]


@pytest.fixture(scope="module")
def stream(spark, elements):
    return spark.createDataFrame(elements, "batch bigint, seq bigint, value string").cache()


def test_bytes_modulo(spark):
    values = ["", "a", "a-very-long-identifier-of-more-than-22-bytes", "é漢字", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(bytes_modulo("v", 114_514)).collect()]
    assert got == [None if v is None else number(v, 114_514) for v in values]


def sequential_bloom(elements, prime, slots, functions):
    bits, users, out = set(), set(), {}
    for batch in sorted({b for b, _, _ in elements}):
        fp = tn = 0
        own = [v for b, _, v in elements if b == batch]
        for v in own:
            if all(h in bits for h in hashes(v, prime, slots, functions)):
                fp += v not in users
            else:
                tn += 1
        for v in own:
            bits.update(hashes(v, prime, slots, functions))
            users.add(v)
        out[batch] = (fp, tn, fp / (fp + tn) if fp + tn else None)
    return out


@pytest.mark.parametrize("slots", [97, 997, 69_997])
def test_bloom(stream, elements, slots):
    got = {r["batch"]: (r["fp"], r["tn"], r["fpr"]) for r in K.bloom_rates(stream, slots=slots).collect()}
    assert got == sequential_bloom(elements, 114_514, slots, 7)


def test_distinct_estimates(stream, elements):
    want = {}
    for batch in {b for b, _, _ in elements}:
        own = {v for b, _, v in elements if b == batch}
        highest = [0] * 7
        for v in own:
            for i, h in enumerate(hashes(v, 69_997, 1_919, 7)):
                zeros = 3 if h == 0 else len(bin(h)) - len(bin(h).rstrip("0"))
                highest[i] = max(highest[i], zeros)
        want[batch] = (len(own), round(sum(2**r for r in highest) / 7))
    got = {r["batch"]: (r["truth"], r["estimate"]) for r in K.distinct_estimates(stream).collect()}
    assert got == want


def py_draw(seq, salt):
    once = (seq % 2**31 * 1_103_515_245 + 12_345 + salt) % 2**31
    return (once // 65_536 * 22_695_477 + once % 65_536 * 69_069 + 1) % 2**31


def sequential_reservoir(elements, size):
    held, out = {}, {}
    for b, n, v in elements:
        if n <= size:
            held[n - 1] = v
        elif py_draw(n, 1) % n < size:
            held[py_draw(n, 2) % size] = v
        out[b] = (n, dict(held))
    return {(b, s): (v, n) for b, (n, slots) in out.items() for s, v in slots.items()}


def test_reservoir(stream, elements):
    for size in (10, 50):
        got = {(r["batch"], r["slot"]): (r["value"], r["n"]) for r in K.reservoir(stream, size).collect()}
        assert got == sequential_reservoir(elements, size)


def test_reservoir_is_fair():
    hits = [0] * 1000
    for n in range(1, 100_001):
        if n > 100 and py_draw(n, 1) % n < 100:
            hits[py_draw(n, 2) % 100] += 1
    expected = sum(100 / n for n in range(101, 100_001))
    assert sum(hits) == pytest.approx(expected, rel=0.15)
    assert max(hits[:100]) < 4 * expected / 100


def test_live_forms_give_the_same_rows(spark, stream, elements, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "batch bigint, seq bigint, value string"
    for b in sorted({b for b, _, _ in elements}):
        part = tmp_path / f"b{b}"
        stream.where(F.col("batch") == b).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        shutil.copy(file, source / f"{b:04d}.parquet")

    def run(function):
        query = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
            .writeStream.foreachBatch(function).option("checkpointLocation", str(tmp_path / f"c{id(function)}")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)

    out = {"bloom": [], "fm": [], "reservoir": []}
    run(live.bloom_batch(str(tmp_path / "bloom"), lambda df, _: out["bloom"].extend(df.collect()), every=4))
    run(live.distinct_batch(lambda df, _: out["fm"].extend(df.collect())))
    run(live.reservoir_batch(str(tmp_path / "res"), lambda df, _: out["reservoir"].extend(df.collect()), size=10))
    key = lambda r: tuple(map(str, r))
    assert sorted(out["bloom"], key=key) == sorted(K.bloom_rates(stream, **K.BLOOM).collect(), key=key)
    assert sorted(out["fm"], key=key) == sorted(K.distinct_estimates(stream).collect(), key=key)
    got = {(r["batch"], r["slot"]): (r["value"], r["n"]) for r in out["reservoir"]}
    assert got == sequential_reservoir(elements, 10)


def test_compacted_state(spark, tmp_path):
    grown = live._Grown(spark, str(tmp_path / "g"), "value string", 3)
    seen = set()
    for batch in range(10):
        assert {r["value"] for r in grown.before(batch).collect()} == seen
        own = spark.createDataFrame([(f"v{batch}",)], "value string")
        grown.add(own, batch)
        grown.add(own, batch)  # a batch may be run again
        assert {r["value"] for r in grown.before(batch).collect()} == seen
        seen |= {f"v{batch}"}
    kept = sorted(p.name for p in (tmp_path / "g").iterdir())
    assert kept == ["batch=6", "batch=7", "batch=8", "batch=9", "upto=6", "upto=9"]


def test_empty_stream(stream):
    empty = stream.limit(0)
    assert K.bloom_rates(empty).count() == K.distinct_estimates(empty).count() == K.reservoir(empty).count() == 0
