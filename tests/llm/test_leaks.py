import random

from hypothesis import given, settings
from hypothesis import strategies as st

from minegrove.llm.leaks import Items, anchors, automaton_of, build, find_leaks, normalise, normalise_with_offsets, runs_in


def brute(text, items, length):
    out = {}
    for i, item in enumerate(items):
        best = 0
        for s in range(len(text)):
            for t in range(len(item)):
                n = 0
                while s + n < len(text) and t + n < len(item) and text[s + n] == item[t + n]:
                    n += 1
                best = max(best, n)
        if best >= length:
            out[i] = best
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=60), st.lists(st.text("ab", max_size=40), max_size=3), st.integers(1, 12))
def test_runs(text, items, length):
    block = Items(tuple(range(len(items))), tuple(items))
    found = runs_in(text, build(block, length), block, length)
    assert {i: r[0][0] for i, r in found.items()} == brute(text, items, length)
    for i, runs in found.items():
        for n, at in runs:
            assert text[at : at + n] in items[i]


def test_every_run_holds_an_anchor():
    for length in range(1, 80):
        size, stride = anchors(length)
        assert size + stride - 1 <= length and size >= 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=50) | st.text("eéèÀ̂́ ﬁⅣ①ｆＡİΣς각ᄀ​­한", max_size=20))
def test_offsets(text):
    text = text.encode("utf-8", "ignore").decode()
    made, starts, ends = normalise_with_offsets(text)
    assert made == normalise(text)
    assert len(starts) == len(ends) == len(made)
    assert all(0 <= s < e <= len(text) for s, e in zip(starts, ends))
    assert all(a <= b for a, b in zip(starts, starts[1:]))


ITEM = "The visiting auctioneer never compares ninety ash-grey turnips until the kettle whistles; instead, a proud sommelier measures thirty napkins."


def documents(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)
    rows = [
        (1, "Before. " + ITEM + " After."),
        (2, ITEM.upper().replace(" ", " \n\t")),
        (3, "so: " + wide),
        (4, "".join(c + "​" for c in ITEM)),
        (5, ITEM[:45] + " breaks off"),
        (6, None),
        (7, ""),
        (8, "x" * 100_000 + ITEM[20:90] + "y" * 100_000),
        (1, "Before. " + ITEM + " After."),
        (None, ITEM),
    ]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, item_id string")


def items(spark):
    return spark.createDataFrame([(10, ITEM), (11, None), (12, "short"), (13, ITEM[:70]), (14, "")], "item_id bigint, text string")


def test_find_leaks(spark):
    for block in (10_000, 90):
        got = find_leaks(documents(spark), items(spark), length=50, block_chars=block)
        pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
        assert pairs == {(d, i) for d in (1, 2, 3, 4, None) for i in (10, 13)} | {(8, 10)}
    rows = {(r["doc_id"], r["item_id"]): r for r in find_leaks(documents(spark), items(spark)).collect()}
    r = rows[1, 10]
    assert (r["text_start"], r["text_end"]) == (8, 8 + len(ITEM) - 1)
    assert rows[8, 10]["text_start"] == 100_000


def test_nothing_to_find(spark):
    none = items(spark).where("item_id = 11")
    assert find_leaks(documents(spark), none).count() == 0
    assert find_leaks(documents(spark).limit(0), items(spark)).count() == 0


def test_random_passages(spark):
    rng = random.Random(5)
    words = ["kettle", "bridge", "turnip", "ferry", "lamp", "oyster", "grain", "mule"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    docs = []
    for d in range(40):
        source = rng.choice(texts)
        at, n = rng.randrange(len(source)), rng.randrange(20, 140)
        docs.append((d, "zzz " + source[at : at + n] + " qqq"))
    want = {(d, i) for d, t in docs for i in brute(normalise(t), [normalise(x) for x in texts], 50)}
    got = find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string"),
    )
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_blocks_change_nothing(spark):
    """Items longer than a block come out in one row with their longest run, as in one block."""
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij", k=400))
    items = [(1, long), (2, long[100:300]), (3, "".join(rng.choices("klmn", k=90)))]
    docs = [(1, "so " + long), (2, long[60:200] + " -- " + long[250:390]), (3, items[2][1] + long[:55]), (4, long[:49])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, find_leaks(d, i, block_chars=20_000_000).collect()))
    assert sorted(map(tuple, find_leaks(d, i, block_chars=150).collect())) == whole
    assert [(r[0], r[1], r[2], r[3]) for r in whole] == [(1, 1, 400, 1), (1, 2, 200, 1), (2, 1, 140, 2), (2, 2, 100, 2), (3, 1, 55, 1), (3, 3, 90, 1)]


def test_an_automaton_is_built_once_a_worker():
    one, two = Items((1,), (normalise(ITEM),), "one"), Items((2,), ("b" * 60,), "two")
    first = automaton_of(one, 50)
    assert automaton_of(one, 50) is first
    assert automaton_of(two, 50) is not first
