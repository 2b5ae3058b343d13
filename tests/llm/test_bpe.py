import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from minegrove.llm.bpe import DEFAULT_VOCABULARY, encode_texts, load

if not os.path.exists(DEFAULT_VOCABULARY):
    pytest.skip("the vocabulary files are not here", allow_module_level=True)

TEXTS = [
    None,
    "",
    " ",
    "   \t\r\n  ",
    "Hello world, it's 2024!  \n\n Don't <|endoftext|> stop",
    "Zażółć gęślą jaźń — naïve façade",
    "这家店的小笼包太咸了……但是酸辣粉不错。",
    "เรารอ38นาทีกว่าจะได้กินปลาทอด",
    "कीमत रु. 42.66 थी, जो 2017 से ज़्यादा है।",
    "👨‍👩‍👧👍🏽 ½ ₿0.0022",
    "a" * 5000,
    " the" * 3000,
    "\x00\x1c\x85  ​",
    "ｆｕｌｌ ｗｉｄｔｈ １２３",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(DEFAULT_VOCABULARY)
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    return load(DEFAULT_VOCABULARY)


def test_same_ids_as_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "x")], "doc_id int, text string")
    rows = encode_texts(df.selectExpr("*", "1 as ids")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r["ids"] == library(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "x")
    assert encode_texts(df.limit(0)).count() == 0
    assert encode_texts(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(bpe, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert bpe.encode_batch(texts, {}) == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinorst ld", max_size=60) | st.text(alphabet="一二三的了是不", max_size=40))
def test_repairs_equal_exact_merging(bpe, text):
    words = bpe._split.findall(text)
    made, _ = bpe.encode_words(words)
    assert made == [bpe.merge_exactly(w.encode()) for w in words]


def test_compatible_pairs_are_those_that_encode_to_themselves(bpe):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    a[:1000], b[:1000] = rng.integers(0, 2000, 1000), rng.integers(0, 2000, 1000)
    fine = bpe.compatible(a, b)
    for x, y, f in zip(a.tolist(), b.tolist(), fine.tolist(), strict=True):
        assert (bpe.merge_exactly(bpe.bytes_of[x] + bpe.bytes_of[y]) == [x, y]) == f


def test_decodes_to_the_text(bpe):
    for t in TEXTS:
        (ids,) = bpe.encode_batch([t], {})
        assert b"".join(bpe.bytes_of[i] for i in ids).decode() == (t or "")
