import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from minegrove.llm import sentences as S

BAR = "|"

#: Texts with bars where sentences end; the white space after a bar is between sentences.
CASES = {
    "plain": "It was dry.| Was it?| Yes!!!| No?!",
    "no space, lower case": "It was dry.|Next one.| So it did.|M. Oskeld saw the rug.|J. R. Quellan too.| meh.| got soup to go.| ok.",
    "abbreviations": "Dr. Quellan and Mrs. Dovrik sat at table No. 45.| They open at 7 a.m. and close at 9 p.m. on weekends.| We left at 9:30 p.m.| The sign fell.",
    "streets": "It is on St. Quellan Ave. near the mill.| We met in St. Oskeld.| He lives on Main St.| The mill burned.",
    "firms": "She works for Hasperin Bros. Ltd. and it shows.| He left Oskeld Inc.| Then we paid.",
    "dates": "I ate there on Sat. and again on Aug. 31.| He came on Mon. Jan. 5 and left.",
    "initials": "Ask for J. R. Velmora at the bar.| The U.K. style stew.| Ph.D. students pay less.",
    "numbers": "Rated 2.7 stars, it cost $1,159.99 (incl. tip).| Chapter 3.2.38, p. 34, says so.| In 2011.| Next.",
    "addresses": "See www.a-b.example/x for hours.| Open C:\\menus\\day_5.txt or x.example/m_v2.pdf now.| Fine.",
    "ellipsis": "Well... it was tiny.| Perhaps…| The end...| «Soon», he said.| And so...",
    "quotation": "The sign said “Open. Always.” and shut.| He yelled \"Wait! Come back!\" and ran.| My cousin said, \"It is bland.\"| My boss left.",
    "quotation first": "\"Never again?\" said my sister.| “Best stew.”| If only.",
    "brackets": "He (she knows it!) left.| (Nobody told us.)| The end.",
    "unpaired": "A smile :) helps.| An open “quote stays.| and so on.| More.",
    "french": "Quelle crêpe !| Mme Velmora a dit : « C'est fade. »| « Jamais ! » a crié ma tante.| M. Oskeld est au n° 27 de l'av. Dovrik.| Fin.",
    "german": "„Nie wieder!“, sagte sie.| Am 22. Mai waren wir da.| Das war ca. 5 Euro, also z. B. mehr als 2016.| In der Oskeldstr. 5 ist der 3. Stock leer.| Hr. Quellan, d. h. er, kam.",
    "spanish": "¿Por qué?| ¡No!| Tía gritó: «¡No! ¡Otra vez no!» y se fue.| El Sr. Oskeld vino a las 7:30 p. m. y pagó.| Está en la Av. Dovrik n.º 28, cerca...| «Vuelvan», dijo, p. ej., ella.",
    "chinese": "价格是55.74元。|为什么？|他说“卖完了。”就走了。|“不来了！”我说。|环境凉了……但是不错。|（停车很难。）\n\n|好。",
    "japanese": "「また来ます。」と笑った。|新鮮です！！|また行きたい……と思います。",
    "hindi": "डॉ. Oskeld ने कहा।| कीमत रु. 17.38 थी॥| “फिर नहीं!” बहन ने कहा।",
    "arabic": "قال د. Brindlow نعم.| لماذا؟| قالت: «لن نعود!» ثم خرجت.| المكان بارد... لكن جيد.",
    "thai": "เรารอ38นาที| ชามะนาวแพง|\nราคา26.17บาท2016|  Then English here.| จบ",
    "blank lines": "Prices vs. portions\n\n|got soup\nto go.|\n \t\n— J. T. Velmora\r\n\r\n|Tags",
    "other scripts": "Сюда мы больше не пойдём!| 참 맛있었어요.| Ինչ։| Done.",
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    pieces = CASES[name].split(BAR)
    text = "".join(pieces)
    want, at = [], 0
    for p in pieces:
        inner = p.strip(" \t\r\n")
        begin = at + p.index(inner)
        want.append(inner)
        at += len(p)
        assert text[begin : begin + len(inner)] == inner
    assert [text[a:b] for a, b in S.split_texts([text])[0]] == want


@pytest.mark.parametrize(
    "text",
    ["字" * 250 + "吗?好吗", "字" * 250 + "了.Then more.", "Inc. OK so", "X Inc. OK so", "a/b" + "字" * 250 + "吗?好吗"],
)
def test_other_texts_of_the_batch_change_nothing(text):
    alone = S.split_texts([text])[0]
    for before in ("See x/y", "Mail a@b.example OK", "C:\\x"):
        assert S.split_texts([before, text, before])[1] == alone


def test_a_token_may_be_longer_than_any_window():
    far = "字" * 250
    assert len(S.split_texts([f"{far}吗?好吗"])[0]) == 2
    assert len(S.split_texts([f"a/b{far}吗?好吗"])[0]) == 1


def test_learned_names():
    text = "I ate at Zing! Noodles on Monday. What a zing! Noodles are good."
    plain = [text[a:b] for a, b in S.split_texts([text])[0]]
    assert len(plain) == 4
    learned = S.split_texts([text], frozenset({("Zing", "!")}))[0]
    assert [text[a:b] for a, b in learned] == ["I ate at Zing! Noodles on Monday.", "What a zing!", "Noodles are good."]


def test_names_with_a_dot():
    names = frozenset({("Oat St", ".", "B"), ("Zing", "!", "N")})
    text = "The stew at Oat St. Bakery is fresh. He lives on Oat St. There it is. See Oat  St.\nBkaery. I love Zing! It is fun. Zing! Nodoles too."
    got = [text[a:b] for a, b in S.split_texts([text], names)[0]]
    assert got == ["The stew at Oat St. Bakery is fresh.", "He lives on Oat St.", "There it is.", "See Oat  St.\nBkaery.", "I love Zing!", "It is fun.", "Zing! Nodoles too."]


def test_names_with_a_dot_are_learned(spark):
    rows = [(f"The stew at Oat St. {shop} {v} fresh. On Elm St. {n} it is. Ask Hull Ltd. and go.",) for v in ("is", "was", "tastes") for n in ("Yes", "Well", "Oh") for shop in ("Bakery", "Bakery", "Bakery", "Bkaery")]
    got = [tuple(r) for r in S.learn_names(spark.createDataFrame(rows, "text string")).collect()]
    assert got == [("Oat St", ".", "B")]


def test_more_names_than_can_be_sent(spark):
    rows = [(i, f"I ate at Zing! Noodles on day {i}. So good! {w} it was. At Oat St. Bakery we left. Day! {w} again.") for i, w in enumerate(("Yes", "Well", "Oh", "Ah", "No", "So"))]
    df = spark.createDataFrame(rows + [(1, rows[1][1]), (9, None)], "doc_id bigint, text string")
    learned = spark.createDataFrame([("Zing", "!", "N"), ("Oat St", ".", "B"), ("Never", "?", "X")], "word string, mark string, initial string")
    want = sorted(map(tuple, S.split_sentences(df, learned=learned).collect()))
    assert sorted(map(tuple, S.split_sentences(df, learned=learned, most_sent=1).collect())) == want
    assert len(want) == 7 * 6


def test_words_go_on_over_invisible_characters():
    text = "Because the bell hu\u200bms. Which one? \u200bDr. Quellan knows. It said no\u00ad. Then it left."
    got = [text[a:b] for a, b in S.split_texts([text])[0]]
    assert got == ["Because the bell hu\u200bms.", "Which one?", "\u200bDr. Quellan knows.", "It said no\u00ad.", "Then it left."]


def test_depth_is_unbounded():
    for n in (1, 7, 8, 9, 40):
        text = "(" * n + "a. B" + ")" * (n - 1) + " c. D. e) f. G"
        assert [text[a:b] for a, b in S.split_texts([text])[0]] == [text[:-2], "G"]


def test_time_is_linear_in_a_token():
    import time

    took = []
    for n in (4000, 64000):
        begun = time.perf_counter()
        S.split_texts([("x" * 30 + ".Y") * n])
        took.append(time.perf_counter() - begun)
    assert took[1] < 16 * 8 * max(took[0], 0.02)


def test_long_texts_are_dealt_out(spark):
    text = "\n\n".join(f"1. He said “{i}. So.” and left\nthe bar... That was {i}" for i in range(300))
    df = spark.createDataFrame([(7, text), (8, "One. Two."), (None, text)], "doc_id int, text string")
    want = sorted(map(tuple, S.split_sentences(df).collect()), key=str)
    assert sorted(map(tuple, S.split_sentences(df, long_chars=500, batch_chars=100).collect()), key=str) == want


def test_names_are_learned_from_the_corpus(spark):
    rows = [(f"I like Zing! Noodles {v} much. What a day! The end. So many Minutes? {n} it was.",) for v in ("so", "too", "very") for n in ("Yes", "Well", "Oh")]
    df = spark.createDataFrame(rows + [(None,), ("",)], "text string")
    assert [(r["word"], r["mark"]) for r in S.learn_names(df).collect()] == [("Zing", "!")]
    assert S.learn_names(df.limit(0)).count() == 0


def runs_one_by_one(symbols):
    state, out = 0, []
    for s in symbols:
        out.append(state)
        state = S.NEXT[s, state]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, S.SYMBOLS - 1), max_size=200), st.integers(1, 40))
def test_prefix_scan_is_the_sequential_run(symbols, chunk):
    stream = np.array(symbols, np.uint8)
    assert S.entry_states(stream, chunk).tolist() == runs_one_by_one(symbols)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aA.!?…\"“”„«»()' \n\t1,。ก：'s", max_size=40), max_size=4), st.integers(1, 9))
def test_sentences_cover_the_text(texts, chunk):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    together = S.split_texts(texts, chunk=chunk)
    assert together == [S.split_texts([t])[0] for t in texts]
    for text, spans in zip(texts, together):
        covered = set()
        for a, b in spans:
            assert a < b and text[a] not in " \t\r\n" and text[b - 1] not in " \t\r\n"
            assert not covered & set(range(a, b))
            covered |= set(range(a, b))
        assert all(i in covered for i, c in enumerate(text) if c not in " \t\r\n")


def test_very_long_text():
    text = ("One is here. “Two. Still two.” The third... goes on, e.g. here! " * 20_000).strip()
    spans = S.split_texts([text])[0]
    assert len(spans) == 3 * 20_000
    assert len(S.split_texts(["a" * 300_000 + "(" * 1000])[0]) == 1
    for filler in (" ", "\n", "\r\n", "\t \n", ".", "“", "a.", "! "):
        S.split_texts([filler * 200_000 + "x"])


def test_long_texts_are_cut_at_blank_lines(spark):
    text = "\n\n".join(f"1. He said “{i}. So.” and left\nthe bar... That was {i}" for i in range(300)) + "(" * 50
    want = [(7, a, b) for a, b in S.split_texts([text])[0]]
    df = spark.createDataFrame([(7, text)], "doc_id int, text string")
    assert sorted(map(tuple, S.split_sentences(df, batch_chars=100).collect())) == want
    assert len(list(S.paragraphs(text, 100))) > 50


def test_in_spark(spark):
    rows = [(1, "A b. C d."), (2, None), (3, ""), (4, " \t\r\n "), (1, "A b. C d."), (None, "x")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, sent_start int")
    got = sorted(map(tuple, S.split_sentences(df).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(None, 0, 1)], key=str)
    assert S.split_sentences(df.limit(0)).count() == 0
