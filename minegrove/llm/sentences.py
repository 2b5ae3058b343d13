"""Sentence boundaries across languages and scripts: a finite transducer run by prefix scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut_lineage

# ---------------------------------------------------------------------------
# What counts as a mark, a quote or an abbreviation.

#: Characters of ellipses; a dot is one only in company.
ELLIPSES = "…‥⋯"
DOTS = ".．"
#: Pairs that enclose, by kind: opening and closing characters. Straight and German quotes are told apart by place.
PAIRS = (
    ('"', '"'),
    ("“„‟", "”“"),
    ("«", "»"),
    ("‹", "›"),
    ("「｢", "」｣"),
    ("『", "』"),
    ("(（", ")）"),
    ("[［", "]］"),
    ("{｛", "}｝"),
    ("【", "】"),
    ("《", "》"),
    ("〈", "〉"),
    ("〔", "〕"),
    ("‘", "’"),
)
#: Closing characters that may follow a mark; of these, some only there.
CLOSERS = "".join(close for _, close in PAIRS) + "'"
#: Marks that break off a pending end: what follows belongs to the same sentence.
CONTINUING = ",;:，、；：،؛"

#: The dot of these ends no sentence, whatever follows: titles, and words that lean on the next one.
LEANING = frozenset(
    """Mr Mrs Ms Mx Dr Prof Rev Hon Gen Col Capt Lt Sgt Cpl Gov Sen Rep Pres Mt Ft Messrs mr mrs ms dr prof MR MRS MS DR PROF
    vs VS cf viz approx APPROX incl Incl excl ca Ca
    Hr Hrn Fr Frl Dipl Ing bzw inkl exkl evtl ggf vgl Vgl sog geb gest zzgl abzgl mind max
    Sr Sra Srta Sres Dra Profa Av Avda Ud Uds Vd Vds aprox Aprox
    MM Mlle Mlles Mmes Mme Pr Me Ste av bd env boul
    Sig Sigg Dott dott Avv Exmo Exma Ilmo Ilma ul mgr inż
    डॉ प्रो श्री सु कु पं रु मो
    أ د م ص ج
    г ул им проф др стр
    dhr mevr bijv np tzn""".split()
)
#: The dot of these ends a sentence only before a capital.
CLOSING = frozenset(
    """etc Etc ETC Inc Ltd Co Corp Bros Jr Ave Blvd Rd Hwy Dept Est LTD INC min mins hr hrs sec lb lbs oz ft yr yrs mo tbsp tsp qt pt
    Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun
    usw Std Min Mio Mrd Tsd Jh Jhd Okt Dez Mrz ecc al ej
    Ph.D Ed.D M.Sc B.Sc Ph.D.s J.-C UU EE kg km cm ml tel Tel тыс руб enz""".split()
)
#: The dot of these ends no sentence before a digit.
NUMBERING = frozenset(
    """No Nos no nos NO Nr Nrn nr Num Núm núm num p P pp S s fig Fig figs Figs art Art ch Ch chap Chap Kap Abs Bd vol Vol sec Sec
    eq Eq pág págs Pág Str str tel Tel ext Ext Rs rs नं सं Apt apt Rm Ste Pl ver Ver v""".split()
)
#: What goes on after an abbreviation although it has a capital: the rest of a firm's or a person's name, a month.
CONTINUATIONS = frozenset("Ltd Inc Co Corp LLC LLP PLC Bros Jr Sr Esq PhD MD GmbH AG KG SA Cie Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split())
#: Abbreviations of several letters with dots, as written without blanks: leaning ones; all others may close a sentence.
LEANING_LETTERS = frozenset("e.g i.e E.G I.E z.B d.h u.a o.ä p.ej p.ex c.-à-d v.a i.d.R bzw.d".split())
#: Parts of such abbreviations with more than one letter.
LETTERED = frozenset("Ph Ed Sc Lit Eng".split())
#: The same with blanks between the parts.
LEANING_PARTS = frozenset({("p", "ej"), ("p", "ex"), ("z", "B"), ("d", "h"), ("u", "a"), ("e", "g"), ("i", "e"), ("v", "a"), ("i", "d"), ("d", "R")})
CLOSING_PARTS = frozenset({("p", "m"), ("a", "m"), ("P", "M"), ("A", "M"), ("v", "Chr"), ("n", "Chr"), ("EE", "UU"), ("S", "A"), ("т", "д"), ("т", "п")})
FIRST_PARTS = frozenset(a for a, _ in LEANING_PARTS | CLOSING_PARTS)
SECOND_PARTS = frozenset(b for _, b in LEANING_PARTS | CLOSING_PARTS)
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sep Sept Okt Nov Dez".split())
#: Words after which a number with a dot is an ordinal.
BEFORE_ORDINALS = frozenset("am Am im Im der Der die Die das Das den Den dem Dem des Des zum Zum zur Zur beim vom Vom ab Ab seit bis jeder jeden jede jedes vor nach".split())
#: Words before the name of a street, unlike that of a saint.
BEFORE_STREETS = frozenset("on at to from of near off along down up the".split())

# ---------------------------------------------------------------------------
# Classes of characters and the transducer's symbols.

LOWER, CAPITAL, DIGIT, SPACE, MARK, ELLIPSIS, DOT, OPEN, CLOSE, PAUSE, COMBINING, OTHER = range(12)
(S_LOWER, S_CAPITAL, S_DIGIT, S_PAUSE, S_FINAL, S_ELLIPSIS, S_ABBREVIATION, S_OPEN, S_CLOSE, S_CLOSE_NEXT, S_PLAIN_NEXT, S_BLANK_LINE, S_THAI_SPACE, S_END, S_PAD) = range(15)
SYMBOLS = 15
DEPTHS = 8
NONE, AFTER_FINAL, PENDING, AFTER_ABBREVIATION = range(4)
STATES = DEPTHS * 4
#: What the transducer writes: an end where the last setting symbol ended, an end where this symbol begins.
AT_SAVED, AT_SYMBOL = 1, 2


def _step(depth: int, mode: int, symbol: int, deepest: int | None = DEPTHS - 1) -> tuple[int, int, int, bool]:
    """One transition: the next depth and mode, what is written, whether the symbol's end is saved.

    A mark at depth 0 ends a sentence unless closing characters follow at once; after
    those, after an ellipsis and after an abbreviation the end is pending until the
    next letter shows whether it is a capital. Within brackets or quotes marks end
    nothing, but if the last of them closes right after a mark, an end is pending.
    """
    written = 0
    closes_next = symbol in (S_CLOSE_NEXT, S_PLAIN_NEXT)
    if symbol == S_PAD:
        return depth, mode, 0, False
    if symbol in (S_BLANK_LINE, S_END):
        return 0, NONE, AT_SYMBOL, False
    if mode == AFTER_FINAL:
        if closes_next:
            depth = max(0, depth - (symbol == S_CLOSE_NEXT))
            return (0, PENDING, 0, True) if depth == 0 else (depth, AFTER_FINAL, 0, False)
        if depth == 0:
            written |= AT_SAVED
        mode = NONE
    if mode == PENDING:
        if symbol == S_CAPITAL:
            return depth, NONE, written | AT_SAVED, False
        if symbol in (S_LOWER, S_PAUSE):
            mode = NONE
        elif closes_next and depth == 0:
            return 0, PENDING, written, True
    if mode == AFTER_ABBREVIATION:
        if closes_next and depth == 0:
            return 0, PENDING, written, True
        if symbol == S_CAPITAL:
            return depth, NONE, written | AT_SAVED, False
        if symbol in (S_LOWER, S_PAUSE, S_DIGIT):
            mode = NONE
    if symbol == S_OPEN:
        return depth + 1 if deepest is None else min(depth + 1, deepest), mode, written, False
    if symbol in (S_CLOSE, S_CLOSE_NEXT):
        return max(0, depth - 1), mode, written, False
    if symbol in (S_FINAL, S_ELLIPSIS, S_ABBREVIATION):
        if depth > 0:
            return depth, AFTER_FINAL, written, False
        after = {S_FINAL: AFTER_FINAL, S_ELLIPSIS: PENDING, S_ABBREVIATION: AFTER_ABBREVIATION}
        return 0, after[symbol], written, True
    if symbol == S_THAI_SPACE and depth == 0:
        return 0, NONE, written | AT_SYMBOL, False
    return depth, mode, written, False


def _compile() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    following = np.zeros((SYMBOLS, STATES), np.uint8)
    writes = np.zeros((SYMBOLS, STATES), np.uint8)
    saves = np.zeros((SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            depth, mode, written, saved = _step(*divmod(state, 4), symbol)
            following[symbol, state] = depth * 4 + mode
            writes[symbol, state] = written
            saves[symbol, state] = saved
    return following, writes, saves


NEXT, WRITES, SAVES = _compile()


def entry_states(symbols: np.ndarray, chunk: int) -> np.ndarray:
    """The state before each symbol, by a parallel prefix scan.

    The symbols are cut into chunks. Each chunk's effect is a function from states to
    states, found for all chunks and states side by side; the functions are composed
    in log2(chunks) rounds, which gives each chunk's entry state; with it the chunks
    run once more, again side by side.
    """
    count = -(-len(symbols) // chunk)
    padded = np.full(count * chunk, S_PAD, np.uint8)
    padded[: len(symbols)] = symbols
    padded = padded.reshape(count, chunk)
    effect = np.tile(np.arange(STATES, dtype=np.uint8), (count, 1))
    for j in range(chunk):
        effect = NEXT[padded[:, j][:, None], effect]
    reach = 1
    while reach < count:
        composed = effect.copy()
        composed[reach:] = np.take_along_axis(effect[reach:], effect[:-reach].astype(np.intp), 1)
        effect, reach = composed, reach * 2
    state = np.zeros(count, np.uint8)
    state[1:] = effect[:-1, 0]
    before = np.empty((count, chunk), np.uint8)
    for j in range(chunk):
        before[:, j] = state
        state = NEXT[padded[:, j], state]
    return before.ravel()[: len(symbols)]


def exact_depths(symbols: np.ndarray, state: np.ndarray) -> list[tuple[int, int, bool]]:
    """What the stretches that nest deeper than the states tell write and save: ``(place, written, saved)``.

    Where the deepest state occurs, its stretch, from one blank line or end of a text to
    the next, is run once more, with an unbounded depth.
    """
    deepest = np.flatnonzero(state // 4 == DEPTHS - 1)
    if not len(deepest):
        return []
    resets = np.flatnonzero((symbols == S_BLANK_LINE) | (symbols == S_END))
    out = []
    for k in np.unique(np.searchsorted(resets, deepest)).tolist():
        depth, mode = 0, NONE
        for i in range(int(resets[k - 1]) + 1 if k else 0, int(resets[k]) + 1 if k < len(resets) else len(symbols)):
            depth, mode, wrote, saved = _step(depth, mode, int(symbols[i]), None)
            out.append((i, wrote, saved))
    return out


#: Traits beside the class: a small letter (others are caseless), white space of any kind, an opening character, one of addresses, an invisible one.
CASED, WHITE, OPENER, ADDRESS, INVISIBLE = 1, 2, 4, 8, 16
_OPENERS = "".join(o for o, _ in PAIRS) + "-–—"


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, whether Thai, and traits, for each code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    trait = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    code = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for pattern, value in (
        (r"\p{L}", LOWER),
        (r"[\p{Lu}\p{Lt}]", CAPITAL),
        (r"\p{N}", DIGIT),
        (r"\p{M}", COMBINING),
        (r"\p{Sentence_Terminal}", MARK),
    ):
        spans = [(m.start(), m.end()) for m in regex.finditer(f"{pattern}+", text)]
        for begin, end in spans:
            kind[code[begin:end]] = value
    for chars, value in ((" \t\r\n", SPACE), (CONTINUING, PAUSE), (ELLIPSES, ELLIPSIS), (DOTS, DOT), ("!?", MARK)):
        for c in chars:
            kind[ord(c)] = value
    for opening, closing in PAIRS:
        for c in opening:
            kind[ord(c)] = OPEN
        for c in closing:
            kind[ord(c)] = CLOSE
    kind[ord("'")] = CLOSE
    for pattern, flag in ((r"\p{Lowercase}", CASED), (r"\s", WHITE), (r"\p{Cf}", INVISIBLE)):
        for m in regex.finditer(f"{pattern}+", text):
            trait[code[m.start() : m.end()]] |= flag
    for chars, flag in ((_OPENERS, OPENER), ("/\\@", ADDRESS)):
        for c in chars:
            trait[ord(c)] |= flag
    thai = np.zeros(0x110000, bool)
    thai[0x0E01:0x0E3B] = thai[0x0E40:0x0E4F] = True
    return kind, thai, trait


KIND, THAI, TRAIT = _classes()
_KINDS_OF_PAIR = np.full(0x110000, -1, np.int8)
for _i, (_o, _c) in enumerate(PAIRS):
    for _x in _o + _c:
        _KINDS_OF_PAIR[ord(_x)] = _i
_BLANK_LINE = regex.compile(r"\n[ \t\r]*\n\s*")
_CLOSED_MARK = regex.compile(
    r"[\p{Sentence_Terminal}…‥⋯．](?P<c>(?:[" + regex.escape(CLOSERS) + r"]|[^\S\n]{1,3}(?=[»›]))+)"
)
def _before(flags: np.ndarray) -> np.ndarray:
    """For each place the last place before it, or -1, where the flag is set."""
    at = np.where(flags, np.arange(len(flags), dtype=np.int32), np.int32(-1))
    last = np.maximum.accumulate(at)
    return np.concatenate([np.array([-1], np.int32), last[:-1]])


#: Names with a mark in them: what stands before the mark, the mark, and perhaps the initial of what must follow.
Names = frozenset[tuple[str, ...]]


class Lexicon:
    """Words with their classes, looked up for many spans of a text at once.

    A span's hash is the difference of two prefix sums; what it hits is compared
    character by character, so the hash decides nothing.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, classes: Sequence[Iterable[str]]) -> None:
        bits: dict[str, int] = {}
        for i, words in enumerate(classes):
            for w in words:
                bits[w] = bits.get(w, 0) | 1 << i
        self.words = sorted(bits)
        self.longest = max(map(len, self.words))
        self.bits = np.array([bits[w] for w in self.words] + [0], np.uint32)  # the last for no word
        self.lengths = np.array([len(w) for w in self.words])
        self.codes = np.zeros((len(self.words), self.longest), np.uint32)
        for i, w in enumerate(self.words):
            self.codes[i, : len(w)] = [ord(c) for c in w]
        powers = self.powers(self.longest)
        hashes = (self.codes.astype(np.uint64) * powers).sum(1, dtype=np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    @classmethod
    def powers(cls, n: int) -> np.ndarray:
        """BASE ** 0, 1, ... modulo 2 ** 64."""
        out = np.full(n, cls.BASE, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def find(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span of ``code`` the number of the word it is, or that of none (-1)."""
        length = end - begin
        found = np.full(len(begin), -1, np.int32)
        fits = np.flatnonzero((length > 0) & (length <= self.longest))
        if not len(fits):
            return found
        places = np.arange(self.longest)
        at = np.minimum(begin[fits, None] + places, len(code) - 1)
        seen = np.where(places < length[fits, None], code[at], 0)
        hashes = (seen.astype(np.uint64) * self.powers(self.longest)).sum(1, dtype=np.uint64)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = self.order[spot]
        same = (self.codes[word] == seen).all(1)
        found[fits[same]] = word[same]
        return found


(L_LEANING, L_CLOSING, L_NUMBERING, L_CONTINUATION, L_MONTH, L_ORDINAL, L_STREET, L_LETTERED, L_LETTERS) = (1 << i for i in range(9))
LEXICON = Lexicon(
    [LEANING, CLOSING, NUMBERING, CONTINUATIONS, MONTHS, BEFORE_ORDINALS, BEFORE_STREETS, LETTERED, LEANING_LETTERS, FIRST_PARTS | SECOND_PARTS | {"St", "str", "Str", "www."}]
)
_NUMBER = {w: i for i, w in enumerate(LEXICON.words)}


def _pairs_of(parts: Iterable[tuple[str, str]]) -> np.ndarray:
    """Which words, by their numbers, stand together as parts of an abbreviation; the last row and column are for none."""
    out = np.zeros((len(LEXICON.words) + 1,) * 2, bool)
    for first, second in parts:
        out[_NUMBER[first], _NUMBER[second]] = True
    return out


LEANING_TOGETHER, CLOSING_TOGETHER = _pairs_of(LEANING_PARTS), _pairs_of(CLOSING_PARTS)


def _following(flags: np.ndarray) -> np.ndarray:
    """For each place, and the one behind the last, the first place from it on where the flag is set, or the last place."""
    n = len(flags)
    at = np.where(flags, np.arange(n, dtype=np.int32), np.int32(n - 1))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], np.int32(n - 1))


def _last(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For these places only, what ``_before`` tells for all."""
    places = np.concatenate([np.array([-1]), np.flatnonzero(flags)])
    return places[np.searchsorted(places, at, "left") - 1]


def _next(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For these places only, what ``_following`` tells for all."""
    places = np.append(np.flatnonzero(flags), len(flags) - 1)
    return places[np.minimum(np.searchsorted(places, at, "left"), len(places) - 1)]


class _Batch:
    """Texts side by side, each followed by a separator. No lookup reaches beyond a separator into another text."""

    def __init__(self, texts: Sequence[str], names: Names) -> None:
        self.text = "\0".join(texts) + "\0"
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.separators = np.cumsum(lengths + 1) - 1
        self.starts = self.separators - lengths
        self.names = names
        kind = KIND[self.code]
        kind[self.separators] = SPACE
        self.kind = kind
        trait = self.trait = TRAIT[self.code]
        self.cased = (trait & CASED) > 0
        self.separator = np.zeros(len(kind), bool)
        self.separator[self.separators] = True
        self.white = ((trait & WHITE) > 0) & ~self.separator
        self.letter = (kind == LOWER) | (kind == CAPITAL)
        self.solid = self.letter | (kind == DIGIT) | (kind == COMBINING)
        self.token_starts = _before((kind == SPACE) & (self.code != ord("\r"))) + 1
        self.slashes = _before(self.code == ord("/"))
        # a word goes on over invisible characters, but begins with a visible one
        invisible = (trait & INVISIBLE) > 0
        self.break_before = _following(~invisible)[_before(~(self.solid | invisible)) + 1]
        self.letters_from = _before(~self.letter) + 1
        self.letters_to = _following(~self.letter)
        self.next_visible = _following(kind != SPACE)
        self.blank = np.array([m.start() for m in _BLANK_LINE.finditer(self.text)], np.int64)
        self.divided = self.separator.copy()
        self.divided[self.blank] = True

    def dots(self, at: np.ndarray) -> np.ndarray:
        """What each of these lone dots is: the symbol of a final mark, of an abbreviation, or of nothing.

        Each rule is a mask over all dots; of those that hold, the first decides.
        """
        kind, code, n = self.kind, self.code, len(self.code)
        start = self.break_before[at]
        direct = kind[at + 1]
        nexts = np.where(self.separator[at + 1], at + 1, self.next_visible[at + 1])
        after = kind[nexts]
        length = at - start
        word = LEXICON.find(code, start, at)
        bits = LEXICON.bits[word]
        tokens = self.token_starts[at]
        before = np.maximum(start - 1, 0)

        cased_next = (direct == LOWER) & self.cased[at + 1]
        within = (direct == DIGIT) | cased_next | np.isin(code[at + 1], [ord(c) for c in "ºª°"])
        # addresses and file names: what comes directly is a capital
        addressed = _last((self.trait & ADDRESS) > 0, at) >= tokens
        web = LEXICON.find(code, tokens, np.minimum(tokens + 4, at)) == _NUMBER["www."]
        lettered = (code[np.minimum(at + 2, n - 1)] == ord(".")) & ((length == 1) | ((bits & L_LETTERED) > 0))
        joined = (direct == CAPITAL) & (addressed | web | lettered)
        digits = _last(kind != DIGIT, at) < start
        # parts of an abbreviation, written with blanks
        shown = ~self.white
        q = _last(shown, start)
        gap = start - 1 - q
        lead_end = np.where((gap >= 1) & (gap <= 4) & (q >= 0) & (code[np.maximum(q, 0)] == ord(".")), q, start)
        lead = LEXICON.find(code, np.where(lead_end < start, self.letters_from[lead_end], start), lead_end)
        r = _next(shown, at + 1)
        gap = r - at - 1
        tail_end = self.letters_to[r]
        tailed = (gap >= 1) & (gap <= 4) & self.letter[r] & (code[tail_end] == ord("."))
        tail = LEXICON.find(code, np.where(tailed, r, 0), np.where(tailed, tail_end, 0))
        leaning_parts = LEANING_TOGETHER[lead, word] | LEANING_TOGETHER[word, tail] | CLOSING_TOGETHER[word, tail]
        # several letters with dots, written without blanks
        dotted = (start > 0) & (code[before] == ord("."))
        begin = np.minimum(_next((self.trait & OPENER) == 0, tokens), at)
        own = LEXICON.bits[np.where(dotted, LEXICON.find(code, begin, at), -1)]
        part_end = code == ord(".")
        part = np.arange(n) - self.letters_from
        odd = ~(self.letter | part_end) | (part_end & ((part < 1) | (part > 2)))
        short_parts = (_last(odd, at) < begin) & (at - self.letters_from[at] <= 2) & (at > self.letters_from[at])
        # saints and streets
        here = word == _NUMBER["St"]
        named_end = np.where(here & self.white[before], before, 0)
        named = self.letters_from[named_end]
        lead_white = np.maximum(named - 1, 0)
        to_street = (named_end - named >= 2) & (kind[named] == CAPITAL) & self.white[lead_white]
        street = (LEXICON.bits[LEXICON.find(code, self.letters_from[lead_white], np.where(to_street, lead_white, 0))] & L_STREET) > 0
        in_street = (LEXICON.find(code, np.maximum(at - 3, start), at) == _NUMBER["str"]) | (
            LEXICON.find(code, np.maximum(at - 3, start), at) == _NUMBER["Str"]
        )
        # an abbreviation may close a sentence, but not before the rest of a name; among capitals a capital shows nothing
        ahead = LEXICON.bits[LEXICON.find(code, nexts, np.where(self.letter[nexts], self.letters_to[nexts], nexts))]
        loud = self._loud(nexts, nexts + 1) & self._loud(tokens - 3, tokens - 2) & ~self.separator[np.maximum(tokens - 1, 0)]
        shout = np.where(((ahead & L_CONTINUATION) > 0) | loud, S_PAD, S_ABBREVIATION)
        initial = (length == 1) & (kind[start] == CAPITAL) & np.isin(after, (LOWER, CAPITAL, DOT))
        rules = [
            (length == 0, np.where(direct == DIGIT, S_PAD, S_FINAL)),
            (within | joined, S_PAD),
            (digits, np.where(self._ordinal(at, start, nexts, q, ahead), S_PAD, S_FINAL)),
            (LEANING_TOGETHER[lead, word], S_PAD),
            (CLOSING_TOGETHER[lead, word], S_ABBREVIATION),
            (leaning_parts, S_PAD),
            (dotted & ((own & L_LETTERS) > 0), S_PAD),
            (dotted & (((own & L_CLOSING) > 0) | short_parts), shout),
            ((bits & L_LEANING) > 0, S_PAD),
            (here, np.where(street, S_ABBREVIATION, S_PAD)),
            ((bits & L_CLOSING) > 0, shout),
            (((bits & L_NUMBERING) > 0) & (after == DIGIT), S_PAD),
            (in_street & (length > 3), np.where(after == DIGIT, S_PAD, S_ABBREVIATION)),
            (initial, S_PAD),
        ]
        out = np.select([np.asarray(r) for r, _ in rules], [np.broadcast_to(v, at.shape) for _, v in rules], S_FINAL).astype(np.uint8)
        if self.names:
            # the second word of a name, with another capitalised one before it
            may = np.flatnonzero((out != S_PAD) & (kind[start] == CAPITAL) & self.white[before] & self._before_capital(at))
            lead_from = self.letters_from[q[may] + 1]
            out[may[self._named(lead_from, at[may])]] = S_PAD
        return out

    def _before_capital(self, at: np.ndarray) -> np.ndarray:
        """Whether white space and then a capital follow, in the same text."""
        space = (self.kind[at + 1] == SPACE) & ~self.separator[at + 1]
        return space & (self.kind[self.next_visible[at + 1]] == CAPITAL)

    def _named(self, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether what stands from ``begin`` to these marks, with the mark, is a name that goes on."""
        text, names, found = self.text, self.names, []
        for b, e, n in zip(begin.tolist(), at.tolist(), self.next_visible[at + 1].tolist(), strict=True):
            key = (" ".join(text[b:e].split()), text[e])
            found.append(key in names or (*key, text[n]) in names)
        return np.array(found, bool)

    def _loud(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether these two neighbours, of one text, have a capital and no small letter."""
        fine = (a >= 0) & (b < len(self.code))
        a, b = np.maximum(a, 0), np.minimum(np.maximum(b, 0), len(self.code) - 1)
        capital = (self.kind[a] == CAPITAL) | (self.kind[b] == CAPITAL)
        return fine & capital & ~self.cased[a] & ~self.cased[b] & ~self.separator[a] & ~self.separator[b]

    def _ordinal(self, at: np.ndarray, start: np.ndarray, nexts: np.ndarray, known: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Whether numbers with a dot number a paragraph, or are ordinals: before a month, or after certain words.

        ``known``: the last place before the number that isn't white space.
        """
        length, before = at - start, np.maximum(start - 1, 0)
        short = (length <= 3) & self.white[at + 1]
        shown = _last(self.kind != SPACE, start)  # the last visible place before the number
        first = shown < _last(self.divided, start) + (start == 0)
        before_letter = self.letter[nexts] & ~((start > 0) & np.isin(self.code[before], [ord(c) for c in ".,:"]))
        month = (length <= 2) & ((ahead & L_MONTH) > 0)
        apart = (start > 0) & self.white[before]
        end = np.where(apart, known + 1, 0)
        begin = _last(self.white | self.separator, np.maximum(end - 1, 0)) + 1
        told = apart & ((LEXICON.bits[LEXICON.find(self.code, begin, end)] & L_ORDINAL) > 0)
        return short & (first | (before_letter & (month | told)))

    def marks_within(self, at: np.ndarray) -> np.ndarray:
        """Which of these lone marks right after a word stand within an address, or are part of a name."""
        query = self.code[at] == ord("?")
        out = query & self.solid[at + 1] & (self.slashes[at] >= self.token_starts[at])
        if self.names:
            may = np.flatnonzero(self._before_capital(at) & (query | (self.code[at] == ord("!"))))
            out[may] = self._named(self.break_before[at[may]], at[may])
        return out

    def ends(self, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (in the joined text) of all sentences."""
        text, kind, code, separator = self.text, self.kind, self.code, self.separator
        n = len(kind)
        place = np.arange(n, dtype=np.int32)
        letter, solid, next_visible = self.letter, self.solid, self.next_visible
        # runs of marks
        mark = (kind == MARK) | (kind == ELLIPSIS) | (kind == DOT)
        first = mark & ~np.concatenate([[False], mark[:-1]])
        last = mark & ~np.concatenate([mark[1:], [False]])
        begins, finals = np.flatnonzero(first), np.flatnonzero(last)
        run = np.full(len(begins), S_FINAL, np.uint8)
        lone = begins == finals
        single_dot = np.flatnonzero(lone & (kind[begins] == DOT))
        run[single_dot] = self.dots(begins[single_dot])
        dots = np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == DOT, dtype=np.int32)])
        soft = np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == ELLIPSIS, dtype=np.int32)])
        length = finals - begins + 1
        in_dots = dots[finals + 1] - dots[begins]
        in_soft = soft[finals + 1] - soft[begins]
        run[(in_dots + in_soft == length) & ((in_dots >= 3) | (in_soft > 0))] = S_ELLIPSIS
        # marks within addresses, and marks that are part of a name
        after_word = np.flatnonzero(lone & (kind[begins] == MARK) & solid[np.maximum(begins - 1, 0)])
        run[after_word[self.marks_within(begins[after_word])]] = S_PAD

        # blank lines divide paragraphs
        blank, divided = self.blank, self.divided
        paragraph = np.cumsum(divided, dtype=np.int32)

        # what encloses, and what only seems to
        pair = _KINDS_OF_PAIR[code]
        pair[separator] = -1
        held = np.flatnonzero(((kind == OPEN) | (kind == CLOSE)) & (pair >= 0))
        kind_before, kind_after, own = kind[np.maximum(held - 1, 0)], kind[np.minimum(held + 1, n - 1)], code[held]
        kind_before[held == 0] = SPACE
        loose_before = (kind_before == SPACE) | (kind_before == OPEN)
        wordy_after = (kind_after == LOWER) | (kind_after == CAPITAL)
        straight, low = own == ord('"'), own == ord("“")
        opens = straight & (loose_before | (kind_before == OTHER)) & (kind_after != SPACE)
        earlier_low = _last((code == ord("„")) | (code == ord("‟")), held)
        closes_low = (
            low
            & (earlier_low >= 0)
            & (paragraph[np.maximum(earlier_low, 0)] == paragraph[held])
            & ~loose_before
            & ~(wordy_after | (kind_after == DIGIT))
        )
        apostrophe = (own == ord("’")) & wordy_after
        opening, closing = np.zeros(n, bool), np.zeros(n, bool)
        opening[held] = ((kind[held] == OPEN) & ~straight & ~low) | opens | (low & ~closes_low)
        closing[held] = ((kind[held] == CLOSE) & ~straight & ~low & ~apostrophe) | (straight & ~opens) | closes_low
        valid_open, valid_close = np.zeros(n, bool), np.zeros(n, bool)
        kinds = pair[held]
        for k in np.unique(kinds).tolist():
            same = held[kinds == k]
            o, c = same[opening[same]], same[closing[same]]
            if not len(o) or not len(c):
                continue
            # the last closing place and the first opening place of each paragraph
            latest, earliest = np.full(paragraph[-1] + 1, -1), np.full(paragraph[-1] + 1, n)
            np.maximum.at(latest, paragraph[c], c)
            np.minimum.at(earliest, paragraph[o], o)
            valid_open[o] = o < latest[paragraph[o]]
            valid_close[c] = c > earliest[paragraph[c]]
        directly = np.zeros(n, bool)
        for m in _CLOSED_MARK.finditer(text):
            directly[m.start("c") : m.end("c")] = True
        directly &= closing | (code == ord("'"))

        # white space of a Thai passage: the last letter before it is Thai
        thai = THAI[code]
        space_begins = (kind == SPACE) & ~np.concatenate([[False], (kind == SPACE)[:-1]])
        last_letter = _before(letter | thai | divided)
        thai_space = space_begins & (last_letter >= 0) & thai[np.maximum(last_letter, 0)]

        # symbols in the order of the text; of letters only the first after something else matters
        symbol = np.full(n, S_PAD, np.uint8)
        symbol[kind == LOWER] = S_LOWER
        symbol[kind == CAPITAL] = S_CAPITAL
        symbol[kind == DIGIT] = S_DIGIT
        symbol[kind == PAUSE] = S_PAUSE
        symbol[finals] = run
        symbol[valid_open] = S_OPEN
        symbol[valid_close] = np.where(directly, S_CLOSE_NEXT, S_CLOSE)[valid_close]
        symbol[directly & ~valid_close] = S_PLAIN_NEXT
        symbol[thai_space] = S_THAI_SPACE
        symbol[blank] = S_BLANK_LINE
        symbol[separator] = S_END
        kept = np.flatnonzero(symbol != S_PAD)
        stream = symbol[kept]
        idle = stream <= S_PAUSE
        kept = kept[~(idle & np.concatenate([[False], (stream[:-1] <= S_CAPITAL)]))]
        stream = symbol[kept]

        state = entry_states(stream, chunk)
        deep = exact_depths(stream, state)
        written, saves = WRITES[stream, state], SAVES[stream, state]
        for i, wrote, saved_here in deep:
            written[i], saves[i] = wrote, saved_here
        setter = np.where(saves, np.arange(len(stream)), 0)
        saved = np.concatenate([[0], np.maximum.accumulate(setter)[:-1]])
        at_saved = kept[saved[(written & AT_SAVED) > 0]] + 1
        at_symbol = kept[(written & AT_SYMBOL) > 0]
        cut = np.unique(np.concatenate([at_saved, at_symbol, self.starts]))
        # each piece without the white space at its ends
        begin, end = cut[:-1], cut[1:]
        begin, end = begin[begin < n], end[begin < n]
        last_visible = np.maximum.accumulate(np.where(kind != SPACE, place, np.int32(-1)))
        begin = next_visible[begin]
        end = last_visible[end - 1] + 1
        real = begin < end
        return begin[real], end[real]


def split_texts(texts: Sequence[str], names: Names = frozenset(), chunk: int = 256) -> list[list[tuple[int, int]]]:
    """Sentences of each text as (start, end) in code points; ``chunk`` symbols make one step of the scan."""
    if not texts:
        return []
    batch = _Batch(texts, names)
    begin, end = batch.ends(chunk)
    owner = np.searchsorted(batch.separators, begin)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    offset = batch.starts[owner]
    for i, b, e in zip(owner.tolist(), (begin - offset).tolist(), (end - offset).tolist(), strict=True):
        out[i].append((b, e))
    return out


def paragraphs(text: str, most: int) -> Iterator[tuple[int, str]]:
    """The text in parts of about ``most`` characters, cut only at blank lines, where all states begin anew."""
    base = 0
    while len(text) - base > most and (line := _BLANK_LINE.search(text, base + most)):
        yield base, text[base : line.start()]
        base = line.start()
    yield base, text[base:]


#: How a name with a mark is seen: a capitalised word with ``!`` or ``?``, or two with the dot of a short second one
#: that is not all capitals; the next capitalised word; and the one after that. A word without a mark is seen too, to tell how often it has one.
_NEXT = r"(?:\s{1,4}\p{Lu}\p{L}+(?:\W{1,3}\p{L}{1,12})?)?"
_SIGHTING = rf"\s(\p{{Lu}}\p{{L}}+\s{{1,4}}\p{{Lu}}\p{{Ll}}{{0,3}}\.(?!\p{{L}}){_NEXT}|\p{{Lu}}\p{{L}}+(?:[!?]{_NEXT})?)"


def learn_names(
    documents: DataFrame, *, text: str = "text", min_count: int = 5, min_places: int = 2, share: float = 0.9, slips: int = 2
) -> DataFrame:
    """``(word, mark, initial)``: names with a mark that ends nothing, found in the whole corpus.

    Nearly always (``share`` of all sightings) such a word has the mark, and is then
    followed by the same capitalised word, with ``min_count`` sightings or more and at
    least ``min_places`` different words after that; ``initial`` is that word's. Spellings
    within ``slips`` changes of the most frequent follower count as that one. A word
    that merely ends sentences is followed by what happens to come next. With a dot the
    word is two, the second short, as in the name of a street that a shop is named by.

    Every sighting of every document counts, and every name is kept, however many.
    """
    seen = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_SIGHTING), F.lit(1))).alias("s"))
    counted = seen.groupBy("s").agg(F.count("*").alias("n"))
    stem = F.regexp_extract("s", r"^(\p{L}+(?:\s+\p{L}+(?=\.))?)", 1)
    parts = counted.select(
        F.regexp_replace(stem, r"\s+", " ").alias("word"),
        F.regexp_extract("s", r"^[\p{L}\s]+([!?.])", 1).alias("mark"),
        F.regexp_extract("s", r"[!?.]\s+(\p{L}+)", 1).alias("next"),
        F.regexp_extract("s", r"[!?.]\s+\p{L}+\W+(\p{L}+)$", 1).alias("tail"),
        "n",
    )
    places = parts.groupBy("word", "mark", "next", "tail").agg(F.sum("n").alias("n"))
    each = places.groupBy("word", "mark", "next").agg(F.count("*").alias("places"), F.sum("n").alias("n"))
    # only words that are mostly marked and mostly followed go on to the comparison of spellings
    followed = (F.col("mark") != "") & (F.col("next") != "")
    words = each.groupBy("word").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(followed, F.col("n"))).alias("followed"),
        F.max(F.when(followed, F.struct("n", "places", "mark", "next"))).alias("top"),
    )
    likely = words.where((F.col("followed") >= F.col("all") * F.lit(share)) & (F.col("top.n") >= min_count) & (F.col("top.places") >= min_places))
    spelled = each.where(followed).join(likely, "word")
    alike = (F.col("mark") == F.col("top.mark")) & (F.levenshtein(F.col("next"), F.col("top.next")) <= slips)
    told = spelled.groupBy("word", "all", "top").agg(F.sum(F.when(alike, F.col("n"))).alias("same"))
    return told.where(F.col("same") >= F.col("all") * F.lit(share)).select(
        "word", F.col("top.mark").alias("mark"), F.substring("top.next", 1, 1).alias("initial")
    )


SENTENCES = "doc_id bigint, sent_start bigint, sent_end bigint"
PIECES = "doc_id bigint, base bigint, text string"


def _sentences_of(rows: list[tuple[int, int, str]], names: Names, chunk: int, batch_chars: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row number, begin and end of the sentences of these pieces: (row, offset in its text, piece)."""
    at = 0
    while at < len(rows):
        upto, chars = at, 0
        while upto < len(rows) and (upto == at or chars < batch_chars):
            chars += len(rows[upto][2])
            upto += 1
        part = rows[at:upto]
        made = _Batch([p for _, _, p in part], names)
        begin, end = made.ends(chunk)
        owner = np.searchsorted(made.separators, begin)
        offset = (np.array([b for _, b, _ in part]) - made.starts)[owner]
        yield np.array([r for r, _, _ in part])[owner], begin + offset, end + offset
        at = upto


def _with_own_names(pieces: DataFrame, learned: DataFrame) -> DataFrame:
    """Pieces with ``names``, those learned names that their text may hold; for more names than every task can hold.

    Joined by a hash of the text: texts that share one share names, which changes nothing,
    as any name that is learned is one everywhere.
    """
    key = F.xxhash64("text")
    held = pieces.select(key.alias("_h"), F.explode(F.regexp_extract_all("text", F.lit(_SIGHTING), F.lit(1))).alias("s"))
    held = held.select(
        "_h",
        F.regexp_replace(F.regexp_extract("s", r"^(\p{L}+(?:\s+\p{L}+(?=\.))?)", 1), r"\s+", " ").alias("word"),
        F.regexp_extract("s", r"^[\p{L}\s]+([!?.])", 1).alias("mark"),
    ).distinct()
    found = held.join(learned, ["word", "mark"]).groupBy("_h").agg(
        F.collect_set(F.struct("word", "mark", "initial")).alias("names")
    )
    return salted_join(pieces.withColumn("_h", key), found, "_h", how="left", spread=F.struct("doc_id", "base")).drop("_h")


def split_sentences(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    names: Names = frozenset(),
    learned: DataFrame | None = None,
    chunk: int = 256,
    batch_chars: int = 500_000,
    long_chars: int = 2_000_000,
    most_sent: int = 100_000,
) -> DataFrame:
    """``(doc_id, sent_start, sent_end)``: the sentences of every document, in code points.

    The rules are compiled into a transducer over classes of characters. Texts are laid
    side by side and cut into chunks, whose effects on the state are composed by prefix
    scan, so a long text costs no more steps than many short ones. What a document's
    sentences are depends on its own text and the names only.

    Texts of more than ``long_chars`` characters are cut at blank lines, where all states
    begin anew, and the pieces are dealt to all tasks; nothing else is shuffled.

    ``names`` and ``learned`` (the result of ``learn_names``) are names with a mark in them.
    Up to ``most_sent`` learned ones are sent to all tasks; more are joined to the
    documents that may hold them, with the same result.

    Null, empty and blank texts have no sentences; repeated documents repeat theirs.
    """
    spark = documents.sparkSession
    joined = False
    if learned is not None:
        learned = cut_lineage(learned)
        joined = learned.limit(most_sent + 1).count() > most_sent
        if not joined:
            names = names | {tuple(r) for r in learned.select("word", "mark", "initial").toLocalIterator()}
    sent = spark.sparkContext.broadcast(names)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0), sent.value
            if joined:
                own = own.union(tuple(x.values()) for found in batch.column(3).to_pylist() for x in found or ())
            rows = [
                (row, base + more, piece)
                for row, (base, whole) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                if whole
                for more, piece in paragraphs(whole, batch_chars)
            ]
            for row, begin, end in _sentences_of(rows, own, chunk, batch_chars):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "sent_start", "sent_end"],
                )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
                for base, piece in paragraphs(whole, batch_chars):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()], pa.int64()), pa.array([base], pa.int64()), pa.array([piece], pa.string())],
                        names=["doc_id", "base", "text"],
                    )

    source = documents.select(
        documents[doc_id].cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("base"), documents[text].cast("string").alias("text")
    )
    short = source.where(F.char_length("text") <= long_chars)
    long = source.where(F.char_length("text") > long_chars).mapInArrow(cut, PIECES).repartition("doc_id", "base")
    made = [short, long]
    if joined:
        made = [_with_own_names(df, learned) for df in made]
    return made[0].mapInArrow(split, SENTENCES).unionByName(made[1].mapInArrow(split, SENTENCES))
