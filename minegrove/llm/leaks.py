"""Held-out passages inside a corpus: one Aho-Corasick scan over normalised text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_DROPPED = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_KEPT = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CLUSTER = regex.compile(r"\X")
_WORD = regex.compile(r"\s+|\S+")
_ALL = regex.compile(r"(?s:.+)")
LEAKS = "doc_id bigint, item_id bigint, run bigint, runs bigint, text_start bigint, text_end bigint"


def normalise(text: str) -> str:
    """NFKC and lower case; only letters, marks and digits stay."""
    return _DROPPED.sub("", unicodedata.normalize("NFKC", text).lower())


def normalise_with_offsets(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text and, for each of its characters, where its source begins and ends in ``text``."""
    whole = unicodedata.normalize("NFKC", text)
    lowered = whole.lower()
    for cutter in (_CLUSTER, _WORD, _ALL):
        # pieces that normalise on their own: grapheme clusters, or else words, or else the text
        spans = np.array([m.span() for m in cutter.finditer(text)], np.int64).reshape(-1, 2)
        pieces = [unicodedata.normalize("NFKC", text[a:b]) for a, b in spans.tolist()]
        if "".join(pieces) == whole:
            break
    widths = np.array([len(p.lower()) for p in pieces], np.int64)
    kept = np.zeros(len(lowered), bool)
    for m in _KEPT.finditer(lowered):
        kept[m.start() : m.end()] = True
    return _DROPPED.sub("", lowered), np.repeat(spans[:, 0], widths)[kept], np.repeat(spans[:, 1], widths)[kept]


@dataclass(frozen=True)
class Items:
    """A block of test items: ids and normalised texts; ``name`` tells blocks apart."""

    ids: tuple[int, ...]
    texts: tuple[str, ...]
    name: str = ""


def anchors(length: int) -> tuple[int, int]:
    """Length and stride of the substrings of an item of which every run of ``length`` holds one whole."""
    size = (length + 1) // 2
    return size, length - size + 1


def build(items: Items, length: int) -> ahocorasick.Automaton:
    size, stride = anchors(length)
    places: dict[str, list[tuple[int, int]]] = {}
    for index, text in enumerate(items.texts):
        if len(text) >= length:
            for at in range(0, len(text) - size + 1, stride):
                places.setdefault(text[at : at + size], []).append((index, at))
    automaton = ahocorasick.Automaton()
    for pattern, where in places.items():
        automaton.add_word(pattern, where)
    if places:
        automaton.make_automaton()
    return automaton


#: The automaton that this worker built last: a worker runs many tasks over one block.
_built: dict[tuple[str, int], ahocorasick.Automaton] = {}


def automaton_of(items: Items, length: int) -> ahocorasick.Automaton:
    """The block's automaton, built once by a worker; that of a block before is let go."""
    key = (items.name, length)
    if key not in _built:
        _built.clear()
        _built[key] = build(items, length)
    return _built[key]


def blocks_of(items: DataFrame, item_id: str, item_text: str, length: int, block_chars: int) -> Iterator[Items]:
    """Normalised items in blocks of about ``block_chars`` characters, streamed; an item is never cut.

    Items too short to share a run of ``length`` are left out.
    """
    ids: list[int] = []
    texts: list[str] = []
    filled = 0
    for row in items.select(item_id, item_text).where(items[item_text].isNotNull()).toLocalIterator():
        own = normalise(row[1])
        if len(own) < length:
            continue
        if ids and filled + len(own) > block_chars:
            yield Items(tuple(ids), tuple(texts), uuid4().hex)
            ids, texts, filled = [], [], 0
        ids.append(row[0])
        texts.append(own)
        filled += len(own)
    if ids:
        yield Items(tuple(ids), tuple(texts), uuid4().hex)


def _same_before(a: str, i: int, b: str, j: int) -> int:
    most, n = min(i, j), 0
    while n + 32 <= most and a[i - n - 32 : i - n] == b[j - n - 32 : j - n]:
        n += 32
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def _same_after(a: str, i: int, b: str, j: int) -> int:
    most, n = min(len(a) - i, len(b) - j), 0
    while n + 32 <= most and a[i + n : i + n + 32] == b[j + n : j + n + 32]:
        n += 32
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def runs_in(text: str, automaton: ahocorasick.Automaton, items: Items, length: int) -> dict[int, list[tuple[int, int]]]:
    """For each item (by index) the maximal common runs with ``text``: (length, start), longest first."""
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(automaton) or len(text) < length:
        return found
    size, _ = anchors(length)
    covered: dict[tuple[int, int], int] = {}
    for end, places in automaton.iter(text):
        start = end - size + 1
        for index, at in places:
            line = (index, start - at)
            if covered.get(line, -1) > start:  # inside a run that is known
                continue
            before = _same_before(text, start, items.texts[index], at)
            after = _same_after(text, start + size, items.texts[index], at + size)
            covered[line] = end + 1 + after
            if before + size + after >= length:
                found.setdefault(index, []).append((before + size + after, start - before))
    for runs in found.values():
        runs.sort(key=lambda r: (-r[0], r[1]))
    return found


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 50,
    block_chars: int = 20_000_000,
) -> DataFrame:
    """Documents that share a run of ``length`` or more normalised characters with a test item.

    One row for each document and item: the longest such run (``run`` characters; the
    first of equal ones), the number of maximal runs, and where the longest lies in the
    document's own text (``text_start``, ``text_end``, in code points).

    The items are stated queries: they pass through the driver one block of about
    ``block_chars`` characters at a time (more where a single item is longer, as items are
    not cut), and each block is one automaton, built once by a worker; texts are scanned
    once a block. From each item, substrings of half the length are taken so densely
    that any qualifying run holds one whole; a hit is extended both ways to the exact
    run, so how items fall into blocks changes no row.

    Null and short texts leak nothing. Repeated documents give repeated rows, repeated
    items one row an item id and row of the items. No items give no rows.
    """
    context = documents.sparkSession.sparkContext
    source = documents.select(documents[doc_id].cast("bigint"), documents[text].cast("string"))
    made: list[DataFrame] = []
    for block in blocks_of(items, item_id, item_text, length, block_chars):
        sent = context.broadcast(block)

        def scan(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, automaton = sent.value, automaton_of(sent.value, length)
            for batch in batches:
                rows = []
                for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if own is None:
                        continue
                    found = runs_in(normalise(own), automaton, items, length)
                    if not found:
                        continue
                    _, starts, ends = normalise_with_offsets(own)
                    for index, runs in found.items():
                        n, at = runs[0]
                        rows.append((doc, items.ids[index], n, len(runs), int(starts[at]), int(ends[at + n - 1])))
                names = ["doc_id", "item_id", "run", "runs", "text_start", "text_end"]
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        made.append(source.mapInArrow(scan, LEAKS))
    if not made:
        return documents.sparkSession.createDataFrame([], LEAKS)
    return reduce(DataFrame.unionByName, made)
