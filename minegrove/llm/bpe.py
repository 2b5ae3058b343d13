"""Encoding of a corpus by a byte-level BPE vocabulary: speculate, verify, repair."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: How text is cut into words before any merge (fixed values of the public vocabulary).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_NEVER = np.iinfo(np.int64).max
_BETWEEN = "Ā"  # stands for no byte


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones as they are, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    for place, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(0x100 + place)] = b
    return letters


class ByteBpe:
    """A vocabulary with its merges, and the tables that verify a proposed encoding.

    Two neighbouring tokens stand in the true encoding together exactly if no merge
    crosses the cut between them at any time. The piece left of the cut is, over time,
    one on the right edge of the left token's merge tree, each until the merge that
    consumes it; likewise on the right. So a pair is tested by looking up the merges of
    edge pieces with each other, and encodings by testing every adjacent pair.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        vocabulary: dict[str, int] = model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.size = max(vocabulary.values()) + 1
        self.bytes_of: dict[int, bytes] = {
            i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in special
        }
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        left = np.full(self.size, -1, np.int64)
        right = np.full(self.size, -1, np.int64)
        born = np.full(self.size, -1, np.int64)  # rank of the merge that makes a token; bytes have none
        keys, ranks, made = [], [], []
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            keys.append(x * self.size + y)
            ranks.append(rank)
            made.append(z)
            if born[z] < 0:
                left[z], right[z], born[z] = x, y, rank
        order = np.argsort(keys)
        self._keys, self._ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.merge_of = {divmod(k, self.size): (r, z) for k, r, z in zip(keys, ranks, made, strict=True)}
        self._right_edge, self._right_death = self._edges(right, born)
        self._left_edge, self._left_death = self._edges(left, born)
        self._trust(left, right, born)
        self._proposer = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if self._sound[i]:
                self._proposer.add_word(b.decode("latin-1"), (len(b), i))
        self._proposer.make_automaton()
        self._split = regex.compile(WORDS)

    def _edges(self, inner: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the pieces on one edge of its tree, and the rank at which each is consumed."""
        pieces, deaths = [np.arange(self.size)], [np.full(self.size, _NEVER)]
        while True:
            outer = pieces[-1]
            inside = np.where(outer >= 0, inner[outer], -1)
            if (inside < 0).all():
                break
            pieces.append(inside)
            deaths.append(np.where(inside >= 0, born[outer], -1))
        return np.stack(pieces, 1), np.stack(deaths, 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens ``a[i]``, ``b[i]`` may be neighbours, of merges earlier than ``before``."""
        fine = np.ones(len(a), bool)
        limit = np.full(len(a), _NEVER) if before is None else before
        for i in range(self._right_edge.shape[1]):
            x, dx = self._right_edge[a, i], self._right_death[a, i]
            if (x < 0).all():
                break
            for j in range(self._left_edge.shape[1]):
                y, dy = self._left_edge[b, j], self._left_death[b, j]
                live = np.flatnonzero((x >= 0) & (y >= 0) & fine)
                if not len(live):
                    break
                rank = self._rank(x[live], y[live])
                # of equal merges the left one goes first: inside ``a`` before the cut, at the cut before inside ``b``
                crosses = (rank < dx[live]) & (rank <= dy[live]) & (rank < limit[live]) & (rank < _NEVER)
                fine[live[crosses]] = False
        return fine

    def _trust(self, left: np.ndarray, right: np.ndarray, born: np.ndarray) -> None:
        """Tokens that their own bytes are merged to; no other may be proposed."""
        sound = np.zeros(self.size, bool)
        for i in self.bytes_of:
            sound[i] = born[i] < 0
        made = np.flatnonzero(born >= 0)
        made = made[np.argsort(born[made])]
        alone = self.compatible(left[made], right[made], born[made])
        for i, fine in zip(made.tolist(), alone.tolist(), strict=True):
            sound[i] = fine and sound[left[i]] and sound[right[i]]
        self._sound = sound

    def merge_exactly(self, word: bytes) -> list[int]:
        """The encoding of one word by its merges, least rank and then leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, merge_of = [*range(1, n), -1], list(range(-1, n - 1)), self.merge_of
        heap = []
        for i in range(n - 1):
            if (m := merge_of.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (m := merge_of.get((z, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge_of.get((ids[h], z))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Encodings of words, and how many of them had to be merged exactly."""
        if not words:
            return [], 0
        plain = [w.encode("utf-8", "surrogatepass") for w in words]
        joined = _BETWEEN.join(b.decode("latin-1") for b in plain)
        ends, lengths, ids = [], [], []
        for end, (length, i) in self._proposer.iter_long(joined):
            ends.append(end)
            lengths.append(length)
            ids.append(i)
        end, length, token = (np.array(x, np.int64) for x in (ends, lengths, ids))
        sizes = np.array([len(b) for b in plain], np.int64)
        word_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        word = np.searchsorted(word_start, end - length + 1, "right") - 1
        covered = np.bincount(word, weights=length, minlength=len(plain)).astype(np.int64)
        bad = covered != sizes
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(token[inside] * self.size + token[inside + 1], return_inverse=True)
        fine = self.compatible(*np.divmod(pair, self.size))[back]
        bad[word[inside[~fine]]] = True
        first = np.searchsorted(word, np.arange(len(plain) + 1))
        out, spots = token.tolist(), first.tolist()
        failing = bad.tolist()
        made = [
            self.merge_exactly(plain[w]) if failing[w] else out[spots[w] : spots[w + 1]] for w in range(len(plain))
        ]
        return made, int(bad.sum())

    def encode_batch(self, texts: list[str | None], known: dict[str, list[int]], most: int = 8_000_000) -> list[list[int]]:
        """Encodings of texts; null and empty texts have no ids. ``known`` keeps words across batches, ``most`` bytes or so."""
        split = [self._split.findall(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        encoded, _ = self.encode_words(new)
        known.update(zip(new, encoded, strict=True))
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        if sum(len(w) for w in new) + 64 * len(known) > most:
            # a word seen once is not worth keeping
            known.clear()
        return out


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The vocabulary at this path, or else the file of this name that was added to the job."""
    return ByteBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def encode_texts(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``(doc_id, ids)``: every document's text under a byte-level BPE, without special tokens.

    The file ``vocabulary`` must lie at the same path on every machine, or have been given to
    all of them by ``SparkContext.addFile``. Within a task,
    each different word is encoded once: greedy longest matches propose its tokens,
    every adjacent pair is tested for compatibility, and words with a failing pair are
    merged exactly. Nothing is shuffled.

    Null, empty and tokenless texts have the empty list. Strings of special tokens in a
    text are ordinary text. One row out for each row in, repeated ids included.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load(vocabulary), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = bpe.encode_batch(part.column(1).to_pylist(), known)
                flat = np.fromiter((i for x in ids for i in x), np.int32)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["doc_id", "ids"]
                )

    source = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string"))
    return source.mapInArrow(encode, "doc_id bigint, ids array<int>")
