"""Evaluation items whose passages occur in documents, by pigeonhole edit matching.

A passage is a window of ``span_words`` consecutive words of an item, as normalised words joined by single
blanks. With an error budget of k edits the letters and blanks of the window are cut into k + 1 pieces; a
text within k edits of the window holds at least one piece unchanged (pigeonhole), wherever its words begin
and end, because every edit falls into one piece or between two. Pieces are found at any letter of the
document by rolling hashes. Where what lies on either side of a piece can be within the budget, the least
edit distance of the window to the letters around is computed bit-parallel; the least one over all places is that of
the window to any stretch of the document. Distance 0 is followed by a comparison of word borders, because a match of
letters may begin or end inside a word.

Every document is read whole, where it lies: there is no shuffle of documents and no pair that does
not share a piece. Items are taken in blocks of bounded size, each broadcast and matched against all
documents.

Null or empty texts match nothing; items of fewer than ``span_words`` words have no passage. Repeated
document rows with the same id give one row.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.llm.texts import normal_words

SPAN_WORDS = 12
ERROR_BUDGET = 2
#: Words of the items of one block at most (an item that is larger is a block by itself).
BLOCK_WORDS = 250_000

#: Bits of the hashes by which places are picked out, beyond those that number the pieces.
SPARE_BITS = 5
#: The odd number that spreads hashes.
_MIX = 0x9E3779B97F4A7C15

_FOUND = "doc_id bigint, item_id bigint, distance int, exact boolean"


def least_distance(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; stops early at 0.

    Bit-parallel: one column of the dynamic-programming matrix is two bit vectors of vertical differences.
    """
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        match = where.get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if score < best:
            best = score
            if not best:
                break
    return best


def edits_of_prefix(pattern: str, text: str, budget: int) -> int:
    """Least edits between ``pattern`` and any prefix of ``text``, or ``budget + 1`` if it takes more.

    Follows the furthest reach on each diagonal edit by edit, so texts that differ are given up at once.
    """
    m, n = len(pattern), len(text)
    reach: dict[int, int] = {0: 0}
    for edits in range(budget + 1):
        for diagonal, i in reach.items():
            j = i + diagonal
            while i < m and j < n and pattern[i] == text[j]:
                i, j = i + 1, j + 1
            if i == m:
                return edits
            reach[diagonal] = i
        further: dict[int, int] = {}
        for diagonal, i in reach.items():
            # a letter replaced, one only in the text, one only in the pattern
            for d, x in ((diagonal, i + 1), (diagonal + 1, i), (diagonal - 1, i + 1)):
                if x <= m and 0 <= x + d <= n and x > further.get(d, -1):
                    further[d] = x
        reach = further
    return budget + 1


def _rolling_hashes(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the letters at each place) for sizes 1, 2, 4 and on up to ``most``."""
    held = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * np.uint64(_MIX)
    size, factor = 1, _MIX
    while size <= most and len(held):
        yield size, (held ^ (held >> np.uint64(29))) * np.uint64(_MIX)
        held = held[:-size] * np.uint64(factor) + held[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


class LetterIndex:
    """Exact index of the pieces of letters of all windows of a block of items: arrays sorted by hash."""

    def __init__(self, items: list[tuple[int, list[str]]], span_words: int, budget: int):
        self.budget = budget
        texts, windows, base = [], [], 0
        for key, words in items:
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            begin = base + np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(words) else lengths
            count = len(words) - span_words + 1
            if count > 0:
                first = begin[:count]
                windows.append(np.stack([np.full(count, key), first, begin[span_words - 1 :] + lengths[span_words - 1 :] - first]))
            texts.append(" ".join(words))
            base += len(texts[-1]) + 1
        self.text = "\n".join(texts)
        key, first, length = np.concatenate(windows, axis=1) if windows else np.zeros((3, 0), dtype=np.int64)
        cuts = [np.round(i * length / (budget + 1)).astype(np.int64) for i in range(budget + 2)]
        pieces = np.concatenate([np.stack([key, first, length, a, b]) for a, b in zip(cuts, cuts[1:])], axis=1)
        sizes = 1 << (np.frexp(np.maximum(pieces[4] - pieces[3], 1).astype(float))[1] - 1).astype(np.int64)
        bits = max(12, int(pieces.shape[1]).bit_length() + SPARE_BITS)
        self.shift = np.uint64(64 - bits)
        #: size -> hashes of the first letters of the pieces of that size, in order, and the pieces
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.marks: dict[int, np.ndarray] = {}
        for size, hashes in _rolling_hashes(self.text, int(sizes.max()) if len(sizes) else 0):
            own = pieces[:, sizes == size]
            if own.shape[1]:
                found = hashes[own[1] + own[3]]
                order = np.argsort(found, kind="stable")
                self.pieces[size] = found[order], own[:, order]
                self.marks[size] = np.zeros(1 << bits, dtype=bool)
                self.marks[size][found >> self.shift] = True

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, bool]]:
        """(item, distance, exact) for each item with a window within the budget."""
        text = " ".join(words)
        bordered = f" {text} "
        best: dict[int, tuple[int, bool]] = {}
        for size, hashes in _rolling_hashes(text, max(self.marks, default=0)):
            if size not in self.marks:
                continue
            places = np.flatnonzero(self.marks[size][hashes >> self.shift])
            known, pieces = self.pieces[size]
            low, high = (np.searchsorted(known, hashes[places], side) for side in ("left", "right"))
            for i, begin, end in zip(places.tolist(), low.tolist(), high.tolist()):
                for key, first, length, a, b in pieces[:, begin:end].T.tolist() if begin < end else ():
                    found = best.get(key, (self.budget + 1, False))
                    if found[1] or not text.startswith(self.text[first + a : first + b], i):
                        continue
                    window = self.text[first : first + length]
                    budget = min(self.budget, found[0])
                    if self._edits(window, text, i, a, b, budget) <= budget:
                        around = text[max(0, i - a - self.budget) : i - a + length + self.budget]
                        edits = least_distance(window, around)
                        exact = not edits and i >= a and bordered.startswith(f" {window} ", i - a)
                        if exact or edits < found[0]:
                            best[key] = edits, exact
        for key, found in best.items():
            yield key, *found

    @staticmethod
    def _edits(window: str, text: str, i: int, a: int, b: int, budget: int) -> int:
        """Edits of a window whose letters ``a`` to ``b`` are at ``i`` of the text, or more than the budget."""
        end = i + b - a
        right = edits_of_prefix(window[b:], text[end : end + len(window) - b + budget], budget)
        if right > budget:
            return right
        return right + edits_of_prefix(window[:a][::-1], text[max(0, i - a - budget) : i][::-1], budget - right)


@lru_cache(1)
def _index(name: str, block: _Block, span_words: int, budget: int) -> LetterIndex:
    """The index of a block, built once in a Python worker."""
    return LetterIndex(block.items, span_words, budget)


class _Block:
    """Items of a block, told apart by nothing: their name does."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Block)

    def __hash__(self) -> int:
        return 0


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = normal_words(row["text"])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        yield block


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    span_words: int = SPAN_WORDS,
    error_budget: int = ERROR_BUDGET,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, distance, exact`` for documents that hold a passage of an item.

    ``documents`` has ``doc_id, text``; ``items`` has ``item_id`` (unique) and ``text``. ``distance`` is the
    least edit distance found, up to ``error_budget``; ``exact`` says that ``span_words`` consecutive words
    are equal, word by word. Rows with a null id are left out.
    """
    if span_words < error_budget + 1 or error_budget < 0:
        raise ValueError("a window needs at least one word for each of its error_budget + 1 pieces")
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    found = spark.createDataFrame([], _FOUND)
    for block in _blocks(known, block_words):
        shared, name = spark.sparkContext.broadcast(_Block(block)), uuid.uuid4().hex

        def match(batches: Iterable[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, span_words, error_budget)
            for batch in batches:
                rows = [
                    (doc, *hit)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for hit in index.matches(normal_words(text))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["doc_id", "item_id", "distance", "exact"]
                    )

        found = found.unionByName(texts.mapInArrow(match, _FOUND))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("exact").alias("exact"))
