"""Texts with template residue, filler, error messages or script notices where content should be.

Texts become tokens (placeholders, numbers, codes, paths, filler words and words for pages and scripts by class).
Labelled exemplar passages are found through an inverted index of their terms, single tokens and pairs of
neighbours, and compared with windows of the text of about the exemplar's length: the TF-IDF containment of an
exemplar in a window is the weight of its terms that the window holds, as a share of the weight of all its terms.
Weights are inverse document frequencies counted over all documents of the input.

A text that only speaks of such things holds the words of an exemplar within a sentence of its own. So windows that hold
enough of an exemplar count by coverage: they must cover ``COVERAGE`` of the tokens of a sentence, unless the exemplar
is long (``LONG`` tokens), a placeholder or a notice in ``noscript`` tags. Placeholders in quotes are spoken of and count as nothing.

Filler words are those of the common passage and those the corpus itself shows to be filler: words of which most
documents have them between words of the common passage.

Null and empty texts hold nothing. Texts of any length are read whole. Rows with a null id are left out;
repeated rows with one id give one row.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.llm.exemplars import DOC_WORDS, FIELD_WORDS, FILLER_WORDS, SCRIPT_WORDS, labelled
from chronoloom.llm.texts import UNSEEN
from chronoloom.operators.staging import dimension

#: Share of an exemplar's weight that a window must hold.
CONTAINMENT = 0.72
#: Share of a sentence's tokens that windows must cover.
COVERAGE = 0.6
#: Tokens of an exemplar that says enough wherever it stands.
LONG = 8
#: Tokens by which a window may be longer than the exemplar.
SLACK = 2
#: The weight of a class token and of punctuation, as a share of its own idf: they say less than words.
CLASS_WEIGHT = {"<n>": 0.3, "<id>": 0.6, "<path>": 0.5, "<any>": 0.0}

#: Tokens on either side in which a word of filler has words of the common passage, and how many.
FILLER_REACH, FILLER_SEEDS = 8, 2
#: Documents such a word must at least be found so in, also as a share of all documents with filler, and the share of the word's documents that these must be.
FILLER_DOCUMENTS, FILLER_SHARE, FILLER_PURITY = 2, 0.01, 0.8

_BRACED = r"\{\{[^{}]*\}\}|\{\$[^{}]*\}|\{%[^{}]*%\}|\$\{[^{}]*\}|%\([a-z_ ]{1,40}\)s|##[a-z_ ]{1,40}##|@@[a-z_ ]{1,40}@@|<%[^<>]*%>|<insert [^<>]+>"
#: Brackets that ordinary text has too: placeholders if what they hold is the name of a field.
_NAMED = r"\[\[([^\[\]]{1,60})\]\]|\[([a-z_ ]{1,60})\]|%([a-z_]{2,40})%|__([a-z][a-z_ ]{0,40}?)__|<([a-z_ ]{1,40})>"
_SLOT = re.compile(rf"(?:{_BRACED}|{_NAMED}|(\{{[0-9]{{1,2}}\}}))", re.IGNORECASE)
_QUOTES = frozenset("`\"'“”„‘’‚«»‹›")
#: Every placeholder has one of these signs.
_SLOT_SIGN = re.compile(r"[{\[%#@<]|__")
_TAG = re.compile(r"</?(?!noscript|slot>|gap>)[a-z][a-z0-9]{0,15}(?: [^<>]{0,200})?/?>", re.IGNORECASE)
_TOKEN = re.compile(
    r"<slot>|<gap>|</?noscript>|(?:(?<=\s)|^)/[\w./-]+|[\w./-]*/[\w./-]*\w|\w+\.(?:php|py|js|html?)\b|[^\W_]+(?:_[^\W_]+)+|[^\W_]+|[–:=`(),-]", re.IGNORECASE
)
_CODE = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{6,16}$|[0-9a-f]{8}$")
_SENTENCE = re.compile(r"[.!?;]+(?=\s|$)|[\r\n]+")
_FIELD = re.compile(r"[^\W_]+")


def _placeholder(match: re.Match) -> str:
    """What a placeholder counts as: ``<slot>``, ``<gap>`` where it may be something else, nothing in quotes."""
    text, begin, end = match.string, match.start(), match.end()
    if text[begin - 1 : begin] in _QUOTES and text[end : end + 1] in _QUOTES:
        return " "
    if match[6]:
        return " <gap> "
    named = next((g for g in match.groups()[:5] if g), None)
    if named is None:
        return " <slot> "
    words = _FIELD.findall(named.lower().partition("|")[0])
    return " <slot> " if words and all(w in FIELD_WORDS for w in words) else match[0]


def _plain(text: str) -> str:
    """The text in lower case without markup and invisible characters, placeholders by class."""
    plain = html.unescape(text) if "&" in text else text
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", UNSEEN.sub("", plain))
    if _SLOT_SIGN.search(plain):
        plain = _SLOT.sub(_placeholder, plain)
    return (_TAG.sub("\n", plain) if "<" in plain else plain).lower()


def _tokens(plain: str, filler: frozenset[str]) -> list[str]:
    found = _TOKEN.findall(plain)
    classed = [_class_of(t) for t in found]
    if filler and not filler.isdisjoint(classed):
        classed = ["<filler>" if t in filler else t for t in classed]
    again = [i for i, (a, b) in enumerate(zip(found, found[1:]), 1) if a == b] + [i for i, (a, b) in enumerate(zip(found, found[2:]), 2) if a == b]
    for i in again:
        if len(found[i]) > 1 and classed[i] == found[i] and found[i].isalpha():
            classed[i] = "<rep>"
    return classed


def residue_tokens(text: str | None, filler: frozenset[str] = frozenset()) -> list[str]:
    """Tokens of a text with placeholders, numbers, codes, paths, filler and other classes of words by class."""
    return _tokens(_plain(text), filler) if text else []


def sentence_numbers(text: str) -> np.ndarray:
    """The number of the sentence of each token of :func:`residue_tokens`; a line break or a tag ends one too."""
    plain = _plain(text)
    begins = np.array([m.start() for m in _TOKEN.finditer(plain)])
    return np.searchsorted(np.array([m.start() for m in _SENTENCE.finditer(plain)]), begins, "right")


@lru_cache(1 << 16)
def _class_of(token: str) -> str:
    """The token, or the class it counts as."""
    if token[0] == "<":
        return "noscript" if "noscript" in token else token
    if token.isdigit():
        return "<id>" if len(token) == 8 else "<n>"
    if _CODE.match(token):
        return "<id>"
    if "/" in token or "." in token:
        return "<path>"
    return "<filler>" if token in FILLER_WORDS else "<script>" if token in SCRIPT_WORDS else "<doc>" if token in DOC_WORDS else token


@lru_cache(1 << 14)
def exemplar_tokens(passage: str) -> tuple[str, ...]:
    """Tokens of an exemplar as it is written in the list."""
    return tuple(t if t.startswith("<") else _class_of(t) for t in passage.split())


def terms_of(tokens: list[str] | tuple[str, ...]) -> list[tuple[str, ...]]:
    """Single tokens and pairs of neighbours; ``<any>`` is in none of them."""
    single = [(t,) for t in tokens if t != "<any>"]
    return single + [(a, b) for a, b in zip(tokens, tokens[1:]) if "<any>" not in (a, b)]


class Vocabulary:
    """The terms of a list of exemplars."""

    def __init__(self, exemplars: list[str]):
        self.terms = frozenset(term for passage in exemplars for term in terms_of(exemplar_tokens(passage)))
        self.tokens = frozenset(t for term in self.terms for t in term)

    def held(self, tokens: list[str]) -> set[tuple[str, ...]]:
        """The distinct terms that a text's tokens hold."""
        found = {(t,) for t in self.tokens.intersection(tokens)}
        found.update(zip(tokens, tokens[1:]))
        return found & self.terms


def filler_candidates(texts: DataFrame) -> DataFrame:
    """Words that stand between words of the common filler passage in enough of the documents with filler.

    Documents with filler are those with the passage's first words, which alone reach Python. A word is in at least ``FILLER_SHARE`` of the documents with
    filler, so there are at most ``1 / FILLER_SHARE`` times as many as such a document has words beside its filler.
    """

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = residue_tokens(text)
                seeds = np.cumsum([0] + [t == "<filler>" for t in tokens])
                at = np.arange(len(tokens))
                around = seeds[np.minimum(at + FILLER_REACH + 1, len(tokens))] - seeds[np.maximum(at - FILLER_REACH, 0)]
                words = {t for t, k in zip(tokens, around.tolist()) if k >= FILLER_SEEDS and t[0].isalpha() and len(t) > 2}
                n += bool(words)
                seen.update(words)
        rows = [*seen.items(), ("", n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "n"])

    small = F.lower("text")
    seeded = texts.where(small.contains("lorem") | small.contains("ipsum"))
    counts = seeded.select("text").mapInArrow(near, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = dimension(counts)
    whole = counts.where("word = ''").first()
    return counts.where(F.col("word") != "").where(F.col("n") >= max(FILLER_DOCUMENTS, FILLER_SHARE * (whole["n"] if whole else 0)))


def document_frequencies(documents: DataFrame, exemplars: list[str]) -> tuple[int, dict[tuple[str, ...], int], frozenset[str]]:
    """Number of documents, in how many each term of the exemplars occurs, and the corpus' own filler words.

    Counted per partition and added up over all documents; what reaches the driver is one number per exemplar term and
    per candidate for filler. Terms with the class of filler are counted for the words of the common passage.
    """
    vocabulary = Vocabulary(exemplars)
    near = {row["word"]: row["n"] for row in filler_candidates(documents).collect()}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                tokens = residue_tokens(text)
                seen.update(vocabulary.held(tokens))
                seen.update(("\n", t) for t in near.keys() & tokens)
        rows = [("\t".join(term), k) for term, k in seen.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["term", "n"])

    counted = documents.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {tuple(row["term"].split("\t")): row["n"] for row in counted.collect()}
    total = found.pop(("",), 0)
    filler = frozenset(w for w, n in near.items() if n >= FILLER_PURITY * found.get(("\n", w), n))
    return total, {term: n for term, n in found.items() if term[0] != "\n"}, filler


class ExemplarIndex:
    """Inverted index of the exemplars' terms with their TF-IDF weights."""

    def __init__(
        self, exemplars: list[str], documents: int, frequencies: dict[tuple[str, ...], int], filler: frozenset[str] = frozenset(),
        containment: float = CONTAINMENT, coverage: float = COVERAGE,
    ):
        self.containment, self.coverage, self.filler = containment, coverage, filler
        self.vocabulary = Vocabulary(exemplars)
        self.lengths: list[int] = []
        #: exemplars that need not cover a sentence
        self.sure: list[bool] = []
        self.weights: list[dict[tuple[str, ...], tuple[int, float]]] = []
        self.mass: list[float] = []
        self.postings: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, passage in enumerate(exemplars):
            tokens = exemplar_tokens(passage)
            self.lengths.append(len(tokens))
            self.sure.append(len(tokens) >= LONG or not {"<slot>", "<gap>", "noscript"}.isdisjoint(tokens))
            counts = Counter(terms_of(tokens))
            own = {t: (n, self._idf(t, documents, frequencies)) for t, n in counts.items()}
            self.weights.append(own)
            self.mass.append(sum(n * w for n, w in own.values()))
            # enough of an exemplar cannot be held without one of its rarest terms of more than the rest's weight
            spare = (1 - containment) * self.mass[i] + 1e-9
            for t in sorted(own, key=lambda t: (frequencies.get(t, 0), t)):
                self.postings[t].append(i)
                spare -= own[t][0] * own[t][1]
                if spare < 0:
                    break

    @staticmethod
    def _idf(term: tuple[str, ...], documents: int, frequencies: dict[tuple[str, ...], int]) -> float:
        idf = math.log((documents + 1) / (frequencies.get(term, 0) + 1)) + 1
        share = min(CLASS_WEIGHT.get(t, 0.2 if not t[0].isalnum() and t[0] != "<" else 1.0) for t in term)
        return idf * share

    def candidates(self, tokens: list[str]) -> list[int]:
        """Exemplars of which the whole text holds enough, counted as a set of terms."""
        held = self.vocabulary.held(tokens)
        near = {i for term in held for i in self.postings.get(term, ())}
        return [i for i in sorted(near) if sum(n * w for t, (n, w) in self.weights[i].items() if t in held) >= self.containment * self.mass[i]]

    def best_window(self, i: int, tokens: list[str]) -> Iterator[tuple[float, int, int]]:
        """(containment, begin, end) of each window that reaches the threshold, by a sliding count of terms."""
        weights, size = self.weights[i], self.lengths[i] + SLACK
        enough = self.containment * self.mass[i]
        held: Counter = Counter()
        mass = 0.0
        n = len(tokens)
        for end in range(n + min(size, n)):
            # the token at `end` comes in, the one before the window goes out
            if end < n:
                for term in ((tokens[end],), (tokens[end - 1], tokens[end]) if end else None):
                    if term in weights:
                        held[term] += 1
                        if held[term] <= weights[term][0]:
                            mass += weights[term][1]
            begin = end - size
            if begin >= 0:
                for term in ((tokens[begin],), (tokens[begin], tokens[begin + 1]) if begin + 1 < n else None):
                    if term in weights:
                        if held[term] <= weights[term][0]:
                            mass -= weights[term][1]
                        held[term] -= 1
            if mass >= enough - 1e-9 and end < n:
                yield mass / self.mass[i], max(0, begin + 1), end + 1
            if end >= n:
                break

    def residue(self, text: str | None) -> tuple[int, float, float] | None:
        """(exemplar, containment, share of the text's tokens in residue windows), or None."""
        tokens = residue_tokens(text, self.filler)
        found = self.candidates(tokens) if tokens else ()
        if not found:
            return None
        sentence = sentence_numbers(text)
        covered = np.zeros(len(tokens), dtype=bool)
        sure = np.zeros(len(tokens), dtype=bool)
        windows = []
        for i in found:
            own = {t for term in self.weights[i] for t in term}
            for held, begin, end in self.best_window(i, tokens):
                # without the words on either side that are not the exemplar's
                while begin < end and tokens[begin] not in own:
                    begin += 1
                while begin < end and tokens[end - 1] not in own:
                    end -= 1
                covered[begin:end] = True
                sure[begin:end] |= self.sure[i]
                windows.append((held, begin, end, i))
        word = np.array([t[0].isalnum() or t[0] == "<" for t in tokens])
        size = np.bincount(sentence, word)
        full = np.bincount(sentence, covered & word) >= self.coverage * size
        counts = covered & (full[sentence] | sure)
        good = [w for w in windows if counts[w[1] : w[2]].any()]
        if not good:
            return None
        best = max(good, key=lambda w: (w[0], -w[3]))
        return best[3], best[0], float(counts.mean())


def residue_documents(documents: DataFrame, exemplars: list[str] | None = None, containment: float = CONTAINMENT, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, exemplar, containment, coverage`` of the documents (``doc_id, text``) that hold residue.

    Two passes over the texts (and one over those with filler), no shuffle of texts: one counts document frequencies,
    one matches. The column ``coverage`` is the share of the text's tokens that lie in residue windows.
    """
    chosen = labelled() if exemplars is None else exemplars
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    total, frequencies, filler = document_frequencies(texts, chosen)
    shared = documents.sparkSession.sparkContext.broadcast((chosen, total, frequencies, filler, containment, coverage))

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ExemplarIndex(*shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = index.residue(text)
                if found:
                    rows.append((doc, shared.value[0][found[0]], found[1], found[2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "exemplar", "containment", "coverage"])

    found = texts.mapInArrow(match, "doc_id bigint, exemplar string, containment double, coverage double")
    return found.groupBy("doc_id").agg(F.max_by("exemplar", "containment").alias("exemplar"), F.max("containment").alias("containment"), F.max("coverage").alias("coverage"))


def without_residue(documents: DataFrame, **options) -> DataFrame:
    """The documents that hold no residue; rows with a null id or text stay."""
    return documents.join(residue_documents(documents, **options).select("doc_id"), "doc_id", "left_anti")
