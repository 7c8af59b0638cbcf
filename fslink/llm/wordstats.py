"""Word, line and repeat statistics of texts, over Arrow's own string buffers with numpy.

A word is a run of characters other than U+0020 and U+0009 to U+000D; lines are what ``\\n``
separates.  Texts are taken in groups of about a megabyte, however long each is, and whole.
Hashes find the texts with repeated windows; exact comparison of their words then decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: UTF-8 bytes of texts looked at together (a longer text is a group by itself).
GROUP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, step in enumerate((_BASE, inverse)):
            factors = np.full(max(n, GROUP_BYTES + 1), step, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


class Spans:
    """Texts' bytes with document offsets, and 64-bit hashes of any spans of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        up, self.down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past the last, bytes, offsets from 0) of groups of texts; null is empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, what = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, their documents, and the mask of bytes in words."""
    inside = ~white(data)
    before = np.empty(len(data), dtype=bool)
    before[1:] = inside[:-1]
    if len(data):
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        before[0] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[:-1] = inside[1:]
    if len(data):
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, inside


def repeated_words(tokens: list[str], window: int = WINDOW) -> list[bool]:
    """For each word, whether a window of so many words that is found twice or more covers it."""
    covered = [False] * len(tokens)
    first: dict[tuple, int] = {}
    for i in range(len(tokens) - window + 1):
        key = tuple(tokens[i : i + window])
        j = first.setdefault(key, i)
        if j != i:
            covered[i : i + window] = [True] * window
            covered[j : j + window] = [True] * window
    return covered


def document_words(text: str) -> list[str]:
    return WORD.findall(text)


def _within(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per-byte counts within consecutive offsets."""
    sums = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CLASSES = {
    "chars": lambda d: (d & 0xC0) != 0x80,
    "symbols": lambda d: _IS_SYMBOL[d],
    "capitals": lambda d: (d >= 65) & (d <= 90),
    "letters": lambda d: ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 0xC0),
    "digits": lambda d: (d >= 48) & (d <= 57),
    "shouts": lambda d: d == 33,
    "bars": lambda d: d == 124,
    "stops": lambda d: (d == 46) | (d == 44),
}
#: Columns of ``Group.lines`` and ``Group.docs``, in order.
COUNTS = ("bytes", "words", "word_chars", *_CLASSES, "repeats", "same_words")


class Group:
    """Statistics of one group of texts.

    docs: one row of COUNTS per text.  lines: one row per line, with line_doc naming its text;
    line_dup marks lines with a word that equal an earlier line of their text.
    n_dup_lines: such lines per text.
    """

    def __init__(self, texts: pa.Array, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        n = last - first
        starts, ends, doc, inside = words(data, offsets)
        spans = Spans(data, offsets)
        hashes = spans.hashes(starts, ends)
        covered = self._repeats(texts, first, starts, ends, doc, hashes)
        breaks = np.flatnonzero(data == 10) + 1
        bounds = np.sort(np.concatenate([offsets[:-1], breaks]))  # every line's start; an empty text has one line
        limits = np.append(bounds, len(data))
        self.line_doc = np.repeat(np.arange(n), 1 + _within(data == 10, offsets))
        word_line = np.searchsorted(bounds, starts, side="right") - 1
        same = np.zeros(len(starts), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        masks = [f(data) for f in _CLASSES.values()]
        per_line = [np.diff(limits), np.bincount(word_line, minlength=len(bounds)), _within(masks[0] & inside, limits)]
        per_line += [_within(m, limits) for m in masks]
        per_line += [np.bincount(word_line, weights=w, minlength=len(bounds)) for w in (covered, same)]
        self.lines = np.stack([np.asarray(x, dtype=np.float64) for x in per_line], axis=1)
        self.docs = np.zeros((n, len(COUNTS)))
        np.add.at(self.docs, self.line_doc, self.lines)
        self.n_lines = np.bincount(self.line_doc, minlength=n)
        self.line_dup = self._same_lines(texts, first, n)
        self.n_dup_lines = np.bincount(self.line_doc, weights=self.line_dup, minlength=n).astype(np.int64)

    @staticmethod
    def _repeats(texts, first, starts, ends, doc, hashes) -> np.ndarray:
        covered = np.zeros(len(starts), dtype=bool)
        m = len(starts) - WINDOW + 1
        if m < 2:
            return covered
        key = mix(doc[:m].astype(np.uint64))
        for j, factor in enumerate(_FACTORS):
            key = key + hashes[j : j + m] * factor
        key = mix(key)[doc[:m] == doc[WINDOW - 1 :]]
        owner = doc[:m][doc[:m] == doc[WINDOW - 1 :]]
        order = np.argsort(key)
        twice = key[order][1:] == key[order][:-1]
        for d in np.unique(owner[order[1:][twice]]):
            a, b = np.searchsorted(doc, [d, d + 1])
            covered[a:b] = repeated_words(document_words(texts[first + int(d)].as_py()))
        return covered

    def _same_lines(self, texts, first: int, n: int) -> np.ndarray:
        found = np.zeros(len(self.line_doc), dtype=bool)
        at = 0
        for d in range(n):
            count = int(self.n_lines[d])
            if count > 1:
                seen = set()
                for k, line in enumerate(texts[first + d].as_py().split("\n")):
                    if line in seen:
                        found[at + k] = bool(line.strip(WHITE))
                    else:
                        seen.add(line)
            at += count
        return found

    def column(self, name: str) -> np.ndarray:
        return self.docs[:, COUNTS.index(name)]


def measured(texts: pa.Array) -> Iterator[Group]:
    """Statistics of all texts, group by group, in order."""
    for first, last, data, offsets in groups(texts):
        yield Group(texts, first, last, data, offsets)
