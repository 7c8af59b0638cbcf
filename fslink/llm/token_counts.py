"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A text of more than ``CHUNK`` characters is cut
into chunks that overlap.  Each chunk is encoded with offsets; in an overlap both chunks give their
own token boundaries.  The vocabulary's splitter looks at a character and at what stands right
before and after it, so a cut between pieces is proven stable where both encodings have a token
boundary and the text has a letter or digit before it and a single space after it that a letter or
digit follows: no piece of the pattern reaches over that place, whatever surrounds it.  There the
two chunks are spliced.  Without such a place the overlap is doubled, in the end to the whole text.

Shorter texts go through a cache: where a single space stands between two visible characters, the
same argument lets a text be cut before the space, and a piece met before costs one lookup.  A text
with a space of any other kind goes to the library whole.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted alike;
an empty table gives an empty result; other columns are ignored.  A very long text takes memory for one
chunk's offsets, about 100 bytes a token; only a text without any stable place, such as one of a script
without spaces, for all of its tokens.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.llm.common import tokenizer_path
from fslink.llm.word_bpe import Generations, byte_alphabet

LIMIT = 512
CHUNK = 32_768
OVERLAP = 512
#: Characters of other texts that go to the library in one call.
CALL_CHARS = 1 << 18

# Visible characters at which both the pattern and this module agree that they aren't white space.
_UNSURE = re.compile("^ | $|  |[^!-~\xa1-\xac\xae-\u024f] | [^!-~\xa1-\xac\xae-\u024f]")
_PLAIN = re.compile("[!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PARTS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[^A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

_tokenizers: dict = {}
_pieces: dict = {}


class PieceCounts(Generations):
    """piece -> its tokens; with ``space`` a space stands before the piece."""

    def __init__(self, full, space: bool, bare: PieceCounts | None = None):
        super().__init__()
        self.full, self.space, self.bare = full, " " if space else "", bare
        self.model, self.letters = full.model, byte_alphabet()
        self.before = self.letters[32] if space else ""

    def made(self, piece: str) -> int:
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            return len(self.full.encode(self.space + piece, add_special_tokens=False).ids)
        first, *rest = _PARTS.findall(piece)
        if rest:
            bare = self.bare or self
            return self[first] + sum([bare[p] for p in rest])
        if not first.isascii():
            first = "".join(map(self.letters.__getitem__, first.encode()))
        return len(self.model.tokenize(self.before + first))


def piece_counts(name: str) -> tuple[PieceCounts, PieceCounts]:
    """The worker's own caches for pieces at a text's start and after a space."""
    if name not in _pieces:
        full = tokenizer(name)
        bare = PieceCounts(full, False)
        _pieces[name] = bare, PieceCounts(full, True, bare)
    return _pieces[name]


def tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    if name not in _tokenizers:
        _tokenizers[name] = Tokenizer.from_file(tokenizer_path(name))
    return _tokenizers[name]


def _stable(text: str, at: int) -> bool:
    """Whether the pattern must break before the space at ``at``."""
    return text[at] == " " and text[at - 1].isascii() and text[at - 1].isalnum() and text[at + 1].isascii() and text[at + 1].isalnum()


def _boundaries(encode, text: str, start: int, stop: int) -> list[int]:
    """The start of each token of text[start:stop], as places in text."""
    return [start + a for a, _ in encode(text[start:stop], add_special_tokens=False).offsets]


def count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` is the tokenizer's method."""
    if len(text) <= chunk:
        return len(encode(text, add_special_tokens=False).ids)
    start, total = 0, 0
    stop = chunk
    here = _boundaries(encode, text, start, stop)
    while stop < len(text):
        width, spliced = overlap, False
        while not spliced:
            left = max(start, stop - width)
            if left == start:  # no stable place at all: take the chunk and the next as one
                stop = min(len(text), stop + max(chunk, stop - start))
                here = _boundaries(encode, text, start, stop)
                break
            right = min(len(text), left + chunk)
            right = max(right, min(len(text), stop + width))
            ahead = _boundaries(encode, text, left, right)
            shared = set(here) & set(ahead)
            # Away from the edges of the overlap, where a chunk's own cut shapes its tokens.
            middle = [p for p in shared if left < p < stop - 1 and _stable(text, p)]
            if middle:
                at = min(middle, key=lambda p: (abs(p - (left + stop) // 2), p))
                total += bisect.bisect_left(here, at)
                start, stop, here = at, right, ahead[bisect.bisect_left(ahead, at) :]
                spliced = True
            width *= 2
    return total + len(here)


def counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(vocabulary)
        bare, spaced = piece_counts(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [0] * len(texts)
            call: list[int] = []
            size = 0
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    found[i] = count(made.encode, text, chunk, overlap)
                    continue
                if not _UNSURE.search(text):
                    head, *tail = text.split(" ")
                    found[i] = (bare[head] if head else 0) + sum(map(spaced.__getitem__, tail))
                    continue
                call.append(i)
                size += len(text)
                if size >= CALL_CHARS:
                    for j, e in zip(call, made.encode_batch([texts[j] for j in call], add_special_tokens=False)):
                        found[j] = len(e)
                    call, size = [], 0
            for j, e in zip(call, made.encode_batch([texts[j] for j in call], add_special_tokens=False)):
                found[j] = len(e)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
