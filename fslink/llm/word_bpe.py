"""Token ids of the white-space-dropping BPE vocabulary, with a bounded cache of words.

The vocabulary's normaliser turns runs of white space into one space and its splitter drops them,
so no token, contraction or special token reaches across a space or a line feed, and Unicode
composition doesn't either.  The ids of a text are therefore the ids of its chunks between spaces
and line feeds, one after the other.  A chunk met before costs one dictionary lookup.

A chunk of ASCII or Latin-1 letters, digits and marks goes to the library's BPE model directly
(lower-cased, in the byte alphabet, split as the vocabulary's pattern does); all other chunks go
through the library's full ``encode``.  A text of such chunks alone is split by that pattern at once, so
that capitals and marks at a word make no words of their own.
"""

from __future__ import annotations

import re
import sys
from array import array

from fslink.llm.common import tokenizer_path

#: Words in each of a worker's two generations: about 200 bytes each.
CACHE_WORDS = 500_000
#: Whole chunks in each of two generations, of texts that aren't plain.
CACHE_CHUNKS = 100_000
#: Chunks longer than this aren't kept.
CACHE_CHARS = 40

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as this machine's unsigned 32-bit integers, which must be little-endian")

_PLAIN_TEXT = re.compile(r"[ \n!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_RUNS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff \n]+")
_PLAIN = re.compile(r"[!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's alphabet: printable Latin-1 bytes stand for themselves, the other bytes
    for the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = (x for x in range(256, 512))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


class Generations(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one, and
    what is used again moves back, so frequent words stay."""

    def __init__(self, most: int | None = None):
        super().__init__()
        self.old: dict = {}
        self.most = most or CACHE_WORDS

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.made(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class PartIds(Generations):
    """part -> its ids as little-endian unsigned 32-bit integers, in bytes; a part is a run of lower-case
    letters, a digit, or a run of marks."""

    def __init__(self, model):
        super().__init__(CACHE_WORDS)
        self.tokenize, self.letters = model.tokenize, byte_alphabet()

    def made(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.tokenize(part)]).tobytes()


class WordIds(Generations):
    """chunk -> its ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE_CHUNKS)
        self.full = Tokenizer.from_file(file)
        self.parts = PartIds(self.full.model)

    def made(self, word: str) -> bytes:
        if "<|" not in word and _PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, _RUNS.findall(word.lower())))
        return array("I", self.full.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _RUNS.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ready: dict[str, WordIds] = {}


def word_ids(name: str = "word_bpe_49k.json") -> WordIds:
    """The worker's own cache for the vocabulary file ``name``."""
    if name not in _ready:
        _ready[name] = WordIds(tokenizer_path(name))
    return _ready[name]
