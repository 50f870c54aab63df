"""Token ids of whole texts, as the tokenizers library gives them, at a multiple of its speed.

The library's own model (`Tokenizer.model`) turns each distinct pre-token into ids once; texts are cut into
pre-tokens with the vocabulary's own pattern and their ids joined from a bounded memo. Both vocabularies cut a
text at places that do not depend on what lies beyond white space, so ids of the parts are ids of the whole.
Texts that hold a special string go through the library as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from .common import Memo

#: Unicode White_Space, what \s means to the library (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The two vocabularies' patterns (fixed values; \s spelled out).
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: its own where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def spelled(s: str) -> str:
    """A pre-token in byte letters."""
    if s.isascii() and s.isprintable():
        return s.replace(" ", LETTERS[32])
    return s.encode("utf-8", "replace").decode("latin-1").translate(LETTERS)


@lru_cache(maxsize=1)
def doubtful() -> re.Pattern:
    """Code points that are letters or numbers to one Unicode version here and not to another: the library decides."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No"}
    one, other = set("".join(regex.findall(r"[\p{L}\p{N}]+", every))), {c for c, k in zip(every, map(unicodedata.category, every), strict=True) if k in kinds}
    points = sorted(map(ord, one ^ other))
    starts = [p for p, q in zip(points, [-2, *points], strict=False) if p != q + 1]
    stops = [p for p, q in zip(points, [*points[1:], -2], strict=True) if p + 1 != q]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, stops, strict=True)) + "]" if points else r"(?!)")


WIDE = "".join(c for c in SPACES if not c.isascii())


@lru_cache(maxsize=1)
def rare() -> re.Pattern:
    """Wide spaces, doubtful code points, and all beyond U+FFFF: one class that is quick to search, as no slow ranges are in it."""
    low = "".join(doubtful().findall("".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]))))
    return re.compile(f"[{WIDE}{low}\U00010000-\U0010ffff]")


def lowered(text: str) -> str:
    """Lower case letter by letter (no final sigma), after canonical composition."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, words: int = 350_000, parts: int = 200_000):
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.part = Memo(self._part, parts)
        self.word = Memo(self._word, words)
        self.lower = self.tok.normalizer is not None
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        # a word vocabulary's texts are cut by split(), which also cuts at these; a byte vocabulary's are cut at single spaces and breaks
        self.odd = "\x1c\x1d\x1e\x1f" if self.lower else [*"\t\x0b\x0c\r", "  ", " \n", "\n ", "\n\n"]
        self.runs = re.compile(rf"[^{SPACES}]+")

    def _part(self, s: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelled(s))]).tobytes()

    def _word(self, s: str) -> bytes:
        if not self.lower:  # a line break stands for itself; anything else follows a space
            if s.isalpha():  # one pre-token, kept as a word only
                return self._part(" " + s)
            s = s if s[0] == "\n" else " " + s
        elif s.isalpha() and s.isascii():
            return self._part(s)
        return b"".join(map(self.part.__getitem__, self.pattern.findall(s)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        plain = text.isascii() or not rare().search(text)
        if any(s in text for s in self.specials) or not plain and doubtful().search(text):
            return self.whole(text)
        if self.lower:
            text = lowered(text)
            return b"".join(map(self.word.__getitem__, self.runs.findall(text) if any(s in text for s in self.odd) else text.split()))
        if any(s in text for s in self.odd) or text[0] in " \n" or text[-1] in " \n" or not plain and any(s in text for s in WIDE):
            return b"".join(map(self.part.__getitem__, self.pattern.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.part.__getitem__, self.pattern.findall(first)), *map(self.word.__getitem__, rest)])


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One per worker process and vocabulary."""
    return Ids(path)
