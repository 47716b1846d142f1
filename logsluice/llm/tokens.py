"""Whole texts to token ids with a public tokenizer file, a word at a time.

A pre-tokenizer never joins what white space parts, so a text's ids are those of its white-space segments in turn. Each
worker keeps the ids of segments that it has met, and gives only new segments to the tokenizers library.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache

import numpy as np

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Segments that a worker remembers (about 200 bytes each); beyond it, it forgets all and starts anew. Only segments met before
#: are remembered: most of a corpus' distinct segments come once. SEEN bits tell (by hash) which have been met.
MEMORY = 1_000_000
SEEN = 1 << 24
#: Characters that count as white space for Python alone: such texts, and those with special tokens, go to the library whole.
_OWN_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: White space other than single spaces and line ends.
_ODD_SPACE, _WIDE_SPACE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"), re.compile(r"[^\S \n]")
_SEGMENT = re.compile(r"\s*\S+|\s+\Z")
#: One run of Latin letters, perhaps with marks after it: the pre-tokenizers part these two and nothing else, so that the
#: library's model can be asked for each directly.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,!?;:|#$%&*@()+=/]*)")
#: Byte-level vocabularies spell each byte as one letter: a printable Latin-1 character as itself, the others as the letters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted({*range(256)} - {*_PRINTABLE})
_LETTERS = "".join(chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory(dict):
    """segment -> ids of prefix + segment as little-endian 32-bit integers, asked of the library once."""

    def __init__(self, tool, prefix: str, lower: bool) -> None:
        self.tool, self.model, self.prefix, self.lower = tool, tool.model, prefix, lower
        self.ends: dict[str, bytes] = {"": b""}
        self.seen = bytearray(SEEN >> 3)

    def clear(self) -> None:
        super().clear()
        self.seen = bytearray(SEEN >> 3)

    def _model(self, piece: str) -> bytes:
        """Of a piece that the pre-tokenizer leaves whole."""
        return array("I", [x.id for x in self.model.tokenize(charmap_decode(piece.encode(), "strict", _LETTERS)[0])]).tobytes()

    def __missing__(self, segment: str) -> bytes:
        if not self.lower and segment.isalpha():
            ids = self._model(self.prefix + segment)
        elif m := _PLAIN.fullmatch(segment):
            word, end = m.groups()
            if end not in self.ends:
                self.ends[end] = self._model(end)
            ids = (end and self.get(word) or self._model(self.prefix + (word.lower() if self.lower else word))) + self.ends[end]
        else:
            ids = array("I", self.tool.encode(self.prefix + segment, add_special_tokens=False).ids).tobytes()
        at = hash(segment)
        byte, bit = (at >> 3) & (SEEN >> 3) - 1, 1 << (at & 7)
        if self.seen[byte] & bit:
            self[segment] = ids
        else:
            self.seen[byte] |= bit
        return ids


@lru_cache(maxsize=4)  # a worker's later tasks go on with the same memory
def encoder(path: str, spaced: bool) -> Callable[[str], np.ndarray]:
    """text -> its ids (uint32), as tokenizer.encode(text, add_special_tokens=False).

    spaced: the tokenizer keeps white space and case, so a segment takes the white space before it along (byte-level
    BPE); else it lowers letters, and white space only parts words and is dropped.
    """
    tool = tokenizer(path)
    bare, after_space = _Memory(tool, "", not spaced), _Memory(tool, " ", False)

    def encode(text: str) -> np.ndarray:
        if "<|" in text or any(x in text for x in _OWN_SPACE):
            return np.array(tool.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(bare) + len(after_space) > MEMORY:
            bare.clear()
            after_space.clear()
        if not spaced:
            ids = map(bare.__getitem__, text.split())
        elif any(x in text for x in _ODD_SPACE) or not text.isascii() and _WIDE_SPACE.search(text):
            ids = [after_space[x[1:]] if x[0] == " " else bare[x] for x in _SEGMENT.findall(text)]
        else:
            parts = text.split(" ")
            ids = [bare[parts[0]] if parts[0] else b"", *map(after_space.__getitem__, parts[1:])]
        return np.frombuffer(b"".join(ids), np.uint32)

    return encode
