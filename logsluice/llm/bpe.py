"""Byte-level BPE by forced boundaries: certain cuts first, then each fragment on its own.

1. No token spans the places where the pre-tokenizer parts words, nor a place between two bytes that never stand side by side
   inside any token of the vocabulary. Both are certain cuts, found for a whole batch at once: the first from classes of
   characters, the second by one look into a table of 256 x 256 pairs.
2. Merges never cross a certain cut and their order depends on ranks alone, so each fragment's ids follow from the fragment.
   A worker keeps the ids of short fragments and merges only new ones, in O(n log n) of their length.
3. A text's ids are those of its fragments in turn. Decoding joins the tokens' bytes.

The library is asked for the classes of characters alone (its Unicode version decides), once for each distinct character.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_rows, texts_of
from .tokens import _LETTERS, BYTE_BPE, tokenizer, tokenizer_path

#: Fragments that a worker remembers, and the longest that it does.
MEMORY, REMEMBERED = 1_000_000, 64
#: Longer texts are taken in parts of about so many characters, which end where white space follows a word.
PART = 1 << 20
_PART_END = re.compile(r"(?<=\S)(?=[ \n])")
_LETTER, _DIGIT, _SPACE, _OTHER, _BREAK = 1, 2, 3, 4, 5
#: Endings that the pre-tokenizer parts from a word, after an apostrophe (fixed values of byte-level BPE).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class _Fragments(dict):
    """fragment -> its ids as little-endian 32-bit integers."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int]) -> None:
        self.merges, self.byte_ids = merges, byte_ids

    def __missing__(self, fragment: bytes) -> bytes:
        ids = array("I", merged([self.byte_ids[b] for b in fragment], self.merges)).tobytes()
        if len(fragment) <= REMEMBERED:
            if len(self) >= MEMORY:
                self.clear()
            self[fragment] = ids
        return ids


def merged(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of least rank, the leftmost of these, until none is left."""
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(*merges[pair], k, pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
    heapq.heapify(heap)
    while heap:
        _, new, k, (left, right) = heapq.heappop(heap)
        n = after[k]
        if ids[k] != left or n >= len(ids) or ids[n] != right:
            continue  # one of the two has been merged meanwhile
        ids[k], ids[n], after[k] = new, -1, after[n]
        if after[k] < len(ids):
            before[after[k]] = k
            if (pair := (new, ids[after[k]])) in merges:
                heapq.heappush(heap, (*merges[pair], k, pair))
        if before[k] >= 0 and (pair := (ids[before[k]], new)) in merges:
            heapq.heappush(heap, (*merges[pair], before[k], pair))
    return [x for x in ids if x >= 0]


class Coder:
    """Encodes and decodes with a byte-level BPE file, as the tokenizers library does with special tokens in the text recognised."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte_of = {c: b for b, c in enumerate(_LETTERS)}
        vocab: dict[str, int] = model["vocab"]
        pieces = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocab.items()}
        joined = lambda pair: pair if isinstance(pair, list) else pair.split(" ")
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(joined, model["merges"]))}
        self.fragments = _Fragments(merges, [vocab[c] for c in _LETTERS])
        #: Whether two bytes stand side by side in no token: their place is a certain cut.
        self.apart = np.ones(1 << 16, bool)
        for p in pieces.values():
            both = np.frombuffer(p, np.uint8).astype(np.int64)
            self.apart[both[:-1] << 8 | both[1:]] = False
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pieces |= {i: token.encode() for token, i in self.added.items()}
        self.pieces = np.array([pieces.get(i, b"") for i in range(max(pieces) + 2)], object)  # the last stands for unknown ids
        self.classes = np.zeros(0x110000, np.int8)
        self._ask = tokenizer(path).pre_tokenizer.pre_tokenize_str
        self._classify(np.arange(128))

    def _classify(self, points: np.ndarray) -> None:
        for k in points.tolist():
            c, ends = chr(k), lambda text: [end for _, (_, end) in self._ask(text)]
            if 0xD800 <= k < 0xE000:
                kind = _OTHER
            elif ends("a" + c)[0] == 2:
                kind = _LETTER
            elif ends(c + "1")[0] == 2 and c != " ":
                kind = _DIGIT
            else:
                kind = _OTHER if ends("!" + c)[0] == 2 else _SPACE
            self.classes[k] = kind

    def _cuts(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where the pre-tokenizer starts a new part; breaks are the places of separators, parts of their own."""
        kinds = self.classes[points]
        if not kinds.all():
            self._classify(np.unique(points[kinds == 0]))
            kinds = self.classes[points]
        kinds[breaks] = _BREAK
        before, after = np.empty_like(kinds), np.empty_like(kinds)
        before[0], before[1:] = _BREAK, kinds[:-1]
        after[-1], after[:-1] = _BREAK, kinds[1:]
        blank = points == 32
        # A run of white space leaves its last character to the word after it; that character belongs to the word if it is a space.
        in_space = (kinds == _SPACE) & (before == _SPACE)
        cut = (kinds != before) | (kinds == _BREAK)
        cut |= in_space & (after != _SPACE) & (after != _BREAK)
        joins = blank[:-1] & (kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _BREAK)
        cut[1:] &= ~joins
        marks = np.flatnonzero((points == 39) & cut & (kinds == _OTHER))
        for ending in _ENDINGS:
            at = marks[marks + len(ending) < len(points)]
            for k, c in enumerate(ending, 1):
                at = at[points[at + k] == ord(c)]
            cut[at + 1] = False
            cut[at[at + len(ending) + 1 < len(points)] + len(ending) + 1] = True
        return cut

    def fragments_of(self, parts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all parts with a separator after each, where fragments start, and which of them are separators."""
        text = "\0".join(parts) + "\0"
        points = code_points(text)
        breaks = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        cut = self._cuts(points, breaks)
        if points.dtype == np.uint8:
            data, whole, ends = points.tobytes(), points, breaks
        else:
            data = text.encode()
            whole = np.frombuffer(data, np.uint8)
            sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            by_byte = np.zeros(len(whole), bool)
            by_byte[starts[cut]] = True
            cut, ends = by_byte, starts[breaks]
        cut[1:] |= self.apart[whole[:-1].astype(np.uint16) << 8 | whole[1:]]
        at = np.flatnonzero(cut)
        return data, at, np.searchsorted(at, ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        parts: list[str] = []
        specials: list[bytes] = []  # what follows each part
        last = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for n, piece in enumerate(self._added.split(text) if self._added else [text]):
                if n % 2:
                    specials[-1] = array("I", [self.added[piece]]).tobytes()
                    continue
                at = 0
                while len(piece) - at > PART and (m := _PART_END.search(piece, at + PART)):
                    parts.append(piece[at : m.start()])
                    specials.append(b"")
                    at = m.start()
                parts.append(piece[at:])
                specials.append(b"")
            last[k] = len(parts) - 1
        data, starts, separators = self.fragments_of(parts)
        found = list(map(self.fragments.__getitem__, map(data.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(data)]))))
        for k, special in zip(separators.tolist(), specials):
            found[k] = special
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        return np.frombuffer(b"".join(found), np.uint32), ends[separators[last]]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become replacement characters; unknown ids become nothing."""
        return b"".join(self.pieces[np.where((ids < 0) | (ids >= len(self.pieces)), len(self.pieces) - 1, ids)].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)  # a worker's later tasks go on with the same memory
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, special tokens in it recognised, none added.

    A null or empty text has no ids. Repeated rows and null ids are documents of their own; extra columns are ignored.
    """
    path = path or tokenizer_path(BYTE_BPE)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encode = coder(path).encode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = encode(texts_of(batch.column(1)))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of ids, special tokens kept. Null ids count as none; an id outside the vocabulary gives nothing."""
    path = path or tokenizer_path(BYTE_BPE)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        decode = coder(path).decode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1)
            texts = [decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column]
            return pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

        return each

    filled = F.coalesce(F.filter(F.col("ids").cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))
    return map_rows(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), filled.alias("ids")), make, "doc_id long, ids array<int>, text string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    back = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
