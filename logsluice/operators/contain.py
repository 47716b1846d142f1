"""Which names contain which: hashes of windows of only those lengths that occur on the other side.

A name of length L is inside another if the other has a window of L letters with the same hash; all windows of one length come
from one pass over prefix sums, so a long name costs its length times the number of distinct lengths, never its substrings.
Hashes only propose: pairs are compared word for word. Few names (counted first) are broadcast as sorted hashes and
matched on the spot; more meet the windows in a hash join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept_table

#: Distinct names up to which their hashes are broadcast (8 bytes each).
FEW = 1_000_000
#: Letters that one step looks at, and windows that one output batch holds.
LETTERS, ROWS = 1 << 20, 1 << 18
_FACTOR = 0x9E3779B97F4A7C15


def _windows(texts: list[str], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each length: which text, and the hash, of every window of so many letters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    up, down = np.full(n + 1, _FACTOR, np.uint64), np.full(n + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[:n], dtype=np.uint64)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(n)  # letters from here to the end of its text
    for length in lengths:
        if length == 0:
            yield np.arange(len(texts)), np.zeros(len(texts), np.uint64), 0
            continue
        at = np.flatnonzero(left >= length)
        if not len(at):
            break
        x = (sums[at + length] - sums[at]) * down[at]
        x ^= x >> np.uint64(31)
        yield owner[at], (x * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(length), length


def _hashed(names: DataFrame, lengths: list[int] | None, known: np.ndarray | None = None) -> DataFrame:
    """(id, size, h): the windows of each name of the given lengths (in rising order), or, with None, of its whole length.

    known: sorted hashes; other windows are left out.
    """

    def rows(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        for owner, h, size in _windows(texts, sorted(set(map(len, texts))) if lengths is None else lengths):
            if lengths is None:
                whole = np.array([len(t) == size for t in texts])
                owner, h = owner[whole[owner]], h[whole[owner]]
            if known is not None:
                place = np.searchsorted(known, h)
                hit = known[np.minimum(place, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                owner, h = owner[hit], h[hit]
            both = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)
            for k in range(0, both.shape[1], ROWS):
                part = both[:, k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[part[0].astype(np.int64)]), pa.array(np.full(part.shape[1], size, np.int32)), pa.array(part[1].view(np.int64))], ["id", "size", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            texts: list[str] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                texts.append(text)
                if sum(map(len, texts[-64:])) > LETTERS // 64 or len(texts) >= 4096:
                    yield from rows(ids, texts)
                    ids, texts = [], []
            if texts:
                yield from rows(ids, texts)

    return names.select("id", "name").mapInArrow(run, "id long, size int, h long")


def _inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer_id, inner_id): stored tables (id, name) with distinct names; the pairs whose hashes meet."""
    whole = kept_table(_hashed(inner, None), "names")
    lengths = sorted(r["size"] for r in whole.select("size").distinct().collect())  # as many as there are lengths of names
    known = None
    if whole.count() <= FEW:
        known = np.sort(np.array([r.h for r in whole.select("h").collect()], np.int64).view(np.uint64))
    windows = _hashed(outer, lengths, known).withColumnRenamed("id", "outer_id")
    return windows.join(whole.withColumnRenamed("id", "inner_id"), ["size", "h"]).select("outer_id", "inner_id").distinct()


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name): all pairs of distinct names of which one contains the other. Nulls match nothing, the empty name
    is inside every name. left and right have one column of names."""

    def numbered(names: DataFrame, label: str) -> DataFrame:
        distinct = names.toDF("name").filter("name IS NOT NULL").distinct()
        return kept_table(distinct.withColumn("id", F.monotonically_increasing_id()), label)

    a, b = numbered(left, "left-names"), numbered(right, "right-names")
    pairs = _inside(a, b).toDF("a", "b").unionByName(_inside(b, a).toDF("b", "a")).distinct()
    named = pairs.join(a.select(F.col("id").alias("a"), F.col("name").alias("left_name")), "a").join(b.select(F.col("id").alias("b"), F.col("name").alias("right_name")), "b")
    return named.filter(F.contains("left_name", "right_name") | F.contains("right_name", "left_name")).select("left_name", "right_name")
