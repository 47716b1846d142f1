"""Quartile bucket digests of documents, and how alike two digests are.

Every window of five bytes gives six byte triplets, hashed into 256 buckets. The digest is text: two hex digits for the
logarithm of the length, two for how the bucket quartiles compare, and for every bucket two bits that tell in which
quartile of the document's own bucket counts it lies. Equal texts have equal digests; a changed part moves few buckets.
A text of fewer than five bytes has no window: all such texts have the digest of their length alone, and are alike but for that.
"""

from __future__ import annotations

import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, map_rows, small_batches, texts_of, written

BUCKETS = 256
SPAN = 5
#: The places of a window's triplets.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: What codes that differ by 0 to 3 quartiles add to the difference; differences of MOST or more count as nothing alike.
STEPS = np.array([0, 1, 2, 6])
MOST = 320


def counts(data: np.ndarray) -> np.ndarray:
    """Of the triplets of all windows, how many fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    n = len(data) - SPAN + 1
    for at in range(0, max(n, 0), 1 << 18):  # blocks, so that a long text takes little memory
        block = data[at : min(at + (1 << 18), n) + SPAN - 1].astype(np.uint32)
        m = len(block) - SPAN + 1
        for salt, (a, b, c) in enumerate(TRIPLETS):
            x = block[a : a + m] | block[b : b + m] << np.uint32(8)
            x |= block[c : c + m] << np.uint32(16)
            x += np.uint32(salt * 0x2545F491 & 0xFFFFFFFF)
            x *= np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            total += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return total


def encoded(total: np.ndarray, n: int) -> str:
    """The digest of a text of n bytes with these bucket counts."""
    q1, q2, q3 = (int(x) for x in np.partition(total, [63, 127, 191])[[63, 127, 191]])
    codes = (total > q1).astype(np.uint8) + (total > q2) + (total > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)
    ratio = lambda q: min(15, 16 * q // (q3 + 1))
    return f"{min(255, round(8 * log(1 + n))):02x}{ratio(q1):x}{ratio(q2):x}" + packed.tobytes().hex()


def digest(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return encoded(counts(data), len(data))


def _codes(mark: str) -> np.ndarray:
    return (np.frombuffer(bytes.fromhex(mark[4:]), np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(np.int8)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: one less the digests' bounded difference score over MOST."""
    apart = int(STEPS[np.abs(_codes(a) - _codes(b))].sum())
    apart += max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1) + sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))
    return 1.0 - min(apart, MOST) / MOST


class _Document:
    def __init__(self, key, text: str) -> None:
        self.key, self.text = key, text
        self.data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        self.counts = counts(self.data)
        self.mark = encoded(self.counts, len(self.data))

    def against(self, after: _Document) -> tuple:
        """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)"""
        n = len(self.text)
        cut = n - n // 4
        head, tail = self.text[:cut].encode("utf-8", "replace"), after.text[: n // 4].encode("utf-8", "replace")
        edited = np.frombuffer(head + tail, np.uint8)
        kept = max(0, len(head) - SPAN + 1)  # the windows before it are those of the text itself
        mark = encoded(self.counts - counts(self.data[kept:]) + counts(edited[kept:]), len(edited))
        return self.key, n, hashlib.sha256(edited.tobytes()).hexdigest(), self.mark, mark, likeness(self.mark, mark), likeness(self.mark, after.mark)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint) for every row; null texts count as empty, null ids stay. The plain operator."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([digest(x) for x in texts])], ["doc_id", "n_chars", "fingerprint"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_chars long, fingerprint string")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's digest, its edited text's, and how alike they and the next document's are.

    The next document is the one with the next doc_id; the first follows the last. Rows with a null id come first; rows
    with equal ids follow each other in any order. Texts cross the network once, dealt out by ranges of doc_id; a range's
    last document meets the next range's first in a second, small step over two rows of each range.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        held = None
        rows: list[tuple] = []
        edge = lambda kind, part, d: (kind, part, *[None] * 7, d.key, d.text)

        def flush():
            nonlocal rows
            types = [pa.string(), pa.int32(), *_TYPES, pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "part", *_NAMES, "key", "text"])
            rows = []
            return out

        part = 0
        for batch in batches:
            for key, text, part in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                now = _Document(key, text)
                rows.append(("row", part, *held.against(now), None, None) if held else edge("head", part, now))
                held = now
            if rows:
                yield flush()
        if held:
            rows.append(edge("tail", part, held))
            yield flush()

    dealt = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    found = written(dealt.mapInArrow(run, f"kind string, part int, {_RESULT}, key long, text string"), "digests")
    heads = found.filter("kind = 'head'")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(order)).alias("next"))  # a row for each range
    ends = found.filter("kind = 'tail'").select("part", "key", "text").join(after, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("next_text")), "next")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [_Document(k, t).against(_Document(None, x)) for k, t, x in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2)))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        return each

    last = map_rows(ends.select("key", "text", "next_text"), make, _RESULT)
    return found.filter("kind = 'row'").select(*_NAMES).unionByName(last)


def op9_digest(spark, sf_dir: str) -> DataFrame:
    return with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
