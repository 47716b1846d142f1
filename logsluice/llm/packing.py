"""Best-fit decreasing packing of token sequences into fixed windows.

1. One Arrow pass turns each document into pieces: full windows while more than a window is left, then the rest. A piece
   row has its place, length and checksum (and its ids, if asked for), and is written to the shared folder.
2. A full window is a sequence of its own. The rests, one at most for a document and each shorter than a window, are dealt to
   groups of a bounded expected size by a hash that spreads even equal rows: however long documents are, a group is bounded.
3. Each group is packed on its own: longest piece first, each into the open window with the least room that still holds
   it, which a segment tree over the remaining capacities finds in a logarithm of the window. A group leaves about one
   window partly empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of, written
from .tokens import WORD_BPE, encoder, tokenizer_path

WINDOW = 2048
END = 1
#: Rests of documents to a group, on average.
GROUP = 8192


class CapacityTree:
    """How many open windows have each remaining capacity; finds the least capacity that is enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int = 1) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open window, need or more."""
        at, count = self.leaves + need, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:  # a right-hand neighbour has an open window: go down to its leftmost
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence (from 0) and offset in it. Pieces of equal length keep their order."""
    tree, stacks, used = CapacityTree(window), {}, 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n) if n < window else None
        if room is None:
            at, room, used = used, window, used + 1
        else:
            at = stacks[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, window - room
        if room > n:
            stacks.setdefault(room - n, []).append(at)
            tree.add(room - n)
    return sequence, offset


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and the end id, cut at full windows."""
    path = path or tokenizer_path(WORD_BPE)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def make():
        encode = encoder(path, False)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids), *[part.tolist()] * with_ids))
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], fields)

        return each

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; each sequence's pieces lie gapless from 0 and fill window ids at most.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed as documents of their own; of equal
    pieces any may come first. An empty table gives no rows; extra columns are ignored.
    """
    cut = written(pieces(docs, path, window, end, with_ids), "pieces")
    at = F.monotonically_increasing_id()  # of a written table: the same at every reading
    full = cut.withColumn("sequence_id", at + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long")).filter(F.col("length") == window)
    rests = cut.withColumn("at", at).filter(F.col("length") < window)
    groups = max(1, -(-cut.filter(F.col("length") < window).count() // group))
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int")).drop("at")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(rows.length.to_numpy(), window)
        return rows.assign(sequence_id=rows.grp.astype("int64") * (1 << 32) + sequence, offset=offset)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    return full.unionByName(dealt.groupBy("grp").applyInPandas(fill, fields).drop("grp"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
