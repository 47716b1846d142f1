"""Helpers that several training-data operators share: shared-folder tables, Arrow batches, word hashing."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that one Arrow batch may hold; keeps a Python worker's memory small where texts are long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or on one machine one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again after the loss of any executor."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, for whole texts. The session keeps the setting: it bounds bytes, not rows, so narrow rows do not mind."""
    said = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(_BATCH).strip().lower())
    now = int(said[1]) << 10 * " kmgtp".index(said[2] or " ") if said else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function that each task makes once, e.g. after it has loaded a tokenizer."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def in_order(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by ranges of key, with the range's number as column part, each range sorted by key (nulls first).

    The range bounds come from quantiles of the key column alone, so that wide columns are read once and shuffled once.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [x / n for x in range(1, n)] or [0.5]
    bounds = sorted(set(df.select(F.percentile_approx(key, cuts, 10 * n + 1000)).first()[0] or ()))
    # How many bounds lie below the key, in two steps: whole chunks of about the root of their number, then within one.
    w = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[k : k + w] for k in range(0, len(bounds), w)]
    below = lambda xs: F.coalesce(F.size(F.filter(xs, lambda b: b < F.col(key))), F.lit(0))
    whole = below(F.array(*[F.lit(c[-1]) for c in chunks if len(c) == w])) if bounds else F.lit(0)
    part = whole * w + F.greatest(F.lit(0), below(F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), whole))) if bounds else F.lit(0)
    return df.withColumn("part", F.when(F.col(key).isNull(), 0).otherwise(part).cast("int")).repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.asc_nulls_first(key))


#: Keys that have this share of all rows meet them by broadcast.
HOT = 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with their match in counted, a written table of one row for each key and of its number of rows, times.

    Keys of more than a share of 1 / HOT of all rows are fewer than HOT, so these are broadcast; all others meet their rows in
    a join whose largest key has no more than that share.
    """
    hot = F.col("times") > total / HOT
    return rows.join(F.broadcast(counted.filter(hot).drop("times")), on).unionByName(rows.join(counted.filter(~hot).drop("times"), on))


def texts_of(column: pa.Array) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M ** i modulo 2 ** 64 for i < n at least, and their inverses."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up = np.full(size, _M, np.uint64)
        down = np.full(size, np.uint64(pow(int(_M), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that their low bits can serve as bucket numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SpanHash:
    """Hashes of any spans of a byte string, each in constant time, from prefix sums of byte * power."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: Letters of scripts that put no spaces between words (Thai to Lao, Burmese, Khmer, kana, ideographs): each is a word.
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF))
_kinds: list[np.ndarray] = []


def _char_kinds() -> np.ndarray:
    """By code point: 1 for letters, digits and marks of words, 2 for letters that are words, else 0."""
    if not _kinds:
        kinds = np.zeros(0x110000, np.int8)
        kinds[[k for k in range(0x20000) if (c := chr(k)).isalnum() or unicodedata.category(c)[0] == "M"]] = 1
        for a, b in _ALONE:
            kinds[a : b + 1] *= 2
        kinds[0x20000:0x40000] = 2
        _kinds.append(kinds)
    return _kinds[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of letters and digits; of scripts without spaces, each letter."""
    kinds = np.zeros(len(points) + 2, np.int8)
    kinds[1:-1] = _char_kinds()[points]
    own, before, after = kinds[1:-1], kinds[:-2], kinds[2:]
    return np.flatnonzero((own == 2) | (own == 1) & (before != 1)), np.flatnonzero((own == 2) | (own == 1) & (after != 1)) + 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word of all texts, and the number of its text; punctuation and white space part words."""
    low = [t.lower() for t in texts]
    points = code_points("\n".join(low))
    starts, ends = word_bounds(points)
    ends_of = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    return SpanHash(points).of(starts, ends), np.searchsorted(ends_of, starts, side="right")
