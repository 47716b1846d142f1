"""Periodic runs: stretches of words that repeat with one period, found by minimizers at several scales.

A run is a maximal stretch with smallest period q (words q apart are equal) of at least max(24, 3 q) words.

1. Periods under SHORT: words are compared with those q before, q by q; stretches of equality are runs.
2. Longer periods, by scale: for periods from P to 1.5 P, words are hashed in grams of P / 2, and of each window of 1.2 P grams the
   least hash is kept, ties included. Inside a run, a window and the one a period later are equal, so the places kept repeat at
   distance q: the run has two kept places of equal hash that lie q apart. All pairs of equal kept hashes between P and 1.5 P
   apart are seeds.
3. A gram that has itself a period of a third of its length or less lies inside a run that a shorter scale has found. Such
   grams are never kept: a window has others, as a run of a short period overlaps one of period q by less than the two
   periods (Fine and Wilf). So equal kept hashes lie over a sixth of P apart, and a place has no more than nine partners.
4. Seeds grow to both sides by binary search on span hashes; what is long enough is compared word by word, so hashes only propose.
   Runs whose bounds a shorter period has found are no runs of their own.

Batches of texts are one array with separators that equal nothing, so each step is one numpy operation for all texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, map_rows, mixed, texts_of

LEAST, TIMES = 24, 3
#: Periods under this are scanned for one by one; grams of the first scale have half its words, and LEAST at least.
SHORT = 48
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches of at least so many places, given the places in order."""
    if len(equal) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.diff(equal) != 1) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(equal)]])
    long = last - first >= least
    return equal[first[long]], equal[last[long] - 1] + 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in turn, by block-wise running minima from both sides."""
    n = len(values)
    full = np.full(-(-n // width) * width, values.max(), values.dtype)
    full[:n] = values
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class _Finder:
    def __init__(self, words: np.ndarray, least: int, times: int) -> None:
        self.words, self.least, self.times = words, least, times
        self.found: dict[tuple[int, int], int] = {}  # bounds -> smallest period

    def keep(self, starts: np.ndarray, ends: np.ndarray, period: int) -> None:
        for bounds in zip(starts.tolist(), ends.tolist()):
            self.found.setdefault(bounds, period)

    def lag(self, q: int) -> None:
        """All stretches of period q, of the whole array."""
        if len(self.words) > q:
            equal = np.flatnonzero(self.words[q:] == self.words[:-q])
            starts, ends = stretches(equal, max(self.least, self.times * q) - q)
            self.keep(starts, ends + q, q)

    def scale(self, low: int, high: int, hashes: SpanHash) -> None:
        """All runs with periods from low to below high, given all those with shorter ones."""
        gram, window, n = low // 2, low + low // 5 + 2, len(self.words)
        places = n - gram + 1
        if places < window:
            return
        at = np.arange(places)
        values = hashes.of(at, at + gram)
        covered = np.zeros(places + 1, np.int64)
        for (start, end), q in self.found.items():
            if 3 * q <= gram <= end - start:
                covered[start] += 1
                covered[end - gram + 1] -= 1
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        values[np.cumsum(covered[:-1]) > 0] = none
        least = sliding_min(values, window)
        # A place is kept if it holds the minimum of any window around it: the greatest of these minima, by complements.
        edge = np.full(window - 1, none)
        greatest = ~sliding_min(np.concatenate([edge, ~least, edge]), window)
        kept = np.flatnonzero((values == greatest) & (values != none))
        kept = kept[np.lexsort((kept, values[kept]))]
        left, apart = [], []
        for k in range(1, len(kept)):
            same, far = values[kept[k:]] == values[kept[:-k]], kept[k:] - kept[:-k]
            if not (same & (far < high)).any():
                break
            ok = same & (far >= low) & (far < high)
            left.append(kept[:-k][ok])
            apart.append(far[ok])
        if left:
            self.grow(np.concatenate(left), np.concatenate(apart), hashes)

    def grow(self, at: np.ndarray, lag: np.ndarray, hashes: SpanHash) -> None:
        """From places that look like those lag later to the whole stretch of that period around them."""
        n = len(self.words)
        same = lambda a, b: hashes.of(a, b) == hashes.of(a + lag, b + lag)
        # The furthest end up to which, and the least start from which, words equal those lag later.
        low, high = at.copy(), n - lag
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = same(at, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        end, low, high = low, np.zeros_like(at), at.copy()
        while (low < high).any():
            middle = (low + high) // 2
            ok = same(middle, at)
            low, high = np.where(ok, low, middle + 1), np.where(ok, middle, high)
        long = end + lag - low >= np.maximum(self.least, self.times * lag)
        seen = np.unique(np.stack([lag[long], low[long], end[long]]), axis=1)
        for q, a, b in seen.T.tolist():  # smallest periods first
            if (a, b + q) in self.found:
                continue
            whole = np.array_equal(self.words[a:b], self.words[a + q : b + q])
            if whole and (a == 0 or self.words[a - 1] != self.words[a + q - 1]) and (b + q == n or self.words[b] != self.words[b + q]):
                self.found[a, b + q] = q
            else:  # two spans with one hash
                self.lag(q)


def runs(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES, short: int = SHORT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. words are numbers, equal for equal words; longest is how many may
    follow each other without a separator. least is 24 and times is 3 at least: the scales rely on it."""
    if least < 24 or times < 3 or short < 48:
        raise ValueError("runs have 24 words and three periods at least, and periods under 48 are scanned for")
    finder = _Finder(words, least, times)
    for q in range(1, min(short - 1, longest // times) + 1):
        finder.lag(q)
    low = short
    if longest >= times * low:
        hashes = SpanHash(mixed(words.astype(np.uint64) + np.uint64(1)))
        while times * low <= longest:
            high = low + low // 2
            finder.scale(low, high, hashes)
            low = high
    return sorted((start, end - start, q) for (start, end), q in finder.found.items())


def _runs_of(texts: list[list[str]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text. Scales that only long texts can hold see these alone."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    short_limit = times * SHORT
    for wanted in (False, True):  # texts without and with room for long periods
        chosen = [k for k, t in enumerate(texts) if len(t) >= least and (len(t) >= short_limit) == wanted]
        if not chosen:
            continue
        ids: dict[str, int] = {}
        flat: list[int] = []
        starts = []
        for k in chosen:
            starts.append(len(flat))
            flat += [ids.setdefault(w, len(ids)) for w in texts[k]]
            flat.append(-1 - k)
        words = np.array(flat, np.int64)
        place = np.array(starts)
        for start, length, q in runs(words, max(len(texts[k]) for k in chosen), least, times):
            n = int(np.searchsorted(place, start, side="right")) - 1
            out[chosen[n]].append((start - starts[n], length, q))
    return out


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words without those that any run holds after its first period, joined by spaces."""
    if not found:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


_RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every whole text by start and period, and the text without repetitions.

    Words are what white space parts ([^\\x20\\x09-\\x0D]+). A null or empty text has no words. Repeated rows and null ids are
    documents of their own; extra columns are ignored.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [_WORD.findall(t) for t in texts_of(batch.column(1))]
            found = _runs_of(words, least, times)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            columns = [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(rows, _ARROW_RUNS), pa.array(map(collapsed, words, found), pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text (by a checksum of its id) repeats its own words with a period from a place on.

    With h the crc32 of the decimal id, g = h // 10 and n words: if h % 10 is 0 and n over 0, each word i from a = g % n on becomes
    word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). All other texts, and those without an id, stay.
    """

    def make():
        def one(key: int | None, text: str) -> str:
            h = zlib.crc32(str(key).encode()) if key is not None else 1
            words = _WORD.findall(text) if h % 10 == 0 else []
            if not words:
                return text
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            return " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = map(one, batch.column(0).to_pylist(), texts_of(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, text string")


def strongest(found: Column) -> Column:
    """Of an array of runs by start and period the first with the greatest exact length / period; null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
