"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of kept and ignored places. The hash of the kept tokens at a place is a seed: test and training texts
that differ only in ignored places share it. Six masks of six kept places find 96 of 100 passages with a fifth of their
words changed (at random) that count as overlaps at all, whatever their length; see the README. Tokens are lower-cased words
without punctuation.

1. Seeds of all distinct benchmark texts: a table (seed, item, place). An item of fewer words than a mask has its whole as seed.
2. One Arrow pass over the documents: all seeds of all places, looked up in a Bloom filter of the benchmark's seeds (eight
   megabytes at most). Places that may hit become regions: the token hashes around a run of such places, as many to either
   side as the longest item has, and their seeds.
3. Join regions' seeds with the benchmark's on the hash: candidate alignments (document region, item, offset).
4. Verify: the whole item is laid over the region at that offset; the best stretch (matches count one, others take one off)
   must hold enough matching words. So a hit that a chance agreement made falls away.

A passage that a third of all documents hold makes one row in each of them; no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, texts_of, word_hashes, written

# Fixed masks: six kept places of seven to nine.
MASKS = ("11010111", "110011011", "101100111", "1011111", "110110101", "110100111")
LEAST_SPAN, MOST_SPAN = min(map(len, MASKS)), max(map(len, MASKS))
#: Bits of the benchmark's Bloom filter for each seed, and at least and at most; three bits are set for a seed.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 26
SHIFTS = (0, 19, 38)
#: Characters of documents that are hashed at once.
AT_ONCE = 1 << 19
#: A passage counts if so many words match, or this share of a shorter item, but LEAST words (or the whole item) at all events.
ENOUGH, SHARE, LEAST = 13, 0.6, 8

_PLACE = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(MOST_SPAN)], np.uint64)


def seeds(tokens: np.ndarray, masks: tuple[str, ...] | list[str]) -> Iterator[np.ndarray]:
    """For each mask the seed of each place at which it fits."""
    parts = [tokens * _PLACE[k] for k in range(min(MOST_SPAN, len(tokens)))]
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        total = np.full(n, np.uint64(int("1" + mask, 2) * 0x2545F4914F6CDD1D % (1 << 64)), np.uint64)
        for k, keep in enumerate(mask):
            if keep == "1":
                total += parts[k][k : k + n]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        yield total ^ (total >> np.uint64(29))


def masks_of(size: int) -> tuple[str, ...]:
    """The masks of an item of so many words."""
    return MASKS if size >= LEAST_SPAN else ("1" * size,)


def best_stretch(same: np.ndarray) -> int:
    """Matches within the longest stretch of greatest matches less mismatches."""
    if not len(same):
        return 0
    sums = np.concatenate([[0], np.cumsum(2 * same.astype(np.int64) - 1)])
    low = np.minimum.accumulate(sums)
    ends = np.flatnonzero(sums - low == (sums - low).max())
    length = int((ends - np.searchsorted(-low, -low[ends])).max())
    return (length + int((sums - low).max())) // 2


def enough(matches: int, size: int) -> bool:
    return matches >= min(size, max(LEAST, min(ENOUGH, int(np.ceil(SHARE * size)))))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray, list[int], int]:
    """(seed, item, place); (item, tokens); (item_id, item); the seeds' Bloom filter; the sizes of items shorter than all masks; the longest item's.

    Equal texts are one item.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            words, text = word_hashes(texts)
            tokens = np.split(_signed(words), np.searchsorted(text, np.arange(1, len(texts))))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "tokens"])

        return each

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = written(map_rows(named, make, "item_id long, tokens array<long>").filter("size(tokens) > 0"), "benchmark")
    items = written(rows.select("tokens").distinct().withColumn("item", F.monotonically_increasing_id()), "items")

    def run(batches):
        for batch in batches:
            found, key, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for item, tokens in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                for s in seeds(np.array(tokens, np.int64).view(np.uint64), masks_of(len(tokens))):
                    found.append(s)
                    key.append(np.full(len(s), item))
                    at.append(np.arange(len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found))), pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(at), pa.int32())], ["seed", "item", "place"])

    table = written(items.mapInArrow(run, "seed long, item long, place int"), "seeds")
    bits = 1 << max(LEAST_BITS, min(MOST_BITS, table.count() * BITS_A_SEED)).bit_length() - 1
    # pmod by a power of two gives the low bits of the unsigned seed
    places = table.select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned("seed", k), F.lit(bits)) for k in SHIFTS])).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("set")).toArrow()  # bits / 64 rows at most
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["at"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    sizes = [r[0] for r in items.select(F.size("tokens")).distinct().filter(f"size(tokens) < {LEAST_SPAN}").collect()]  # fewer than LEAST_SPAN rows
    longest = items.agg(F.max(F.size("tokens"))).first()[0] or 0
    return table, items.select("item", "tokens"), rows.join(items, "tokens").select("item_id", "item"), bitmap, sorted(sizes), longest


def regions_of(texts: list[str], bitmap: np.ndarray, short: list[int], margin: int) -> list[tuple[int, np.ndarray, list[int], list[int]]]:
    """(text's number, token hashes, seeds, the seeds' places) of each run of places that may hit."""
    tokens, text = word_hashes(texts)
    places, found, out = [], [], []
    masks = [*MASKS, *("1" * n for n in short)]
    for mask, s in zip(masks, seeds(tokens, masks)):
        hit = np.arange(len(s))
        for k in SHIFTS:
            low = s[hit] >> np.uint64(k) & np.uint64(64 * len(bitmap) - 1)
            hit = hit[(bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)]
        hit = hit[text[hit] == text[hit + len(mask) - 1]]  # not over the end of a text
        places.append(hit)
        found.append(s[hit])
    at, seed = np.concatenate(places), np.concatenate(found)
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    at, seed = at[order], seed[order]
    for run in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > margin) | (np.diff(text[at]) > 0)) + 1):
        own = int(text[at[run[0]]])
        first, last = np.searchsorted(text, [own, own + 1])
        start, end = max(int(first), int(at[run[0]]) - margin), min(int(last), int(at[run[-1]]) + margin + 1)
        out.append((own, tokens[start:end], _signed(seed[run]).tolist(), (at[run] - start).tolist()))
    return out


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, same, item_id, matches, item_tokens): overlaps, at least one row for each pair of texts; same is the text's hash."""
    table, items, names, bitmap, short, longest = benchmark_tables(benchmark)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, short))  # eight megabytes at most
    small_batches(docs.sparkSession)

    def run(batches):
        bits, sizes = shared.value
        for batch in batches:
            texts, rows, first = texts_of(batch.column(2)), [], 0
            ids, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            while first < len(texts):
                last, chars = first + 1, len(texts[first])
                while last < len(texts) and chars + len(texts[last]) <= AT_ONCE:
                    chars += len(texts[last])
                    last += 1
                rows += [(ids[first + k], same[first + k], _signed(t), s, p) for k, t, s, p in regions_of(texts[first:last], bits, sizes, longest)]
                first = last
            if rows:
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "same", "tokens", "seeds", "places"])

    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    regions = written(named.mapInArrow(run, "doc_id long, same long, tokens array<long>, seeds array<long>, places array<int>").withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("at"))))
    aligned = hits.join(table, "seed").select("region", "item", (F.col("at") - F.col("place")).alias("offset")).distinct()
    pairs = aligned.join(regions.select("region", "doc_id", "same", "tokens"), "region").join(items.select("item", F.col("tokens").alias("words")), "item")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            matches, sizes = [], []
            for k, o in enumerate(batch.column(3).to_pylist()):
                a, b = (batch.column(c)[k].values.to_numpy() for c in (4, 5))
                first, last = max(0, -o), min(len(b), len(a) - o)
                matches.append(best_stretch(a[first + o : last + o] == b[first:last]))
                sizes.append(len(b))
            keep = pa.array([enough(m, n) for m, n in zip(matches, sizes)], pa.bool_())
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(matches, pa.int32()), pa.array(sizes, pa.int32())], ["doc_id", "same", "item", "matches", "item_tokens"]).filter(keep)

        return each

    found = map_rows(pairs.select("doc_id", "same", "item", "offset", "tokens", "words"), make, "doc_id long, same long, item long, matches int, item_tokens int")
    best = found.groupBy("doc_id", "same", "item").agg(F.max("matches").alias("matches"), F.first("item_tokens").alias("item_tokens"))
    return best.join(names, "item").select("doc_id", "same", "item_id", "matches", "item_tokens")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, matches, item_tokens): each document and benchmark item that share a verified passage.

    matches is the greatest over all regions of all texts. Null and empty texts and items overlap with nothing; null ids are kept
    as null; rows with equal doc_id, and rows with equal item_id, give one row a pair. Extra columns are ignored; an empty
    benchmark gives no rows.
    """
    found = _overlaps(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max("matches").alias("matches"), F.max("item_tokens").alias("item_tokens"))


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap with the benchmark; every column stays.

    Rows go by id and text: of rows with one id, null or not, those with other texts stay. Null and empty texts stay.
    """
    bad = written(_overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct(), "contaminated")
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs.text.cast("string")) == bad["_same"]), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
