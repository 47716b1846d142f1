"""Splits, samples, top-k and set operations on rows. Randomness is a hash of the id, so that results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept_table

#: percentile_approx looks at a table with ranks right to one in so many.
ACCURACY = 200_000


def shuffled_order(key: str, seed: int = 42) -> Column:
    """The first 60 bits of an MD5 of key and seed: the same order in any engine."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.lit(15)), 16, 10).cast("long")


def _ranked(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """Rows (by, share, n, value, below, upto): the group's size, and values around each share with the numbers of rows less, and no greater.

    Two passes. The first bounds each share by approximate quantiles on either side (small groups: by least and greatest), the
    second counts the rows below and ranks the distinct values in between, 5 / ACCURACY of a group at most.
    """
    near = [(s, max(0.0, s - 2 / ACCURACY), min(1.0, s + 2 / ACCURACY)) for s in shares]
    kept = df.filter(F.col(value).isNotNull())
    cuts = sorted({c for _, lo, hi in near for c in (lo, hi)})
    found = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("_a"), F.max(value).alias("_z"), F.percentile_approx(value, cuts, ACCURACY).alias("_q"))
    few = F.col("n") <= ACCURACY
    bound = lambda c, end: F.when(few, F.col(end)).otherwise(F.col("_q")[cuts.index(c)])
    bounds = found.select(*by, "n", F.inline(F.array(*[F.struct(F.lit(s).alias("share"), bound(lo, "_a").alias("lo"), bound(hi, "_z").alias("hi")) for s, lo, hi in near])))
    if by:
        both = kept.select(*by, F.col(value).alias("value")).join(bounds, by)
    else:
        known = [F.struct(*[F.lit(r[c]).cast(bounds.schema[c].dataType).alias(c) for c in bounds.columns]) for r in bounds.collect()]  # a row for each share
        both = kept.select(F.col(value).alias("value"), F.inline(F.array(*known)))
    both = both.filter("value <= hi").withColumn("value", F.when(F.col("value") >= F.col("lo"), F.col("value")))  # those below the bound count as one
    counts = both.groupBy(*by, "share", "n", "value").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by, "share").orderBy(F.asc_nulls_first("value")))
    return counts.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("k")).filter("value IS NOT NULL").drop("k")


def quantiles(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """Rows (by, share, quantile), exact, with linear interpolation between neighbours; nulls do not count."""
    at = F.col("share") * (F.col("n") - 1)
    own = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("upto")), F.col("value").cast("double")))
    ends = _ranked(df, value, shares, [*by]).groupBy(*by, "share", "n").agg(own(F.floor(at)).alias("_l"), own(F.ceil(at)).alias("_h"))
    return ends.select(*by, "share", (F.col("_l") + (F.col("_h") - F.col("_l")) * (at - F.floor(at))).alias("quantile"))


def stratified_split(df: DataFrame, key: str, label: str, shares: tuple[float, float] = (0.75, 0.10), seed: int = 42) -> DataFrame:
    """df with split (train, val, test): within each label, rows in hashed order are cut at the shares, rounded down to whole rows.

    The hash at a cut is an order statistic of the label's hashes, so no class is sorted in one task. Rows of equal key stay together.
    """
    hashed = df.withColumn("_h", shuffled_order(key, seed)).withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("")))
    ends = [shares[0], sum(shares)]
    ranked = _ranked(hashed, "_h", ends, ["_label"])
    rank = F.floor(F.col("share") * F.col("n") + 1e-9)
    cuts = ranked.groupBy("_label").agg(*[F.max(F.when((F.col("share") == s) & (F.col("below") < rank) & (rank <= F.col("upto")), F.col("value"))).alias(f"_c{k}") for k, s in enumerate(ends)])
    both = hashed.join(cuts, "_label", "left")  # a row for each label
    split = F.when(F.col("_h") <= F.col("_c0"), "train").when(F.col("_h") <= F.col("_c1"), "val").otherwise("test")
    return both.withColumn("split", split).drop("_h", "_label", "_c0", "_c1")


def class_weights(df: DataFrame, label: str, copies: str | None = None) -> DataFrame:
    """Balanced weight of each class: rows / (classes * its rows). copies names a column that tells for how many rows a row stands."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg((F.sum(copies) if copies else F.count("*")).alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))  # a row for each class


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffled_order(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffled_order(key, seed), key)


def tail_fraction(df: DataFrame, order: str, share: float = 0.2) -> DataFrame:
    """The last share of rows by a numeric order column: all beyond its exact quantile, so no global sort."""
    cut = quantiles(df, order, [1 - share]).select(F.col("quantile").alias("_cut"))
    return df.join(F.broadcast(cut), F.col(order) > F.col("_cut")).drop("_cut")  # one row is broadcast


def scaled(df: DataFrame, columns: list[str], normal: Column) -> DataFrame:
    """Zero mean and unit population deviation, fitted on normal rows only; a constant column is only centred."""
    fit = df.filter(normal).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    both = df.join(F.broadcast(fit.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))  # one row is broadcast
    out = both.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.drop("_k", *[f"_{x}_{c}" for c in columns for x in "ms"])


def term_scores(docs: DataFrame, key: str, text: str, most: int = 10_000, least_docs: int = 2, most_share: float = 0.95) -> DataFrame:
    """(key, term, tf, df, score): words of two letters or more, in so many documents, the most frequent ones; log tf times smoothed idf."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))).alias("term"))
    tf = kept_table(tokens.groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")  # read twice: by term, and with the terms that stay
    total = docs.agg(F.count("*").alias("_n"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    kept = terms.join(F.broadcast(total), (F.col("df") >= least_docs) & (F.col("df") <= F.col("_n") * most_share)).orderBy(F.desc("all"), "term").limit(most)
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    return tf.join(F.broadcast(kept), "term").select(key, "term", "tf", "df", ((1 + F.log("tf")) * idf).alias("score"))  # most rows are broadcast at most


#: Terms of one length up to which those that longer ones may hold are broadcast.
FEW = 200_000


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The words of two letters or more of column _w, where blanks part words, and the number of each one's row."""
    lists = pc.split_pattern(batch.column("_w"), " ")
    rows, words = pc.list_parent_indices(lists), lists.flatten()
    long = pc.greater_equal(pc.utf8_length(words), 2)
    return rows.filter(long).to_numpy().astype(np.int64), words.filter(long)


def _places(rows: np.ndarray, words: pa.Array, levels: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For terms of 1, 2, ... words, by the place of their first word: their code and their number in the level, -1 where there is none.

    A level has the terms of one length that count: words, or sorted codes. A longer term's code is made of the numbers of its two parts
    that are one word shorter.
    """
    codes = None
    for keys in levels:
        if codes is None:
            ids = pc.index_in(words, value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        elif len(keys):
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            ids = np.where(keys[at] == codes, at, -1)
        else:
            ids = np.full(len(codes), -1, np.int64)
        yield codes, ids
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (rows[:-1] == rows[1:])
        codes = np.append(np.where(both, ids[:-1] * len(keys) + ids[1:], -1), np.full(min(1, len(ids)), -1, np.int64))
    yield codes, None


def _tallied(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and how often, of the codes from 0 on."""
    base = int(codes.max(initial=0)) + 1
    both, tf = np.unique((rows * base + codes)[codes >= 0], return_counts=True)
    return both // base, both % base, tf


def _totals(whole: DataFrame, key: str, levels: Broadcast, column: str) -> DataFrame:
    """(column, df, all) of the terms one word longer than the last level's: by term if there is none yet, else by code.

    A batch sums up its rows before the shuffle. Rows whose key others have too (_many) are counted by key.
    """

    def own(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
        rows, words = _words_of(batch)
        if not levels.value:
            coded = words.dictionary_encode()
            return *_tallied(rows, coded.indices.to_numpy().astype(np.int64)), coded.dictionary
        *_, (codes, _) = _places(rows, words, levels.value)
        return *_tallied(rows, codes), None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, tf, names = own(batch)
            codes, at = np.unique(codes, return_inverse=True)
            sums = np.bincount(at, minlength=len(codes)), np.bincount(at, tf, len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(codes)) if names is not None else pa.array(codes), *map(pa.array, sums)], [column, "df", "all"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, tf, names = own(batch)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), names.take(pa.array(codes)) if names is not None else pa.array(codes), pa.array(tf)], [key, column, "tf"])

    kind = T.StringType() if column == "term" else T.LongType()
    found = whole.filter("NOT _many").select("_w").mapInArrow(summed, T.StructType().add(column, kind).add("df", "long").add("all", "long"))
    several = whole.filter("_many").select(key, "_w").mapInArrow(single, T.StructType().add(key, whole.schema[key].dataType).add(column, kind).add("tf", "long"))
    several = several.groupBy(key, column).agg(F.sum("tf").alias("tf")).groupBy(column).agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    return found.unionByName(several).groupBy(column).agg(F.sum("df").alias("df"), F.sum("all").alias("all"))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _w, _many): lower-case words parted by blanks, and whether other rows have the same key."""
    plain = docs.select(key, F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ").alias("_w"))
    keys = kept_table(docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "keys")
    if keys.isEmpty():
        return kept_table(plain.withColumn("_many", F.lit(False)), "words")
    both = plain.join(keys.withColumn("_many", F.lit(True)), plain[key].eqNullSafe(F.col("_key")), "left")
    return kept_table(both.select(key, "_w", F.coalesce("_many", F.lit(False)).alias("_many")), "words")


def gram_scores(docs: DataFrame, key: str, text: str, grams: int = 3, most: int = 10_000, least_docs: int = 2, most_share: float = 0.95) -> DataFrame:
    """term_scores on terms of 1 to so many words: (key, term, tf, df, score), of the most frequent terms of any length.

    Longer terms are not all counted: a term among the most frequent ones has no part that is rarer or in fewer documents, so pairs are
    formed of words alone that are as frequent as the last of the most frequent words, triples of pairs likewise, and so on. The
    parts are numbered, so a longer term is a number too, and each Arrow batch sums up its terms before the shuffle; the result is
    exact. Where more than FEW parts are as frequent as that, terms are formed by joins.
    """
    spark = docs.sparkSession
    whole, n = _marked(docs, key, text), docs.count()
    levels, terms, found = [], [], None
    for size in range(1, grams + 1):
        counts = _totals(whole, key, spark.sparkContext.broadcast(levels), "code" if levels else "term").filter(F.col("df") >= least_docs)
        if levels:
            counts = counts.filter(F.col("all") >= least)  # others are no part of the outcome
            parts = spark.createDataFrame([(k, x, x.rpartition(" ")[2]) for k, x in enumerate(terms)], "k long, term string, last string")
            first, second = F.broadcast(parts.select(F.col("k").alias("_a"), "term")), F.broadcast(parts.select(F.col("k").alias("_b"), "last"))
            counts = counts.withColumns({"_a": F.floor(F.col("code") / len(terms)), "_b": F.col("code") % len(terms)}).join(first, "_a").join(second, "_b")
            counts = counts.select(F.concat_ws(" ", "term", "last").alias("term"), "code", "df", "all")
        else:
            counts = counts.withColumn("code", F.lit(None).cast("long"))
        counts = kept_table(counts.withColumn("size", F.lit(size)), "terms")
        valid = counts.filter(F.col("df") <= n * most_share)
        found = kept_table((valid if found is None else found.unionByName(valid)).orderBy(F.desc("all"), "term").limit(most), "vocabulary")
        last = found.agg(F.count("*").alias("n"), F.min("all").alias("least")).first()
        least = last["least"] if last["n"] >= most else 1
        often = counts.filter(F.col("all") >= least).select("term", "code").orderBy("code", "term").limit(FEW + 1).collect()
        if len(often) > FEW:
            return _joined_gram_scores(docs, key, text, grams, most, least_docs, most_share)
        terms = [r.term for r in often]
        levels.append(np.array([r.code for r in often], np.int64) if levels else pa.array(terms, pa.string()))
        if not terms:
            break
    vocabulary = found.select("term", "code", "size", "df").collect()  # most rows at most
    place = {r.term if r.size == 1 else (r.size, r.code): k for k, r in enumerate(vocabulary)}
    numbers = [np.array([place.get(x.as_py() if size == 1 else (size, int(x)), -1) for x in keys], np.int64) for size, keys in enumerate(levels, 1)]
    known = spark.sparkContext.broadcast((levels, numbers))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, numbers = known.value
        for batch in batches:
            rows, words = _words_of(batch)
            for (_, ids), own in zip(_places(rows, words, levels), numbers):
                at, k, tf = _tallied(rows, np.where(ids >= 0, own[ids], -1) if len(own) else ids)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(k), pa.array(tf)], [key, "_k", "tf"])

    tf = lambda some: whole.filter(some).select(key, "_w").mapInArrow(each, T.StructType().add(key, whole.schema[key].dataType).add("_k", "long").add("tf", "long"))
    several = tf("_many").groupBy(key, "_k").agg(F.sum("tf").alias("tf"))
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    scored = spark.createDataFrame([(k, r.term, r.df) for k, r in enumerate(vocabulary)], "_k long, term string, df long")
    return tf("NOT _many").unionByName(several).join(F.broadcast(scored), "_k").select(key, "term", "tf", "df", ((1 + F.log("tf")) * idf).alias("score"))


def _joined_gram_scores(docs: DataFrame, key: str, text: str, grams: int, most: int, least_docs: int, most_share: float) -> DataFrame:
    """gram_scores with the parts looked up by joins before the shuffle, for any number of parts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    whole = kept_table(docs.select(key, words.alias("_w")).filter(F.size("_w") > 0), "words")
    n, counted, found = docs.count(), [], None
    for size in range(1, grams + 1):
        place = F.sequence(F.lit(1), F.size("_w") - (size - 1))
        part = lambda at, k: F.array_join(F.slice("_w", at, k), " ")
        long = whole.filter(F.size("_w") >= size)
        if size == 1:
            terms = long.select(key, F.explode("_w").alias("term"))
        else:  # both parts that are one word shorter
            terms = long.select(key, F.inline(F.transform(place, lambda at: F.struct(part(at, F.lit(size)).alias("term"), part(at, F.lit(size - 1)).alias("_a"), part(at + 1, F.lit(size - 1)).alias("_b")))))
            parts = F.broadcast(often) if often.count() <= FEW else often
            for side in ("_a", "_b"):
                terms = terms.join(parts.withColumnRenamed("term", side), side, "left_semi")
        tf = kept_table(terms.groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")
        totals = kept_table(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")), "terms")
        counted.append(tf)
        valid = totals.filter((F.col("df") >= least_docs) & (F.col("df") <= n * most_share))
        found = kept_table((valid if found is None else found.unionByName(valid)).orderBy(F.desc("all"), "term").limit(most), "vocabulary")
        last = found.agg(F.count("*").alias("n"), F.min("all").alias("least")).first()
        often = kept_table(totals.filter(F.col("all") >= (last["least"] if last["n"] >= most else 1)).select("term"), "often")
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    tf = counted[0]
    for more in counted[1:]:
        tf = tf.unionByName(more)
    return tf.join(F.broadcast(found), "term").select(key, "term", "tf", "df", ((1 + F.log("tf")) * idf).alias("score"))  # most rows are broadcast at most
