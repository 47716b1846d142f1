"""Token counts as rollups that are maintained by deltas.

A ledger holds each document's counts by tokenizer version. A batch is a set of signed ledger rows: +1 for an insert, -1
for a delete, both for a revision (the old row out, the new one in). A commit sums the batch by (source, lang, tokenizer),
so that a few rows are all that is kept of it. Totals are the sum over the committed batches.

Below the folder, each attempt of a commit writes its sums to a folder of its own and is published by one marker row, written
after them in a single file, that names batch, attempt and a digest of the sums. A batch counts once, however many markers it has:
the least attempt of the first digest. So a crash between the two leaves no trace in the totals, a retry or replay adds nothing,
and a new Rollup on the folder goes on where the last one stopped. A known batch id with other rows is refused.

A fold sums what is committed into one attempt of its own, lists the batches that it holds, and is published by a marker row without a
batch. Totals read one fold, the one with most batches, and the batches that it does not list: so folds that race, or of which a crash
left half, change no total, and reading costs the batches since the last fold and not all that ever were.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, map_rows, new_path, texts_of, written
from .tokens import BYTE_BPE, encoder, tokenizer_path

#: Tokenizer versions: the byte-level vocabulary, and words parted by white space.
BPE, WORDS = "byte_bpe_50k@1", "words@1"
_GROUP = [("source", T.StringType()), ("lang", T.StringType()), ("tokenizer", T.StringType())]
_DELTA = T.StructType([T.StructField(n, t) for n, t in (*_GROUP, ("n_docs", T.LongType()), ("n_tokens", T.LongType()))])
#: What an attempt keeps: its sums, and sums of two hashes of the rows behind them.
_KEPT = T.StructType([*_DELTA.fields, *[T.StructField(f"h{k}", T.DecimalType(38, 0)) for k in (0, 1)]])
_MARK = "batch string, attempt string, digest string"


def ledger(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, source, lang, same, bpe, words): same is a hash that equal texts share. Null texts count as empty."""
    path = path or tokenizer_path(BYTE_BPE)

    def make():
        encode = encoder(path, True)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(4))
            counts = [pa.array([len(encode(t)) for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], *counts], ["doc_id", "source", "lang", "same", "bpe", "words"])

        return each

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(text, 256).alias("same"), text.alias("text"))
    return map_rows(named, make, "doc_id long, source string, lang string, same string, bpe long, words long")


class Rollup:
    """Totals below a folder that any number of sessions may open one after the other, or at once for batches of their own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        # the folder must be there before it can be read; this row names no batch
        self.spark.createDataFrame([], _MARK).write.mode("append").parquet(f"{self.folder}/markers")

    def _markers(self) -> DataFrame:
        return self.spark.read.schema(_MARK).parquet(f"{self.folder}/markers")

    def digest_of(self, batch: str) -> str | None:
        """The digest of a committed batch's rows; None for a batch that is not committed."""
        return self._markers().filter(F.col("batch") == str(batch)).agg(F.min("digest")).first()[0]

    def prepared(self, rows: DataFrame, sign: Column | int, attempt: str) -> str:
        """Write the sums of signed ledger rows under an attempt, which does not count yet; the digest of the rows, in any order."""
        signed = rows.withColumn("sign", F.lit(sign) if isinstance(sign, int) else sign)
        counts = signed.select("doc_id", "source", "lang", "same", "sign", F.inline(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("n")) for v, c in ((BPE, "bpe"), (WORDS, "words"))])))
        hashes = [F.sum(F.xxhash64(F.lit(k), *counts.columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"h{k}") for k in (0, 1)]
        sums = counts.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("n_tokens"), *hashes)
        sums.write.parquet(f"{self.folder}/sums/attempt={attempt}")
        found = self.spark.read.schema(_KEPT).parquet(f"{self.folder}/sums/attempt={attempt}").agg(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).first()
        return f"{found.n}:{found.h0 or 0}:{found.h1 or 0}"

    def commit(self, batch: str, rows: DataFrame, sign: Column | int = 1) -> bool:
        """Add signed ledger rows under this batch id; False, and nothing added, if the batch is committed with these rows already.

        A batch that is committed with other sums is refused: a change is a batch of its own, with the old rows out and the new ones in.
        """
        attempt = uuid.uuid4().hex
        digest, before = self.prepared(rows, sign, attempt), self.digest_of(batch)
        if before is not None and before != digest:
            raise ValueError(f"batch {batch} is committed with other rows")
        if before is None:
            self.spark.createDataFrame([(str(batch), attempt, digest)], _MARK).coalesce(1).write.mode("append").parquet(f"{self.folder}/markers")
        return before is None

    def batches(self, marks: DataFrame | None = None) -> DataFrame:
        """Rows (batch, attempt) of what counts: one attempt for each committed batch."""
        first = F.row_number().over(Window.partitionBy("batch").orderBy("digest", "attempt"))  # a batch has as many markers as sessions raced for it
        marks = self._markers() if marks is None else marks
        return marks.filter("batch IS NOT NULL").withColumn("_k", first).filter("_k = 1").select("batch", "attempt")

    def _fold(self, marks: DataFrame) -> str | None:
        """The attempt of the published fold with most batches."""
        return marks.filter("batch IS NULL").agg(F.max(F.struct(F.col("digest").cast("long").alias("n"), "attempt"))["attempt"]).first()[0]

    def folded(self, marks: DataFrame | None = None) -> DataFrame:
        """Rows (batch, attempt) of the batches in the fold that totals read; nothing reads these attempts' sums again, so they may be removed."""
        fold = self._fold(self._markers() if marks is None else marks)
        if fold is None:
            return self.spark.createDataFrame([], "batch string, attempt string")
        return self.spark.read.schema("batch string, attempt string").parquet(f"{self.folder}/folds/{fold}")

    def _summed(self, marks: DataFrame) -> DataFrame:
        """The totals of the batches that marks, one reading of the markers, name."""
        some, fold = self.batches(marks), self._fold(marks)
        if fold is not None:
            own = self.spark.createDataFrame([(fold,)], "attempt string")
            some = some.join(self.folded(marks).select("batch"), "batch", "left_anti").select("attempt").unionByName(own)
        if some.isEmpty():
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(T.StructType([*_DELTA.fields, T.StructField("attempt", T.StringType())])).parquet(f"{self.folder}/sums")
        deltas = deltas.join(some.select("attempt"), "attempt", "left_semi")
        return deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); groups whose documents have all gone are left out. A null source or lang is a group of its own."""
        return self._summed(self._markers())

    def fold(self) -> int:
        """Sum all that is committed into one attempt; the number of batches in it. Totals stay as they are, and a batch in a fold stays known."""
        marks = self._markers()  # the files of this moment: what is listed is what is summed
        attempt = uuid.uuid4().hex
        self._summed(marks).write.parquet(f"{self.folder}/sums/attempt={attempt}")
        self.batches(marks).write.parquet(f"{self.folder}/folds/{attempt}")
        n = self.spark.read.parquet(f"{self.folder}/folds/{attempt}").count()
        if n:
            self.spark.createDataFrame([(None, attempt, str(n))], _MARK).coalesce(1).write.mode("append").parquet(f"{self.folder}/markers")
        return n


def copies(rows: DataFrame) -> DataFrame:
    """The ledger rows of texts that a smaller doc_id has too (a null id is the greatest; rows of one id stay together).

    A text's least id is a minimum that is combined before the shuffle, and written; very common texts are broadcast.
    """
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).filter("times > 1")
    both = join_counted(rows, written(first, "firsts"), ["same"], rows.count())
    return both.filter("doc_id IS NULL AND first IS NOT NULL OR doc_id > first").select(*rows.columns)


def revised(docs: DataFrame, text: Column) -> DataFrame:
    """Signed ledger rows (column sign) of giving docs a new text: each document goes out as it was, and comes in as it is to be."""
    return ledger(docs).withColumn("sign", F.lit(-1)).unionByName(ledger(docs.withColumn("text", text)).withColumn("sign", F.lit(1)))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents come in with one batch; the exact copies go with another, which is replayed after a fold of both; of what is left,
    texts with repeated lines are revised to keep the first of each. The totals are those of a Rollup that is opened anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    rows = written(ledger(docs), "ledger")
    folder = new_path(spark, "token-counts")
    sums = Rollup(spark, folder)
    sums.commit("load", rows)
    gone = written(copies(rows), "copies")
    sums.commit("copies", gone, -1)
    sums.fold()
    sums.commit("copies", gone, -1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fewer = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    away = gone.select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct()
    left = docs.filter(fewer != text).join(away, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.sha2(text, 256) == F.col("_same")), "left_anti")
    sums.commit("revision", revised(left, fewer), F.col("sign"))
    return Rollup(spark, folder).totals()
