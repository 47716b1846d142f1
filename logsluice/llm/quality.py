"""Quality scores from supervised subword embeddings.

A document is the bag of its words and of its words' character n-grams, each hashed to a row of an embedding table. Its
vector is their average; a softmax layer turns it into the probability of each class. Table and layer are learned
together by stochastic gradient descent in numpy, on a bounded sample of labelled documents (SAMPLE rows, the least by a
hash of their id, so that any partitioning gives the same sample), inside one task.

With two classes only the difference of the two outputs matters, so the learned table folds into one number for each
hash bucket: that vector is all that goes to the scoring tasks, and a score is an average of gathered numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, map_rows, small_batches, texts_of

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
BUCKETS = 1 << 17
DIMS = 12
GRAMS = (3, 4, 5)
EPOCHS = 12
RATE = 0.4
THRESHOLD = 0.7


def features(text: str | None) -> np.ndarray:
    """The hash buckets of all words and of their character n-grams, repeats included. Words are parted by white space.

    A word that repeats the one before it counts once more, as one word common to all such. n-grams reach over a word's ends by one space, which marks beginnings and endings.
    """
    points = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), "<u4")
    space = (points <= 32) | (points == 0x85) | (points == 0xA0) | (points == 0x3000) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x2028) | (points == 0x2029)
    points = np.where(space, np.uint32(32), points)
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    starts, ends = edges[::2] + 1, edges[1::2] + 1
    words = SpanHash(points).of(starts, ends)
    again = np.zeros(np.count_nonzero(words[1:] == words[:-1]), np.int32)  # bucket 0: a word like the one before it
    found = [(words & np.uint64(BUCKETS - 1)).astype(np.int32), again]
    rolled, inner = points * np.uint32(0x9E3779B1), np.zeros(len(points), bool)
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            break
        rolled = (rolled[:-1] + points[n - 1 :]) * np.uint32(0x85EBCA77)
        inner = inner[:-1] | (space[n - 2 : len(points) - 1] if n > 2 else False)
        if n in GRAMS:
            mixed = rolled[~inner]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(found)


def trained(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, dims: int = DIMS) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from rows (buckets, their shares of the document, label), by gradient descent in row order.

    Rows of one class only, or none, give no weights and the smoothed share of label 1 as bias.
    """
    ones = sum(label for *_, label in docs)
    prior = float(np.log((ones + 1) / (len(docs) - ones + 1)))
    if not 0 < ones < len(docs):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(0)
    table = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    layer, bias = np.zeros((dims, 2), np.float32), np.array([0, prior], np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, share, label = docs[i]
            now = rate * (1 - done / steps)
            done += 1
            vector = share @ table[buckets]
            out = vector @ layer + bias
            p = np.exp(out - out.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            layer -= now * np.outer(vector, error)
            bias -= 0.1 * now * error
            table[buckets] -= np.float32(now) * len(buckets) ** 0.5 * share[:, None] * back  # rare rows would hardly move by their share alone
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on labelled rows whose crc32(doc_id as text) mod 4 is not 2. Null labels and ids do not count.

    Labels that contradict each other for one id, and documents of one id, count each as a row; a text without words is left out.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    least = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(least), F.col("doc_id") == F.col("id"))  # sample rows of two numbers

    def run(batches):
        kept = []
        for batch in batches:
            for key, text, label in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                buckets, count = np.unique(features(text), return_counts=True)
                if len(buckets):
                    kept.append((key, buckets, (count / count.sum()).astype(np.float32), int(label > 0)))
        kept.sort(key=lambda x: (x[0], x[3], len(x[1])))
        weights, bias = trained([x[1:] for x in kept])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    model = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "weights binary, bias double").first()  # none if no row counts
    if model is None:
        return trained([])
    return np.frombuffer(bytes(model.weights), np.float32), model.bias


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _scores(texts: list[str], table: np.ndarray, base: float) -> np.ndarray:
    """The probability of label 1 of each text; that of the bias alone for a text without words."""
    odds = [base + (table[found].mean(dtype=np.float64) if len(found) else 0.0) for found in map(features, texts)]
    return 1 / (1 + np.exp(-np.clip(np.array(odds, float), -60, 60)))


def scored(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """docs' (doc_id, score): the probability of label 1, for every row. Null and empty texts get that of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # half a megabyte, whatever the data

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(texts_of(batch.column(1)), *shared.value))], ["doc_id", column])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, f"doc_id long, {column} double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of docs; a null id is not held out. Extra columns are ignored."""
    found = scored(docs, *fit(docs, labels))
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects; every column stays. One pass: no join by id, so ids need not be unique.

    Null and empty texts have the score of the bias alone, so all of them stay or all go; repeated rows and null ids are rows like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(texts_of(batch.column(at)), *shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
