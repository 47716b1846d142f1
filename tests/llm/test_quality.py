import math
import zlib

import numpy as np
import pandas as pd
import pytest
from logsluice.llm import quality


def plain(text):
    """Words, repeats and n-grams as strings."""
    words = (text or "").split()
    out = [("word", w) for w in words] + ["<again>" for a, b in zip(words, words[1:]) if a == b]
    for w in words:
        w = f" {w} "
        out += [w[i : i + n] for n in quality.GRAMS for i in range(len(w) - n + 1)]
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "a", "aa aa b", "The the, ünï  x\ty\n##!", "word " * 500])
def test_features_are_the_plain_ones(text):
    found, expected = quality.features(text), plain(text)
    assert len(found) == len(expected)
    assert len(set(found.tolist())) <= len(set(expected)) <= len(set(found.tolist())) + 1
    assert (found == 0).sum() >= expected.count("<again>")


def test_order_of_rows_and_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    found = quality.quality(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert found.held_out.tolist() == [zlib.crc32(str(k).encode()) % 4 == 2 for k in found.doc_id]
    assert found.predicted.tolist() == (found.score >= 0.7).astype(int).tolist()
    both = found.merge(pd.read_parquet(f"{at}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.98
    assert held[held.quality == 1].predicted.mean() > 0.99


def test_odd_rows_and_no_labels(spark, documents, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.quality(documents(odd), labels).collect()
    assert len(found) == len(odd) and {r.score for r in found} == {0.5}
    one = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in quality.quality(documents(odd), one).collect())
    assert quality.quality(documents([]), one).count() == 0
    good = quality.keep_good(documents(odd), one, 0.4)
    assert good.columns == documents(odd).columns and good.count() == len(odd)


def test_training_against_a_plain_one():
    """Gradient descent written out for each number, with the same start and order."""
    rng = np.random.default_rng(4)
    docs = []
    for k in range(12):
        buckets = np.unique(rng.integers(0, 40, 6) + 40 * (k % 2))
        docs.append((buckets, np.full(len(buckets), 1 / len(buckets), np.float32), k % 2))
    dims, epochs, rate = 3, 4, 0.4
    weights, bias = quality.trained(docs, epochs, rate, dims)
    start = np.random.default_rng(0)
    table = start.uniform(-1 / dims, 1 / dims, (quality.BUCKETS, dims)).astype(float)
    layer, b, done = [[0.0, 0.0] for _ in range(dims)], [0.0, math.log(7 / 7)], 0
    for _ in range(epochs):
        for i in start.permutation(len(docs)):
            own, share, label = docs[i]
            now = rate * (1 - done / (epochs * len(docs)))
            done += 1
            vector = [sum(float(s) * table[k][d] for k, s in zip(own, share)) for d in range(dims)]
            out = [sum(vector[d] * layer[d][c] for d in range(dims)) + b[c] for c in (0, 1)]
            p = [math.exp(o) / sum(map(math.exp, out)) for o in out]
            error = [p[c] - (c == label) for c in (0, 1)]
            back = [sum(layer[d][c] * error[c] for c in (0, 1)) for d in range(dims)]
            for d in range(dims):
                for c in (0, 1):
                    layer[d][c] -= now * vector[d] * error[c]
                for k, s in zip(own, share):
                    table[k][d] -= now * len(own) ** 0.5 * float(s) * back[d]
            for c in (0, 1):
                b[c] -= 0.1 * now * error[c]
    for k in range(80):
        assert abs(weights[k] - sum(table[k][d] * (layer[d][1] - layer[d][0]) for d in range(dims))) < 1e-4
    assert abs(bias - (b[1] - b[0])) < 1e-4


def test_scores_are_the_plain_average(spark, documents, odd):
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    found = quality.scored(documents(odd), weights, 0.3).collect()
    plain = {}
    for key, text in odd:
        own = [float(weights[k]) for k in quality.features(text)]
        plain.setdefault(key, []).append(1 / (1 + math.exp(-(0.3 + (sum(own) / len(own) if own else 0.0)))))
    for r in found:
        assert min(abs(r.score - x) for x in plain[r.doc_id]) < 1e-6
