"""Training and scoring with Spark ML: boosted trees on word n-grams, isolation forests, evaluation, saved models."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values

LABELS = sorted(values.CATEGORIES)


def label_indexed(df: DataFrame, label: str, to: str = "label") -> DataFrame:
    """Index of a category in alphabetical order; other labels give null."""
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col(label))
    return df.withColumn(to, F.when(place > 0, (place - 1).cast("double")))


def label_decoded(index: Column) -> Column:
    """The category of an index; what is no index gives routine."""
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), index.cast("int")), F.lit("routine"))


def text_features(points: DataFrame, text: str = "message", copies: str = "copies", grams: int = 3, most: int = 10_000, least_docs: int = 2, most_share: float = 0.95) -> list:
    """Fitted stages: words, 1..n-grams, counts of the most frequent terms, times their inverse document frequencies.

    points has each different text once or more, for so many copies; frequencies count the copies. The vocabulary alone comes to the driver.
    """
    parts = [RegexTokenizer(inputCol=text, outputCol="_w1", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)]
    parts += [NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in range(2, grams + 1)]
    joined = ", ".join(f"_w{n}" for n in range(1, grams + 1))
    parts.append(SQLTransformer(statement=f"SELECT *, concat({joined}) AS _grams FROM __THIS__"))
    told = PipelineModel(parts).transform(points.select(text, copies))
    each = lambda xs, tf, df: F.transform(xs, lambda x: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))
    terms = told.select(copies, F.inline(F.concat(each(F.col("_grams"), 1, 0), each(F.array_distinct("_grams"), 0, 1))))
    n = points.agg(F.sum(copies)).first()[0] or 0
    counts = terms.groupBy("term").agg(F.sum(F.col("tf") * F.col(copies)).alias("tf"), F.sum(F.col("df") * F.col(copies)).alias("df"))
    found = counts.filter((F.col("df") >= least_docs) & (F.col("df") <= most_share * n)).orderBy(F.desc("tf"), "term").limit(most).collect()
    if not found:
        raise ValueError(f"no term comes in {least_docs} texts and in no more than {most_share:.0%} of them")
    counter = CountVectorizerModel.from_vocabulary([r.term for r in found], "_grams", "_tf")
    return [*parts, counter, ElementwiseProduct(inputCol="_tf", outputCol="features", scalingVec=Vectors.dense([math.log((n + 1) / (r.df + 1)) for r in found]))]


def boosted_trees(rounds: int = 200, depth: int = 6, rate: float = 0.1, weight: str | None = "weight", validation: str | None = None) -> OneVsRest:
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42)
    if validation:
        one = one.setValidationIndicatorCol(validation)
    out = OneVsRest(classifier=one, labelCol="label", featuresCol="features", parallelism=4)
    return out.setWeightCol(weight) if weight else out


def train(df: DataFrame, text: str, label: str, classifier: Estimator | None = None, rows_a_task: int = 20_000, copies: str | None = None, **features) -> PipelineModel:
    """A pipeline from text to prediction, with balanced class weights. Rows without a known label or text do not count.

    Rows that are equal in all that the classifier sees are one point with the sum of their weights, so passes over the points cost
    what the different texts cost, whatever the rows are. copies names a column that tells for how many rows a row stands.
    Trees are grown in many short passes over the points, so these are dealt out to no more tasks than their number asks for.
    """
    from ..sources.scratch import kept_table
    from . import rows

    classifier = classifier or boosted_trees()
    inner = classifier.getClassifier() if isinstance(classifier, OneVsRest) else classifier
    seen = [inner.getValidationIndicatorCol()] if inner.hasParam("validationIndicatorCol") and inner.isDefined("validationIndicatorCol") else []
    known = label_indexed(df, label).filter(F.col("label").isNotNull() & (F.trim(text) != ""))
    points = kept_table(known.groupBy(text, label, "label", *seen).agg((F.sum(copies) if copies else F.count("*")).alias("copies")), "points")
    weighted = points.join(F.broadcast(rows.class_weights(points, label, "copies").select(label, "weight")), label)  # a row for each class
    weighted = weighted.withColumn("weight", F.col("weight") * F.col("copies"))
    tasks = max(1, -(-points.count() // rows_a_task))
    weighted = weighted.coalesce(tasks) if tasks < df.sparkSession.sparkContext.defaultParallelism else weighted
    if classifier.hasParam("weightCol") and not classifier.isDefined("weightCol"):
        classifier = classifier.copy().setWeightCol("copies")
    stages = text_features(points, text, **features)
    return PipelineModel([*stages, classifier.fit(PipelineModel(stages).transform(weighted))])


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction and _raw, the classifier's raw score of each class. One-vs-rest models are asked one by one: the
    combined one takes every row through Python for each of its classes."""
    last = model.stages[-1]
    if not isinstance(last, OneVsRestModel):
        return model.transform(df).withColumn("_raw", vector_to_array("rawPrediction"))
    out = PipelineModel(model.stages[:-1]).transform(df)
    for k, one in enumerate(last.models):
        out = one.copy().setRawPredictionCol(f"_raw{k}").setPredictionCol("").setProbabilityCol("").transform(out)
    out = out.withColumn("_raw", F.array(*[F.get(vector_to_array(f"_raw{k}"), F.lit(1)) for k in range(len(last.models))]))
    return out.withColumn("prediction", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with category, confidence and four probabilities: the softmax of the classifier's raw scores."""
    out = predicted(model, df)
    up = F.transform("_raw", lambda x: F.exp(x - F.array_max("_raw")))
    out = out.withColumn("_p", up).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
    shares = {f"p_{c}": F.get("_p", F.lit(k)) / F.col("_sum") for k, c in enumerate(LABELS)}
    out = out.withColumns(shares).withColumns({"category": label_decoded(F.col("prediction")), "confidence": F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in shares])})
    return out.select(*df.columns, "category", "confidence", *shares)


def importances(model: PipelineModel, n: int = 50) -> list[tuple[str, float]]:
    """The n most important terms over all trees; the vocabulary is bounded by the model's own size."""
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    total = np.mean([m.featureImportances.toArray() for m in model.stages[-1].models], axis=0)
    order = np.lexsort((np.arange(len(total)), -total))[:n]
    return [(vocabulary[i], float(total[i])) for i in order if total[i] > 0]


def cross_validated(df: DataFrame, key: str, text: str, label: str, classifier: Estimator | None = None, most: int = 5, **features) -> DataFrame:
    """(fold, n, accuracy): at most so many folds, of ten rows at least; a row's fold is a hash of its key. One fold is tested on itself.

    After one pass over the rows, folds consist of different texts and labels with their numbers.
    """
    from ..sources.scratch import kept_table

    folds = max(1, min(most, df.count() // 10))
    placed = df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    placed, out = kept_table(placed.groupBy("fold", text, label).agg(F.count("*").alias("times")), "folds"), None
    for k in range(folds):
        model = train(placed.filter((F.col("fold") != k) | F.lit(folds == 1)).drop("fold"), text, label, classifier or boosted_trees(rounds=50), copies="times", **features)
        tested = predicted(model, label_indexed(placed.filter(F.col("fold") == k), label)).filter("label IS NOT NULL")
        n, right = F.coalesce(F.sum("times"), F.lit(0)), F.sum(F.when(F.col("prediction") == F.col("label"), F.col("times")).otherwise(0))
        one = tested.agg(F.lit(k).alias("fold"), n.alias("n"), F.try_divide(right, F.sum("times")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


class NothingPublished(LookupError):
    """No model has been published at a path."""


def publish(spark: SparkSession, path: str, said: dict, write: Callable[[str], object]) -> str:
    """Have a model written to a new folder below path, then add a row that tells of it. What was published before stays as it is, so
    a reader finds either the last model or this one, whole, whatever fails."""
    folder = f"{path}/{said['name']}-{uuid.uuid4().hex}"
    write(folder)
    row = spark.createDataFrame([(time.time_ns(), folder, json.dumps(said))], "at long, folder string, said string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return folder


def published(spark: SparkSession, path: str) -> tuple[str, dict]:
    """Folder and description of the last model that was published at path."""
    try:
        last = spark.read.schema("at long, folder string, said string").parquet(f"{path}/published").orderBy(F.desc("at")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        raise NothingPublished(path)
    return last.folder, json.loads(last.said)


def save(model: PipelineModel, path: str, results: dict) -> str:
    return publish(SparkSession.active(), path, results, lambda folder: model.write().save(f"{folder}/model"))


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    folder, said = published(spark, path)
    return PipelineModel.load(f"{folder}/model"), said


def _depth_left(n: float) -> float:
    """Mean path length of a search that fails among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, copies: np.ndarray, rng: np.random.Generator, limit: int) -> list:
    """Rows (feature, cut, left, right, path length left at a leaf), the root first. Each point stands for so many copies."""
    nodes: list[list[float]] = []

    def grow(own: np.ndarray, depth: int) -> int:
        at, rows = len(nodes), x[own]
        nodes.append([-1.0, 0.0, 0.0, 0.0, depth + _depth_left(float(copies[own].sum()))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left = rows[:, f] < cut
            if left.any() and not left.all():
                nodes[at][:2] = [f, cut]
                nodes[at][2] = grow(own[left], depth + 1)
                nodes[at][3] = grow(own[~left], depth + 1)
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def draw_shares(n: int, sample: int, trees: int) -> list[float]:
    """The chances that a row of n is drawn by 1 tree or more, 2 or more, and so on, if each takes it with chance sample / n."""
    p = sample / n
    one = lambda k: math.exp(math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1) + k * math.log(p) + (trees - k) * math.log1p(-p))
    tails, so_far = [], 0.0
    for k in range(trees, 0, -1):
        so_far += one(k)
        tails.append(so_far)
    return [t for t in reversed(tails) if t > 2.0**-60]


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 200, sample: int = 256) -> DataFrame:
    """Rows (tree, nodes): each tree grows on its own hashed sample of about sample rows, in one task of its own.

    One hash of a row's key and values tells how many trees take it, and for the few rows that any takes, which: so the forest is
    the same under any partitioning. Rows that are equal throughout are drawn together and are one point of so many copies,
    counted before the shuffle; a tree sees no more points than different rows were drawn.
    """
    n, every = df.count(), F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = df.select(key, *columns, F.xxhash64(F.lit(42), key, *columns).alias("_h"))
    if n <= sample:
        drawn = drawn.withColumn("_k", F.lit(trees))
    else:
        u = F.shiftrightunsigned("_h", 11).cast("double") * 2.0**-53
        shares = draw_shares(n, sample, trees)
        drawn = drawn.withColumn("_u", u).filter(F.col("_u") < shares[0])
        drawn = drawn.withColumn("_k", F.size(F.filter(F.array(*map(F.lit, shares)), lambda s: F.col("_u") < s))).drop("_u")
    points = drawn.groupBy(key, *columns, "_h", "_k").agg(F.count("*").alias("copies"))
    order = F.array_sort(F.transform(every, lambda t: F.struct(F.xxhash64(F.col("_h"), t).alias("o"), t.alias("t"))))
    points = points.select(key, *columns, "copies", F.explode(F.transform(F.slice(order, F.lit(1), F.col("_k")), lambda x: x["t"])).alias("tree"))

    def grow(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, *columns])
        nodes = _tree(rows[columns].to_numpy(float), rows["copies"].to_numpy(float), np.random.default_rng(42 + int(key_[0])), int(np.ceil(np.log2(max(sample, 2)))))
        return pd.DataFrame({"tree": [int(key_[0])], "nodes": [[v for r in nodes for v in r]]})

    return points.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>")


def forest_scored(df: DataFrame, forest: DataFrame, columns: list[str], sample: int = 256) -> DataFrame:
    """df with anomaly_score: 0.5 less the usual isolation score, so negative means anomalous."""
    trees = [np.array(r.nodes).reshape(-1, 5) for r in forest.orderBy("tree").collect()]  # trees * 2 * sample nodes
    if not trees:
        raise ValueError("The forest has no trees: it was grown on no rows.")
    # All trees in one table; a leaf is its own child, so rows go down as many levels as the deepest tree has, all trees at once.
    base = np.cumsum([0, *(len(t) for t in trees)])
    nodes = np.concatenate(trees)
    inner = nodes[:, 0] >= 0
    own, shift = np.arange(len(nodes)), np.repeat(base[:-1], [len(t) for t in trees])
    left, right = (np.where(inner, nodes[:, k].astype(int) + shift, own).astype(np.int32) for k in (2, 3))
    levels = int(np.ceil(np.log2(max(sample, 2))))
    table = base[:-1].astype(np.int32), np.maximum(nodes[:, 0], 0).astype(np.int32), nodes[:, 1], np.stack([right, left], 1), nodes[:, 4], levels
    shared, usual = df.sparkSession.sparkContext.broadcast(table), _depth_left(sample)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        roots, feature, cut, child, depth, steps = shared.value
        whole, out = np.column_stack([np.asarray(v, float) for v in xs]), []
        for x in np.array_split(whole, max(1, len(whole) // 1000)):  # rows * trees numbers at once
            at, rows = np.repeat(roots[None, :], len(x), 0), np.arange(len(x))[:, None]
            for _ in range(steps):
                at = child[at, (x[rows, feature[at]] < cut[at]).astype(np.int8)]
            out.append(depth[at].mean(axis=1))
        return pd.Series(0.5 - 2.0 ** (-np.concatenate(out) / usual))

    return df.withColumn("anomaly_score", score(*columns))


def scaled(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns less their mean over train, by their deviation (by 1 where that is 0)."""
    r = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"] or 1.0) for c in columns})


def contamination_cut(scores: DataFrame, contamination: float = 0.1) -> float:
    """The score below which that share of the training rows lies, exactly."""
    from . import rows

    return rows.quantiles(scores, "anomaly_score", [contamination]).first()["quantile"]


def anomaly_category(score: Column, cut: Column | float) -> tuple[Column, Column]:
    """Below the cut suspicious at min(0.9, 0.5 + |score|), else routine at 0.5."""
    odd = score < cut
    return F.when(odd, "suspicious").otherwise("routine"), F.when(odd, F.least(F.lit(0.9), 0.5 + F.abs(score))).otherwise(F.lit(0.5))
