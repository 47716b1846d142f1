"""Fitted models that score logs inside the triage plan, saved to a folder and loaded from it by name.

A text model is a Spark ML pipeline from words to boosted trees; an anomaly model is an isolation forest with the scaling of its
features and the cut of its scores. Either turns logs into logs with its columns in one narrow step: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from . import ml, registry

KINDS = ("text_model", "anomaly")


def _beside(logs: DataFrame, taken: set[str], columns: dict) -> tuple[DataFrame, list]:
    """logs with columns that a model reads, and how to select logs' own ones again. Own columns with names that the model takes are renamed
    meanwhile. (One struct of all would be taken apart by the optimizer, which then writes out everything below it anew.)"""
    own = {c: f"_kept_{c}" if c in taken | {*columns} else c for c in logs.columns}
    out = logs.select("*", *[c.alias(f"_new_{n}") for n, c in columns.items()]).withColumnsRenamed({c: k for c, k in own.items() if c != k}).withColumnsRenamed({f"_new_{n}": n for n in columns})
    return out, [F.col(k).alias(c) for c, k in own.items()]


@dataclass
class TextModel:
    """Adds text_category, text_confidence and text_p_<category>. A null text counts as an empty one."""

    model: PipelineModel

    def __call__(self, logs: DataFrame, message: str = "message", at: str | None = None) -> DataFrame:
        words = text.normalised(F.coalesce(F.col(message), F.lit("")), text.NORMALISE_TRAIN)
        taken = {"prediction", "rawPrediction", "probability", "features", "label", "category", "confidence", *[f"p_{c}" for c in values.CATEGORIES]}
        beside, own = _beside(logs.drop("text_category", "text_confidence", *[f"text_p_{c}" for c in values.CATEGORIES]), taken, {"message": words})
        out = ml.scored(self.model, beside)
        return out.select(*own, F.col("category").alias("text_category"), F.col("confidence").alias("text_confidence"), *[F.col(f"p_{c}").alias(f"text_p_{c}") for c in values.CATEGORIES])

    def save(self, spark: SparkSession, path: str, name: str) -> str:
        return ml.save(self.model, path, {"name": name, "kind": "text_model"})


@dataclass
class AnomalyModel:
    """Adds anomaly_score, anomaly_category and anomaly_confidence. Features that cannot be told (no text, no time) count as usual."""

    trees: DataFrame
    mean: dict[str, float]
    deviation: dict[str, float]
    cut: float
    sample: int = 256

    def __call__(self, logs: DataFrame, message: str = "message", at: str | None = "event_ts") -> DataFrame:
        when = F.col(at) if at in logs.columns else F.lit(None).cast("timestamp")
        features = text.anomaly_features(F.col(message), when)
        scaled = {f"_x_{c}": F.coalesce((features[c].cast("double") - F.lit(self.mean[c])) / F.lit(self.deviation[c] or 1.0), F.lit(0.0)) for c in self.mean}
        beside, own = _beside(logs.drop("anomaly_score", "anomaly_category", "anomaly_confidence"), set(), scaled)
        out = ml.forest_scored(beside, self.trees, list(scaled), self.sample)
        category, confidence = ml.anomaly_category(F.col("anomaly_score"), self.cut)
        return out.select(*own, "anomaly_score", category.alias("anomaly_category"), confidence.alias("anomaly_confidence"))

    def save(self, spark: SparkSession, path: str, name: str) -> str:
        said = {"name": name, "kind": "anomaly", "mean": self.mean, "deviation": self.deviation, "cut": self.cut, "sample": self.sample}
        return ml.publish(spark, path, said, lambda folder: self.trees.write.parquet(f"{folder}/trees"))


def fit_anomaly(logs: DataFrame, usual, key: str = "log_id", message: str = "message", at: str = "event_ts", trees: int = 200, contamination: float = 0.1) -> AnomalyModel:
    """Scaling, forest and cut from the usual logs (all, if 100 or fewer are)."""
    from ..sources.scratch import kept_table

    features = text.anomaly_features(F.col(message), F.col(at))
    own = kept_table(logs.select(key, F.coalesce(usual, F.lit(False)).alias("usual"), *[c.cast("double").alias(n) for n, c in features.items()]), "features")
    train = own if own.filter("usual").limit(101).count() <= 100 else own.filter("usual")
    of = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    mean, deviation = ({c: float(of[f"{k}_{c}"] or 0.0) for c in features} for k in "ms")
    scaled = train.select(key, *[((F.col(c) - F.lit(mean[c])) / F.lit(deviation[c] or 1.0)).alias(c) for c in features])
    forest = kept_table(ml.isolation_forest(scaled, key, list(features), trees), "forest")
    scores = kept_table(ml.forest_scored(scaled, forest, list(features)).select("anomaly_score"), "scores")
    return AnomalyModel(forest, mean, deviation, ml.contamination_cut(scores, contamination))


Model = Callable[..., DataFrame]
_loaded: dict[tuple[str, str], Model] = {}


def load(spark: SparkSession, path: str) -> tuple[Model, dict]:
    """The model that was last published at path, and what was told of it. A published folder never changes, so it is read once."""
    folder, said = ml.published(spark, path)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _loaded:
        if said.get("kind") == "anomaly":
            _loaded[key] = AnomalyModel(spark.read.parquet(f"{folder}/trees"), said["mean"], said["deviation"], said["cut"], said["sample"])
        else:
            _loaded[key] = TextModel(PipelineModel.load(f"{folder}/model"))
    return _loaded[key], said


def models_at(spark: SparkSession, paths: dict[str, str]) -> dict[str, Model]:
    """The models of a triage: kind -> the path where it was published. A path where nothing was published gives no model, so
    that triage takes the default in its place."""
    out = {}
    for kind, path in paths.items():
        if kind not in KINDS:
            raise KeyError(f"no kind of model {kind}; there are {', '.join(KINDS)}")
        try:
            out[kind] = load(spark, path)[0]
        except ml.NothingPublished:
            continue
    return out


def register(name: str, path: str) -> None:
    """Let registry.classify know the model at path by a name: logs with category and confidence, and p_* of a text model. Which model is
    the last one is looked up at each use."""

    def classify(logs: DataFrame) -> DataFrame:
        model, said = load(logs.sparkSession, path)
        prefix = "anomaly" if said.get("kind") == "anomaly" else "text"
        own = {"category": f"{prefix}_category", "confidence": f"{prefix}_confidence"} | ({} if prefix == "anomaly" else {f"p_{c}": f"text_p_{c}" for c in values.CATEGORIES})
        return model(logs.drop(*own)).select(*[c for c in logs.columns if c not in own], *[F.col(c).alias(n) for n, c in own.items()])

    registry.register(name)(classify)


def create(config: dict) -> registry.Classifier:
    """A classifier by configuration: {"type": a registered name}, or {"type": name, "path": where its model was published}."""
    kind = str(config.get("type", "rules"))
    if config.get("path"):
        register(kind, config["path"])
    if kind not in registry.names():
        raise KeyError(f"no classifier {kind}; there are {', '.join(registry.names())}")
    return lambda logs: registry.classify(logs, kind)
