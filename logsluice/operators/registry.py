"""Named classifiers: functions from logs to logs with category and confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

Classifier = Callable[[DataFrame], DataFrame]
_KNOWN: dict[str, Classifier] = {}


def register(name: str) -> Callable[[Classifier], Classifier]:
    def keep(f: Classifier) -> Classifier:
        _KNOWN[name] = f
        return f

    return keep


def names() -> list[str]:
    return sorted(_KNOWN)


def classify(logs: DataFrame, name: str) -> DataFrame:
    if name not in _KNOWN:
        raise KeyError(f"no classifier {name}; there are {', '.join(names())}")
    return _KNOWN[name](logs)


@register("rules")
def by_rules(logs: DataFrame) -> DataFrame:
    return rules.with_rule(logs, F.col("message"))


@register("weak")
def by_weak_labels(logs: DataFrame) -> DataFrame:
    label, sure = rules.auto_labels(F.col("message"))
    return logs.withColumns({"category": label, "confidence": sure})
