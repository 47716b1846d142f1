"""Combining model predictions, routing and the whole triage of a log. Column arithmetic in one narrow stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, values
from . import rules

CATEGORIES = values.CATEGORIES


def spread(category: Column, confidence: Column) -> dict[str, Column]:
    """Probabilities of a model that has none: its category gets the confidence, the others share the rest."""
    return {c: F.when(category == c, confidence).otherwise((1 - confidence) / (len(CATEGORIES) - 1)) for c in CATEGORIES}


def best(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Category and score of the greatest; ties go to the first in order."""
    top = F.greatest(*scores.values())
    pick = F.when(scores[CATEGORIES[0]] >= top, CATEGORIES[0])
    for c in CATEGORIES[1:]:
        pick = pick.when(scores[c] >= top, c)
    return pick, top


def with_weighted(df: DataFrame, models: dict[str, dict[str, Column]], rule: tuple[Column, Column], weights: dict[str, float] | None = None, by_sum: bool = False, override_above: float | None = None) -> DataFrame:
    """df with category, confidence, overridden and p_*: the weighted average of the models' probabilities.

    by_sum: divide by the sum of scores (a rule's critical above 0.9 overrides), else by the total weight (above 0.85).
    """
    weights, limit = weights or values.MODEL_WEIGHTS, override_above if override_above is not None else (0.9 if by_sum else 0.85)
    plus = lambda xs: sum(xs[1:], xs[0])
    raw = {f"_s_{c}": plus([F.lit(weights.get(m, 0.25)) * p[c] for m, p in models.items()]) for c in CATEGORIES}
    total = plus([F.col(c) for c in raw]) if by_sum else F.lit(sum(weights.get(m, 0.25) for m in models))
    out = df.withColumns(raw).withColumns({f"p_{c}": F.try_divide(F.col(f"_s_{c}"), total) for c in CATEGORIES}).drop(*raw)
    category, confidence = best({c: F.col(f"p_{c}") for c in CATEGORIES})
    forced = F.coalesce((rule[0] == "critical") & (rule[1] > limit), F.lit(False))
    out = out.withColumn("overridden", forced).withColumn("_top", confidence)
    pick = F.when(F.col("overridden"), "critical").otherwise(category)
    return out.withColumns({"category": pick, "confidence": F.when(F.col("overridden"), rule[1]).otherwise(F.col("_top"))}).drop("_top")


def voted(models: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    weights = weights or values.MODEL_WEIGHTS
    votes = {}
    for c in CATEGORIES:
        each = [F.when(category == c, F.lit(weights.get(m, 0.25))).otherwise(F.lit(0.0)) for m, category in models.items()]
        votes[c] = sum(each[1:], each[0])
    category, top = best(votes)
    return {"category": category, "confidence": top / sum(weights.get(m, 0.25) for m in models)}


def or_default(category: Column, confidence: Column, default: tuple[str, float] = ("routine", 0.5)) -> tuple[Column, Column]:
    """A model that gave nothing counts as the default."""
    return F.coalesce(category, F.lit(default[0])), F.when(category.isNotNull(), F.coalesce(confidence, F.lit(default[1]))).otherwise(F.lit(default[1]))


def fail_open(category: Column, confidence: Column, model: str, reason: Column) -> dict[str, Column]:
    """A row whose scoring failed is critical at 0.0, so that it is forwarded."""
    failed = category.isNull()
    return {"category": F.coalesce(category, F.lit("critical")), "confidence": F.when(failed, 0.0).otherwise(confidence), "model": F.when(failed, "fail_open").otherwise(model), "fail_open_used": failed, "reason": F.when(failed, reason)}


def forwarded(category: Column) -> Column:
    return category.isin("critical", "suspicious")


def severity(category: Column, known: dict[str, int] | None = None) -> Column:
    """A severity for each known category, else 5; null counts as routine's text does: 5."""
    case = None
    for c, s in (known or values.SEVERITY).items():
        case = F.when(F.lower(category) == c, s) if case is None else case.when(F.lower(category) == c, s)
    return case.otherwise(5)


def title_severity(title: Column) -> Column:
    case = None
    for word, s in values.TITLE_SEVERITY:
        case = F.when(F.lower(title).contains(word), s) if case is None else case.when(F.lower(title).contains(word), s)
    return case


def routes(logs: DataFrame, category: str = "category", table: dict | None = None) -> DataFrame:
    """A row for each log and destination, with method and batch size. Categories without a rule take the routine queue.

    The outer explode loses nothing, as every rule has a destination; the inner one would make the optimizer push a filter on
    the route through all projections below it, each time writing their expressions out anew.
    """
    table = table or values.ROUTES
    entry = lambda v: F.struct(F.lit(v[0]).alias("method"), F.array(*map(F.lit, v[1])).alias("destinations"), F.lit(v[2]).alias("batch_size"))
    case = None
    for c, v in table.items():
        case = F.when(F.col(category) == c, entry(v)) if case is None else case.when(F.col(category) == c, entry(v))
    other = (table["routine"][0], ["cold_storage"], table["routine"][2]) if "routine" in table else ("queue", ["cold_storage"], 100)
    return logs.withColumn("_route", case.otherwise(entry(other))).withColumn("destination", F.explode_outer("_route.destinations")).withColumns({"method": F.col("_route.method"), "batch_size": F.col("_route.batch_size")}).drop("_route")


def triage(logs: DataFrame, with_models: bool = True, models: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """parse, compliance, rules and model scores, combination, routing: one projection and one explode, no shuffle.

    logs has log_id, raw_message and source. models (see scoring.models_at) are applied to the parsed message and event_ts; a
    kind without a model counts as routine at 0.5. With none given, with_models expects text_* and anomaly_* columns
    (see plans.views.scored), else rules decide alone. Filters on logs belong before it: none is pushed through.
    """
    message = F.col("parsed_message")
    out = rules.with_compliance(parse.parsed(logs), F.col("source"), message)
    out = rules.with_rule(out, message, names=("_category", "_rule_name", "_confidence"))
    rule = (F.col("_category"), F.col("_confidence"))
    scores = {"rule_based": spread(*rule)}
    if models is not None:
        for model in models.values():
            out = model(out, "parsed_message", "event_ts")
        scores |= {kind: spread(*or_default(F.lit(None).cast("string"), F.lit(None).cast("double"))) for kind in ("text_model", "anomaly") if kind not in models}
    if models is None and with_models or models and "text_model" in models:
        scores["text_model"] = {c: F.col(f"text_p_{c}") for c in CATEGORIES}
    if models is None and with_models or models and "anomaly" in models:
        scores["anomaly"] = spread(F.col("anomaly_category"), F.col("anomaly_confidence"))
    out = with_weighted(out, scores, rule)
    regulated = F.col("decision.is_regulated")
    # Always true, but unknown to the optimizer: a filter on the decision stays above it and is not written out in terms of the raw line.
    here = F.spark_partition_id() >= 0
    out = out.withColumns({
        "category": F.when(here & regulated, "critical").otherwise(F.col("category")),
        "confidence": F.when(regulated, 1.0).otherwise(F.col("confidence")),
        "model": F.when(regulated, "compliance_bypass").otherwise("ensemble"),
        "retention_days": F.col("decision.retention_days"),
    })
    return routes(out).select("log_id", "format", "source", "parsed_message", "category", "confidence", "model", "retention_days", "destination", "method")
