"""Lookups, confidence thresholds, decision records and alerts on classified logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lookup tables of so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 100_000
# The least confidence at which a category stands.
THRESHOLDS = {"critical": 0.70, "suspicious": 0.60, "noise": 0.80}


def enriched(logs: DataFrame, table: DataFrame, key: str, columns: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """logs with columns of a lookup table (reputation, assets, places) by key; without an entry they are null. Equal keys: the least row."""
    once = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_e")).select(key, "_e.*")
    small = once.count() <= broadcast_rows
    return logs.join(F.broadcast(once) if small else once, key, "left")


def above_threshold(logs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """logs with a category of routine where the confidence is below the category's threshold; kept tells which stood."""
    low = F.lit(False)
    for category, least in (thresholds or THRESHOLDS).items():
        low = low | ((F.col("category") == category) & (F.col("confidence") < least))
    low = F.coalesce(low, F.lit(False))
    return logs.withColumns({"kept": ~low, "category": F.when(low, "routine").otherwise(F.col("category"))})


def decision_records(logs: DataFrame, model_version: str, rules_version: str) -> DataFrame:
    """One nested record for each log, for an append-only table."""
    return logs.select(
        "log_id", F.col("event_ts").alias("ingest_ts"),
        F.struct(F.col("source").alias("host"), F.col("source_ip").alias("ip")).alias("source"),
        F.struct(F.col("decision.is_regulated").alias("compliance_bypass"), F.col("decision.reason").alias("bypass_reason")).alias("policy"),
        F.struct(F.lit(model_version).alias("model_version"), F.lit(rules_version).alias("rules_version")).alias("model"),
        F.struct(F.col("category").alias("class"), "confidence", F.lit(False).alias("fail_open"), F.col("category").isin("critical", "suspicious").alias("forwarded")).alias("decision"),
    )


def alerts(series: DataFrame, rules: list[tuple[str, str, str, float, int, str]]) -> DataFrame:
    """(alert, severity, ts) where a metric has been beyond its limit for so many samples in a row.

    rules: (alert, metric, "<" or ">", limit, samples, severity); series: (metric_name, ts, value).
    """
    out = None
    for name, metric, sign, limit, samples, severity in rules:
        rows = series.filter(F.col("metric_name") == metric)
        beyond = (F.col("value") < limit if sign == "<" else F.col("value") > limit).cast("int")
        frame = Window.partitionBy("metric_name").orderBy("ts").rowsBetween(-(samples - 1), 0)
        fired = rows.withColumns({"_n": F.count("*").over(frame), "_b": F.sum(beyond).over(frame)}).filter(F.col("_b") == samples)
        one = fired.select(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "ts")
        out = one if out is None else out.unionByName(one)
    return out
