"""Compliance rules that change while a stream runs: a table of versions, looked up anew by every micro-batch.

Each version is a set of rows added at once; a rule that is added again under its name takes the older one's place. Which version a
batch used is written before the batch is, so that a batch that is run again after a failure decides as it did.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules

_RULES = "version long, name string, framework string, retention_days int, source_patterns array<string>, message_patterns array<string>"


def _table(spark: SparkSession, path: str, schema: str) -> list:
    try:
        return spark.read.schema(schema).parquet(path).collect()  # a row a rule or batch
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def add_rules(spark: SparkSession, path: str, new: list[tuple]) -> int:
    """Add compliance rules (name, framework, days, source patterns, message patterns) as the next version, and tell its number. One writer
    at a time; readers see all of a version or nothing of it, as it is one file."""
    version = max((r.version for r in _table(spark, path, _RULES)), default=0) + 1
    spark.createDataFrame([(version, *r) for r in new], _RULES).coalesce(1).write.mode("append").parquet(path)
    return version


def rules_at(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[tuple]]:
    """The newest version (or the given one) and its rules in the order in which names first came; 0 and none before the first."""
    rows = sorted((r for r in _table(spark, path, _RULES) if version is None or r.version <= version), key=lambda r: r.version)
    last = {r.name: (r.name, r.framework, r.retention_days, list(r.source_patterns or []), list(r.message_patterns or [])) for r in rows}
    return max((r.version for r in rows), default=0) if version is None else version, list(last.values())


def checked(rules_path: str, out: str, pins: str) -> Callable[[DataFrame, int], None]:
    """A batch function: logs with source and message get decision and rules_version, and are written by batch. pins is where batches
    note their version. Patterns that are no regular expressions are left out, as elsewhere."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        noted = _table(spark, f"{pins}/batch={number}", "version long")
        version, current = rules_at(spark, rules_path, noted[0].version if noted else None)
        if not noted:
            spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{pins}/batch={number}")
        usable = [(n, f, d, [p for p in s if rules.valid(p)], [p for p in m if rules.valid(p)]) for n, f, d, s, m in current]
        judged = rules.with_compliance(batch, F.col("source"), F.col("message"), usable).withColumn("rules_version", F.lit(version).cast("long"))
        judged.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each
