"""File sinks: the partitioned archive, SIEM feed files, validation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cold_storage(logs: DataFrame, path: str, at: str = "event_ts", format: str = "json", rows_a_file: int = 10_000, mode: str = "append") -> None:
    """All logs below year=/month=/day=/category= folders, gzip for JSON."""
    dated = logs.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})
    writer = dated.write.mode(mode).partitionBy("year", "month", "day", "category").option("maxRecordsPerFile", rows_a_file)
    writer.option("compression", "gzip").json(path) if format == "json" else writer.parquet(path)


def feed(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One text column to text files."""
    lines.write.mode(mode).text(path)


def validation_report(summary: DataFrame, misses: DataFrame, path: str) -> None:
    """The summary as JSON and the misses as CSV."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    misses.write.mode("overwrite").option("header", True).csv(f"{path}/misses")
