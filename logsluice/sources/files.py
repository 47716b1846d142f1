"""File sources: labelled CSV, split CSV, log directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values

LABELLED = "timestamp string, message string, category string, source string"


def labelled_csv(spark: SparkSession, path: str, schema: str | None = LABELLED) -> DataFrame:
    """Rows with a known category. Fails if the file has no message or category column."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    header = reader.csv(path).columns
    missing = [c for c in ("message", "category") if c not in header]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    known = {f.split()[0]: f.split()[1] for f in (schema or "").split(", ") if f}
    return reader.schema(", ".join(f"`{c}` {known.get(c, 'string')}" for c in header)).csv(path).filter(F.col("category").isin(*values.CATEGORIES))


def split_csv(spark: SparkSession, paths: dict[str, str], text: str = "message", label: str = "category") -> DataFrame:
    """(split, text, label) of one file for each split."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    parts = [reader.csv(p).select(F.lit(name).alias("split"), F.col(text).alias("text"), F.col(label).alias("label")) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def log_directory(spark: SparkSession, path: str) -> DataFrame:
    """(message, source_file) of all *.log and *.txt lines and *.csv rows below path; blank lines and unreadable files are skipped.

    Of a CSV, the message is column Content or message, or else the first.
    """
    options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true"}
    name = F.col("_metadata.file_name").alias("source_file")
    parts = []
    for kind in ("*.log", "*.txt"):
        lines = spark.read.options(**options, pathGlobFilter=kind).text(path)
        parts.append(lines.select(F.col("value").alias("message"), name).filter(F.trim("message") != ""))
    table = spark.read.options(**options, pathGlobFilter="*.csv", header="true", multiLine="true", escape='"').csv(path)
    if table.columns:
        column = next((c for c in ("Content", "message") if c in table.columns), table.columns[0])
        parts.append(table.select(F.col(column).alias("message"), name))
    return union_sources(*parts)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Frames below each other; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
