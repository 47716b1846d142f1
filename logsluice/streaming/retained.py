"""Decisions that a stream keeps for a day, by hour, and offenses that look up the hours that they need.

A batch writes its decisions to partitions of hour and batch number, so a batch that is run again replaces itself. An offense's
window touches three hours at most; these are read by partition pruning, whatever the day holds. Hours out of the retention are
dropped as folders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import correlate

RETAINED, LOOKBACK, EVERY = 24, 1, 300  # hours, hours, seconds between two runs


def hour_of(at: Column) -> Column:
    """Hours since 1970."""
    return F.floor(F.unix_timestamp(at) / 3600).cast("long")


def keep(folder: str, at: str = "event_ts") -> Callable[[DataFrame, int], None]:
    """A batch function that adds decisions to the folder. Those without a time are in no hour, and so match no offense."""

    def each(batch: DataFrame, number: int) -> None:
        placed = batch.filter(F.col(at).isNotNull()).withColumns({"hour": hour_of(F.col(at)), "batch": F.lit(number).cast("long")})
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(folder)

    return each


def drop_old(spark: SparkSession, folder: str, now: dt.datetime, hours: int = RETAINED) -> int:
    """Drop the hours that ended longer ago than the retention; how many these were. now is in UTC."""
    last = int(now.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600 - hours
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("hour=") and int(s.getPath().getName()[5:]) < last]
    for p in old:
        fs.delete(p, True)
    return len(old)


def near(spark: SparkSession, folder: str, schema: T.StructType, offenses: DataFrame) -> DataFrame:
    """The kept decisions of all hours that the offenses' windows touch."""
    start = F.col("start_time")
    ends = [hour_of(start - F.expr(f"INTERVAL {correlate.BEFORE} MINUTES")), hour_of(start + F.expr(f"INTERVAL {correlate.AFTER} MINUTES"))]
    wanted = [r.h for r in offenses.filter(start.isNotNull()).select(F.explode(F.sequence(*ends)).alias("h")).distinct().collect()]  # as many as hours
    whole = T.StructType([*schema, T.StructField("hour", T.LongType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(folder).filter(F.col("hour").isin(wanted)).drop("hour", "batch")


def by_source(folder: str, schema: T.StructType, out: str, now: Callable[[], dt.datetime] | None = None, lookback: int = LOOKBACK) -> Callable[[DataFrame, int], None]:
    """A batch function for offenses: their pairs (offense_id, log_id) with kept decisions of a like source name, by batch. With now,
    only open offenses that began in the hours before it count, as in a run every few minutes (EVERY); else all do. now is in UTC."""

    def each(offenses: DataFrame, number: int) -> None:
        if now is not None:
            at = F.timestamp_seconds(F.lit(int(now().replace(tzinfo=dt.timezone.utc).timestamp())))
            offenses = offenses.filter((F.col("status") == "OPEN") & (F.col("start_time") > at - F.expr(f"INTERVAL {lookback} HOURS")) & (F.col("start_time") <= at))
        offenses = offenses.persist()
        try:
            found = correlate.by_source(near(offenses.sparkSession, folder, schema, offenses), offenses)
            found.select("offense_id", "log_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            offenses.unpersist()

    return each
