"""Structured Streaming: the same operators on streams, with watermarks, state and sinks.

Metrics are late by ten minutes at most, decisions by a day. Stateless steps are the batch functions themselves; state is
bounded by watermarks or by the operator's own window. Operators with state of their own are in stateful.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text, values
from ..operators import ensemble
from ..sources.scratch import folder as _place
from .stateful import state_store

LATE, LATE_DECISIONS = "10 minutes", "24 hours"
#: Files of a replay for each core.
RANGES = 4


def replayed(rows: DataFrame, at: str = "event_ts", files_a_batch: int | None = None, key: str | None = None, ordered: bool = True) -> DataFrame:
    """A table as a stream from files, closed by a row of the far future that lets every window end.

    Files hold ranges of event time and come in its order, as the rows did: dealt out at random, all but those of the first
    batches would be too late for the watermark and be dropped. With ordered False they stay as the table has them, for streams whose
    watermark spans it. A batch has a file for each core, unless told otherwise.

    All else in the closing row is null, but for a key of -1: a join key must not be null, or the row is filtered out before the
    watermark sees it.
    """
    spark = rows.sparkSession
    path, cores = f"{_place(spark, 'replay')}/0", spark.sparkContext.defaultParallelism
    closing = spark.range(1).select(F.lit("2100-01-01").cast("timestamp").alias(at))
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    # The hash parts rows of one time; a file still has none that are younger than the next one's.
    (rows.repartitionByRange(RANGES * cores, at, F.xxhash64(*rows.columns)) if ordered else rows).write.parquet(path)
    if ordered:
        _in_order(spark, path)
    closing.select(*[F.col(c) if c == at else F.lit(-1 if c == key else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch or cores).parquet(path)


def _in_order(spark: SparkSession, path: str) -> None:
    """Files of a folder by the number of their task: a stream takes files by their time, which is set so, before now."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda: sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: int(s.getPath().getName().split("-")[1]))
    first = min((s.getModificationTime() for s in parts()), default=0) - 1000 * (len(parts()) + 1)
    for k, s in enumerate(parts()):
        fs.setTimes(s.getPath(), first + 1000 * k, -1)
    times = [s.getModificationTime() for s in parts()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise OSError(f"{path}: this store keeps no times that are set, so files of a replay would come in no order")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into files, and read those."""
    spark = stream.sparkSession
    path = _place(spark, name)
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def in_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], state: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to a function (a callback, several sinks); progress is kept, in the folder state, once it returns."""
    state = state or f"{_place(stream.sparkSession, name)}/state"
    with state_store(stream.sparkSession):
        query = stream.writeStream.option("checkpointLocation", state).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def triage(logs: DataFrame) -> DataFrame:
    return ensemble.triage(logs, with_models=False)


def to_destinations(routed: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each destination's rows to its own folder, by batch, so that a replayed batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name in sorted({d for _, ds, _ in values.ROUTES.values() for d in ds}):
                batch.filter(F.col("destination") == name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return each


def noise_summary(logs: DataFrame, late: str = LATE) -> DataFrame:
    """Noise by hour and template, one row once the hour is over."""
    # As it names the time, the filter stays above the watermark, which so follows all logs and not noise alone.
    noise = logs.withWatermark("event_ts", late).filter("expected_category = 'noise' OR event_ts IS NULL")
    out = noise.groupBy(F.window("event_ts", "1 hour"), text.template(F.col("message")).alias("template")).agg(F.count("*").alias("n"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.min("message").alias("sample_log"))
    return out.select(F.col("window.start").alias("hour"), "template", "n", "first_seen", "last_seen", "sample_log")


def eps(logs: DataFrame, length: str = "60 seconds", every: str = "10 seconds", late: str = LATE) -> DataFrame:
    out = logs.withWatermark("event_ts", late).groupBy(F.window("event_ts", length, every), "source").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "source", "n", (F.col("n") / 60.0).alias("eps"))


def correlated(decisions: DataFrame, offenses: DataFrame, before: int = 60, after: int = 5) -> DataFrame:
    """Decisions and offenses of one address within the window: an interval join of two streams, state bounded by watermarks."""
    d = decisions.withWatermark("event_ts", LATE_DECISIONS)
    o = offenses.withWatermark("start_time", "1 hour").withColumn("offense_ip", F.explode_outer("source_ips"))
    near = F.expr(f"source_ip = offense_ip AND event_ts BETWEEN start_time - INTERVAL {before} MINUTES AND start_time + INTERVAL {after} MINUTES")
    return d.join(o, near)


def with_outcome(decisions: DataFrame, outcomes: DataFrame, hours: int = 24) -> DataFrame:
    """Decisions with the outcome that came within the hours, or none once that time has passed: a left outer interval join."""
    d = decisions.withWatermark("event_ts", LATE)
    o = outcomes.withWatermark("outcome_ts", LATE).withColumnRenamed("log_id", "outcome_id")
    return d.join(o, F.expr(f"log_id = outcome_id AND outcome_ts BETWEEN event_ts AND event_ts + INTERVAL {hours} HOURS"), "leftOuter")
