"""Rolling frames: control charts, event rates, cost trends, runs of failures.

A metric's series is one window partition, so series are aggregated to minutes first: a year is half a million rows,
whatever the number of logs. What runs over all rows in order (running sums, runs of failures) goes range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..sources.scratch import kept_table


def metric_series(logs: DataFrame) -> DataFrame:
    """(metric_name, ts, value) a minute: error_rate, eps, failed_login_rate, processing_latency_ms (the mean), unique_ips_per_minute."""
    minute = logs.groupBy(F.date_trunc("minute", "event_ts").alias("ts")).agg(
        (F.count_if(F.col("expected_category").isin("critical", "suspicious")) / F.count("*")).alias("error_rate"),
        (F.count("*") / 60.0).alias("eps"),
        F.count_if(F.col("message").rlike("(?i)failed.*(login|auth)")).cast("double").alias("failed_login_rate"),
        F.avg("latency_ms").alias("processing_latency_ms"),
        F.count_distinct("source_ip").cast("double").alias("unique_ips_per_minute"),
    )
    return minute.unpivot("ts", ["error_rate", "eps", "failed_login_rate", "processing_latency_ms", "unique_ips_per_minute"], "metric_name", "value")


def spc(series: DataFrame, size: int = 100, sigma: float = 3.0, least: int = 30, warmup: int = values.SPC_WARMUP) -> DataFrame:
    """Shewhart chart of each metric: limits from the last size values, the current one included; population deviation.

    Below warmup values there are no limits, below least values no alarm. A constant window counts as deviation 1e-10.
    """
    frame = Window.partitionBy("metric_name").orderBy("ts").rowsBetween(-(size - 1), 0)
    n = F.count("value").over(frame)
    out = series.withColumns({"n": n, "mean": F.when(n >= warmup, F.avg("value").over(frame)), "std": F.when(n >= warmup, F.stddev_pop("value").over(frame))})
    out = out.withColumn("std", F.when(F.col("std") == 0, 1e-10).otherwise(F.col("std")))
    out = out.withColumns({"upper": F.col("mean") + sigma * F.col("std"), "lower": F.col("mean") - sigma * F.col("std")})
    sure = F.col("n") >= max(least, warmup)
    side = F.when(sure & (F.col("value") > F.col("upper")), "upper").when(sure & (F.col("value") < F.col("lower")), "lower")
    return out.withColumns({"z": F.when(sure, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0), "direction": side, "is_anomaly": side.isNotNull()})


def spc_presets(series: DataFrame, presets: list | None = None) -> DataFrame:
    """Each metric with its own window, sigma and least number: one frame a preset, over that metric's rows alone."""
    out = None
    for name, size, sigma, least in presets or values.SPC_PRESETS:
        one = spc(series.filter(F.col("metric_name") == name), size, sigma, least)
        out = one if out is None else out.unionByName(one)
    return out


def spc_stats(charted: DataFrame) -> DataFrame:
    return charted.groupBy("metric_name").agg(F.count("*").alias("checks"), F.count_if("is_anomaly").alias("anomalies"), F.round(F.count_if("is_anomaly") / F.count("*"), 4).alias("anomaly_rate"), F.max_by("mean", "ts").alias("last_mean"), F.max_by("std", "ts").alias("last_std"))


def trailing_rate(counts: DataFrame, at: str, n: str, seconds: int = 60, *keys: str) -> Column:
    """Events a second over the trailing seconds: the sum of n over the time between first and last sample, 0 if there is none."""
    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)
    span = F.max(at).over(frame) - F.min(at).over(frame)
    return F.when(span > 0, F.sum(n).over(frame) / span).otherwise(0.0)


def trailing_mean(value: str, rows: int, order: str, *keys: str) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df as a stored table whose ranges of the order columns have rising numbers, part; rows of equal order share a range."""
    return kept_table(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def with_carried(ranges: DataFrame, carried: list[tuple]) -> DataFrame:
    """ranges with the columns (part, name ...) of one row a range, told by the driver: as many rows as there are ranges."""
    names, rows = carried[0], carried[1:]
    return ranges.join(F.broadcast(ranges.sparkSession.createDataFrame(rows, names)), "part")


def with_running_sum(df: DataFrame, value: Column, order: str, to: str) -> DataFrame:
    """df with the sum of value over all rows up to this one, as of `order`, a column without ties (or with equal rows at one).

    A range's sum is all that the next ranges need of it, so no task sees more than one range.
    """
    ranges = ranged(df.withColumn("_value", value), order)
    sums, so_far = [], None
    for r in sorted(ranges.groupBy("part").agg(F.sum("_value").alias("s")).collect(), key=lambda r: r.part):
        sums.append((r.part, so_far))
        if r.s is not None:
            so_far = r.s if so_far is None else so_far + r.s
    if not sums:
        return ranges.withColumn(to, F.col("_value")).drop("part", "_value")
    kind = ranges.select(F.sum("_value")).schema[0].dataType.simpleString()
    within = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_carried(ranges, [f"part int, _before {kind}", *sums])
    return out.withColumn(to, F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("part", "_before", "_value")


def failure_runs(batches: DataFrame, order: str, failed: str, least: int = 5) -> DataFrame:
    """Runs of consecutive failures; from the least-th on, the run is open. A null counts as no failure.

    The length of a run at a row is its place less that of the last success. Of a range, others need the number of rows and
    the place of its last success; so a run, however long, is spread over as many tasks as it has ranges.
    """
    ok = ~F.coalesce(F.col(failed), F.lit(False))
    ranges = ranged(batches, order)
    order_in = Window.partitionBy("part").orderBy(order)
    placed = ranges.withColumn("_n", F.row_number().over(order_in))
    said = placed.groupBy("part").agg(F.max("_n").alias("n"), F.max(F.when(ok, F.col("_n"))).alias("last"))
    carried, before, last = [], 0, 0
    for r in sorted(said.collect(), key=lambda r: r.part):
        carried.append((r.part, before - last))
        last = before + r.last if r.last is not None else last
        before += r.n
    if not carried:
        return ranges.drop("part").withColumns({"failures": F.lit(0).cast("long"), "open": F.lit(False)})
    out = with_carried(placed, ["part int, _since long", *carried])  # failures right before the range
    own = F.max(F.when(ok, F.col("_n"))).over(order_in.rowsBetween(Window.unboundedPreceding, 0))
    failures = F.when(own.isNull(), F.col("_since") + F.col("_n")).otherwise(F.col("_n") - own)
    return out.withColumn("failures", failures.cast("long")).withColumn("open", ~ok & (F.col("failures") >= least)).drop("part", "_n", "_since")
