"""Rollups that merge: a row a minute and group with counts and sketches, stored once and united for any span.

Quantiles come from KLL sketches, distinct counts from HyperLogLog sketches. Both are aggregates that combine before the shuffle,
and a row keeps a few kilobytes whatever the number of logs; longer spans read the rows of minutes, never the logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameter of the quantile sketches and the rank error that they stay under with 99 % probability (a fixed value of KLL at k = 200).
KLL_K, RANK_ERROR = 200, 0.0165
#: Binary logarithm of the registers of the distinct sketches, and three standard errors of their estimate.
HLL_K, DISTINCT_ERROR = 14, 3 * 1.04 / 2**7


def minutes(logs: DataFrame, at: str, *groups: str, value: str | None = None, distinct: str | None = None) -> DataFrame:
    """(minute, groups, n[, least, most, total, quantiles][, distinct]): sketches of value and of distinct, by minute and group.

    Rows without a time have a null minute. Nulls of value and distinct do not count in their sketches; a group with none has a
    null sketch.
    """
    out = [F.count("*").alias("n")]
    if value:
        x = F.col(value).cast("double")
        out += [F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("total"), F.count(x).alias("n_values"), F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias("quantiles")]
    if distinct:
        out += [F.hll_sketch_agg(F.col(distinct), F.lit(HLL_K)).alias("distinct")]
    return logs.groupBy(F.date_trunc("minute", at).alias("minute"), *groups).agg(*out)


def united(rollup: DataFrame, span: Column | None, *groups: str) -> DataFrame:
    """Rows of minutes united by a span of time (an expression of minute; None: all of it) and groups, in the same columns; the result
    can be united again."""
    keys = ([span.alias("minute")] if span is not None else []) + [F.col(g) for g in groups]
    have, out = rollup.columns, [F.sum("n").alias("n")]
    if "quantiles" in have:
        out += [F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles")]
    if "distinct" in have:
        out += [F.hll_union_agg("distinct").alias("distinct")]
    return rollup.groupBy(*keys).agg(*out)


def quantile(share: float) -> Column:
    """A value whose rank among the group's is within RANK_ERROR of the share; null where the group has no values."""
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(share)))


def at_most(bound: float) -> Column:
    """About how many values are no greater than the bound: a histogram's bucket, at any bounds chosen later."""
    whole = F.kll_sketch_get_rank_double("quantiles", F.lit(float(bound)))
    return F.when(F.coalesce(F.col("n_values"), F.lit(0)) == 0, 0).when(F.col("most") <= bound, F.col("n_values")).when(F.col("least") > bound, 0).otherwise(F.round(whole * F.col("n_values"))).cast("long")


def distinct_count() -> Column:
    """About how many different values, within DISTINCT_ERROR of them."""
    return F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0))
