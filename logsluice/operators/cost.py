"""What filtering saves: licence tiers, savings, reports. Column arithmetic over event rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .metrics import beside


def tier(eps: Column) -> Column:
    """Licence tier of a rate; beyond the last but one, the last without an upper limit. Fractions are cut off first."""
    whole, case = F.floor(eps), None
    for name, most, _ in values.TIERS[:-1]:
        case = F.when(whole <= most, name) if case is None else case.when(whole <= most, name)
    return F.when(eps.isNotNull(), case.otherwise(values.TIERS[-1][0]))


def _of_tier(name: Column, k: int) -> Column:
    case = None
    for t in values.TIERS:
        case = F.when(name == t[0], float(t[k])) if case is None else case.when(name == t[0], float(t[k]))
    return case


def annual(name: Column) -> Column:
    return _of_tier(name, 2)


def capacity(name: Column) -> Column:
    return _of_tier(name, 1)


def lower_tier(name: Column) -> Column:
    case = None
    for below, this in zip(values.TIERS, values.TIERS[1:]):
        case = F.when(name == this[0], below[0]) if case is None else case.when(name == this[0], below[0])
    return case


def savings(before: Column, after: Column, current: str = "standard", infrastructure: float = values.INFRASTRUCTURE_COST) -> dict[str, Column]:
    """A change of tier saves the difference in cost (negative for a higher tier), else each saved event its share."""
    cost, most = next((float(c), m) for n, m, c in values.TIERS if n == current)
    possible = tier(after)
    yearly = F.when(possible != current, F.lit(cost) - annual(possible)).otherwise((before - after) * F.lit(cost / most))
    a_second = infrastructure / (365 * 24 * 3600)
    saved = before - after
    return {
        "potential_tier": possible, "savings_annual": yearly, "savings_monthly": yearly / 12, "savings_daily": yearly / 365, "savings_hourly": yearly / (365 * 24),
        "cost_per_eps_saved": F.when(saved > 0, F.lit(a_second) / saved).otherwise(0.0), "cost_per_event": F.when(before > 0, F.lit(a_second) / before).otherwise(0.0),
    }


def report(series: DataFrame, current: str = "standard", infrastructure: float = values.INFRASTRUCTURE_COST, last: int = 60) -> DataFrame:
    """One row over the last samples (ts, before, after) of the series: averages, savings, break-even, return."""
    recent = series.orderBy(F.desc("ts")).limit(last).agg(F.avg("before").alias("eps_before"), F.avg("after").alias("eps_after"))
    span = series.agg(F.datediff(F.max("ts"), F.min("ts")).alias("days_running"))
    rates = series.withColumns({k: v for k, v in savings(F.col("before"), F.col("after"), current, infrastructure).items() if k == "savings_hourly"}).agg((F.sum("savings_hourly")).alias("cumulative"))
    one = beside(beside(recent, span), rates)
    one = one.withColumns(savings(F.col("eps_before"), F.col("eps_after"), current, infrastructure))
    saved = F.col("eps_before") - F.col("eps_after")
    r = lambda c, k=2: F.round(c, k)
    broken_even = F.when(F.col("savings_daily") > 0, F.floor(infrastructure / F.col("savings_daily"))).otherwise(0)
    return one.select(
        F.lit(current).alias("current_tier"), "potential_tier", "days_running", r(F.col("eps_before")).alias("avg_eps_before"), r(F.col("eps_after")).alias("avg_eps_after"),
        r(F.coalesce(F.try_divide(saved * 100, F.col("eps_before")), F.lit(0.0))).alias("reduction_percent"), r(saved * 24 * 3600, 0).alias("filtered_daily"), r(saved * 30 * 24 * 3600, 0).alias("filtered_monthly"),
        r(F.col("savings_daily")).alias("daily"), r(F.col("savings_monthly")).alias("monthly"), r(F.col("savings_annual")).alias("annual"), broken_even.alias("days_to_break_even"),
        F.greatest(F.lit(0), broken_even - F.col("days_running")).alias("days_remaining"), r((F.col("cumulative") - infrastructure) / infrastructure * 100).alias("roi_percent"), r(F.col("cumulative") - infrastructure).alias("net_savings"),
    )
