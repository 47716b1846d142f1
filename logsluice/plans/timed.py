"""Queries: windows, cost, correlation, streams and models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import correlate, cost, enrich, ensemble, metrics, ml, rollups, rows, rules, scoring, windows
from ..sources.scratch import folder as scratch
from ..sources.scratch import kept_table
from ..streaming import jobs, retained, ruled, stateful
from . import views
from .book import Book, decided, on_logs
from .triage import CHECKED, SPLIT

book = Book()
SIX = lambda c: F.round(c, 6)
_SERIES = """minutes AS (SELECT date_trunc('minute', event_ts) AS ts, count(*) FILTER (expected_category IN ('critical', 'suspicious')) / count(*) AS error_rate, count(*) / 60.0 AS eps, CAST(count(*) FILTER (regexp_matches(message, 'failed.*(login|auth)', 'i')) AS DOUBLE) AS failed_login_rate, CAST(count(DISTINCT source_ip) AS DOUBLE) AS unique_ips_per_minute, avg(latency_ms) AS processing_latency_ms FROM logs GROUP BY 1),
series AS (SELECT 'error_rate' AS metric_name, ts, error_rate AS value FROM minutes UNION ALL SELECT 'eps', ts, eps FROM minutes UNION ALL SELECT 'failed_login_rate', ts, failed_login_rate FROM minutes UNION ALL SELECT 'processing_latency_ms', ts, processing_latency_ms FROM minutes UNION ALL SELECT 'unique_ips_per_minute', ts, unique_ips_per_minute FROM minutes)"""


def _chart(size: int, sigma: float, least: int, of: str = "series") -> str:
    return f"SELECT metric_name, ts, value, n, mean, std, CASE WHEN n >= {max(least, 10)} THEN (value - mean) / std ELSE 0 END AS z, CASE WHEN n >= {max(least, 10)} AND value > mean + {sigma} * std THEN 'upper' WHEN n >= {max(least, 10)} AND value < mean - {sigma} * std THEN 'lower' END AS direction FROM (SELECT *, CASE WHEN n >= 10 THEN m END AS mean, CASE WHEN n >= 10 THEN (CASE WHEN s < 1e-9 THEN 1e-10 ELSE s END) END AS std FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM {of} WINDOW w AS (PARTITION BY metric_name ORDER BY ts ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)))"


def _series(spark, sf):
    return windows.metric_series(views.logs(spark, sf))


# A metric in whole numbers: sums of squares of doubles may differ in the last bits where all values are equal.
_HOURLY = "series AS (SELECT source AS metric_name, date_trunc('hour', event_ts) AS ts, CAST(count(*) + hour(min(event_ts)) % 5 AS DOUBLE) AS value FROM logs GROUP BY ALL)"


def _hourly(spark, sf):
    hour = F.date_trunc("hour", "event_ts")
    return views.logs(spark, sf).groupBy(F.col("source").alias("metric_name"), hour.alias("ts")).agg((F.count("*") + F.hour(F.min("event_ts")) % 5).cast("double").alias("value"))


@book.query("spc_rolling", on_logs(f"SELECT metric_name, CAST(floor(epoch(ts)) AS BIGINT) AS at, value, n, round(mean, 5) AS mean, round(std, 5) AS std, round(z, 4) AS z FROM ({_chart(100, 3, 30)})", _HOURLY))
def spc_rolling(spark, sf):
    out = windows.spc(_hourly(spark, sf))
    return out.select("metric_name", F.unix_timestamp("ts").alias("at"), "value", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("z", 4).alias("z"))


@book.query("spc_presets", on_logs(" UNION ALL ".join(f"SELECT metric_name, count(*) AS n, count(*) FILTER (z > {s} + 1e-6) AS upper, round(avg(mean), 4) AS mean FROM ({_chart(n, s, m)}) WHERE metric_name = '{k}' GROUP BY 1" for k, n, s, m in values.SPC_PRESETS), _SERIES))
def spc_presets(spark, sf):
    out = windows.spc_presets(_series(spark, sf))
    limit = F.lit(3.0)
    for name, _, sigma, _ in values.SPC_PRESETS:
        limit = F.when(F.col("metric_name") == name, sigma).otherwise(limit)
    return out.groupBy("metric_name").agg(F.count("*").alias("n"), F.count_if(F.col("z") > limit + 1e-6).alias("upper"), F.round(F.avg("mean"), 4).alias("mean"))


@book.query("spc_stats", on_logs(f"SELECT metric_name, count(*) AS checks, count(direction) AS anomalies, round(count(direction) / count(*), 4) AS anomaly_rate, round(arg_max(mean, ts), 5) AS last_mean, round(arg_max(std, ts), 5) AS last_std FROM ({_chart(100, 3, 30)}) GROUP BY 1", _HOURLY))
def spc_stats(spark, sf):
    return windows.spc_stats(windows.spc(_hourly(spark, sf))).withColumns({c: F.round(c, 5) for c in ("last_mean", "last_std")})


@book.query("metric_series", on_logs("SELECT metric_name, CAST(floor(epoch(ts)) AS BIGINT) AS at, round(value, 6) AS value FROM series", _SERIES))
def metric_series(spark, sf):
    return _series(spark, sf).select("metric_name", F.unix_timestamp("ts").alias("at"), SIX(F.col("value")).alias("value"))


_EPS = "seconds AS (SELECT source, CAST(floor(epoch(event_ts)) AS BIGINT) AS s, count(*) AS n FROM logs GROUP BY ALL)"


@book.query("eps_window", on_logs("SELECT source, s AS \"at\", round(CASE WHEN max(s) OVER w > min(s) OVER w THEN sum(n) OVER w / (max(s) OVER w - min(s) OVER w) ELSE 0 END, 6) AS eps FROM seconds WINDOW w AS (PARTITION BY source ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)", _EPS))
def eps_window(spark, sf):
    counts = views.logs(spark, sf).groupBy("source", F.unix_timestamp("event_ts").alias("at")).agg(F.count("*").alias("n"))
    return counts.select("source", "at", SIX(windows.trailing_rate(counts, "at", "n", 60, "source")).alias("eps"))


# rollups
@book.query("latency_rollup", "SELECT CAST(floor(epoch(date_trunc('day', CAST(ts AS TIMESTAMP)))) AS BIGINT) AS day, event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, true AS p50_close, true AS p95_close, true AS p99_close FROM events GROUP BY ALL")
def latency_rollup(spark, sf):
    """Percentiles of days from the stored sketches of minutes alone; against the logs, how far off their ranks are."""
    logs = views.logs(spark, sf)
    stored = kept_table(rollups.minutes(logs, "event_ts", "event_type", value="latency_ms"), "minutes")
    days = rollups.united(stored, F.date_trunc("day", "minute"), "event_type")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    told = kept_table(days.select(F.to_date("minute").alias("day"), "event_type", "n", "n_values", "least", "most", "total", *[rollups.quantile(s).alias(p) for p, s in shares.items()]), "days")
    both = logs.select(F.to_date("event_ts").alias("day"), "event_type", "latency_ms").join(told, ["day", "event_type"])
    keys = ["day", "event_type", "n", "n_values", "least", "most", "total"]
    # A value's own copies span ranks, any of which would be right; a single value may be one rank off.
    below = [F.count_if(F.col("latency_ms") < F.col(p)).alias(f"_b_{p}") for p in shares] + [F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"_u_{p}") for p in shares]
    ranks = both.groupBy(*keys).agg(*below)
    close = [((F.col(f"_b_{p}") - 1 <= (s + rollups.RANK_ERROR) * F.col("n_values")) & (F.col(f"_u_{p}") + 1 >= (s - rollups.RANK_ERROR) * F.col("n_values"))).alias(f"{p}_close") for p, s in shares.items()]
    return ranks.select(F.unix_date("day").cast("long").alias("_d"), "*").select((F.col("_d") * 86400).alias("day"), "event_type", "n", *[SIX(F.col(c)).alias(c) for c in ("least", "most")], SIX(F.col("total") / F.col("n_values")).alias("mean"), *close)


@book.query("unique_ips_rollup", on_logs("SELECT CAST(floor(epoch(date_trunc('hour', event_ts))) AS BIGINT) AS hour, count(*) AS n, count(DISTINCT source_ip) AS addresses, true AS close FROM logs GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT source_ip), true FROM logs"))
def unique_ips_rollup(spark, sf):
    """Distinct addresses by hour, and over all, from the stored sketches of minutes; beside the exact count."""
    logs = views.logs(spark, sf)
    stored = kept_table(rollups.minutes(logs, "event_ts", distinct="source_ip"), "minutes")
    hours = rollups.united(stored, F.date_trunc("hour", "minute")).withColumn("hour", F.unix_timestamp("minute"))
    every = rollups.united(stored, None).withColumn("hour", F.lit(None).cast("long"))
    told = hours.select("hour", "n", rollups.distinct_count().alias("about")).unionByName(every.select("hour", "n", rollups.distinct_count().alias("about")))
    hour = F.unix_timestamp(F.date_trunc("hour", "event_ts")).alias("hour")
    exact = logs.select("source_ip", hour).groupingSets([["hour"], []], "hour").agg(F.count_distinct("source_ip").alias("addresses"))
    joined = told.join(exact.withColumnRenamed("hour", "_hour"), F.col("hour").eqNullSafe(F.col("_hour")))
    return joined.select("hour", "n", "addresses", (F.abs(F.col("about") - F.col("addresses")) <= F.col("addresses") * rollups.DISTINCT_ERROR + 0.5).alias("close"))


# cost
_RATES = "rates AS (SELECT date_trunc('hour', event_ts) AS ts, count(*) * 1000.0 AS before, count(*) FILTER (category IN ('critical', 'suspicious')) * 1000.0 AS after FROM decisions GROUP BY 1)"
_TIER = "CASE WHEN floor({0}) <= 5000 THEN 'basic' WHEN floor({0}) <= 15000 THEN 'standard' WHEN floor({0}) <= 50000 THEN 'enterprise' ELSE 'premium' END"
_COST = "CASE {0} WHEN 'basic' THEN 150000.0 WHEN 'standard' THEN 450000.0 WHEN 'enterprise' THEN 1200000.0 ELSE 2500000.0 END"
_SAVED = "saved AS (SELECT *, " + _TIER.format("after") + " AS tier_after, CASE WHEN " + _TIER.format("after") + " <> 'standard' THEN 450000.0 - " + _COST.format(_TIER.format("after")) + " ELSE (before - after) * 30.0 END AS annual FROM rates)"
_R = (decided(), _RATES, _SAVED)


@book.query("tier_lookup", on_logs("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, " + _TIER.format("before") + " AS tier, " + _COST.format(_TIER.format("before")) + " AS annual_cost, CASE " + _TIER.format("before") + " WHEN 'standard' THEN 'basic' WHEN 'enterprise' THEN 'standard' WHEN 'premium' THEN 'enterprise' END AS lower_tier FROM rates", decided(), _RATES))
def tier_lookup(spark, sf):
    name = cost.tier(F.col("before"))
    return views.eps_series(spark, sf).select(F.unix_timestamp("ts").alias("at"), name.alias("tier"), cost.annual(name).alias("annual_cost"), cost.lower_tier(name).alias("lower_tier"))


@book.query("cost_savings", on_logs("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, tier_after AS potential_tier, round(CAST(annual AS DOUBLE), 4) AS savings_annual, round(CAST(annual AS DOUBLE) / 8760, 4) AS savings_hourly, round(CAST(CASE WHEN before > after THEN 60000.0 / 31536000 / (before - after) ELSE 0 END AS DOUBLE), 9) AS cost_per_eps_saved FROM saved", *_R))
def cost_savings(spark, sf):
    out = cost.savings(F.col("before").cast("double"), F.col("after").cast("double"))
    return views.eps_series(spark, sf).select(F.unix_timestamp("ts").alias("at"), out["potential_tier"].alias("potential_tier"), *[F.round(out[c], 4).alias(c) for c in ("savings_annual", "savings_hourly")], F.round(out["cost_per_eps_saved"], 9).alias("cost_per_eps_saved"))


@book.query("cost_by_category", on_logs("SELECT category, round(CAST(count(*) * 450000.0 / 15000 / 12 AS DOUBLE), 4) AS savings_monthly FROM decisions WHERE category NOT IN ('critical', 'suspicious') GROUP BY 1", decided()))
def cost_by_category(spark, sf):
    out = views.decisions(spark, sf).filter(~ensemble.forwarded(F.col("category"))).groupBy("category").agg(F.count("*").alias("eps_saved"))
    return out.select("category", F.round(F.col("eps_saved") * (450_000 / 15_000 / 12), 4).alias("savings_monthly"))


@book.query("cost_trend", on_logs("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, round(avg(CAST(annual AS DOUBLE) / 365) OVER (ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 4) AS week, round(avg(CAST(annual AS DOUBLE) / 365) OVER (ORDER BY ts ROWS BETWEEN 719 PRECEDING AND CURRENT ROW), 4) AS month FROM saved", *_R))
def cost_trend(spark, sf):
    """Means over the last 7 and 30 days of hourly samples."""
    daily = views.eps_series(spark, sf).withColumn("daily", cost.savings(F.col("before").cast("double"), F.col("after").cast("double"))["savings_daily"])
    return daily.select(F.unix_timestamp("ts").alias("at"), F.round(windows.trailing_mean("daily", 7 * 24, "ts"), 4).alias("week"), F.round(windows.trailing_mean("daily", 30 * 24, "ts"), 4).alias("month"))


@book.query("cumulative_savings", on_logs("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, round(sum(CAST(annual AS DOUBLE) / 8760 / 3600) OVER (ORDER BY ts), 4) AS total FROM saved", *_R))
def cumulative_savings(spark, sf):
    hourly = cost.savings(F.col("before").cast("double"), F.col("after").cast("double"))["savings_hourly"] / 3600
    out = windows.with_running_sum(views.eps_series(spark, sf), hourly, "ts", "total")
    return out.select(F.unix_timestamp("ts").alias("at"), F.round("total", 4).alias("total"))


@book.query("eps_avg60", on_logs("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, round(avg(CAST(before AS DOUBLE)) OVER w, 4) AS before, round(avg(CAST(after AS DOUBLE)) OVER w, 4) AS after FROM rates WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", decided(), _RATES))
def eps_avg60(spark, sf):
    s = views.eps_series(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("before", "after")})
    return s.select(F.unix_timestamp("ts").alias("at"), F.round(windows.trailing_mean("before", 60, "ts"), 4).alias("before"), F.round(windows.trailing_mean("after", 60, "ts"), 4).alias("after"))


_REPORT = (
    "recent AS (SELECT avg(CAST(before AS DOUBLE)) AS b, avg(CAST(after AS DOUBLE)) AS a FROM (SELECT * FROM rates ORDER BY ts DESC LIMIT 60))",
    "yearly AS (SELECT *, " + _TIER.format("a") + " AS tier, CASE WHEN " + _TIER.format("a") + " <> 'standard' THEN 450000 - CAST(" + _COST.format(_TIER.format("a")) + " AS DOUBLE) ELSE (b - a) * 30 END AS annual FROM recent)",
    "whole AS (SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days, sum(CAST(annual AS DOUBLE) / 8760) AS cumulative FROM saved)",
    "known AS (SELECT *, CASE WHEN annual > 0 THEN CAST(floor(60000 / (annual / 365)) AS BIGINT) ELSE 0 END AS even FROM yearly, whole)",
)


@book.query("cost_report", on_logs("SELECT 'standard' AS current_tier, tier AS potential_tier, days AS days_running, round(b, 2) AS avg_eps_before, round(a, 2) AS avg_eps_after, round((b - a) * 100 / b, 2) AS reduction_percent, round((b - a) * 86400, 0) AS filtered_daily, round((b - a) * 30 * 86400, 0) AS filtered_monthly, round(annual / 365, 2) AS daily, round(annual / 12, 2) AS monthly, round(annual, 2) AS annual, even AS days_to_break_even, greatest(0, even - days) AS days_remaining, round((cumulative - 60000) / 60000 * 100, 2) AS roi_percent, round(cumulative - 60000, 2) AS net_savings FROM known", *_R, *_REPORT))
def cost_report(spark, sf):
    s = views.eps_series(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("before", "after")})
    return cost.report(s)


@book.query("circuit_state_runs", on_logs("SELECT s AS \"at\", failed, failures, failed AND failures >= 5 AS open FROM (SELECT s, failed, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY s) AS failures FROM (SELECT s, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (ORDER BY s) AS run FROM (SELECT CAST(floor(epoch(date_trunc('hour', event_ts))) AS BIGINT) AS s, count(*) FILTER (event_type = 'error') >= 2 AS failed FROM logs GROUP BY 1)))"))
def circuit_state_runs(spark, sf):
    batches = views.logs(spark, sf).groupBy(F.unix_timestamp(F.date_trunc("hour", "event_ts")).alias("at")).agg((F.count_if(F.col("event_type") == "error") >= 2).alias("failed"))
    return windows.failure_runs(batches, "at", "failed")


# offenses
_OFF = "offenses AS (SELECT log_id AS offense_id, event_ts + INTERVAL 2 MINUTES AS start_time, log_id % 10 + 1 AS severity, CASE WHEN log_id % 5 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, source_ip AS offense_ip, upper(source) AS log_source, event_type AS offense_type_name FROM logs WHERE event_type = 'error' AND log_id % 97 = 0)"
_IN = "d.event_ts BETWEEN o.start_time - INTERVAL 60 MINUTES AND o.start_time + INTERVAL 5 MINUTES"
_APART = "abs(floor(epoch(o.start_time)) - floor(epoch(d.event_ts)))"
_SCORE = f"least(1.0, {{0}} + CASE WHEN {_APART} < 60 THEN 0.3 WHEN {_APART} < 300 THEN 0.21 WHEN {_APART} < 900 THEN 0.12 ELSE 0 END + o.severity / 10 * 0.2)"
_SRC = "(contains(replace(lower(o.log_source), ' ', '_'), lower(d.source)) OR contains(lower(d.source), replace(lower(o.log_source), ' ', '_')))"
_ALL = f"matches AS (SELECT o.offense_id, d.log_id, d.category, offense_type_name, CASE WHEN d.source_ip = o.offense_ip THEN 'ip_match' WHEN {_SRC} THEN 'source_match' ELSE 'time_window' END AS strategy, CASE WHEN d.source_ip = o.offense_ip THEN {_SCORE.format('0.4')} WHEN {_SRC} THEN {_SCORE.format('0.3')} ELSE 0.5 END AS score FROM decisions d JOIN offenses o ON {_IN} AND (d.source_ip = o.offense_ip OR {_SRC} OR (o.severity >= 7 AND d.category IN ('routine', 'noise'))))"


def _both(spark, sf):
    """Decisions and offenses as stored tables: correlation reads each several times."""
    decisions = views.decisions(spark, sf).select("log_id", "event_ts", "source", "source_ip", "category")
    return kept_table(decisions, "decisions"), kept_table(views.offenses(spark, sf), "offenses")


@book.query("offense_scan", on_logs("SELECT offense_id, CAST(floor(epoch(start_time)) AS BIGINT) AS start_time, severity FROM offenses WHERE status = 'OPEN' AND start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-25' ORDER BY start_time, offense_id LIMIT 100", _OFF))
def offense_scan(spark, sf):
    found = views.offenses(spark, sf).filter("status = 'OPEN' AND start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-25'")
    return rows.top(found, 100, "start_time", "offense_id").select("offense_id", F.unix_timestamp("start_time").alias("start_time"), "severity")


@book.query("offense_events", on_logs("SELECT offense_id, log_id FROM offenses o JOIN decisions d ON d.source_ip = o.offense_ip AND d.event_ts BETWEEN o.start_time - INTERVAL 24 HOURS AND o.start_time QUALIFY row_number() OVER (PARTITION BY offense_id ORDER BY log_id DESC) <= 100", decided(), _OFF))
def offense_events(spark, sf):
    d, o = _both(spark, sf)
    near = correlate.by_ip(d, o, 24 * 60, 0)
    place = F.row_number().over(Window.partitionBy("offense_id").orderBy(F.desc("log_id")))
    return near.withColumn("_k", place).filter("_k <= 100").select("offense_id", "log_id")


@book.query("correlate_ip", on_logs(f"SELECT offense_id, log_id FROM decisions d JOIN offenses o ON d.source_ip = o.offense_ip AND {_IN}", decided(), _OFF))
def correlate_ip(spark, sf):
    return correlate.by_ip(*_both(spark, sf)).select("offense_id", "log_id")


@book.query("correlate_source", on_logs(f"SELECT offense_id, log_id FROM decisions d JOIN offenses o ON {_SRC} AND {_IN}", decided(), _OFF))
def correlate_source(spark, sf):
    return correlate.by_source(*_both(spark, sf)).filter(correlate.in_window()).select("offense_id", "log_id")


@book.query("correlate_time", on_logs(f"SELECT offense_id, log_id FROM decisions d JOIN offenses o ON {_IN} AND severity >= 7 AND category IN ('routine', 'noise')", decided(), _OFF))
def correlate_time(spark, sf):
    return correlate.by_time(*_both(spark, sf)).select("offense_id", "log_id")


@book.query("correlation_score", on_logs("SELECT offense_id, log_id, strategy, round(CAST(score AS DOUBLE), 6) AS score FROM matches WHERE score >= 0.3", decided(), _OFF, _ALL))
def correlation_score(spark, sf):
    return correlate.correlated(*_both(spark, sf), least=0.3).select("offense_id", "log_id", "strategy", SIX(F.col("score")).alias("score"))


@book.query("correlate_all", on_logs("SELECT offense_id, log_id, strategy, category IN ('routine', 'noise') AS is_false_negative FROM matches WHERE score >= 0.6", decided(), _OFF, _ALL))
def correlate_all(spark, sf):
    return correlate.correlated(*_both(spark, sf)).select("offense_id", "log_id", "strategy", "is_false_negative")


@book.query("false_negatives", on_logs("SELECT DISTINCT log_id FROM matches WHERE score >= 0.5 AND category IN ('routine', 'noise')", decided(), _OFF, _ALL))
def false_negatives(spark, sf):
    return correlate.correlated(*_both(spark, sf), least=0.5).filter("is_false_negative").select("log_id").distinct()


@book.query("fn_report", on_logs("SELECT offense_type_name, category, count(*) AS n FROM matches WHERE score >= 0.5 AND category IN ('routine', 'noise') GROUP BY GROUPING SETS ((offense_type_name), (category), ())", decided(), _OFF, _ALL))
def fn_report(spark, sf):
    return correlate.miss_report(correlate.correlated(*_both(spark, sf), least=0.5, keep=("offense_type_name",)))


@book.query("recent_false_negatives", on_logs("SELECT offense_id, log_id, category FROM matches WHERE score >= 0.5 AND category IN ('routine', 'noise') ORDER BY log_id DESC, offense_id DESC LIMIT 20", decided(), _OFF, _ALL))
def recent_false_negatives(spark, sf):
    missed = correlate.correlated(*_both(spark, sf), least=0.5).filter("is_false_negative")
    return rows.top(missed.select("offense_id", "log_id", "category"), 20, F.desc("log_id"), F.desc("offense_id"))


_OUT = "judged AS (SELECT log_id, category, CASE WHEN log_id % 7 = 0 THEN 'pending' WHEN event_type = 'error' AND category IN ('critical', 'suspicious') THEN 'tp' WHEN event_type = 'error' THEN 'fn' WHEN category IN ('critical', 'suspicious') THEN 'fp' ELSE 'tn' END AS outcome FROM decisions)"


def _judged(spark, sf):
    d = views.decisions(spark, sf)
    known = d.filter("log_id % 7 <> 0").select("log_id", (F.col("event_type") == "error").alias("offense_generated"))
    return metrics.outcomes(d.select("log_id", "category"), known)


@book.query("outcome_join", on_logs("SELECT log_id, outcome FROM judged", decided(), _OUT))
def outcome_join(spark, sf):
    return _judged(spark, sf).select("log_id", "outcome")


_SHADOW = "shadow AS (SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'pending') AS pending FROM judged), rates AS (SELECT *, tp / (tp + fn) AS recall, fn / (tp + fn) AS fnr FROM shadow)"


@book.query("shadow_outcomes", on_logs("SELECT tp, tn, fp, fn, pending, round(recall, 6) AS recall, round(fnr, 6) AS fnr FROM rates", decided(), _OUT, _SHADOW))
def shadow_outcomes(spark, sf):
    return metrics.shadow(_judged(spark, sf)).withColumns({c: SIX(F.col(c)) for c in ("recall", "fnr")})


@book.query("phase_gate", on_logs("SELECT phase, reason IS NULL AS ready, reason FROM (SELECT phase, CASE WHEN tp + tn + fp + fn < n THEN 'samples' WHEN fnr > f THEN 'false_negative_rate' WHEN recall < r THEN 'critical_recall' END AS reason FROM rates, (VALUES ('shadow', 10000, 0.005, 0.995), ('pilot', 50000, 0.002, 0.998), ('gradual', 100000, 0.001, 0.999)) p(phase, n, f, r))", decided(), _OUT, _SHADOW))
def phase_gate(spark, sf):
    stats = metrics.shadow(_judged(spark, sf)).withColumn("samples", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return metrics.phases(stats, "samples", "fnr", "recall")


@book.query("pending_decisions", on_logs("SELECT log_id FROM judged WHERE outcome = 'pending'", decided(), _OUT))
def pending_decisions(spark, sf):
    d = views.decisions(spark, sf)
    return d.join(d.filter("log_id % 7 <> 0").select("log_id"), "log_id", "left_anti").select("log_id")


@book.query("feedback_relabel", on_logs("SELECT log_id, CASE WHEN log_id % 10 = 0 AND log_id % 30 <> 0 THEN 'noise' ELSE category END AS category, log_id % 10 = 0 AND log_id % 30 <> 0 AS corrected FROM decisions", decided()))
def feedback_relabel(spark, sf):
    d = views.decisions(spark, sf)
    feedback = d.filter("log_id % 10 = 0").select("log_id", F.when(F.col("log_id") % 30 == 0, "wrong").otherwise("noise").alias("correction")).filter(F.col("correction").isin(*values.CATEGORIES))
    both = d.select("log_id", "category").join(feedback, "log_id", "left")
    return both.select("log_id", F.coalesce("correction", "category").alias("category"), F.col("correction").isNotNull().alias("corrected"))


@book.query("enrich_lookup", on_logs("SELECT log_id, logs.source, owner, hits FROM logs LEFT JOIN (SELECT source, min(upper(source)) AS owner, count(*) AS hits FROM logs WHERE source <> 'ids-sensor' GROUP BY 1) t USING (source)"))
def enrich_lookup(spark, sf):
    logs = views.logs(spark, sf)
    assets = logs.filter("source <> 'ids-sensor'").groupBy("source").agg(F.min(F.upper("source")).alias("owner"), F.count("*").alias("hits"))
    return enrich.enriched(logs.select("log_id", "source"), assets, "source", ["owner", "hits"])


@book.query("confidence_thresholds", on_logs("SELECT log_id, CASE WHEN low THEN 'routine' ELSE category END AS category, NOT low AS kept FROM (SELECT log_id, category, CASE category WHEN 'critical' THEN confidence < 0.7 WHEN 'suspicious' THEN confidence < 0.72 WHEN 'noise' THEN confidence < 0.88 ELSE false END AS low FROM decisions)", decided()))
def confidence_thresholds(spark, sf):
    return enrich.above_threshold(views.decisions(spark, sf), {"critical": 0.7, "suspicious": 0.72, "noise": 0.88}).select("log_id", "category", "kept")


@book.query("audit_records", on_logs("SELECT log_id, source AS host, source_ip AS ip, category AS class, category IN ('critical', 'suspicious') AS forwarded, 'v1' AS model_version FROM decisions", decided()))
def audit_records(spark, sf):
    path = scratch(spark, "audit")
    judged = rules.with_compliance(views.decisions(spark, sf), F.col("source"), F.col("message"))
    enrich.decision_records(judged, "v1", "r1").write.parquet(path)
    return spark.read.parquet(path).select("log_id", "source.host", "source.ip", "decision.class", "decision.forwarded", "model.model_version")


@book.query("alert_rules", on_logs("SELECT alert, severity, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM (SELECT 'quiet' AS alert, 'warning' AS severity, ts, sum(CASE WHEN value < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY metric_name ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b FROM series WHERE metric_name = 'load-balancer') WHERE b = 3 UNION ALL SELECT 'busy', 'critical', CAST(floor(epoch(ts)) AS BIGINT) FROM series WHERE metric_name = 'ids-sensor' AND value > 7", _HOURLY))
def alert_rules(spark, sf):
    wanted = [("quiet", "load-balancer", "<", 2.0, 3, "warning"), ("busy", "ids-sensor", ">", 7.0, 1, "critical")]
    return enrich.alerts(_hourly(spark, sf), wanted).withColumn("ts", F.unix_timestamp("ts"))


# streams
_TRIAGED = (decided().replace("(message,", "(parsed,").replace("FROM logs)", "FROM (SELECT *, CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END AS parsed FROM logs))"), "checked AS (SELECT CASE WHEN user_id % 20 < 4 OR message LIKE '%credit_card%' THEN 'critical' WHEN category IN ('critical', 'suspicious', 'noise') OR confidence > 0.5 THEN category ELSE 'routine' END AS category FROM decisions)", "routes AS (SELECT * FROM (VALUES ('critical', 'qradar'), ('critical', 'cold_storage'), ('suspicious', 'qradar'), ('suspicious', 'cold_storage'), ('routine', 'cold_storage'), ('noise', 'summary'), ('noise', 'cold_storage')) r(category, destination))")


@book.query("stream_triage", on_logs("SELECT destination, count(*) AS n FROM (SELECT category FROM checked) JOIN routes USING (category) GROUP BY 1", *_TRIAGED))
def stream_triage(spark, sf):
    stream = jobs.replayed(views.logs(spark, sf)).filter("log_id IS NOT NULL")
    return jobs.finished(jobs.triage(stream), "triage").groupBy("destination").agg(F.count("*").alias("n"))


_LANES = 4


@book.query("stream_multi_sink", on_logs(f"SELECT destination, category, sum(n) AS n, sum(CASE WHEN size = 1 THEN n ELSE ceil(n / size) END) AS batches, sum(CASE WHEN size = 1 THEN n ELSE n // size END) AS full_batches FROM (SELECT destination, category, CASE category WHEN 'critical' THEN 1 WHEN 'suspicious' THEN 100 WHEN 'routine' THEN 500 ELSE 1000 END AS size, log_id % {_LANES} AS lane, count(*) AS n FROM checked JOIN routes USING (category) GROUP BY ALL) GROUP BY 1, 2", _TRIAGED[0], _TRIAGED[1].replace("AS (SELECT CASE", "AS (SELECT log_id, CASE"), _TRIAGED[2]))
def stream_multi_sink(spark, sf):
    """Batches of 1, 100, 500 and 1,000 rows by category for each destination, the last of each queue when the stream ends."""
    folder = scratch(spark, "sinks")
    stream = jobs.replayed(views.logs(spark, sf))
    routed = jobs.triage(stream.filter("log_id IS NOT NULL"))
    sent = stateful.batched(routed, F.pmod("log_id", F.lit(_LANES)), _LANES, stream.filter("log_id IS NULL"), seconds=None)
    jobs.in_batches(sent, "multi", jobs.to_destinations(sent, folder))
    names = sorted({d for _, ds, _ in values.ROUTES.values() for d in ds})
    parts = [spark.read.schema(sent.schema).parquet(f"{folder}/{n}") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    size = F.get(F.map_values(F.map_filter(F.create_map(*[x for c, r in values.ROUTES.items() for x in (F.lit(c), F.lit(r[2]))]), lambda k, v: k == F.col("category"))), F.lit(0))
    each = out.groupBy("destination", "category", "lane", "batch_number", "batch_rows").agg(F.count("*").alias("n"))
    count = F.when(F.col("lane").isNull(), F.col("n")).otherwise(F.col("n") / F.col("batch_rows")).cast("long")  # one, unless a batch was torn or sent twice
    return each.groupBy("destination", "category").agg(F.sum("n").alias("n"), F.sum(count).alias("batches"), F.sum(F.when(F.col("batch_rows") == size, count).otherwise(0)).alias("full_batches"))


@book.query("batch_callbacks", on_logs("SELECT log_id, message FROM logs WHERE expected_category = 'critical'"))
def batch_callbacks(spark, sf):
    """Every batch's misses go to a function that the caller gives; here it appends them to a table."""
    path = scratch(spark, "misses")

    def on_batch(batch, number):
        missed = batch.filter("expected_category = 'critical'").select("log_id", "message")
        missed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    jobs.in_batches(jobs.replayed(views.logs(spark, sf)), "callbacks", on_batch)
    return spark.read.schema("log_id long, message string").parquet(path).select("log_id", "message")


@book.query("stream_eps", on_logs("SELECT start, source, count(*) AS n, round(count(*) / 60.0, 6) AS eps FROM (SELECT source, CAST(floor(epoch(event_ts) / 10) * 10 AS BIGINT) - 10 * k AS start FROM logs, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)) GROUP BY ALL"))
def stream_eps(spark, sf):
    return jobs.finished(jobs.eps(jobs.replayed(views.logs(spark, sf))), "eps").select(F.unix_timestamp("start").alias("start"), "source", "n", SIX(F.col("eps")).alias("eps"))


@book.query("stream_spc", on_logs(f"SELECT metric_name, CAST(floor(epoch(ts)) AS BIGINT) AS at, value, n, round(mean, 5) AS mean, round(std, 5) AS std, round(z, 4) AS z FROM ({_chart(60, 3, 30)})", _HOURLY))
def stream_spc(spark, sf):
    """Files by hashed hours, so that hours come in no order at all; the watermark spans them."""
    series = _hourly(spark, sf).repartition(6, F.xxhash64("ts"))
    out = jobs.finished(stateful.spc(jobs.replayed(series, "ts", 1, ordered=False), late="60 days"), "spc")
    return out.select("metric_name", F.unix_timestamp("ts").alias("at"), "value", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("z", 4).alias("z"))


@book.query("stream_correlate", on_logs(f"SELECT offense_id, log_id, 'ip_match' AS strategy FROM decisions d JOIN offenses o ON d.source_ip = o.offense_ip AND {_IN} UNION ALL SELECT offense_id, log_id, 'source_match' FROM decisions d JOIN offenses o ON {_SRC} AND {_IN}", decided(), _OFF))
def stream_correlate(spark, sf):
    """Both strategies: addresses as a join of two streams, source names batch by batch against the kept decisions of the hours around."""
    d, o = _both(spark, sf)
    ip = jobs.correlated(jobs.replayed(d.select("log_id", "event_ts", "source_ip", "category"), files_a_batch=100), jobs.replayed(o, "start_time", 100))
    ip = jobs.finished(ip.select("offense_id", "log_id"), "correlate").withColumn("strategy", F.lit("ip_match"))
    path = scratch(spark, "by-source")
    jobs.in_batches(jobs.replayed(d).filter("log_id IS NOT NULL"), "decisions", retained.keep(f"{path}/kept"))
    jobs.in_batches(jobs.replayed(o, "start_time").filter("offense_id IS NOT NULL"), "offenses", retained.by_source(f"{path}/kept", d.schema, f"{path}/out"))
    source = spark.read.schema("offense_id long, log_id long").parquet(f"{path}/out").select("offense_id", "log_id", F.lit("source_match").alias("strategy"))
    return ip.unionByName(source)


_NOW = "2024-01-20 12:30:00"


@book.query("stream_correlate_recent", on_logs(f"SELECT offense_id, log_id FROM decisions d JOIN offenses o ON {_SRC} AND {_IN} WHERE status = 'OPEN' AND o.start_time > TIMESTAMP '{_NOW}' - INTERVAL 24 HOURS AND o.start_time <= TIMESTAMP '{_NOW}' AND d.event_ts >= date_trunc('hour', TIMESTAMP '{_NOW}') - INTERVAL 24 HOURS", decided(), _OFF))
def stream_correlate_recent(spark, sf):
    """One run at a time of the replay: a day of decisions is kept, open offenses of the day before are looked up."""
    d, o = _both(spark, sf)
    path, now = scratch(spark, "recent"), dt.datetime.fromisoformat(_NOW)
    jobs.in_batches(jobs.replayed(d).filter("log_id IS NOT NULL"), "decisions", retained.keep(f"{path}/kept"))
    retained.drop_old(spark, f"{path}/kept", now)
    jobs.in_batches(jobs.replayed(o, "start_time", 100).filter("offense_id IS NOT NULL"), "offenses", retained.by_source(f"{path}/kept", d.schema, f"{path}/out", lambda: now, 24))
    return spark.read.schema("offense_id long, log_id long").parquet(f"{path}/out").select("offense_id", "log_id")


@book.query("stream_pending_timeout", on_logs("SELECT log_id, CASE WHEN log_id % 3 = 0 OR log_id % 5 = 0 THEN 'timeout' ELSE 'outcome' END AS state, CAST(floor(epoch(event_ts)) AS BIGINT) + CASE WHEN log_id % 3 = 0 OR log_id % 5 = 0 THEN 86400 ELSE 3600 END AS ended_at FROM decisions", decided()))
def stream_pending_timeout(spark, sf):
    """Outcomes come an hour after the decision, for every fifth log an hour too late, for every third never."""
    d = views.decisions(spark, sf).select("log_id", "event_ts", "category")
    hours = F.when(F.col("log_id") % 5 == 0, F.expr("INTERVAL 25 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    outcomes = d.filter("log_id % 3 <> 0").select("log_id", (F.col("event_ts") + hours).alias("outcome_ts"))
    out = stateful.pending(jobs.replayed(d, files_a_batch=2, key="log_id", ordered=False), jobs.replayed(outcomes, "outcome_ts", 2, "log_id", ordered=False), late="60 days", shares=8)
    return jobs.finished(out, "pending").filter("log_id >= 0").select("log_id", "state", F.unix_timestamp("ended_at").alias("ended_at"))


_ADDED = [("traffic", "internal", 30, [], ["traffic"])], [("balancers", "internal", 90, ["^load-"], []), ("traffic", "internal", 60, [], ["outbound traffic"])]


@book.query("stream_custom_rules", on_logs("SELECT log_id, version, names, CASE WHEN names LIKE '%balancers%' THEN 90 WHEN names = '' THEN 0 WHEN version = 1 THEN 30 ELSE 60 END AS retention_days FROM (SELECT log_id, version, CASE WHEN version = 1 THEN CASE WHEN t THEN 'traffic' ELSE '' END ELSE concat_ws(',', CASE WHEN b THEN 'balancers' END, CASE WHEN t THEN 'traffic' END) END AS names FROM (SELECT log_id, 1 + log_id % 2 AS version, message ILIKE '%traffic%' AS t, source LIKE 'load-%' AS b FROM logs))"))
def stream_custom_rules(spark, sf):
    """Rules are added while the stream stands between two batches: the first batch keeps version 1, the second has version 2."""
    path, logs = scratch(spark, "ruled"), views.logs(spark, sf).select("log_id", "source", "message")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 100_000)
    for k, new in enumerate(_ADDED):
        ruled.add_rules(spark, f"{path}/rules", new)
        logs.filter(F.col("log_id") % 2 == k).write.mode("append").parquet(f"{path}/in")
        jobs.in_batches(stream.parquet(f"{path}/in"), "ruled", ruled.checked(f"{path}/rules", f"{path}/out", f"{path}/pins"), f"{path}/state")
    out = spark.read.parquet(f"{path}/out")
    return out.select("log_id", F.col("rules_version").alias("version"), F.array_join("decision.matched_rules", ",").alias("names"), "decision.retention_days")


# models
def _features(spark, sf):
    feats = text.anomaly_features(F.col("message"), F.col("event_ts"))
    return views.logs(spark, sf).select("log_id", "message", "expected_category", *[c.cast("double").alias(n) for n, c in feats.items()]), list(feats)


_models: dict[tuple, tuple] = {}


def _once(spark, sf, kind, make):
    """What make() gives, once for a session and for the events files as they are."""
    files = spark.read.parquet(f"{sf}/events.parquet").select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()  # a row a file
    key = (spark.sparkContext.applicationId, sf, kind, frozenset(map(tuple, files)))
    if key not in _models:
        _models[key] = make()
    return _models[key]


def _split(spark, sf):
    """The logs with normalised message and split, stored once for a session and folder."""

    def make():
        logs = views.logs(spark, sf).select("log_id", text.normalised(F.col("message"), text.NORMALISE_TRAIN).alias("message"), "expected_category")
        return kept_table(rows.stratified_split(logs, "log_id", "expected_category"), "split")

    return _once(spark, sf, "split", make)


def _trained(spark, sf):
    """The logs with their split, and the model of its full size, trained once for a session and folder: 200 rounds of depth 6 at most, stopped by
    the validation split, on the 10,000 most frequent terms of one to three words of the normalised message."""

    def make():
        fitted = _split(spark, sf).filter("split <> 'test'").withColumn("is_val", F.col("split") == "val")
        return ml.train(fitted, "message", "expected_category", ml.boosted_trees(validation="is_val"))

    return _split(spark, sf), _once(spark, sf, "text", make)


def _published(spark, sf):
    """Where the two models fitted on these logs have been published."""

    def make():
        paths = {kind: scratch(spark, f"models-{kind}") for kind in scoring.KINDS}
        scoring.TextModel(_trained(spark, sf)[1]).save(spark, paths["text_model"], "v1")
        scoring.fit_anomaly(views.logs(spark, sf), F.col("expected_category").isin("routine", "noise")).save(spark, paths["anomaly"], "v1")
        return paths

    return _once(spark, sf, "published", make)


_PARSED = (decided().replace("'message'", "parsed").replace("(message,", "(parsed,").replace("FROM logs)", "FROM (SELECT *, CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END AS parsed FROM logs))"), CHECKED)


@book.query("triage_by_models", on_logs("SELECT split, count(*) AS n, count(*) FILTER (len(rules) > 0) AS regulated, true AS accuracy_from_95, true AS critical_recall_from_99 FROM checked c JOIN split USING (log_id) GROUP BY 1", *_PARSED, SPLIT))
def triage_by_models(spark, sf):
    """The whole triage with rules, the loaded text model and the loaded forest, no score from a label: by split how many logs, how many of
    them are regulated, and whether the decisions on all others are as good as they have to be."""
    out = ensemble.triage(views.logs(spark, sf), models=scoring.models_at(spark, _published(spark, sf)))
    known = _trained(spark, sf)[0].select("log_id", "expected_category", "split")
    judged = out.filter("destination = 'cold_storage'").join(known, "log_id")  # every log goes there
    free, right = F.col("model") == "ensemble", F.col("category") == F.col("expected_category")
    share = judged.groupBy("split").agg(F.count("*").alias("n"), F.count_if(~free).alias("regulated"), F.avg(F.when(free, right.cast("double"))).alias("a"), F.avg(F.when(free & (F.col("expected_category") == "critical"), right.cast("double"))).alias("r"))
    return share.select("split", "n", "regulated", (F.col("a") >= 0.95).alias("accuracy_from_95"), (F.col("r") >= 0.99).alias("critical_recall_from_99"))


@book.query("classifiers_by_name", on_logs("SELECT classifier, count(*) AS n, true AS confident, true AS known FROM logs, (VALUES ('rules'), ('text_model'), ('anomaly')) t(classifier) GROUP BY 1"))
def classifiers_by_name(spark, sf):
    """Classifiers picked by configuration, trained ones loaded from their folders: how many logs, and whether each has a known category
    with a confidence between 0 and 1."""
    paths, logs, out = _published(spark, sf), views.logs(spark, sf), None
    for kind in ("rules", *scoring.KINDS):
        said = scoring.create({"type": kind, "path": paths.get(kind)})(logs)
        one = said.agg(F.lit(kind).alias("classifier"), F.count("*").alias("n"), F.every(F.col("confidence").between(0, 1)).alias("confident"), F.every(F.col("category").isin(*values.CATEGORIES)).alias("known"))
        out = one if out is None else out.unionByName(one)
    return out


@book.query("boosted_tree_train", on_logs("SELECT split, count(*) AS n, true AS accuracy_from_95, true AS critical_recall_from_99 FROM split GROUP BY 1", SPLIT))
def boosted_tree_train(spark, sf):
    """By split: how many rows, and whether the model is as good as it has to be."""
    logs, model = _trained(spark, sf)
    right = F.col("category") == F.col("expected_category")
    points = logs.groupBy("split", "message", "expected_category").agg(F.count("*").alias("copies"))  # equal logs have equal scores
    share = lambda of: F.sum(F.when(of & right, F.col("copies")).otherwise(0)) / F.sum(F.when(of, F.col("copies")))
    out = ml.scored(model, points).groupBy("split").agg(F.sum("copies").alias("n"), share(F.col("expected_category").isNotNull()).alias("a"), share(F.col("expected_category") == "critical").alias("r"))
    return out.select("split", "n", (F.col("a") >= 0.95).alias("accuracy_from_95"), (F.col("r") >= 0.99).alias("critical_recall_from_99"))


@book.query("boosted_tree_score")
def boosted_tree_score(spark, sf):
    logs, model = _trained(spark, sf)
    return ml.scored(model, logs).drop("message", "split")


@book.query("feature_importance_topk")
def feature_importance_topk(spark, sf):
    _, model = _trained(spark, sf)
    return spark.createDataFrame(ml.importances(model, 50), "term string, importance double")


@book.query("cross_validate", on_logs("SELECT least(5, count(*) // 10) AS folds, count(*) AS n, true AS accuracy_from_90 FROM split WHERE split = 'test'", SPLIT))
def cross_validate(spark, sf):
    """Boosted trees of 50 rounds on folds of the test split."""
    out = ml.cross_validated(_split(spark, sf).filter("split = 'test'").drop("split"), "log_id", "message", "expected_category")
    return out.agg(F.count("*").alias("folds"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n") >= 0.9).alias("accuracy_from_90"))


@book.query("model_save_load", on_logs("SELECT 'v1' AS name, count(*) AS n, count(*) AS equal FROM logs"))
def model_save_load(spark, sf):
    path = scratch(spark, "models")
    logs, model = _trained(spark, sf)
    ml.save(model, path, {"name": "v1", "categories": list(values.CATEGORIES), "terms": len(next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary")))})
    back, manifest = ml.load(spark, path)
    points = kept_table(logs.groupBy("message").agg(F.count("*").alias("copies")), "points")  # equal logs have equal scores
    again = [F.col(f"p_{c}").alias(f"again_{c}") for c in ml.LABELS]
    out = ml.scored(back, points).select("message", *again).join(ml.scored(model, points), "message")
    same = F.lit(True)
    for c in ml.LABELS:
        same = same & (F.abs(F.col(f"again_{c}") - F.col(f"p_{c}")) < 1e-9)
    return out.agg(F.lit(manifest["name"]).alias("name"), F.sum("copies").alias("n"), F.sum(F.when(same, F.col("copies")).otherwise(0)).alias("equal"))


def _forest(spark, sf):
    """The logs with scaled features and whether they are trained on, the features' names and a forest of 200 trees, grown once a session."""

    def make():
        df, columns = _features(spark, sf)
        df = kept_table(df.drop("message"), "features")
        usual = F.col("expected_category").isin("routine", "noise")
        few = df.filter(usual).limit(101).count() <= 100
        df = df.withColumn("usual", F.lit(True) if few else usual)
        df = ml.scaled(df, df.filter("usual"), columns)
        return df, columns, kept_table(ml.isolation_forest(df.filter("usual"), "log_id", columns), "forest")

    return _once(spark, sf, "forest", make)


@book.query("isolation_forest_train", on_logs("SELECT unnest(range(200)) AS tree, true AS whole FROM (SELECT count(*) FROM logs WHERE expected_category IN ('routine', 'noise') HAVING count(*) > 0)"))
def isolation_forest_train(spark, sf):
    """The trees, and whether each has cuts, and one leaf more than these."""
    features = F.transform(F.sequence(F.lit(0), (F.size("nodes") / 5 - 1).cast("int")), lambda k: F.get("nodes", 5 * k))
    inner = F.size(F.filter(features, lambda x: x >= 0))
    return _forest(spark, sf)[-1].select(F.col("tree").cast("long").alias("tree"), ((F.size("nodes") == 5 * (2 * inner + 1)) & (inner > 0)).alias("whole"))


@book.query("isolation_forest_score")
def isolation_forest_score(spark, sf):
    df, columns, forest = _forest(spark, sf)
    scored = kept_table(ml.forest_scored(df, forest, columns).select("log_id", "usual", "anomaly_score"), "scores")
    category, confidence = ml.anomaly_category(F.col("anomaly_score"), ml.contamination_cut(scored.filter("usual")))
    return scored.select("log_id", "anomaly_score", category.alias("category"), confidence.alias("confidence"))

