"""Fixture views over the events table, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules

LOGS = """
SELECT log_id, event_ts, user_id, source, source_ip, expected_category, event_type, message, latency_ms,
  CASE log_id % 6
    WHEN 0 THEN 'LEEF:2.0|IBM|QRadar|7.5|' || upper(event_type) || '|src=' || source_ip || chr(9) || 'sev=7' || chr(9) || 'msg="' || message || '"'
    WHEN 1 THEN 'CEF:0|Security|IDS|1.0|' || cast(100 + log_id % 9 AS string) || '|' || message || '|' || cast(log_id % 11 AS string) || '|src=' || source_ip || ' dst=10.0.0.5'
    WHEN 2 THEN '<' || cast(log_id % 192 AS string) || '>1 2024-01-' || lpad(cast(day(event_ts) AS string), 2, '0') || 'T' || lpad(cast(hour(event_ts) AS string), 2, '0') || ':' || lpad(cast(minute(event_ts) AS string), 2, '0') || ':00Z host-' || cast(user_id % 10 AS string) || ' app 1234 ID47 - ' || message
    WHEN 3 THEN '<' || cast(log_id % 192 AS string) || '>Jan ' || lpad(cast(day(event_ts) AS string), 2, ' ') || ' ' || lpad(cast(hour(event_ts) AS string), 2, '0') || ':' || lpad(cast(minute(event_ts) AS string), 2, '0') || ':00 host-' || cast(user_id % 10 AS string) || ' sshd[' || cast(1000 + log_id % 50 AS string) || ']: ' || message
    WHEN 4 THEN '{"level": "INFO", "source": "' || source || '", "message": "' || message || '"}'
    ELSE '2024-01-05 12:34:56 WARN ' || message || ' to 10.0.0.9'
  END AS raw_message
FROM (
  SELECT event_id AS log_id, ts AS event_ts, user_id, event_type, value AS latency_ms,
    '10.' || cast(user_id % 200 AS string) || '.0.' || cast(event_id % 250 AS string) AS source_ip,
    CASE user_id % 20 WHEN 0 THEN 'pci_payment_gateway' WHEN 1 THEN 'ehr_records' WHEN 2 THEN 'financial_ledger' WHEN 3 THEN 'gdpr_portal'
      ELSE CASE user_id % 4 WHEN 0 THEN 'firewall-01' WHEN 1 THEN 'ids-sensor' WHEN 2 THEN 'app-server-01' ELSE 'load-balancer' END END AS source,
    CASE event_type WHEN 'error' THEN (CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'suspicious' END) WHEN 'view' THEN 'noise' ELSE 'routine' END AS expected_category,
    CASE event_type
      WHEN 'error' THEN CASE event_id % 6
        WHEN 0 THEN 'ALERT: Malware detected in file /tmp/payload.exe from '
        WHEN 3 THEN 'CRITICAL: Brute force attack, multiple failed auth from '
        WHEN 1 THEN 'WARNING: Failed login attempt for user admin from '
        WHEN 2 THEN 'NOTICE: Access denied to /etc/app.conf from '
        WHEN 4 THEN 'WARNING: Suspicious powershell execution on '
        ELSE 'NOTICE: Unusual outbound traffic from ' END
      WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'DEBUG: Health check endpoint called by ' ELSE 'TRACE: Heartbeat received from ' END
      WHEN 'purchase' THEN 'INFO: credit_card charge 1000456 completed for '
      WHEN 'signup' THEN 'INFO: Service account started successfully on '
      ELSE 'INFO: Request processed for ' END
    || '10.' || cast(user_id % 200 AS string) || '.0.' || cast(event_id % 250 AS string) AS message
  FROM {events}) e
"""

#: Given model scores: a text model that leans to the expected category, an anomaly model from a score.
SCORED = """
SELECT *, expected_category AS text_category, 0.55e0 + 0.1e0 * (log_id % 4) AS text_confidence,
  CASE WHEN expected_category = 'critical' THEN 0.55e0 + 0.1e0 * (log_id % 4) ELSE (0.45e0 - 0.1e0 * (log_id % 4)) / 3 END AS text_p_critical,
  CASE WHEN expected_category = 'suspicious' THEN 0.55e0 + 0.1e0 * (log_id % 4) ELSE (0.45e0 - 0.1e0 * (log_id % 4)) / 3 END AS text_p_suspicious,
  CASE WHEN expected_category = 'routine' THEN 0.55e0 + 0.1e0 * (log_id % 4) ELSE (0.45e0 - 0.1e0 * (log_id % 4)) / 3 END AS text_p_routine,
  CASE WHEN expected_category = 'noise' THEN 0.55e0 + 0.1e0 * (log_id % 4) ELSE (0.45e0 - 0.1e0 * (log_id % 4)) / 3 END AS text_p_noise,
  ((log_id * 37) % 100 - 50) / 1e2 AS anomaly_score,
  CASE WHEN ((log_id * 37) % 100 - 50) < -30 THEN 'suspicious' ELSE 'routine' END AS anomaly_category,
  CASE WHEN ((log_id * 37) % 100 - 50) < -30 THEN least(9e-1, 5e-1 + abs(((log_id * 37) % 100 - 50) / 1e2)) ELSE 5e-1 END AS anomaly_confidence
FROM logs
"""


def spread(table: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores is dealt out to all of them before work that costs far more than the shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(LOGS.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"), events=events)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.sql(SCORED.replace("FROM logs", "FROM {logs}"), logs=logs(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith(("text_p_", "text_conf", "anomaly_s", "anomaly_conf"))})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_rule(logs(spark, sf_dir), F.col("message"))


def offenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).filter("event_type = 'error' AND log_id % 97 = 0")
    return rows.select(
        F.col("log_id").alias("offense_id"), (F.col("event_ts") + F.expr("INTERVAL 2 MINUTES")).alias("start_time"), (F.col("log_id") % 10 + 1).alias("severity"),
        F.when(F.col("log_id") % 5 == 0, "CLOSED").otherwise("OPEN").alias("status"), F.array("source_ip").alias("source_ips"), F.array(F.upper("source")).alias("log_sources"), F.col("event_type").alias("offense_type_name"),
    )


def eps_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour: all logs and forwarded logs, scaled so as to reach the licence tiers."""
    rows = decisions(spark, sf_dir).groupBy(F.date_trunc("hour", "event_ts").alias("ts"))
    return rows.agg((F.count("*") * 1000.0).alias("before"), (F.count_if(F.col("category").isin("critical", "suspicious")) * 1000.0).alias("after"))


# The same views in DuckDB's SQL, for the oracles.
D_LOGS = "logs AS (" + LOGS.replace("{events}", "events") + ")"
D_SCORED = "scored AS (" + SCORED + ")"
