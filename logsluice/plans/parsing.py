"""Queries: sources, parsing, text and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import ensemble, leef
from ..sources import files, kafka, sinks
from ..sources.scratch import folder as scratch
from . import views
from .book import Book, decided, on_logs

book = Book()


def records(spark, sf):
    """The logs as Kafka would deliver them."""
    rows = views.logs(spark, sf)
    return rows.select(
        F.col("raw_message").cast("binary").alias("value"), F.when(F.col("log_id") % 3 == 0, F.col("source").cast("binary")).alias("key"), F.lit("logs").alias("topic"), (F.col("log_id") % 4).cast("int").alias("partition"),
        F.col("log_id").alias("offset"), F.unix_millis("event_ts").alias("timestamp_ms"), F.array(F.struct(F.lit("message_id").alias("key"), F.concat(F.lit("m"), F.col("log_id")).cast("binary").alias("value"))).alias("headers"),
    )


@book.query("raw_envelope_decode", on_logs("SELECT raw_message, 'logs' AS topic, CAST(log_id % 4 AS INTEGER) AS partition, log_id AS offset, CAST(floor(epoch(event_ts)) AS BIGINT) AS ts, CASE WHEN log_id % 3 = 0 THEN source END AS key, 'm' || log_id AS message_id FROM logs"))
def raw_envelope_decode(spark, sf):
    out = kafka.raw_envelope(records(spark, sf))
    return out.select("raw_message", "topic", "partition", "offset", F.unix_timestamp("timestamp").alias("ts"), "key", F.col("headers")["message_id"].alias("message_id"))


@book.query("json_envelope_decode", on_logs("SELECT 'm' || log_id AS id, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, source, raw_message FROM logs WHERE log_id % 6 = 4"))
def json_envelope_decode(spark, sf):
    return kafka.json_envelope(kafka.raw_envelope(records(spark, sf))).select("id", "timestamp", "source", "raw_message")


@book.query("stream_envelope_errors", on_logs("SELECT count(*) AS n, count(DISTINCT log_id % 6) AS kinds FROM logs WHERE log_id % 6 <> 4"))
def envelope_errors(spark, sf):
    return kafka.bad_envelopes(kafka.raw_envelope(records(spark, sf))).agg(F.count("*").alias("n"), F.count_distinct(F.col("offset") % 6).alias("kinds"))


@book.query("labeled_csv_source", on_logs("SELECT message, CASE WHEN log_id % 50 = 0 THEN 'other' ELSE expected_category END AS category, source FROM logs WHERE log_id % 50 <> 0"))
def labeled_csv_source(spark, sf):
    path = scratch(spark, "labelled")
    category = F.when(F.col("log_id") % 50 == 0, "other").otherwise(F.col("expected_category"))
    views.logs(spark, sf).select(F.col("event_ts").cast("string").alias("timestamp"), "message", category.alias("category"), "source").write.option("header", True).option("escape", '"').csv(path)
    return files.labelled_csv(spark, path).select("message", "category", "source")


@book.query("split_csv_source", on_logs("SELECT CASE log_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, message AS text, expected_category AS label FROM logs"))
def split_csv_source(spark, sf):
    paths = {}
    for k, name in enumerate(("train", "val", "test")):
        paths[name] = scratch(spark, name)
        views.logs(spark, sf).filter(F.col("log_id") % 3 == k).select("message", "expected_category").write.option("header", True).option("escape", '"').csv(paths[name])
    return files.split_csv(spark, paths, "message", "expected_category")


@book.query("log_dir_source", on_logs("SELECT CASE WHEN log_id % 2 = 0 THEN raw_message ELSE message END AS message, CASE WHEN log_id % 2 = 0 THEN 'txt' ELSE 'csv' END AS kind FROM logs"))
def log_dir_source(spark, sf):
    path, rows = scratch(spark, "dir"), views.logs(spark, sf)
    rows.filter("log_id % 2 = 0").select("raw_message").write.text(f"{path}/a/b")
    rows.filter("log_id % 2 = 1").select("log_id", F.col("message").alias("Content")).write.option("header", True).option("escape", '"').csv(f"{path}/c")
    return files.log_directory(spark, path).select("message", F.element_at(F.split("source_file", "\\."), -1).alias("kind"))


@book.query("kafka_log_source", on_logs("SELECT raw_message, 'logs' AS topic, CAST(log_id % 4 AS INTEGER) AS partition, log_id AS offset, CASE WHEN log_id % 3 = 0 THEN source END AS key FROM logs"))
def kafka_log_source(spark, sf):
    """The decoded source as a stream over files in Kafka's schema, as the connector may be absent."""
    from ..streaming import jobs

    rows = records(spark, sf).withColumn("at", F.timestamp_millis("timestamp_ms"))
    decoded = kafka.raw_envelope(jobs.replayed(rows, "at")).filter("raw_message IS NOT NULL")
    return jobs.finished(decoded, "kafka-source").select("raw_message", "topic", "partition", "offset", "key")


@book.query("kafka_classified_sink", on_logs("SELECT 'classified' AS topic, source AS key, log_id, category, round(confidence, 6) AS confidence, CASE WHEN rule IS NULL THEN 'schema=1' ELSE 'schema=1,rule=' || rule END AS headers FROM decisions", decided()))
def kafka_classified_sink(spark, sf):
    rows = views.decisions(spark, sf).select("log_id", "message", "category", "confidence", "source", "rule")
    out = kafka.as_records(rows, "classified", "source", {"schema": "1", "rule": F.col("rule")})
    body = F.from_json("value", "log_id long, category string, confidence double")
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return out.select("topic", "key", body.alias("b"), headers.alias("headers")).select("topic", "key", "b.log_id", "b.category", F.round("b.confidence", 6).alias("confidence"), "headers")


@book.query("cold_storage_sink", on_logs("SELECT year(event_ts) AS year, month(event_ts) AS month, day(event_ts) AS day, category, count(*) AS n, sum(log_id) AS ids FROM decisions GROUP BY ALL", decided()))
def cold_storage_sink(spark, sf):
    path = scratch(spark, "cold")
    sinks.cold_storage(views.decisions(spark, sf).select("log_id", "event_ts", "message", "category"), path)
    back = spark.read.schema("log_id long, year int, month int, day int, category string").json(path)
    return back.groupBy("year", "month", "day", "category").agg(F.count("*").alias("n"), F.sum("log_id").alias("ids"))


_SEV = "CASE category WHEN 'critical' THEN 10 WHEN 'suspicious' THEN 7 WHEN 'routine' THEN 3 WHEN 'noise' THEN 1 ELSE 5 END"


@book.query("leef_feed", on_logs(f"SELECT log_id, 'LEEF:2.0|LogSluice|Triage|1.0|' || category || '|devTime=' || strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') || ' cat=' || category || ' sev=' || {_SEV} || ' msg=' || message || ' confidence=' || printf('%.2f', confidence) AS line FROM decisions WHERE category IN ('critical', 'suspicious')", decided()))
def leef_feed(spark, sf):
    rows = views.decisions(spark, sf).filter(ensemble.forwarded(F.col("category")))
    return rows.select("log_id", leef.feed(F.col("event_ts"), F.col("category"), F.col("message"), F.col("confidence")).alias("line"))


@book.query("leef_event_rich", on_logs(f"SELECT log_id, 'LEEF:1.0' || chr(9) || 'LogSluice' || chr(9) || 'Triage' || chr(9) || '1.0' || chr(9) || {_SEV} || chr(9) || 'id-' || log_id || chr(9) || 'src=' || source_ip || chr(9) || 'shost=' || source || CASE WHEN log_id % 2 = 0 THEN chr(9) || 'cnt=' || log_id % 7 ELSE '' END || chr(9) || 'ai_category=' || category || chr(9) || 'ai_confidence=' || printf('%.2f', confidence) || chr(9) || 'ai_raw_message=' || replace(left(raw_message, 500), chr(9), '\\t') || CASE WHEN category = 'critical' THEN chr(9) || 'severity=10' ELSE '' END AS line FROM decisions", decided()))
def leef_event_rich(spark, sf):
    rows = views.decisions(spark, sf)
    attributes = {"src": F.col("source_ip"), "dst": F.lit(None).cast("string"), "shost": F.col("source"), "cnt": F.when(F.col("log_id") % 2 == 0, F.col("log_id") % 7)}
    return rows.select("log_id", leef.rich(F.col("category"), F.col("confidence"), F.col("raw_message"), F.concat(F.lit("id-"), F.col("log_id")), attributes).alias("line"))


@book.query("validation_report_sink", on_logs("SELECT count(*) AS total, count(*) FILTER (expected_category = category) AS correct, count(*) FILTER (expected_category = 'critical' AND category <> 'critical') AS misses FROM decisions", decided()))
def validation_report_sink(spark, sf):
    rows, path = views.decisions(spark, sf), scratch(spark, "report")
    summary = rows.agg(F.count("*").alias("total"), F.count_if(F.col("expected_category") == F.col("category")).alias("correct"))
    misses = rows.filter("expected_category = 'critical' AND category <> 'critical'").select("log_id", "message", "expected_category", "category")
    sinks.validation_report(summary, misses, path)
    back = spark.read.schema("total long, correct long").json(f"{path}/summary")
    count = spark.read.option("header", True).schema("log_id long").csv(f"{path}/misses").agg(F.count("*").alias("misses"))
    from ..operators.metrics import beside

    return beside(back, count)


# parsing
_FORMAT = r"""CASE WHEN regexp_matches(raw_message, '^LEEF:[^|]+\|[^|]+\|[^|]+\|[^|]+\|[^|]+\|') THEN 'leef' WHEN regexp_matches(raw_message, '^CEF:\d+\|([^|]+\|){6}') THEN 'cef'
 WHEN regexp_matches(raw_message, '^<\d+>\d+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+(\[.*?\]|-)') THEN 'syslog_rfc5424' WHEN regexp_matches(raw_message, '^(<\d+>)?[A-Za-z0-9_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+?(\[\d+\])?:\s+') THEN 'syslog_rfc3164'
 WHEN json_valid(raw_message) AND raw_message LIKE '{%}' THEN 'json' ELSE 'generic' END"""


@book.query("parse_detect_format", on_logs(f"SELECT log_id, {_FORMAT} AS format FROM logs"))
def parse_detect_format(spark, sf):
    return views.logs(spark, sf).select("log_id", parse.detected(F.col("raw_message")).alias("format"))


def _only(spark, sf, kind):
    return parse.of_format(views.logs(spark, sf), kind, "log_id")


def _x(k, pattern):
    return f"nullif(regexp_extract(raw_message, '{pattern}', {k}), '')"


_LEEF = r"^LEEF:([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)"
_CEF = r"^CEF:(\d+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)"
_5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)"
_3164 = r"^(?:<(\d+)>)?([A-Za-z0-9_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"


@book.query("parse_leef", on_logs(f"SELECT log_id, {_x(1, _LEEF)} AS leef_version, {_x(2, _LEEF)} AS vendor, {_x(3, _LEEF)} AS product, {_x(4, _LEEF)} AS product_version, {_x(5, _LEEF)} AS event_id, message, source_ip AS src FROM logs WHERE log_id % 6 = 0"))
def parse_leef(spark, sf):
    return _only(spark, sf, "leef").withColumn("src", F.col("attributes")["src"]).drop("attributes")


@book.query("parse_cef", on_logs(f"SELECT log_id, {_x(1, _CEF)} AS cef_version, {_x(2, _CEF)} AS vendor, {_x(3, _CEF)} AS product, {_x(4, _CEF)} AS product_version, {_x(5, _CEF)} AS signature_id, {_x(6, _CEF)} AS name, {_x(7, _CEF)} AS cef_severity, message, '10.0.0.5' AS dst FROM logs WHERE log_id % 6 = 1"))
def parse_cef(spark, sf):
    return _only(spark, sf, "cef").withColumn("dst", F.col("extension")["dst"]).drop("extension")


@book.query("parse_syslog5424", on_logs(f"SELECT log_id, CAST({_x(1, _5424)} AS INTEGER) AS priority, CAST({_x(1, _5424)} AS INTEGER) // 8 AS facility, CAST({_x(1, _5424)} AS INTEGER) % 8 AS syslog_severity, {_x(2, _5424)} AS version, {_x(3, _5424)} AS timestamp, {_x(4, _5424)} AS hostname, {_x(5, _5424)} AS app_name, {_x(6, _5424)} AS proc_id, {_x(7, _5424)} AS msg_id, {_x(8, _5424)} AS structured_data, message FROM logs WHERE log_id % 6 = 2"))
def parse_syslog5424(spark, sf):
    return _only(spark, sf, "syslog_rfc5424")


@book.query("parse_syslog3164", on_logs(f"SELECT log_id, CAST({_x(1, _3164)} AS INTEGER) AS priority, CAST({_x(1, _3164)} AS INTEGER) // 8 AS facility, CAST({_x(1, _3164)} AS INTEGER) % 8 AS syslog_severity, {_x(2, _3164)} AS timestamp, {_x(3, _3164)} AS hostname, {_x(4, _3164)} AS process, {_x(5, _3164)} AS pid, message FROM logs WHERE log_id % 6 = 3"))
def parse_syslog3164(spark, sf):
    return _only(spark, sf, "syslog_rfc3164")


@book.query("parse_json_log", on_logs("SELECT log_id, json_extract_string(raw_message, '$.message') AS message, json_extract_string(raw_message, '$.source') AS source FROM logs WHERE log_id % 6 = 4"))
def parse_json_log(spark, sf):
    rows = views.logs(spark, sf).filter(parse.detected(F.col("raw_message")) == "json")
    return rows.select("log_id", parse.json_message(parse.stripped(F.col("raw_message"))).alias("message"), F.get_json_object("raw_message", "$.source").alias("source"))


_IPS = r"regexp_extract_all(raw_message, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')"


@book.query("parse_generic", on_logs(rf"SELECT log_id, nullif(regexp_extract(raw_message, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}'), '') AS timestamp, {_IPS}[1] AS source_ip, {_IPS}[2] AS destination_ip, upper(nullif(regexp_extract(raw_message, '\b(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\b', 1, 'i'), '')) AS level, raw_message AS message, len({_IPS}) AS n_ips FROM logs WHERE log_id % 6 = 5"))
def parse_generic(spark, sf):
    return _only(spark, sf, "generic").withColumn("n_ips", F.size("ip_addresses")).drop("ip_addresses")


_PAIR = r"""([A-Za-z0-9_]+)=(?:"([^"]*)"|([^\s]*))"""


@book.query("parse_kv_pairs", on_logs(f"SELECT log_id, k AS key, CASE WHEN q <> '' THEN q ELSE v END AS value FROM (SELECT log_id, unnest(regexp_extract_all(t, '{_PAIR}', 1)) AS k, unnest(regexp_extract_all(t, '{_PAIR}', 2)) AS q, unnest(regexp_extract_all(t, '{_PAIR}', 3)) AS v, generate_subscripts(regexp_extract_all(t, '{_PAIR}', 1), 1) AS i FROM (SELECT log_id, raw_message || ' src=again' AS t FROM logs WHERE log_id % 6 < 2)) QUALIFY row_number() OVER (PARTITION BY log_id, k ORDER BY i DESC) = 1"))
def parse_kv_pairs(spark, sf):
    rows = views.logs(spark, sf).filter("log_id % 6 < 2")
    return rows.select("log_id", F.explode(parse.pairs(F.concat("raw_message", F.lit(" src=again")))))


@book.query("parse_bulk", on_logs("SELECT CASE log_id % 6 WHEN 0 THEN 'leef' WHEN 1 THEN 'cef' WHEN 2 THEN 'syslog_rfc5424' WHEN 3 THEN 'syslog_rfc3164' WHEN 4 THEN 'json' ELSE 'generic' END AS format, count(*) AS n, sum(length(CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END)) AS chars FROM logs GROUP BY 1"))
def parse_bulk(spark, sf):
    return parse.parsed(views.logs(spark, sf)).groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("parsed_message")).alias("chars"))


@book.query("first_ip", on_logs("SELECT log_id, source_ip AS ip FROM logs"))
def first_ip(spark, sf):
    return views.logs(spark, sf).select("log_id", parse.first_ip(F.col("message")).alias("ip"))


@book.query("classified_flatten", on_logs("SELECT log_id, CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END AS message, CASE WHEN user_id % 4 = 0 AND user_id % 20 > 3 THEN 'logs' ELSE source END AS source, category, round(confidence, 6) AS confidence FROM decisions", decided()))
def classified_flatten(spark, sf):
    rows = parse.parsed(views.decisions(spark, sf)).withColumns({"topic": F.lit("logs"), "source": F.when(F.col("source") == "firewall-01", "").otherwise(F.col("source"))})
    return parse.flattened(rows).withColumn("confidence", F.round("confidence", 6))


# text
def _replaced(column: str, steps) -> str:
    for pattern, by in steps:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        column = f"regexp_replace({column}, '{pattern.removeprefix('(?i)')}', '{by}', '{flags}')"
    return column


@book.query("normalize_text", f"SELECT doc_id, md5(trim(regexp_replace(lower({_replaced('text', text.NORMALISE)}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS normalised FROM documents")
def normalize_text(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(text.normalised(F.col("text"))).alias("normalised"))


@book.query("normalize_text_train", on_logs(f"SELECT log_id, trim(regexp_replace(lower({_replaced('raw_message', text.NORMALISE_TRAIN)}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS normalised FROM logs"))
def normalize_text_train(spark, sf):
    return views.logs(spark, sf).select("log_id", text.normalised(F.col("raw_message"), text.NORMALISE_TRAIN).alias("normalised"))


@book.query("log_template", on_logs(f"SELECT log_id, left({_replaced('raw_message', text.TEMPLATE)}, 200) AS template FROM logs"))
def log_template(spark, sf):
    return views.logs(spark, sf).select("log_id", text.template(F.col("raw_message")).alias("template"))


_COUNT = lambda pattern, column="text": f"len(regexp_extract_all({column}, '{pattern}'))"


@book.query("log_features_text", f"SELECT doc_id, md5(left(text, 512)) AS message, length(text) AS message_length, {_COUNT('[^ \\t\\n\\r\\f\\v]+')} AS word_count, {_COUNT(r'\\p{Nd}')} AS digit_count, {_COUNT('[^\\p{L}\\p{N} \\t\\n\\r\\f\\v]')} AS special_char_count, round({_COUNT(r'\\p{Lu}')} / greatest(length(text), 1), 6) AS uppercase_ratio, regexp_matches(text, '\\b(error|fail|exception)\\b', 'i') AS has_error, regexp_matches(text, '\\b(warn|warning|alert)\\b', 'i') AS has_warning, regexp_matches(text, '\\b(auth|login|password|credential)\\b', 'i') AS has_auth, regexp_matches(text, '\\b(connection|port|socket|tcp|udp)\\b', 'i') AS has_network FROM documents".replace("\\\\p", "\\p"))
def log_features_text(spark, sf):
    out = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *[c.alias(n) for n, c in text.log_features(F.col("text")).items()])
    return out.withColumns({"uppercase_ratio": F.round("uppercase_ratio", 6), "message": F.md5("message")})


_BASE = f"length(text) AS message_length, {_COUNT('[^ \\t\\n\\r\\f\\v]+')} AS word_count, {_COUNT('[0-9]')} AS digit_count, {_COUNT('[^A-Za-z0-9 \\t\\n\\r\\f\\v]')} AS special_char_count, round({_COUNT('[A-Z]')} / greatest(length(text), 1), 6) AS uppercase_ratio"
_HAS = ", ".join(f"regexp_matches(text, '\\b({terms})\\b', 'i') AS has_{name}" for name, terms in (("error", "error|fail|exception"), ("warning", "warn|warning|alert"), ("auth", "auth|login|password|credential"), ("network", "connection|port|socket|tcp|udp")))
_META = r"""log_format, log_format IN ('syslog_rfc5424', 'syslog_rfc3164') OR log_format = 'generic' AND regexp_matches(raw_message, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}') AS has_timestamp,
 log_format = 'generic' AND regexp_matches(raw_message, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS has_ip,
 CASE WHEN log_format = 'cef' THEN split_part(raw_message, '|', 7) WHEN log_format LIKE 'syslog%' THEN CAST(CAST(regexp_extract(raw_message, '^<(\d+)>', 1) AS INTEGER) % 8 AS VARCHAR) END AS severity,
 CASE WHEN log_format LIKE 'syslog%' THEN CAST(CAST(regexp_extract(raw_message, '^<(\d+)>', 1) AS INTEGER) // 8 AS VARCHAR) END AS facility,
 CASE WHEN log_format IN ('leef', 'cef') THEN split_part(raw_message, '|', 2) END AS vendor, CASE WHEN log_format IN ('leef', 'cef') THEN split_part(raw_message, '|', 3) END AS product"""


@book.query("log_features", on_logs(f"SELECT log_id, left(text, 512) AS message, {_BASE}, {_HAS}, {_META} FROM texts", f"texts AS (SELECT *, {_FORMAT} AS log_format, CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END AS text FROM logs)"))
def log_features(spark, sf):
    """Features of the parsed message, with what its format told."""
    rows = parse.parsed(views.logs(spark, sf))
    out = rows.select("log_id", *[c.alias(n) for n, c in text.log_features(F.col("parsed_message")).items()], *[c.alias(n) for n, c in parse.metadata().items()])
    return out.withColumn("uppercase_ratio", F.round("uppercase_ratio", 6))


def _anomaly(last: str, terms: str) -> str:
    ratio = lambda p: f"round({_COUNT(p, 'message')} / greatest(length(message), 1), 6)"
    return rf"SELECT log_id, length(message) AS message_length, {_COUNT('[^ ]+', 'message')} AS word_count, {ratio('[0-9]')} AS digit_ratio, {ratio('[^A-Za-z0-9 ]')} AS special_char_ratio, {ratio('[A-Z]')} AS uppercase_ratio, CAST(regexp_matches(message, '\b({terms})\b', 'i') AS INTEGER) AS has_error_keyword, CAST(regexp_matches(message, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b') AS INTEGER) AS has_ip_address, {last} FROM logs"


def _features(spark, sf, at):
    out = views.logs(spark, sf).select("log_id", *[c.alias(n) for n, c in text.anomaly_features(F.col("message"), at).items()])
    return out.withColumns({c: F.round(c, 6) for c in ("digit_ratio", "special_char_ratio", "uppercase_ratio")})


@book.query("anomaly_features", on_logs(_anomaly("hour(event_ts) AS hour_of_day", "error|fail|exception|critical")))
def anomaly_features(spark, sf):
    return _features(spark, sf, F.col("event_ts"))


@book.query("anomaly_features_train", on_logs(_anomaly("CAST(regexp_matches(message, '/[A-Za-z0-9_]+/') AS INTEGER) AS has_path", "error|fail|exception")))
def anomaly_features_train(spark, sf):
    return _features(spark, sf, None)


@book.query("message_fingerprint", "SELECT doc_id, sha256(text) AS message_hash, left(text, 200) AS preview FROM documents")
def message_fingerprint(spark, sf):
    digest, preview = text.fingerprint(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", digest.alias("message_hash"), preview.alias("preview"))


@book.query("category_severity", on_logs(f"SELECT log_id, {_SEV} AS severity FROM (SELECT log_id, CASE WHEN log_id % 11 = 0 THEN 'other' ELSE expected_category END AS category FROM logs)"))
def category_severity(spark, sf):
    category = F.when(F.col("log_id") % 11 == 0, "other").otherwise(F.col("expected_category"))
    return views.logs(spark, sf).select("log_id", ensemble.severity(category).alias("severity"))


@book.query("title_severity", on_logs("SELECT log_id, CASE WHEN lower(message) LIKE '%critical%' THEN 10 WHEN lower(message) LIKE '%high%' THEN 8 WHEN lower(message) LIKE '%medium%' THEN 6 WHEN lower(message) LIKE '%low%' THEN 4 WHEN lower(message) LIKE '%info%' THEN 2 END AS severity FROM logs"))
def title_severity(spark, sf):
    return views.logs(spark, sf).select("log_id", ensemble.title_severity(F.col("message")).alias("severity"))
