"""Kafka source and sinks, and what turns their records into columns and back. The connector's package must be on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "id string, timestamp string, source string, raw_message string, parsed_fields map<string,string>"


def log_source(spark: SparkSession, servers: str, topic: str, starting: str = "latest", most: int = 256, **options: str) -> DataFrame:
    """A stream of a topic's records; offsets are committed with the query's checkpoint, after each batch has been written."""
    known = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(most), "includeHeaders": "true", "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**known | options).load()


def raw_envelope(records: DataFrame) -> DataFrame:
    """Kafka columns (key, value, topic, partition, offset, timestamp_ms or timestamp, headers) as a raw log."""
    at = F.timestamp_millis("timestamp_ms") if "timestamp_ms" in records.columns else F.col("timestamp")
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return records.select(F.col("value").cast("string").alias("raw_message"), "topic", "partition", "offset", at.alias("timestamp"), F.col("key").cast("string").alias("key"), headers.alias("headers"))


def json_envelope(records: DataFrame) -> DataFrame:
    """raw_envelope's rows with a JSON envelope unpacked; a missing field falls back to header, topic or the whole value.

    Rows whose value is no JSON object are left out (see bad_envelopes).
    """
    body = F.from_json("raw_message", ENVELOPE)
    good = records.filter(~_bad(F.col("raw_message"))).withColumn("_b", body)
    return good.select(
        F.coalesce("_b.id", F.try_element_at("headers", F.lit("message_id")), F.lit("unknown")).alias("id"),
        F.coalesce("_b.timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.coalesce("_b.source", "topic").alias("source"),
        F.coalesce("_b.raw_message", "raw_message").alias("raw_message"),
        F.coalesce("_b.parsed_fields", F.create_map().cast("map<string,string>")).alias("parsed_fields"),
    )


def _bad(value: Column) -> Column:
    return F.coalesce(F.try_parse_json(value).isNull() | ~F.ltrim(value).startswith("{"), F.lit(True))


def bad_envelopes(records: DataFrame) -> DataFrame:
    """The rows that json_envelope leaves out, for a dead-letter sink."""
    return records.filter(_bad(F.col("raw_message")))


def as_records(logs: DataFrame, topic: str, key: str | None = None, headers: dict[str, Column | str] | None = None) -> DataFrame:
    """(topic, key, value, headers): each row as JSON. A header is a text or a column; one that is null is left out."""
    value = F.to_json(F.struct(*logs.columns))
    pairs = [F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).cast("string").cast("binary").alias("value")) for k, v in (headers or {}).items()]
    kind = "array<struct<key:string,value:binary>>"
    given = F.filter(F.array(*pairs).cast(kind), lambda h: h["value"].isNotNull()) if pairs else F.array().cast(kind)
    return logs.select(F.lit(topic).alias("topic"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), value.alias("value"), given.alias("headers"))


def _sink(servers: str, options: dict[str, str]) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.enable.idempotence": "true", "includeHeaders": "true"} | options


def write(records: DataFrame, servers: str, **options: str) -> None:
    records.write.format("kafka").options(**_sink(servers, options)).save()


def write_stream(records: DataFrame, servers: str, checkpoint: str, **options: str):
    """The records of a stream to their topics; the query, started."""
    return records.writeStream.format("kafka").options(**_sink(servers, options)).option("checkpointLocation", checkpoint).start()
