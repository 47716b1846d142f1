"""Log lines to typed columns: LEEF, CEF, both syslog formats, JSON and free text. Column expressions only, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import IP

# One pattern for each format, in the order in which they are tried.
LEEF = r"(?d)^LEEF:([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)"
CEF = r"(?d)^CEF:(\d+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)"
RFC5424 = r"(?d)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)"
RFC3164 = r"(?d)^(?:<(\d+)>)?([\p{L}\p{N}_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"
JSON = r"(?s)^\s*\{.*\}\s*$"
PAIR = r"""([\p{L}\p{N}_]+)=(?:"([^"]*)"|([^\s]*))"""
ISO_TIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
BSD_TIME = r"([\p{L}\p{N}_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
LEVEL = r"(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\b"
MESSAGE_KEYS = ("message", "msg", "log", "text", "event", "@message")
FORMATS = ("leef", "cef", "syslog_rfc5424", "syslog_rfc3164", "json", "generic", "empty")


def _group(text: Column, pattern: str, k: int) -> Column:
    """A group's match; null where it took no part or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def stripped(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\n\r\f\x0b"))


def detected(raw: Column) -> Column:
    """The first format that a line matches and that can be parsed; blank and null lines are empty."""
    return _detected(stripped(raw))


def _detected(line: Column) -> Column:
    return (
        F.when(F.coalesce(line, F.lit("")) == "", "empty").when(line.rlike(LEEF), "leef").when(line.rlike(CEF), "cef")
        .when(line.rlike(RFC5424), "syslog_rfc5424").when(line.rlike(RFC3164), "syslog_rfc3164")
        .when(line.rlike(JSON) & F.try_parse_json(line).isNotNull(), "json").otherwise("generic")
    )


def pairs(text: Column) -> Column:
    """key=value pairs as a map; a value in double quotes may hold white space; of equal keys the last counts."""
    keys, quoted, plain = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(k)) for k in (1, 2, 3))
    rows = F.arrays_zip(keys.alias("k"), quoted.alias("q"), plain.alias("p"))
    last = F.filter(rows, lambda x, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), x["k"]) == 0)
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], F.when(x["q"] != "", x["q"]).otherwise(x["p"]))))


def _named(line: Column, pattern: str, names: str, first: int = 1) -> dict[str, Column]:
    return {n: _group(line, pattern, k) for k, n in enumerate(names.split(), first)}


def leef(line: Column, attributes: Column, known: Column) -> dict[str, Column]:
    """Of a stripped line, its attribute text and the pairs in that."""
    found = _named(line, LEEF, "leef_version vendor product product_version event_id")
    return found | {"attributes": known, "message": F.coalesce(known["msg"], known["cat"], attributes, found["event_id"])}


def cef(line: Column, known: Column) -> dict[str, Column]:
    found = _named(line, CEF, "cef_version vendor product product_version signature_id name cef_severity")
    return found | {"extension": known, "message": F.coalesce(known["msg"], found["name"])}


def _priority(found: Column) -> dict[str, Column]:
    number = found.try_cast("int")
    return {"priority": number, "facility": F.floor(number / 8).cast("int"), "syslog_severity": number % 8}


def syslog5424(line: Column) -> dict[str, Column]:
    return _priority(_group(line, RFC5424, 1)) | _named(line, RFC5424, "version timestamp hostname app_name proc_id msg_id structured_data", 2) | {"message": F.regexp_extract(line, RFC5424, 9)}


def syslog3164(line: Column) -> dict[str, Column]:
    return _priority(_group(line, RFC3164, 1)) | _named(line, RFC3164, "timestamp hostname process pid", 2) | {"message": F.regexp_extract(line, RFC3164, 6)}


def json_message(line: Column) -> Column:
    return F.coalesce(*[F.get_json_object(line, f"$['{k}']") for k in MESSAGE_KEYS], line)


def generic(line: Column, ips: Column) -> dict[str, Column]:
    return {
        "timestamp": F.coalesce(_group(line, ISO_TIME, 1), _group(line, BSD_TIME, 1)),
        "ip_addresses": ips,
        "source_ip": F.get(ips, F.lit(0)),
        "destination_ip": F.get(ips, F.lit(1)),
        "level": F.upper(_group(line, LEVEL, 1)),
        "message": line,
    }


def first_ip(text: Column) -> Column:
    return _group(text, f"({IP})", 1)


def parsed(logs: DataFrame, raw: str = "raw_message") -> DataFrame:
    """logs with one struct for each format (null where the line has another), format, and the message of whichever it is.

    A few projections on top of each other, no shuffle, so a stream and a table take the same plan. What several columns
    need (the stripped line, its format, its pairs) is a column of its own first, and computed once.
    """
    line, is_a = F.col("_line"), lambda name: F.col("format") == name
    out = logs.withColumn("_line", stripped(F.col(raw)))
    out = out.withColumn("format", _detected(line))
    out = out.withColumns({
        "_attributes": F.when(is_a("leef"), _group(line, LEEF, 6)).when(is_a("cef"), _group(line, CEF, 8)),
        "_ips": F.when(is_a("generic"), F.regexp_extract_all(line, F.lit(f"({IP})"), F.lit(1))),
    })
    out = out.withColumn("_known", F.when(F.col("_attributes").isNotNull(), pairs(F.col("_attributes"))))
    known = F.col("_known")
    readers = {"leef": leef(line, F.col("_attributes"), known), "cef": cef(line, known), "syslog_rfc5424": syslog5424(line), "syslog_rfc3164": syslog3164(line), "generic": generic(line, F.col("_ips"))}
    out = out.withColumns({f"as_{name}": F.when(is_a(name), F.struct(*[c.alias(n) for n, c in columns.items()])) for name, columns in readers.items()})
    message = F.coalesce(*[F.col(f"as_{name}.message") for name in readers], F.when(is_a("json"), json_message(line)), F.lit(""))
    return out.withColumn("parsed_message", message).drop("_line", "_attributes", "_ips", "_known")


def metadata(raw: str = "raw_message") -> dict[str, Column]:
    """Of parsed logs: the format, whether a time or an address was found, and severity, facility, vendor and product where the format has them."""
    of = lambda k: F.when(F.col("format") == "json", F.get_json_object(raw, f"$.{k}"))
    syslog = lambda k: F.coalesce(F.col(f"as_syslog_rfc5424.{k}"), F.col(f"as_syslog_rfc3164.{k}"))
    found = F.coalesce(syslog("timestamp"), F.col("as_generic.timestamp"), of("timestamp")).isNotNull()
    return {
        "log_format": F.col("format"), "has_timestamp": found, "has_ip": F.coalesce(F.col("as_generic.source_ip"), of("source_ip"), of("ip_addresses")).isNotNull(),
        "severity": F.coalesce(F.col("as_cef.cef_severity"), syslog("syslog_severity").cast("string"), of("severity")),
        "facility": F.coalesce(syslog("facility").cast("string"), of("facility")),
        "vendor": F.coalesce(F.col("as_leef.vendor"), F.col("as_cef.vendor"), of("vendor")), "product": F.coalesce(F.col("as_leef.product"), F.col("as_cef.product"), of("product")),
    }


def of_format(logs: DataFrame, name: str, *keep: str) -> DataFrame:
    """The lines of one format, as its columns."""
    return parsed(logs).filter(F.col("format") == name).select(*keep, f"as_{name}.*")


def flattened(logs: DataFrame) -> DataFrame:
    """Output rows: the parsed message or else the raw line, the log's source or else its topic."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return logs.select("log_id", F.coalesce(blank("parsed_message"), F.col("raw_message")).alias("message"), F.coalesce(blank("source"), F.col("topic")).alias("source"), "category", "confidence")
