"""Output records for a SIEM: LEEF lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ensemble import severity, title_severity


def decimals(number: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", number)


def feed(at: Column, category: Column, message: Column, confidence: Column, vendor: str = "LogSluice", product: str = "Triage") -> Column:
    """LEEF 2.0: header, then devTime, cat, sev, msg and confidence, unquoted and parted by spaces."""
    attributes = F.concat_ws(" ", F.concat(F.lit("devTime="), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("cat="), category), F.concat(F.lit("sev="), severity(category)), F.concat(F.lit("msg="), message), F.concat(F.lit("confidence="), decimals(confidence)))
    return F.concat(F.lit(f"LEEF:2.0|{vendor}|{product}|1.0|"), category, F.lit("|"), attributes)


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value.cast("string"), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def rich(category: Column, confidence: Column, message: Column, message_id: Column, attributes: dict[str, Column], vendor: str = "LogSluice", product: str = "Triage") -> Column:
    """LEEF 1.0, tab-separated: severity by category, attributes that are not null, extensions, severity by title; values escaped."""
    title = F.concat(F.lit("AI-Classified: "), F.upper(category))
    every = attributes | {"ai_category": category, "ai_confidence": decimals(confidence), "ai_raw_message": F.left(message, F.lit(500)), "severity": title_severity(title)}
    parts = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), _escaped(v)) for k, v in every.items()]))
    return F.concat_ws("\t", F.lit("LEEF:1.0"), F.lit(vendor), F.lit(product), F.lit("1.0"), severity(category).cast("string"), message_id, F.array_join(parts, "\t"))
