"""Text of log lines: normalisation, templates and numeric features, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of addresses, ids and times.
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
DAY_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
# Substitutions in the order in which they apply. Word characters are spelt out, so that all engines agree.
NORMALISE = [
    (IP, "<IP>"),
    (DAY_TIME + r"(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TIMESTAMP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (UUID, "<UUID>"),
    (r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]{2,}", "<EMAIL>"),
    (r"(?i)\b(?:[0-9a-f]{2}:){5}[0-9a-f]{2}\b", "<MAC>"),
    (r"(?i)\b[a-f0-9]{64}\b", "<HASH>"),
    (r"(?i)\b[a-f0-9]{40}\b", "<HASH>"),
    (r"(?i)\b[a-f0-9]{32}\b", "<HASH>"),
    (r"(?:/[\p{L}\p{N}_\-./]+)+", "<PATH>"),
    (r"(?:[A-Za-z]:\\[\p{L}\p{N}_\-\\./]+)+", "<PATH>"),
    (r"https?://\S+", "<URL>"),
    (r"\b\d{5,}\b", "<LONGNUM>"),
]
NORMALISE_TRAIN = [(IP, "<IP>"), (DAY_TIME, "<TIMESTAMP>"), (r"0x[0-9a-fA-F]+", "<HEX>"), (UUID, "<UUID>"), (r"(?:/[\p{L}\p{N}_\-./]+)+", "<PATH>"), (r"\b\d{5,}\b", "<LONGNUM>")]
TEMPLATE = [(IP, "<IP>"), (r"\b\d+\b", "<NUM>"), (UUID, "<UUID>")]
SPACE = r"[ \t\n\r\f\x0B]+"


def substituted(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return text


def normalised(text: Column, steps: list[tuple[str, str]] | None = None) -> Column:
    """Variable parts become placeholders; lower case; single spaces."""
    return F.trim(F.regexp_replace(F.lower(substituted(text, steps or NORMALISE)), F.lit(SPACE), F.lit(" ")))


def template(text: Column, most: int = 200) -> Column:
    return F.left(substituted(text, TEMPLATE), F.lit(most))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}")).cast("long")


def specials(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\p{L}\p{N} \t\n\r\f\x0B]")).cast("long")


def uppers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")


def ratio(count: Column, text: Column) -> Column:
    return count / F.greatest(F.length(text), F.lit(1))


def mentions(text: Column, *terms: str) -> Column:
    return text.rlike(rf"(?i)\b({'|'.join(terms)})\b")


# The words that each feature looks for.
ERROR, WARNING, AUTH, NETWORK = ("error", "fail", "exception"), ("warn", "warning", "alert"), ("auth", "login", "password", "credential"), ("connection", "port", "socket", "tcp", "udp")


def log_features(message: Column, most: int = 512) -> dict[str, Column]:
    return {
        "message": F.left(message, F.lit(most)),
        "message_length": F.length(message),
        "word_count": words(message),
        "digit_count": digits(message),
        "special_char_count": specials(message),
        "uppercase_ratio": ratio(uppers(message), message),
        "has_error": mentions(message, *ERROR),
        "has_warning": mentions(message, *WARNING),
        "has_auth": mentions(message, *AUTH),
        "has_network": mentions(message, *NETWORK),
    }


def anomaly_features(text: Column, at: Column | None = None) -> dict[str, Column]:
    """Eight numbers. With a time, the last is its hour and critical counts as an error word; else it tells of paths."""
    terms = [*ERROR] + ["critical"] * (at is not None)
    last = {"hour_of_day": F.hour(at)} if at is not None else {"has_path": text.rlike(r"/[\p{L}\p{N}_]+/").cast("int")}
    return {
        "message_length": F.length(text),
        "word_count": words(text),
        "digit_ratio": ratio(digits(text), text),
        "special_char_ratio": ratio(specials(text), text),
        "uppercase_ratio": ratio(uppers(text), text),
        "has_error_keyword": mentions(text, *terms).cast("int"),
        "has_ip_address": text.rlike(IP).cast("int"),
    } | last


def fingerprint(text: Column) -> tuple[Column, Column]:
    """SHA-256 in hex, and a preview of 200 characters."""
    return F.sha2(text, 256), F.left(text, F.lit(200))
