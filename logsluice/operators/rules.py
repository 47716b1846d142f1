"""Rule matching: rule lists are plain data that become literal patterns in one CASE, compiled once for each task."""

from __future__ import annotations

import re
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

Rule = tuple[str, str, float, list[str]]


@lru_cache(4096)
def valid(pattern: str) -> bool:
    """Whether the engine that will run it takes the pattern: the JVM's."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def usable(rules: list[Rule]) -> list[Rule]:
    """The rules without patterns that are no valid regular expressions."""
    return [(c, n, conf, good) for c, n, conf, patterns in rules if (good := [p for p in patterns if valid(p)])]


def _plain(pattern: str) -> bool:
    return re.fullmatch(r"[\w \-/]+", pattern) is not None


def lowerable(patterns: list[str]) -> bool:
    """Whether case-blind matching is the same as matching the lower-cased text: no capital anywhere, so no class like \\S either."""
    return all(p == p.lower() for p in patterns)


def any_of(text: Column, patterns: list[str], ignore_case: bool = True, low: Column | None = None) -> Column:
    """Whether any pattern is found. Literals are looked for as such; the others become one regular expression.

    low: the lower-cased text, if there is a column of it already.
    """
    if not patterns:
        return F.lit(False)
    flag = ""
    if ignore_case and lowerable(patterns):
        text = low if low is not None else F.lower(text)
    elif ignore_case:
        flag = "(?i)"
    literal = [p for p in patterns if _plain(p) and not flag]
    other = [p for p in patterns if p not in literal]
    hits = [text.contains(p) for p in literal] + ([text.rlike(flag + "|".join(f"(?:{p})" for p in other))] if other else [])
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def with_rule(df: DataFrame, text: Column, rules: list[Rule] | None = None, priority: tuple[str, ...] = values.PRIORITY, default: tuple[str, float] = (values.DEFAULT_CATEGORY, values.DEFAULT_CONFIDENCE), ignore_case: bool = True, names: tuple[str, str, str] = ("category", "rule", "confidence")) -> DataFrame:
    """df with category, rule and confidence of the first rule that matches, categories in order of priority.

    The rule's place in the list is a column of its own, so that patterns are tried once. Null text, or none: the default.
    """
    ordered, at = [r for c in priority for r in usable(rules or values.RULES) if r[0] == c], None
    for k, (_, _, _, patterns) in enumerate(ordered):
        hit = any_of(text, patterns, ignore_case, F.col("_low"))
        at = F.when(hit, k) if at is None else at.when(hit, k)
    at = F.lit(len(ordered)) if at is None else at.otherwise(len(ordered))
    of = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("_rule"))
    out = df.withColumn("_low", F.lower(text)).withColumn("_rule", at)
    columns = of([*[r[0] for r in ordered], default[0]]), of([*[r[1] for r in ordered], None]).cast("string"), of([*[float(r[2]) for r in ordered], float(default[1])])
    return out.withColumns(dict(zip(names, columns))).drop("_rule", "_low")


def all_matches(logs: DataFrame, text: str, key: str, rules: list[Rule] | None = None) -> DataFrame:
    """A row (key, category, rule, confidence, matched) for every pattern that matches: its first matched text."""
    tries = [F.struct(F.lit(c).alias("category"), F.lit(n).alias("rule"), F.lit(float(x)).alias("confidence"), F.regexp_extract(F.col(text), f"(?i)({p})", 1).alias("matched"), F.col(text).rlike(f"(?i){p}").alias("hit")) for c, n, x, ps in usable(rules or values.RULES) for p in ps]
    return logs.select(key, F.inline(F.filter(F.array(*tries), lambda x: x["hit"]))).drop("hit")


def auto_labels(text: Column, labels: list | None = None) -> tuple[Column, Column]:
    """Weak label and its confidence: the first category with a matching pattern, else routine at 0.5."""
    low, label, confidence = F.lower(text), None, None
    for category, sure, patterns in labels or values.AUTO_LABELS:
        hit = any_of(low, patterns, False)
        label = F.when(hit, category) if label is None else label.when(hit, category)
        confidence = F.when(hit, F.lit(sure)) if confidence is None else confidence.when(hit, F.lit(sure))
    return label.otherwise("routine"), confidence.otherwise(F.lit(0.5))


def with_compliance(df: DataFrame, source: Column, message: Column, rules: list | None = None, enabled: bool = True, additional_sources: dict[str, list[str]] | None = None, name: str = "decision") -> DataFrame:
    """df with struct(is_regulated, matched_rules, frameworks, retention_days, must_forward, reason); arrays sorted and distinct.

    additional_sources: more source patterns by framework. A null source or message matches nothing. Which rules match is a
    column of its own first, so that patterns are tried once.
    """
    more, hits = additional_sources or {}, []
    every = [] if not enabled else (rules if rules is not None else values.COMPLIANCE_RULES)
    for _, f, _, s, m in every:
        hits.append(F.coalesce(any_of(source, [*s, *more.get(f, [])], low=F.col("_low_source")), F.lit(False)) | F.coalesce(any_of(message, m, low=F.col("_low")), F.lit(False)))
    one = lambda k: F.col("_hits")[k]
    listed = lambda i: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(one(k), r[i]) for k, r in enumerate(every)])))) if every else F.array().cast("array<string>")
    out = df.withColumns({"_low": F.lower(message), "_low_source": F.lower(source)}).withColumn("_hits", F.array(*hits).cast("array<boolean>")).withColumns({"_names": listed(0), "_frameworks": listed(1)})
    days = F.greatest(F.lit(0), *[F.when(one(k), r[2]).otherwise(0) for k, r in enumerate(every)]) if every else F.lit(0)
    regulated = F.array_contains("_hits", True) if every else F.lit(False)
    reason = F.when(regulated, F.concat(F.lit("Matched compliance rules: "), F.array_join("_names", ", "), F.lit(". Frameworks: "), F.array_join("_frameworks", ", ")))
    struct = F.struct(regulated.alias("is_regulated"), F.col("_names").alias("matched_rules"), F.col("_frameworks").alias("frameworks"), days.alias("retention_days"), regulated.alias("must_forward"), reason.alias("reason"))
    return out.withColumn(name, struct).drop("_hits", "_names", "_frameworks", "_low", "_low_source")


def by_framework(framework: str, rules: list | None = None) -> list:
    return [r for r in (rules if rules is not None else values.COMPLIANCE_RULES) if r[1] == framework]


def bypass(decision: Column) -> Column:
    """The prediction of a regulated log, which no model sees."""
    explanation = F.struct(decision["reason"].alias("bypass_reason"), decision["matched_rules"].alias("matched_rules"), decision["frameworks"].alias("frameworks"), decision["retention_days"].alias("minimum_retention_days"), F.lit(True).alias("ai_classification_skipped"))
    return F.when(decision["is_regulated"], F.struct(F.lit("critical").alias("category"), F.lit(1.0).alias("confidence"), F.lit("compliance_bypass").alias("model"), explanation.alias("explanation")))
