"""Aggregates over classified logs. All are partial before the shuffle; pivots have a fixed domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

CATEGORIES = values.CATEGORIES


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two aggregates of one row each as one row."""
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each group


def histogram(df: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative counts: rows at or below each bound, one row a group and bound."""
    sums = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)])
    cells = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)])
    return sums.select(*keys, F.inline(cells))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """A row for each true category (all four), a column for each predicted one, zero-filled."""
    counts = df.groupBy(true).pivot(predicted, list(CATEGORIES)).count().na.fill(0)
    rows = df.sparkSession.createDataFrame([(c,) for c in CATEGORIES], f"{true} string")
    return rows.join(counts, true, "left").na.fill(0)


def class_metrics(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each category, from one pass over the rows; undefined ratios are 0."""
    cells = [F.count_if((F.col(true) == c) & (F.col(predicted) == c)).alias(f"tp_{c}") for c in CATEGORIES]
    cells += [F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in CATEGORIES]
    cells += [F.count_if(F.col(true) == c).alias(f"true_{c}") for c in CATEGORIES]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"tp_{c}").alias("tp"), F.col(f"pred_{c}").alias("predicted"), F.col(f"true_{c}").alias("support")) for c in CATEGORIES])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = df.agg(*cells).select(F.inline(rows)).withColumns({"precision": zero(F.try_divide(F.col("tp"), F.col("predicted"))), "recall": zero(F.try_divide(F.col("tp"), F.col("support")))})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def gate(df: DataFrame, true: str, predicted: str, least_recall: float = 0.995, most_per_1000: float = 5.0) -> DataFrame:
    """Recall and precision of critical (1 if undefined), misses, misses in 1,000 logs, and whether both limits hold."""
    hit = lambda t, p: F.count_if((F.col(true) == "critical" if t else F.col(true) != "critical") & (F.col(predicted) == "critical" if p else F.col(predicted) != "critical"))
    sums = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fn"), hit(0, 1).alias("fp"), F.count("*").alias("total"))
    one = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(1.0))
    out = sums.withColumns({"recall": one("tp", "fn"), "precision": one("tp", "fp"), "fn_per_1000": F.coalesce(F.try_divide(F.col("fn") * 1000.0, F.col("total")), F.lit(0.0))})
    return out.withColumn("passed", (F.col("recall") >= least_recall) & (F.col("fn_per_1000") <= most_per_1000))


def noise_summary(df: DataFrame, at: str, message: str, key: str, *keys: Column | str) -> DataFrame:
    """Count, first and last time and a sample line (the earliest, by key among equals) of each group, e.g. template."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min_by(message, F.struct(at, key)).alias("sample_log"))


def outcomes(decisions: DataFrame, offenses: DataFrame) -> DataFrame:
    """Decisions with tp/tn/fp/fn against one outcome for each log_id; without an outcome they stay pending."""
    both = decisions.join(offenses.select("log_id", "offense_generated"), "log_id", "left")
    sure, sent = F.col("offense_generated"), F.col("category").isin("critical", "suspicious")
    return both.withColumn("outcome", F.when(sure.isNull(), "pending").when(sure & sent, "tp").when(sure, "fn").when(sent, "fp").otherwise("tn"))


def shadow(judged: DataFrame) -> DataFrame:
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    sums = judged.agg(*[count(x) for x in ("tp", "tn", "fp", "fn", "pending")])
    return sums.withColumns({"recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0)), "fnr": F.coalesce(F.try_divide(F.col("fn"), F.col("tp") + F.col("fn")), F.lit(0.0))})


def phases(stats: DataFrame, samples: str, fnr: str, recall: str, table: list | None = None) -> DataFrame:
    """For each phase: may it go on, and if not, which requirement fails first."""
    rows = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(n).alias("min_samples"), F.lit(f).alias("max_fnr"), F.lit(r).alias("min_recall")) for p, n, f, r in table or values.PHASES])
    out = stats.select(samples, fnr, recall, F.inline(rows))
    reason = F.when(F.col(samples) < F.col("min_samples"), "samples").when(F.col(fnr) > F.col("max_fnr"), "false_negative_rate").when(F.col(recall) < F.col("min_recall"), "critical_recall")
    return out.withColumns({"reason": reason, "ready": reason.isNull()}).select("phase", "ready", "reason")


def psi(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Population stability index between two distributions over the four categories (empty cells count as 1e-4)."""
    share = lambda df, name: df.agg(*[F.greatest(F.count_if(F.col(key) == c) / F.count("*"), F.lit(1e-4)).alias(f"{name}_{c}") for c in CATEGORIES])
    both = beside(share(expected, "e"), share(actual, "a"))
    terms = [(F.col(f"a_{c}") - F.col(f"e_{c}")) * F.log(F.col(f"a_{c}") / F.col(f"e_{c}")) for c in CATEGORIES]
    return both.select(sum(terms[1:], terms[0]).alias("psi")).withColumn("drifted", F.col("psi") > 0.1)
