"""Operators that must not depend on one task, one row or one group: names, running sums, runs."""

import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from logsluice.operators import contain, correlate, rollups, rows, windows
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_names_equal_the_nested_loop(spark, monkeypatch, few):
    monkeypatch.setattr(contain, "FEW", few)
    monkeypatch.setattr(contain, "ROWS", 7)
    rng = random.Random(1)
    a = ["", "ü", "東京", *{"".join(rng.choice("ab-") for _ in range(rng.randrange(12))) for _ in range(150)}]
    b = ["x" * 300 + "ab", "ü-1", *{"".join(rng.choice("ab-") for _ in range(rng.randrange(9))) for _ in range(150)}]
    frame = lambda names: spark.createDataFrame([(x,) for x in [*names, None]], "n string").repartition(4)
    found = sorted((r.left_name, r.right_name) for r in contain.containing(frame(a), frame(b)).collect())
    assert found == sorted((x, y) for x in set(a) for y in set(b) if x in y or y in x)
    assert contain.containing(frame([]), frame(b)).count() == 0


def test_a_name_of_100000_letters_and_many_names(spark):
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(100_000))
    wanted = spark.createDataFrame([(long, long), ("host 7", "host_7"), ("gone", "gone")], "log_source string, name string")
    known = spark.range(200_000).select(F.concat(F.lit("host_"), F.col("id").cast("string")).alias("source")).union(spark.createDataFrame([(long[5000:90_000],), (long[70:90],)], "source string"))
    began = time.time()
    found = sorted((r.log_source[:9], len(r.source), r.source[:6]) for r in correlate.containing(wanted, known.withColumn("low", F.lower("source"))).collect())
    inside = [r for r in found if r[0] == long[:9]]
    assert [r[1] for r in inside] == [20, 85_000]
    assert len(found) - 2 == sum(str(k).startswith("7") for k in range(200_000)) and time.time() - began < 120


def test_pairs_of_correlation_are_not_shuffled(spark):
    """Every log is in the window of every offense: what is shuffled grows with the logs and not with the pairs, which equal a nested loop's."""
    logs = [(k, "2024-01-01 12:00:00", ("web-1", "db", None)[k % 3], (f"10.0.0.{k % 7}", None)[k % 11 == 0], ("noise", "critical")[k % 5 == 0]) for k in range(200)]
    hits = [(k, "2024-01-01 12:02:00", 5 + k % 5, [f"10.0.0.{k % 9}", None], (["WEB 1", "web", "nope"], ["x-db", None], ["none"])[k % 3]) for k in range(30)]
    d = spark.createDataFrame(logs, "log_id long, event_ts string, source string, source_ip string, category string").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    o = spark.createDataFrame(hits, "offense_id long, start_time string, severity int, source_ips array<string>, log_sources array<string>").withColumn("start_time", F.col("start_time").cast("timestamp"))
    fits = lambda n, s: n is not None and s is not None and (s in (low := n.lower().replace(" ", "_")) or low in s)
    kind = lambda x, y: "ip_match" if x[3] and x[3] in y[3] else "source_match" if any(fits(n, x[2]) for n in y[4]) else "time_window" if y[2] >= 7 and x[4] == "noise" else None
    value = lambda s, y: 0.5 if s == "time_window" else {"ip_match": 0.4, "source_match": 0.3}[s] + 0.21 + y[2] * 0.02
    wanted = [(y[0], x[0], s, round(value(s, y), 6)) for x in logs for y in hits if (s := kind(x, y))]
    for least in (0.3, 0.5, 0.601):
        out = correlate.correlated(d, o, least)
        assert sorted((r.offense_id, r.log_id, r.strategy, round(r.score, 6)) for r in out.collect()) == sorted(w for w in wanted if w[3] >= least)
        assert not re.search(r"hashpartitioning\(offense_id#\d+L, log_id#", plan(out))
        assert ("time_window" in plan(out)) == (least <= 0.5)


def runs_of(failed):
    out, n = [], 0
    for f in failed:
        n = n + 1 if f else 0
        out.append((n, bool(f) and n >= 5))
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.97, 1.0])
def test_runs_of_failures_over_many_ranges(spark, share):
    rng = random.Random(3)
    failed = [rng.random() < share or None if rng.random() < 0.9 else False for _ in range(700)]
    rows = [(k, f) for k, f in enumerate(failed)]
    df = spark.createDataFrame(rows, "at int, failed boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.failure_runs(df, "at", "failed")
        assert "SinglePartition" not in plan(out)
        assert windows.ranged(df, "at").select("part").distinct().count() > 4
        assert [(r.failures, r.open) for r in out.orderBy("at").collect()] == runs_of(failed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert windows.failure_runs(df.limit(0), "at", "failed").count() == 0


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(9) if rng.random() < 0.9 else None, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "at int, n int, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.with_running_sum(df, F.col("n"), "at", "total")
        assert "SinglePartition" not in plan(out) and out.columns == ["at", "n", "x", "total"]
        so_far, expected = 0, []
        for _, n, _ in rows:
            so_far += n or 0
            expected.append(so_far)
        assert [r.total for r in out.orderBy("at").collect()] == expected
        assert windows.with_running_sum(df, F.col("x"), "at", "total").agg(F.max("total")).first()[0] == sum(range(500))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert windows.with_running_sum(df.limit(0), F.col("n"), "at", "total").count() == 0


def test_sketches_of_minutes_answer_for_any_span(spark):
    rng = np.random.default_rng(5)
    values, address = rng.gamma(2.0, 30.0, 60_000), rng.integers(0, 20_000, 60_000)
    k = np.arange(60_000)
    frame = pd.DataFrame({"at": k % 7200, "kind": k % 2, "x": values, "ip": address})
    rows = spark.createDataFrame(frame).withColumn("at", F.timestamp_seconds("at"))
    kept = rollups.minutes(rows, "at", "kind", value="x", distinct="ip")
    assert kept.count() == 240
    hours = rollups.united(kept, F.date_trunc("hour", "minute"), "kind")
    told = rollups.united(hours, None).select("n", "least", "most", rollups.distinct_count().alias("ips"), *[rollups.quantile(s).alias(f"q{k}") for k, s in enumerate((0.01, 0.5, 0.9, 0.99))], *[rollups.at_most(b).alias(f"h{b}") for b in (0, 50, 100, 9999)]).first()
    assert told.n == 60_000 and (told.least, told.most) == (values.min(), values.max())
    for k, s in enumerate((0.01, 0.5, 0.9, 0.99)):
        assert abs((values <= told[f"q{k}"]).mean() - s) <= rollups.RANK_ERROR
    assert abs(told.ips - len(set(address.tolist()))) <= rollups.DISTINCT_ERROR * 20_000
    assert told.h0 == 0 and told.h9999 == 60_000 and all(abs(told[f"h{b}"] / 60_000 - (values <= b).mean()) <= rollups.RANK_ERROR for b in (50, 100))
    # nulls, a group without values, an empty table
    odd = spark.createDataFrame([(None, 1, None, None), (None, 1, 3.0, "a"), (None, 2, None, None)], "at timestamp, kind int, x double, ip string")
    found = {r.kind: (r.n, r.q, r.h, r.ips) for r in rollups.united(rollups.minutes(odd, "at", "kind", value="x", distinct="ip"), None, "kind").select("kind", "n", rollups.quantile(0.5).alias("q"), rollups.at_most(5).alias("h"), rollups.distinct_count().alias("ips")).collect()}
    assert found == {1: (2, 3.0, 1, 1), 2: (1, None, 0, 0)}
    assert rollups.minutes(odd.limit(0), "at", value="x").count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_terms_of_three_words_equal_a_full_count(spark, monkeypatch, few):
    from collections import Counter

    monkeypatch.setattr(rows, "FEW", few)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)] + ["the"]
    texts = [(k, " ".join(rng.choices(words, [*range(1, 13), 30], k=rng.randrange(40)))) for k in range(60)] + [(60, None), (61, "x"), (62, "once only")]
    grams = {k: Counter(" ".join(w[i : i + n]) for w in [[x for x in (t or "").split() if len(x) > 1]] for n in (1, 2, 3) for i in range(len(w) - n + 1)) for k, t in texts}
    total, df = Counter(), Counter()
    for c in grams.values():
        total.update(c)
        df.update(c.keys())
    for most in (5, 40, 10_000):
        kept = sorted((t for t in df if 2 <= df[t] <= 0.95 * len(texts)), key=lambda t: (-total[t], t))[:most]
        found = rows.gram_scores(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text", most=most)
        got = {(r.doc_id, r.term): (r.tf, r.df, round(r.score, 9)) for r in found.collect()}
        assert got == {(k, t): (c[t], df[t], round((1 + np.log(c[t])) * (np.log((1 + len(texts)) / (1 + df[t])) + 1), 9)) for k, c in grams.items() for t in kept if t in c}


def test_terms_are_summed_before_the_shuffle(spark, monkeypatch):
    """What is kept of the terms does not grow with documents of the same words."""
    rng, write, sizes = random.Random(3), rows.kept_table, {}
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(150)]

    def counted(df, name):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(rows, "kept_table", counted)
    kept = []
    for copies in (1, 3):
        sizes.clear()
        docs = spark.createDataFrame([(1000 * c + k, t) for c in range(copies) for k, t in enumerate(texts)], "doc_id int, text string")
        assert rows.gram_scores(docs, "doc_id", "text", most=100).select("doc_id").distinct().count() == len(texts) * copies
        kept.append(sum(n for name, n in sizes.items() if name != "words"))
    assert kept[1] <= kept[0] * 1.1


def test_rows_of_one_key_are_one_document_of_terms(spark):
    rng = random.Random(5)
    words = ["Ärger", "été", "x", "東京", "a_b", "n1", "der", "im"]
    texts = [(rng.choice([None, 1, 1, 1, 2, 3, *range(4, 20)]), rng.choice(["-", " ", ", ", "\n\t"]).join(rng.choices(words, k=rng.randrange(25)))) for _ in range(70)]
    docs = spark.createDataFrame([*texts, (7, None), (90, ""), (None, "?")], "doc_id int, text string")
    for most in (6, 50):
        found, plain = (sorted((str(r.doc_id), r.term, r.tf, r.df, round(r.score, 9)) for r in f.collect()) for f in (rows.gram_scores(docs, "doc_id", "text", most=most), rows._joined_gram_scores(docs, "doc_id", "text", 3, most, 2, 0.95)))
        assert found == plain and len(found) > 20
    assert rows.gram_scores(docs.limit(0), "doc_id", "text").count() == 0
