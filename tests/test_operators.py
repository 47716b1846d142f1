"""Literal cases, nulls and edges of the operators."""

import datetime as dt

import pytest
from logsluice.functions import parse, text, values
from logsluice.operators import correlate, cost, ensemble, leef, metrics, ml, registry, rows, rules, windows
from logsluice.sources import files, kafka
from pyspark.sql import functions as F

LINES = [
    "LEEF:2.0|V|P|1|LOGIN|src=10.0.0.1\tmsg=\"two words\"\tcat=x",
    "LEEF:1.0|V|P|1|EV|",
    "CEF:0|Sec|IDS|1|100|worm stopped|9|src=1.2.3.4 msg=SSH brute force",
    "<34>1 2024-01-05T10:00:00Z host app 12 ID1 [a=\"b\"] hello there",
    "<34>Oct 11 22:14:15 host su[230]: failed for lonvick",
    "Oct 11 22:14:15 host su: no priority",
    '{"msg": "from json", "n": 1}',
    '{"broken": ',
    "plain 2024-01-05 10:00:00 error from 10.0.0.1 to 10.0.0.2",
    "   ",
    None,
]


@pytest.fixture(scope="module")
def parsed(spark):
    logs = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "log_id int, raw_message string")
    return {r.log_id: r for r in parse.parsed(logs).collect()}


def test_formats(parsed):
    assert [parsed[k].format for k in range(11)] == ["leef", "leef", "cef", "syslog_rfc5424", "syslog_rfc3164", "syslog_rfc3164", "json", "generic", "generic", "empty", "empty"]
    assert [parsed[k].parsed_message for k in (0, 1, 2, 3, 4, 6, 9, 10)] == ["two words", "EV", "SSH", "hello there", "failed for lonvick", "from json", "", ""]
    assert parsed[0].as_leef.attributes == {"src": "10.0.0.1", "msg": "two words", "cat": "x"}
    assert (parsed[3].as_syslog_rfc5424.facility, parsed[3].as_syslog_rfc5424.syslog_severity) == (4, 2)
    assert parsed[4].as_syslog_rfc3164.pid == "230" and parsed[5].as_syslog_rfc3164.priority is None
    assert (parsed[8].as_generic.source_ip, parsed[8].as_generic.destination_ip, parsed[8].as_generic.level) == ("10.0.0.1", "10.0.0.2", "ERROR")


def test_last_of_equal_keys_counts(spark):
    assert spark.range(1).select(parse.pairs(F.lit('a=1 b="x y" a=2 c='))).first()[0] == {"a": "2", "b": "x y", "c": ""}


def test_normalised_text(spark):
    line = "On 2024-01-05T10:00:00.5Z 10.1.2.3 sent 0xFF to bob@mail.example, aa:bb:cc:dd:ee:ff /etc/passwd 1234567 https://h/p"
    found = spark.range(1).select(text.normalised(F.lit(line)), text.template(F.lit("a 10.0.0.1 12 x" + "y" * 300))).first()
    assert found[0] == "on <timestamp> <ip> sent <hex> to <email>, <mac> <path> <longnum> https:<path>"
    assert found[1].startswith("a <IP> <NUM> x") and len(found[1]) == 200


def test_rules(spark):
    cases = [("Malware detected", "critical", 0.95), ("Failed login for root", "suspicious", 0.75), ("health check ok", "noise", 0.9), ("nothing", "routine", 0.5), (None, "routine", 0.5)]
    out = rules.with_rule(spark.createDataFrame(cases, "m string, c string, x double"), F.col("m")).collect()
    assert all((r.category, r.confidence) == (r.c, r.x) for r in out)
    assert rules.usable([("critical", "bad", 0.5, ["(", "ok"]), ("noise", "worse", 0.5, ["["])]) == [("critical", "bad", 0.5, ["ok"])]
    only = rules.with_rule(spark.createDataFrame(cases, "m string, c string, x double"), F.col("m"), [("noise", "any", 0.7, ["a"])]).filter("rule = 'any'")
    assert only.count() == 3
    assert rules.all_matches(spark.createDataFrame([(1, "brute force malware")], "k int, m string"), "m", "k").count() == 2
    assert rules.all_matches(spark.createDataFrame([(1, None)], "k int, m string"), "m", "k").count() == 0


def test_compliance(spark):
    logs = spark.createDataFrame([("pci-gw", "x"), ("app", "patient_id 5"), ("sox-ledger", "y"), ("app", "plain"), (None, None)], "source string, message string")
    out = rules.with_compliance(logs, F.col("source"), F.col("message")).collect()
    assert [r.decision.is_regulated for r in out] == [True, True, True, False, False]
    assert [r.decision.retention_days for r in out] == [365, 2190, 2555, 0, 0]
    assert out[0].decision.reason == "Matched compliance rules: pci_payment_systems. Frameworks: pci_dss" and out[3].decision.reason is None
    off = rules.with_compliance(logs, F.col("source"), F.col("message"), enabled=False)
    assert off.filter("decision.is_regulated").count() == 0


def test_ensemble(spark):
    one = spark.range(1)
    rule = (F.lit("critical"), F.lit(0.88))
    models = {"rule_based": ensemble.spread(*rule), "text_model": {c: F.lit(0.9 if c == "noise" else 0.1 / 3) for c in values.CATEGORIES}}
    assert ensemble.with_weighted(one, models, rule).first().category == "critical"
    plain = ensemble.with_weighted(one, models, rule, by_sum=True).first()
    assert plain.category == "noise" and abs(sum(plain[f"p_{c}"] for c in values.CATEGORIES) - 1) < 1e-9
    out = one.select(*[c.alias(n) for n, c in ensemble.fail_open(F.lit(None).cast("string"), F.lit(None).cast("double"), "m", F.lit("why")).items()]).first()
    assert out.asDict() == {"category": "critical", "confidence": 0.0, "model": "fail_open", "fail_open_used": True, "reason": "why"}
    routed = ensemble.routes(spark.createDataFrame([("critical",), ("odd",), (None,)], "category string")).collect()
    assert sorted((str(r.category), r.destination, r.method) for r in routed) == [("None", "cold_storage", "queue"), ("critical", "cold_storage", "immediate"), ("critical", "qradar", "immediate"), ("odd", "cold_storage", "queue")]


def test_leef_is_escaped(spark):
    line = spark.range(1).select(leef.rich(F.lit("critical"), F.lit(0.951), F.lit("a\tb\nc" + "d" * 600), F.lit("id"), {"src": F.lit(None).cast("string")})).first()[0]
    assert line.split("\t")[4:6] == ["10", "id"] and "a\\tb\\nc" in line and "ai_confidence=0.95" in line and "src=" not in line and line.endswith("severity=10")


def test_shadow_counts(spark):
    cases = [(k, "critical", True) for k in range(10)] + [(100 + k, "routine", False) for k in range(80)] + [(200 + k, "suspicious", False) for k in range(5)] + [(300, "noise", True), (400, "noise", None)]
    decisions = spark.createDataFrame([c[:2] for c in cases], "log_id int, category string")
    known = spark.createDataFrame([(c[0], c[2]) for c in cases if c[2] is not None], "log_id int, offense_generated boolean")
    out = metrics.shadow(metrics.outcomes(decisions, known)).first()
    assert (out.tp, out.tn, out.fp, out.fn, out.pending) == (10, 80, 5, 1, 1) and abs(out.recall - 10 / 11) < 1e-12 and abs(out.fnr - 1 / 11) < 1e-12
    empty = metrics.shadow(metrics.outcomes(decisions.limit(0), known)).first()
    assert (empty.tp, empty.recall, empty.fnr) == (0, 1.0, 0.0)


def test_rates_and_charts(spark):
    s = spark.createDataFrame([(0, 100), (5, 100), (10, 100), (200, 7)], "at int, n int")
    assert [r[0] for r in s.select(windows.trailing_rate(s, "at", "n")).collect()] == [0.0, 40.0, 30.0, 0.0]
    series = spark.createDataFrame([("m", k, 1.0 if k < 39 else 50.0) for k in range(40)], "metric_name string, ts int, value double")
    out = {r.ts: r for r in windows.spc(series, 30, 3.0, 15).collect()}
    assert out[8].mean is None and out[12].mean == 1.0 and out[12].z == 0.0 and not out[38].is_anomaly and out[39].direction == "upper"
    runs = spark.createDataFrame([(k, k not in (0, 7)) for k in range(10)], "at int, failed boolean")
    assert [r["at"] for r in windows.failure_runs(runs, "at", "failed").filter("open").orderBy("at").collect()] == [5, 6]


def test_cost(spark):
    r = spark.createDataFrame([(20_000.0, 4_000.9), (15_000.0, 14_000.0), (10.0, 60_000.0), (0.0, 0.0)], "before double, after double")
    out = r.select(*[c.alias(n) for n, c in cost.savings(F.col("before"), F.col("after")).items()]).collect()
    assert [x.potential_tier for x in out] == ["basic", "standard", "premium", "basic"]
    assert [x.savings_annual for x in out] == [300_000, 30_000, -2_050_000, 300_000] and out[3].cost_per_event == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.log").write_text("one\n\n two\n")
    (tmp_path / "y.csv").write_text("Id,Content\n1,three\n2,\"four, five\"\n")
    found = {(r.message, r.source_file) for r in files.log_directory(spark, str(tmp_path)).collect()}
    assert found == {("one", "x.log"), (" two", "x.log"), ("three", "y.csv"), ("four, five", "y.csv")}
    (tmp_path / "bad.csv").write_text("message,label\nx,y\n")
    with pytest.raises(ValueError, match="category"):
        files.labelled_csv(spark, str(tmp_path / "bad.csv"))
    raw = spark.createDataFrame([('{"id": "5", "raw_message": "m"}', "t"), ("[1]", "t"), ("no", "t"), (None, "t")], "raw_message string, topic string")
    raw = raw.withColumns({"headers": F.create_map().cast("map<string,string>"), "timestamp": F.lit(dt.datetime(2024, 1, 1))})
    assert [(r.id, r.source, r.raw_message) for r in kafka.json_envelope(raw).collect()] == [("5", "t", "m")]
    assert kafka.bad_envelopes(raw).count() == 3


def test_rows_and_models(spark):
    df = spark.range(3000).withColumns({"label": F.when(F.col("id") % 10 == 0, "critical").otherwise("noise"), "x": F.col("id") % 7})
    shares = {(r.label, r.split): r["count"] for r in rows.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()}
    assert shares == {("noise", "train"): 2025, ("noise", "val"): 270, ("noise", "test"): 405, ("critical", "train"): 225, ("critical", "val"): 30, ("critical", "test"): 45}
    odd = rows.stratified_split(spark.createDataFrame([(1, "a"), (None, None), (2, None), (3, "b")], "id int, label string"), "id", "label")
    assert odd.count() == 4 and odd.filter("split IS NULL").count() == 0 and rows.stratified_split(odd.drop("split").limit(0), "id", "label").count() == 0
    assert [r.id for r in rows.seeded_sample(df.repartition(5), "id", 20).collect()] == [r.id for r in rows.seeded_sample(df.repartition(2), "id", 20).collect()]
    points = df.select("id", (F.sin(F.col("id")) + F.when(F.col("id") == 5, 40.0).otherwise(0.0)).alias("a"), F.cos(F.col("id") * 3).alias("b"))
    scored = ml.forest_scored(points, ml.isolation_forest(points, "id", ["a", "b"]), ["a", "b"])
    assert scored.orderBy("anomaly_score").first().id == 5
    assert "rules" in registry.names()
    with pytest.raises(KeyError):
        registry.classify(df, "none")


def test_forest_draws_rows_of_one_key_and_of_very_large_tables(spark):
    for n in (1_000, 300_000_000, 10**12):  # the mean number of trees that draw a row
        assert abs(sum(ml.draw_shares(n, 256, 200)) * n / (256 * 200) - 1) < 1e-6
    same = spark.range(5_000).selectExpr("1L AS id", "cast(id AS double) AS a")
    assert ml.isolation_forest(same, "id", ["a"], trees=30).count() == 30


def test_forest_is_the_same_under_any_partitioning(spark):
    import numpy as np

    df = spark.range(4_000).selectExpr("id", "cast(pmod(hash(id), 1000) AS double) AS a", "cast(pmod(hash(id, 1), 50) AS double) AS b")
    told = lambda n: sorted((r.tree, r.nodes) for r in ml.isolation_forest(df.repartition(n), "id", ["a", "b"], trees=25).collect())
    assert told(1) == told(16)
    # equal rows, a third of all, are one point of many copies
    same = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS id", "CASE WHEN id % 3 = 0 THEN 0D ELSE 1D + id END AS a")
    trees = ml.isolation_forest(same, "id", ["a"], trees=400, sample=100).collect()
    assert len(trees) == 400 and max(len(r.nodes) // 5 for r in trees) < 2 * 200
    heavy = [max(np.array(r.nodes).reshape(-1, 5)[:, 4]) for r in trees]
    assert 0 < sum(x > 13.5 for x in heavy) < 60  # a thousand copies came to some trees
    assert ml.isolation_forest(same.limit(0), "id", ["a"]).count() == 0


def test_forest_queries_grow_200_trees_and_cut_at_the_contamination(spark):
    from logsluice.plans import timed, views

    at = "/root/testdata/sf0.001"
    assert timed.isolation_forest_train(spark, at).count() == 200
    usual = views.logs(spark, at).filter("expected_category IN ('routine', 'noise')").select("log_id")
    found = timed.isolation_forest_score(spark, at).join(usual, "log_id").groupBy("category").count().collect()
    shares = {r["category"]: r["count"] / sum(x["count"] for x in found) for r in found}
    assert 0.02 < shares["suspicious"] <= 0.1


def test_quantiles_against_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(g, float(x)) for g, n in (("a", 5000), ("b", 7), ("c", 1), ("d", 900)) for x in (rng.normal(size=n) if g != "d" else rng.integers(0, 3, n))]
    df = spark.createDataFrame([*data, ("a", None), ("e", None)], "g string, x double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    for accuracy in (rows.ACCURACY, 500):  # small groups whole, and large ones by bounds
        monkeypatch.setattr(rows, "ACCURACY", accuracy)
        found = {(r.g, r.share): r.quantile for r in rows.quantiles(df, "x", shares, "g").collect()}
        assert len(found) == 4 * len(shares)
        for g in "abcd":
            for s in shares:
                assert abs(found[g, s] - np.quantile([x for k, x in data if k == g], s)) < 1e-9
        whole = [r.quantile for r in rows.quantiles(df, "x", [0.3]).collect()]
        assert abs(whole[0] - np.quantile([x for _, x in data], 0.3)) < 1e-9
        assert rows.tail_fraction(spark.range(1000), "id").count() == 200
    assert rows.quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_names_meet_by_substrings(spark):
    a = ["fire_wall", "ids", "", "a", "gateway_of_pci", "ü"]
    b = ["FIRE_WALL-01", "ids-sensor", "x", "pci", "AB", "ü-1", ""]
    wanted = spark.createDataFrame([(x, x) for x in a], "log_source string, name string")
    known = spark.createDataFrame([(x, x.lower()) for x in b], "source string, low string")
    found = sorted((r.log_source, r.source) for r in correlate.containing(wanted, known).collect())
    assert found == sorted((x, y) for x in a for y in b if x in y.lower() or y.lower() in x)


def test_correlation_against_a_nested_loop(spark):
    import random

    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(40_000))
    logs = [(k, at(), f"src-{rng.randrange(4)}", f"ip{rng.randrange(6)}", rng.choice(["routine", "noise", "critical"])) for k in range(300)]
    hits = [(k, at(), rng.randrange(1, 11), [f"ip{rng.randrange(6)}", f"ip{rng.randrange(6)}"], ["SRC-1"]) for k in range(20)]
    d = spark.createDataFrame(logs, "log_id int, event_ts timestamp, source string, source_ip string, category string")
    o = spark.createDataFrame(hits, "offense_id int, start_time timestamp, severity int, source_ips array<string>, log_sources array<string>")
    pairs = lambda df: sorted((r.offense_id, r.log_id) for r in df.collect())
    near = lambda x, y, before=60, after=5: -before * 60 <= (x[1] - y[1]).total_seconds() <= after * 60
    assert pairs(correlate.by_ip(d, o)) == sorted((y[0], x[0]) for x in logs for y in hits if x[3] in y[3] and near(x, y))
    assert pairs(correlate.by_ip(d, o, 24 * 60, 0)) == sorted((y[0], x[0]) for x in logs for y in hits if x[3] in y[3] and near(x, y, 1440, 0))
    assert pairs(correlate.by_source(d, o)) == sorted((y[0], x[0]) for x in logs for y in hits if x[2] == "src-1" and near(x, y))
    assert pairs(correlate.by_time(d, o)) == sorted((y[0], x[0]) for x in logs for y in hits if y[2] >= 7 and x[4] != "critical" and near(x, y))


def test_more_than_64_compliance_rules(spark):
    many = [(f"rule_{k:03d}", f"frame_{k % 3}", k, [f"^s{k}-"], []) for k in range(150)]
    logs = spark.createDataFrame([("s149-a", "x"), ("s63-b", None), ("s64-", "y"), ("none", "z")], "source string, message string")
    out = {r.source: r.decision for r in rules.with_compliance(logs, F.col("source"), F.col("message"), many).collect()}
    assert [out[k].matched_rules for k in ("s149-a", "s63-b", "s64-", "none")] == [["rule_149"], ["rule_063"], ["rule_064"], []]
    assert out["s149-a"].retention_days == 149 and not out["none"].is_regulated


def test_patterns_are_tried_by_the_engine_that_runs_them(spark):
    assert rules.valid(r"\p{Lu}++x") and not rules.valid("(?P<name>x)") and not rules.valid("[")


class StandIn:
    """Records what a reader or writer was told; any call returns it."""

    def __init__(self):
        self.said = {}

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.said.setdefault(name, []).append((args, kwargs))
            return self

        return call


def test_kafka_options(spark):
    reader, writer = StandIn(), StandIn()
    fake = type("Session", (), {"readStream": reader})
    kafka.log_source(fake, "broker:9092", "raw-logs", "earliest", 256, **{"kafka.security.protocol": "SSL"})
    assert reader.said["format"] == [(("kafka",), {})] and "load" in reader.said
    assert reader.said["options"][0][1] == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "raw-logs", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "256", "includeHeaders": "true", "failOnDataLoss": "false", "kafka.security.protocol": "SSL"}
    kafka.write(type("Records", (), {"write": writer}), "broker:9092", **{"kafka.linger.ms": "5"})
    assert writer.said["options"][0][1] == {"kafka.bootstrap.servers": "broker:9092", "kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.enable.idempotence": "true", "includeHeaders": "true", "kafka.linger.ms": "5"} and "save" in writer.said
    kafka.write_stream(type("Records", (), {"writeStream": writer}), "broker:9092", "/shared/state")
    assert writer.said["option"] == [(("checkpointLocation", "/shared/state"), {})] and "start" in writer.said


def test_kafka_records_and_their_headers_come_back(spark):
    logs = spark.createDataFrame([(1, "a", "r1"), (2, None, None)], "log_id int, source string, rule string")
    out = kafka.as_records(logs, "classified", "source", {"schema": "1", "rule": F.col("rule")})
    assert [(r.topic, r.key, r.value, [(h.key, bytes(h.value)) for h in r.headers]) for r in out.collect()] == [
        ("classified", "a", '{"log_id":1,"source":"a","rule":"r1"}', [("schema", b"1"), ("rule", b"r1")]),
        ("classified", None, '{"log_id":2}', [("schema", b"1")]),
    ]
    back = kafka.raw_envelope(out.withColumns({"value": F.col("value").cast("binary"), "partition": F.lit(0), "offset": F.lit(5), "timestamp_ms": F.lit(0)}))
    assert [r.headers for r in back.collect()] == [{"schema": "1", "rule": "r1"}, {"schema": "1"}]
    assert kafka.as_records(logs, "t").first().headers == []


def test_boosted_trees_have_their_full_size_and_stop_on_validation(spark):
    from logsluice.plans import timed

    at = "/root/testdata/sf0.001"
    logs, model = timed._trained(spark, at)
    assert timed._trained(spark, at)[1] is model
    one = model.stages[-1]
    trees = [m.getNumTrees for m in one.models]
    assert len(trees) == 4 and all(20 < n < 200 for n in trees) and max(t.depth for m in one.models for t in m.trees) <= 6
    params = one.models[0].extractParamMap()
    assert {p.name: v for p, v in params.items() if p.name in ("maxDepth", "stepSize", "maxIter")} == {"maxDepth": 6, "stepSize": 0.1, "maxIter": 200}
    scored = ml.scored(model, logs.filter("split = 'test'"))
    sums = scored.agg(F.max(F.abs(sum(F.col(f"p_{c}") for c in ml.LABELS) - 1)), F.min("confidence"), F.avg((F.col("category") == F.col("expected_category")).cast("double"))).first()
    assert sums[0] < 1e-9 and sums[1] > 0.25 and sums[2] >= 0.95
    terms = timed.feature_importance_topk(spark, at).collect()
    assert 0 < len(terms) <= 50 and [r.importance for r in terms] == sorted((r.importance for r in terms), reverse=True)
