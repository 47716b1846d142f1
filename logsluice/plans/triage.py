"""Queries: rules, compliance, ensemble, routing, aggregates, rows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import ensemble, metrics, rows, rules
from ..sources import files
from . import views
from .book import Book, decided, on_logs, on_scored

book = Book()
CATS = values.CATEGORIES
SIX = lambda c: F.round(c, 6)


@book.query("rule_classify", on_logs("SELECT log_id, category, rule, confidence FROM decisions", decided()))
def rule_classify(spark, sf):
    return views.decisions(spark, sf).select("log_id", "category", "rule", "confidence")


_EVERY = " UNION ALL ".join(f"SELECT log_id, '{c}' AS category, '{n}' AS rule, CAST({x} AS DOUBLE) AS confidence, regexp_extract(message, '({p})', 1, 'i') AS matched FROM logs WHERE regexp_matches(message, '{p}', 'i')" for c, n, x, ps in values.RULES for p in ps)


@book.query("rule_match_all", on_logs(_EVERY))
def rule_match_all(spark, sf):
    return rules.all_matches(views.logs(spark, sf), "message", "log_id")


def _hit(rule) -> str:
    name, _, _, source, message = rule
    parts = [f"regexp_matches(source, '{'|'.join(source)}', 'i')"] + ([f"regexp_matches(message, '{'|'.join(message)}', 'i')"] if message else [])
    return "(" + " OR ".join(parts) + ")"


_CHECK = "checked AS (SELECT *, list_sort(list_filter([" + ", ".join(f"CASE WHEN {_hit(r)} THEN '{r[0]}' END" for r in values.COMPLIANCE_RULES) + "], lambda x: x IS NOT NULL)) AS rules, list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_hit(r)} THEN '{r[1]}' END" for r in values.COMPLIANCE_RULES) + "], lambda x: x IS NOT NULL))) AS frameworks, greatest(0, " + ", ".join(f"CASE WHEN {_hit(r)} THEN {r[2]} ELSE 0 END" for r in values.COMPLIANCE_RULES) + ") AS days FROM logs)"


def checked(spark, sf):
    return rules.with_compliance(views.logs(spark, sf), F.col("source"), F.col("message"), name="d")


@book.query("compliance_check", on_logs("SELECT log_id, len(rules) > 0 AS is_regulated, array_to_string(rules, ',') AS matched_rules, array_to_string(frameworks, ',') AS frameworks, days AS retention_days, CASE WHEN len(rules) > 0 THEN 'Matched compliance rules: ' || array_to_string(rules, ', ') || '. Frameworks: ' || array_to_string(frameworks, ', ') END AS reason FROM checked", _CHECK))
def compliance_check(spark, sf):
    return checked(spark, sf).select("log_id", "d.is_regulated", F.array_join("d.matched_rules", ",").alias("matched_rules"), F.array_join("d.frameworks", ",").alias("frameworks"), "d.retention_days", "d.reason")


@book.query("compliance_custom_rules", on_logs("SELECT log_id, source LIKE 'load-%' OR message ILIKE '%traffic%' AS custom, source LIKE 'ids-%' OR " + _hit(values.COMPLIANCE_RULES[4]) + " AS gdpr FROM logs"))
def compliance_custom_rules(spark, sf):
    custom = [("own", "internal", 30, [r"^load-"], [r"traffic"])]
    out = rules.with_compliance(views.logs(spark, sf), F.col("source"), F.col("message"), custom, name="own")
    out = rules.with_compliance(out, F.col("source"), F.col("message"), rules.by_framework("gdpr"), additional_sources={"gdpr": [r"^ids-"]}, name="law")
    return out.select("log_id", F.col("own.is_regulated").alias("custom"), F.col("law.is_regulated").alias("gdpr"))


@book.query("compliance_split", on_logs("SELECT len(rules) > 0 AS regulated, count(*) AS n, sum(log_id) AS ids FROM checked GROUP BY 1", _CHECK))
def compliance_split(spark, sf):
    return checked(spark, sf).groupBy(F.col("d.is_regulated").alias("regulated")).agg(F.count("*").alias("n"), F.sum("log_id").alias("ids"))


@book.query("compliance_bypass_prediction", on_logs("SELECT log_id, 'critical' AS category, 1.0 AS confidence, 'compliance_bypass' AS model, days AS minimum_retention_days, true AS skipped FROM checked WHERE len(rules) > 0", _CHECK))
def compliance_bypass_prediction(spark, sf):
    out = checked(spark, sf).withColumn("p", rules.bypass(F.col("d"))).filter("p IS NOT NULL")
    return out.select("log_id", "p.category", "p.confidence", "p.model", "p.explanation.minimum_retention_days", F.col("p.explanation.ai_classification_skipped").alias("skipped"))


_AUTO = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{'|'.join(ps)}') THEN {{{k}}}" for k, (_, _, ps) in enumerate(values.AUTO_LABELS))


@book.query("auto_label", on_logs("SELECT log_id, " + _AUTO.format(*[f"'{c}'" for c, _, _ in values.AUTO_LABELS]) + " ELSE 'routine' END AS category, CAST(" + _AUTO.format(*[x for _, x, _ in values.AUTO_LABELS]) + " ELSE 0.5 END AS DOUBLE) AS label_confidence FROM logs"))
def auto_label(spark, sf):
    label, sure = rules.auto_labels(F.col("message"))
    return views.logs(spark, sf).select("log_id", label.alias("category"), sure.alias("label_confidence"))


# ensemble, on given model scores
def scored(spark, sf):
    return rules.with_rule(views.scored(spark, sf), F.col("message"), names=("rule_category", "rule_name", "rule_confidence"))


def _models():
    c = F.col
    return {"rule_based": ensemble.spread(c("rule_category"), c("rule_confidence")), "text_model": {k: c(f"text_p_{k}") for k in CATS}, "anomaly": ensemble.spread(c("anomaly_category"), c("anomaly_confidence"))}


_RULED = decided().replace("FROM logs)", "FROM scored)")
_MIX = "mix AS (SELECT *, " + ", ".join(f"0.30 * (CASE WHEN category = '{c}' THEN confidence ELSE (1 - confidence) / 3 END) + 0.45 * text_p_{c} + 0.25 * (CASE WHEN anomaly_category = '{c}' THEN anomaly_confidence ELSE (1 - anomaly_confidence) / 3 END) AS s_{c}" for c in CATS) + " FROM decisions)"
_PICK = "CASE greatest(s_critical, s_suspicious, s_routine, s_noise) WHEN s_critical THEN 'critical' WHEN s_suspicious THEN 'suspicious' WHEN s_routine THEN 'routine' ELSE 'noise' END"
_TOP = "greatest(s_critical, s_suspicious, s_routine, s_noise)"


def _combined(total: str, limit: float) -> str:
    return on_scored(f"SELECT log_id, CASE WHEN category = 'critical' AND confidence > {limit} THEN 'critical' ELSE {_PICK} END AS category, round(CASE WHEN category = 'critical' AND confidence > {limit} THEN confidence ELSE {_TOP} / {total} END + 1e-9, 6) AS confidence, round(s_noise / {total} + 1e-9, 6) AS p_noise FROM mix", _RULED, _MIX)


@book.query("combine_weighted", _combined("1.0", 0.85))
def combine_weighted(spark, sf):
    out = ensemble.with_weighted(scored(spark, sf), _models(), (F.col("rule_category"), F.col("rule_confidence")))
    return out.select("log_id", "category", SIX(F.col("confidence") + 1e-9).alias("confidence"), SIX(F.col("p_noise") + 1e-9).alias("p_noise"))


@book.query("combine_weighted_sum", _combined("(s_critical + s_suspicious + s_routine + s_noise)", 0.9))
def combine_weighted_sum(spark, sf):
    out = ensemble.with_weighted(scored(spark, sf), _models(), (F.col("rule_category"), F.col("rule_confidence")), by_sum=True)
    return out.select("log_id", "category", SIX(F.col("confidence") + 1e-9).alias("confidence"), SIX(F.col("p_noise") + 1e-9).alias("p_noise"))


_VOTES = "mix AS (SELECT log_id, " + ", ".join(f"(CASE WHEN category = '{c}' THEN 0.30 ELSE 0 END) + (CASE WHEN text_category = '{c}' THEN 0.45 ELSE 0 END) + (CASE WHEN anomaly_category = '{c}' THEN 0.25 ELSE 0 END) AS s_{c}" for c in CATS) + " FROM decisions)"


@book.query("combine_max_voting", on_scored(f"SELECT log_id, {_PICK} AS category, round(CAST({_TOP} AS DOUBLE), 6) AS confidence FROM mix", _RULED, _VOTES))
def combine_max_voting(spark, sf):
    out = ensemble.voted({"rule_based": F.col("rule_category"), "text_model": F.col("text_category"), "anomaly": F.col("anomaly_category")})
    return scored(spark, sf).select("log_id", out["category"].alias("category"), SIX(out["confidence"]).alias("confidence"))


@book.query("model_failure_default", on_scored("SELECT log_id, CASE WHEN log_id % 9 = 0 THEN 'routine' ELSE text_category END AS category, round(CASE WHEN log_id % 9 = 0 THEN 0.5 ELSE CAST(text_confidence AS DOUBLE) END, 6) AS confidence FROM scored"))
def model_failure_default(spark, sf):
    ok = F.col("log_id") % 9 != 0
    category, confidence = ensemble.or_default(F.when(ok, F.col("text_category")), F.when(ok, F.col("text_confidence")))
    return views.scored(spark, sf).select("log_id", category.alias("category"), SIX(confidence.cast("double")).alias("confidence"))


@book.query("fail_open_prediction", on_scored("SELECT coalesce(CASE WHEN log_id % 9 = 0 THEN 'fail_open' END, 'text_model') AS model, CASE WHEN log_id % 9 = 0 THEN 'timeout' END AS reason, CASE WHEN log_id % 9 = 0 THEN 'critical' ELSE text_category END AS category, count(*) AS n, round(sum(CASE WHEN log_id % 9 = 0 THEN 0 ELSE CAST(text_confidence AS DOUBLE) END), 4) AS confidence FROM scored GROUP BY ALL"))
def fail_open_prediction(spark, sf):
    out = ensemble.fail_open(F.when(F.col("log_id") % 9 != 0, F.col("text_category")), F.col("text_confidence").cast("double"), "text_model", F.lit("timeout"))
    named = views.scored(spark, sf).select(*[c.alias(k) for k, c in out.items()])
    return named.groupBy("model", "reason", "category").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@book.query("forward_flag", on_logs("SELECT log_id, category IN ('critical', 'suspicious') AS forwarded FROM decisions", decided()))
def forward_flag(spark, sf):
    return views.decisions(spark, sf).select("log_id", ensemble.forwarded(F.col("category")).alias("forwarded"))


_ROUTES = "routes AS (SELECT * FROM (VALUES ('critical', 'immediate', 'qradar', 1), ('critical', 'immediate', 'cold_storage', 1), ('suspicious', 'queue', 'qradar', 100), ('suspicious', 'queue', 'cold_storage', 100), ('routine', 'queue', 'cold_storage', 500), ('noise', 'queue', 'summary', 1000), ('noise', 'queue', 'cold_storage', 1000)) r(category, method, destination, batch_size))"


@book.query("route_explode", on_logs("SELECT log_id, category, method, destination, batch_size FROM decisions JOIN routes USING (category)", decided(), _ROUTES))
def route_explode(spark, sf):
    return ensemble.routes(views.decisions(spark, sf).select("log_id", "category")).select("log_id", "category", "method", "destination", "batch_size")


#: Compliance on the parsed text of decided logs.
CHECKED = _CHECK.replace("FROM logs)", "FROM decisions)").replace("message", "parsed")
_END = "ended AS (SELECT m.log_id, CASE m.log_id % 6 WHEN 0 THEN 'leef' WHEN 1 THEN 'cef' WHEN 2 THEN 'syslog_rfc5424' WHEN 3 THEN 'syslog_rfc3164' WHEN 4 THEN 'json' ELSE 'generic' END AS format, source, parsed AS parsed_message, " + f"CASE WHEN len(rules) > 0 THEN 'critical' WHEN m.category = 'critical' AND confidence > 0.85 THEN 'critical' ELSE {_PICK} END AS category, round(CASE WHEN len(rules) > 0 THEN 1.0 WHEN m.category = 'critical' AND confidence > 0.85 THEN confidence ELSE {_TOP} END + 1e-9, 6) AS confidence, CASE WHEN len(rules) > 0 THEN 'compliance_bypass' ELSE 'ensemble' END AS model, days AS retention_days FROM mix m)"


@book.query("end_to_end_triage", on_scored("SELECT ended.*, destination, method FROM ended JOIN routes USING (category)", _RULED.replace("'message'", "parsed").replace("(message,", "(parsed,").replace("FROM scored)", "FROM (SELECT *, CASE WHEN log_id % 6 = 5 THEN raw_message ELSE message END AS parsed FROM scored))"), CHECKED, _MIX.replace("FROM decisions)", "FROM checked)"), _ROUTES, _END))
def end_to_end_triage(spark, sf):
    return ensemble.triage(views.scored(spark, sf)).withColumn("confidence", SIX(F.col("confidence") + 1e-9))


@book.query("register_classifier", on_logs("SELECT 'rules' AS classifier, category, count(*) AS n FROM decisions GROUP BY ALL UNION ALL SELECT 'weak', " + _AUTO.format(*[f"'{c}'" for c, _, _ in values.AUTO_LABELS]) + " ELSE 'routine' END, count(*) FROM logs GROUP BY ALL", decided()))
def register_classifier(spark, sf):
    from ..operators import registry as classifiers

    logs, out = views.logs(spark, sf), None
    for name in ("rules", "weak"):
        one = classifiers.classify(logs, name).groupBy("category").agg(F.count("*").alias("n")).select(F.lit(name).alias("classifier"), "category", "n")
        out = one if out is None else out.unionByName(one)
    return out


# aggregates
@book.query("category_distribution", on_logs("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM decisions GROUP BY 1", decided()))
def category_distribution(spark, sf):
    return metrics.distribution(views.decisions(spark, sf), "category").withColumn("share", SIX(F.col("share")))


@book.query("processed_counts", on_logs("SELECT source, category, coalesce(rule, 'default') AS model, count(*) AS n FROM decisions GROUP BY ALL", decided()))
def processed_counts(spark, sf):
    return views.decisions(spark, sf).groupBy("source", "category", F.coalesce("rule", F.lit("default")).alias("model")).agg(F.count("*").alias("n"))


@book.query("filtered_counts", on_logs("SELECT category, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS reason, count(*) AS n FROM decisions WHERE category NOT IN ('critical', 'suspicious') GROUP BY ALL", decided()))
def filtered_counts(spark, sf):
    return views.decisions(spark, sf).filter(~ensemble.forwarded(F.col("category"))).groupBy("category", F.when(F.col("rule").isNull(), "default").otherwise("rule").alias("reason")).agg(F.count("*").alias("n"))


@book.query("model_prediction_counts", on_scored("SELECT model, category, count(*) AS n FROM (SELECT 'rule_based' AS model, category FROM decisions UNION ALL SELECT 'text_model', text_category FROM scored UNION ALL SELECT 'anomaly', anomaly_category FROM scored) GROUP BY ALL", _RULED))
def model_prediction_counts(spark, sf):
    wide = scored(spark, sf).select(F.col("rule_category").alias("rule_based"), F.col("text_category").alias("text_model"), F.col("anomaly_category").alias("anomaly"))
    return wide.unpivot([], ["rule_based", "text_model", "anomaly"], "model", "category").groupBy("model", "category").agg(F.count("*").alias("n"))


@book.query("compliance_stats", on_logs("SELECT f AS framework, count(*) AS bypassed, (SELECT count(*) FROM logs) AS checked, round(100.0 * count(*) / (SELECT count(*) FROM logs), 2) AS percent FROM (SELECT unnest(frameworks) AS f FROM checked) GROUP BY 1 UNION ALL SELECT 'any', count(*) FILTER (len(rules) > 0), count(*), round(100.0 * count(*) FILTER (len(rules) > 0) / count(*), 2) FROM checked", _CHECK))
def compliance_stats(spark, sf):
    rows_ = checked(spark, sf).select(F.explode(F.concat(F.array(F.lit("all")), F.when(F.col("d.is_regulated"), F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")), F.col("d.frameworks"))).alias("framework"))
    counts = rows_.groupBy("framework").agg(F.count("*").alias("bypassed"))
    from pyspark.sql import Window

    total = F.max(F.when(F.col("framework") == "all", F.col("bypassed"))).over(Window.partitionBy())
    return counts.withColumn("checked", total).withColumn("percent", F.round(100.0 * F.col("bypassed") / F.col("checked"), 2)).filter("framework <> 'all'")


@book.query("compliance_bypass_pairs", on_logs("SELECT f AS framework, r AS rule, count(*) AS n FROM (SELECT log_id, rules, unnest(frameworks) AS f FROM checked) c, unnest(c.rules) u(r) GROUP BY ALL", _CHECK))
def compliance_bypass_pairs(spark, sf):
    one = checked(spark, sf).select(F.explode("d.frameworks").alias("framework"), F.col("d.matched_rules").alias("r"))
    return one.select("framework", F.explode("r").alias("rule")).groupBy("framework", "rule").agg(F.count("*").alias("n"))


@book.query("confidence_histogram", on_logs("SELECT category, CAST(bound AS DOUBLE) AS bound, count(*) FILTER (confidence <= bound) AS n FROM decisions, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS bound) GROUP BY ALL", decided()))
def confidence_histogram(spark, sf):
    return metrics.histogram(views.decisions(spark, sf), "confidence", values.CONFIDENCE_BOUNDS, "category")


@book.query("latency_histogram", "SELECT event_type, CAST(bound AS DOUBLE) AS bound, count(*) FILTER (value <= bound) AS n FROM events, (SELECT unnest([1.0, 5, 10, 25, 50, 100, 250, 500]) AS bound) GROUP BY ALL")
def latency_histogram(spark, sf):
    return metrics.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", values.LATENCY_BOUNDS, "event_type")


@book.query("batch_size_bucket", on_logs("SELECT bucket, count(*) AS batches, sum(n) AS logs FROM (SELECT n, CASE WHEN n < 50 THEN 'small' WHEN n < 200 THEN 'medium' ELSE 'large' END AS bucket FROM (SELECT hour(event_ts) AS h, source, count(*) AS n FROM logs GROUP BY ALL)) GROUP BY 1"))
def batch_size_bucket(spark, sf):
    n = views.logs(spark, sf).groupBy(F.hour("event_ts").alias("h"), "source").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") < 50, "small").when(F.col("n") < 200, "medium").otherwise("large")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("batches"), F.sum("n").alias("logs"))


@book.query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    p = rows.quantiles(events, "value", [0.5, 0.95, 0.99], "event_type").groupBy("event_type").agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    out = events.groupBy("event_type").agg(F.max("value").alias("most"), F.avg("value").alias("mean")).join(p, "event_type")
    return out.select("event_type", *[SIX(F.col(c)).alias(c) for c in ("p50", "p95", "p99", "most", "mean")])


@book.query("confusion_matrix", on_logs("SELECT c AS expected_category, " + ", ".join(f"count(*) FILTER (expected_category = c AND category = '{c}') AS {c}" for c in CATS) + " FROM decisions, (SELECT unnest(['critical', 'suspicious', 'routine', 'noise']) AS c) GROUP BY 1", decided()))
def confusion_matrix(spark, sf):
    return metrics.confusion(views.decisions(spark, sf), "expected_category", "category")


_CLASS = "class AS (SELECT c AS category, count(*) FILTER (expected_category = c AND category = c) AS tp, count(*) FILTER (category = c) AS predicted, count(*) FILTER (expected_category = c) AS support FROM decisions, (SELECT unnest(['critical', 'suspicious', 'routine', 'noise']) AS c) GROUP BY 1), scores AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f1 FROM class)"


@book.query("class_metrics", on_logs("SELECT category, tp, predicted, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores", decided(), _CLASS))
def class_metrics(spark, sf):
    out = metrics.class_metrics(views.decisions(spark, sf), "expected_category", "category")
    return out.withColumns({c: SIX(F.col(c)) for c in ("precision", "recall", "f1")})


@book.query("overall_metrics", on_logs("SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM scores", decided(), _CLASS))
def overall_metrics(spark, sf):
    out = metrics.overall(metrics.class_metrics(views.decisions(spark, sf), "expected_category", "category"))
    return out.select(*[SIX(F.col(c)).alias(c) for c in out.columns])


@book.query("promotion_gate", on_logs("SELECT recall >= 0.99 AS passed, accuracy < 0.9 AS warned FROM (SELECT max(recall) FILTER (category = 'critical') AS recall, sum(tp) / sum(support) AS accuracy FROM scores)", decided(), _CLASS))
def promotion_gate(spark, sf):
    out = metrics.class_metrics(views.decisions(spark, sf), "expected_category", "category")
    return out.agg((F.max(F.when(F.col("category") == "critical", F.col("recall"))) >= 0.99).alias("passed"), (F.sum("tp") / F.sum("support") < 0.9).alias("warned"))


@book.query("confidence_stats", on_logs("SELECT round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, min(confidence) AS least, max(confidence) AS most FROM decisions", decided()))
def confidence_stats(spark, sf):
    return views.decisions(spark, sf).agg(SIX(F.avg("confidence")).alias("mean"), SIX(F.stddev_pop("confidence")).alias("std"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


_GATE = "SELECT tp, fn, fp, total, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fn * 1000.0 / total, 6) AS fn_per_1000, tp / (tp + fn) >= 0.995 AND fn * 1000.0 / total <= 5 AS passed FROM (SELECT count(*) FILTER (expected_category = 'critical' AND category = 'critical') AS tp, count(*) FILTER (expected_category = 'critical' AND category <> 'critical') AS fn, count(*) FILTER (expected_category <> 'critical' AND category = 'critical') AS fp, count(*) AS total FROM decisions)"


def _gate(spark, sf):
    out = metrics.gate(views.decisions(spark, sf), "expected_category", "category")
    return out.withColumns({c: SIX(F.col(c)) for c in ("recall", "precision", "fn_per_1000")})


@book.query("critical_gate", on_logs(_GATE, decided()))
def critical_gate(spark, sf):
    return _gate(spark, sf)


@book.query("critical_recall_gauge", on_logs(f"SELECT recall, precision FROM ({_GATE})", decided()))
def critical_recall_gauge(spark, sf):
    return _gate(spark, sf).select("recall", "precision")


_TEMPLATE = r"left(regexp_replace(regexp_replace(message, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'), '\b\d+\b', '<NUM>', 'g'), 200)"


@book.query("noise_summary", on_logs(f"SELECT {_TEMPLATE} AS template, count(*) AS n, CAST(floor(epoch(min(event_ts))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(event_ts))) AS BIGINT) AS last_seen, arg_min(message, log_id) AS sample_log FROM logs WHERE expected_category = 'noise' GROUP BY 1"))
def noise_summary(spark, sf):
    out = metrics.noise_summary(views.logs(spark, sf).filter("expected_category = 'noise'"), "event_ts", "message", "log_id", text.template(F.col("message")).alias("template"))
    return out.withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


@book.query("stream_noise_summary", on_logs(f"SELECT CAST(floor(epoch(date_trunc('hour', event_ts))) AS BIGINT) AS hour, {_TEMPLATE} AS template, count(*) AS n FROM logs WHERE expected_category = 'noise' GROUP BY ALL"))
def stream_noise_summary(spark, sf):
    from ..streaming import jobs

    return jobs.finished(jobs.noise_summary(jobs.replayed(views.logs(spark, sf))), "noise").select(F.unix_timestamp("hour").alias("hour"), "template", "n")


@book.query("eps_reduction", on_logs("SELECT round(count(*) FILTER (category NOT IN ('critical', 'suspicious')) / count(*), 6) AS reduction FROM decisions", decided()))
def eps_reduction(spark, sf):
    return views.decisions(spark, sf).agg(SIX(F.try_divide(F.count_if(~ensemble.forwarded(F.col("category"))), F.count("*"))).alias("reduction"))


# rows and sets
#: Within each class, rows in the order of a hash: three quarters to train on, a tenth to stop by, the rest to test.
SPLIT = "split AS (SELECT log_id, expected_category, CASE WHEN k <= floor(0.75 * n + 1e-9) THEN 'train' WHEN k <= floor(0.85 * n + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (SELECT log_id, expected_category, row_number() OVER (PARTITION BY expected_category ORDER BY left(md5(log_id || '|42'), 15)) AS k, count(*) OVER (PARTITION BY expected_category) AS n FROM logs))"


@book.query("dataset_stats", on_logs("SELECT split, expected_category, count(*) AS n FROM split GROUP BY CUBE (split, expected_category)", SPLIT))
def dataset_stats(spark, sf):
    return rows.stratified_split(views.logs(spark, sf), "log_id", "expected_category").cube("split", "expected_category").agg(F.count("*").alias("n"))


@book.query("stratified_split", on_logs("SELECT log_id, split FROM split", SPLIT))
def stratified_split(spark, sf):
    return rows.stratified_split(views.logs(spark, sf), "log_id", "expected_category").select("log_id", "split")


@book.query("class_weights", on_logs("SELECT expected_category, count(*) AS n, round((SELECT count(*) FROM logs) / (4.0 * count(*)), 6) AS weight FROM logs GROUP BY 1"))
def class_weights(spark, sf):
    return rows.class_weights(views.logs(spark, sf), "expected_category").withColumn("weight", SIX(F.col("weight")))


@book.query("label_index", on_logs("SELECT log_id, CAST(CASE expected_category WHEN 'critical' THEN 0 WHEN 'noise' THEN 1 WHEN 'routine' THEN 2 ELSE 3 END AS DOUBLE) AS label, CASE WHEN log_id % 13 = 0 THEN 'routine' ELSE expected_category END AS decoded FROM logs"))
def label_index(spark, sf):
    from ..operators import ml

    indexed = ml.label_indexed(views.logs(spark, sf), "expected_category", "label")
    back = ml.label_decoded(F.when(F.col("log_id") % 13 == 0, F.lit(99.0)).otherwise(F.col("label")))
    return indexed.select("log_id", "label", back.alias("decoded"))


@book.query("standard_scale", on_logs("SELECT log_id, round((length(message) - m) / s, 6) AS message_length_scaled FROM logs, (SELECT avg(length(message)) AS m, stddev_pop(length(message)) AS s FROM logs WHERE expected_category IN ('routine', 'noise'))"))
def standard_scale(spark, sf):
    sized = views.logs(spark, sf).withColumn("message_length", F.length("message"))
    return rows.scaled(sized, ["message_length"], F.col("expected_category").isin("routine", "noise")).select("log_id", SIX(F.col("message_length_scaled")).alias("message_length_scaled"))


@book.query("anomaly_train_stats", on_scored("SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(quantile_cont(s, 0.1), 6) AS p10 FROM (SELECT CAST(anomaly_score AS DOUBLE) AS s FROM scored WHERE expected_category IN ('routine', 'noise'))"))
def anomaly_train_stats(spark, sf):
    usual = views.scored(spark, sf).filter(F.col("expected_category").isin("routine", "noise")).select(F.col("anomaly_score").cast("double").alias("s"))
    out = metrics.beside(usual.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std")), rows.quantiles(usual, "s", [0.1]).select(F.col("quantile").alias("p10")))
    return out.select(*[SIX(F.col(c)).alias(c) for c in ("mean", "std", "p10")])


_TERMS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), terms AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), kept AS (SELECT term, df FROM terms, n WHERE df >= 2 AND df <= n.n * 0.95 ORDER BY total DESC, term LIMIT 10000), scores AS (SELECT doc_id, term, tf.tf, df, (1 + ln(tf.tf)) * (ln((1 + n.n) / (1 + df)) + 1) AS score FROM tf JOIN kept USING (term), n)"


@book.query("tfidf_vectors", f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, round(sum(score), 3) AS total, round(max(score), 5) AS most FROM scores GROUP BY 1")
def tfidf_vectors(spark, sf):
    out = rows.term_scores(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("score"), 3).alias("total"), F.round(F.max("score"), 5).alias("most"))


@book.query("topk_terms", f"WITH {_TERMS} SELECT term, round(sum(score), 3) AS score FROM scores GROUP BY 1 ORDER BY round(sum(score), 3) DESC, term LIMIT 50")
def topk_terms(spark, sf):
    out = rows.term_scores(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return rows.top(out.groupBy("term").agg(F.round(F.sum("score"), 3).alias("score")), 50, F.desc("score"), F.col("term"))


_GRAMS = "words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), tokens AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words), " + _TERMS[_TERMS.index("tf AS ("):]


@book.query("tfidf_grams", f"WITH {_GRAMS} SELECT doc_id, count(*) AS terms, count(*) FILTER (contains(term, ' ')) AS longer, round(sum(score), 3) AS total, round(max(score), 5) AS most FROM scores GROUP BY 1")
def tfidf_grams(spark, sf):
    """Terms of one to three words, the 10,000 most frequent ones."""
    out = rows.gram_scores(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count("*").alias("terms"), F.count_if(F.contains("term", F.lit(" "))).alias("longer"), F.round(F.sum("score"), 3).alias("total"), F.round(F.max("score"), 5).alias("most"))


@book.query("topk_errors", on_logs("SELECT log_id, expected_category, category, confidence, left(message, 100) AS message FROM decisions WHERE expected_category <> category ORDER BY log_id LIMIT 5", decided()))
def topk_errors(spark, sf):
    wrong = views.decisions(spark, sf).filter("expected_category <> category").select("log_id", "expected_category", "category", "confidence", F.left("message", F.lit(100)).alias("message"))
    return rows.top(wrong, 5, "log_id")


_HASHED = "left(md5(log_id || '|42'), 15)"


@book.query("seeded_sample", on_logs(f"SELECT log_id, message FROM logs ORDER BY {_HASHED}, log_id LIMIT 500"))
def seeded_sample(spark, sf):
    return rows.seeded_sample(views.logs(spark, sf).select("log_id", "message"), "log_id", 500)


@book.query("shuffle_rows", on_logs("SELECT log_id, message FROM logs"))
def shuffle_rows(spark, sf):
    return rows.shuffled(views.logs(spark, sf).select("log_id", "message"), "log_id")


@book.query("tail_fraction", on_logs("SELECT log_id FROM logs WHERE log_id > (SELECT quantile_cont(log_id, 0.8) FROM logs)"))
def tail_fraction(spark, sf):
    return rows.tail_fraction(views.logs(spark, sf).select("log_id"), "log_id")


@book.query("union_sources", on_logs("SELECT message, 'a' AS origin, CAST(NULL AS VARCHAR) AS source FROM logs UNION ALL SELECT message, NULL, source FROM logs"))
def union_sources(spark, sf):
    logs = views.logs(spark, sf)
    return files.union_sources(logs.select("message", F.lit("a").alias("origin")), logs.select("message", "source"))


@book.query("matched_set_union", on_logs("SELECT log_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN source LIKE 'pci%' THEN ['pci', 'any'] ELSE [] END, CASE WHEN message LIKE '%credit%' THEN ['card', 'any'] ELSE [] END))), ',') AS names FROM logs"))
def matched_set_union(spark, sf):
    none = F.array().cast("array<string>")
    source = F.when(F.col("source").startswith("pci"), F.array(F.lit("pci"), F.lit("any"))).otherwise(none)
    message = F.when(F.col("message").contains("credit"), F.array(F.lit("card"), F.lit("any"))).otherwise(none)
    return views.logs(spark, sf).select("log_id", F.array_join(F.array_sort(F.array_union(source, message)), ",").alias("names"))


@book.query("checked_exclusion", on_logs("SELECT log_id FROM logs WHERE log_id NOT IN (SELECT log_id FROM logs WHERE event_type = 'error')"))
def checked_exclusion(spark, sf):
    logs = views.logs(spark, sf)
    return logs.join(logs.filter("event_type = 'error'").select("log_id"), "log_id", "left_anti").select("log_id")


@book.query("invalid_categories", on_logs("SELECT DISTINCT event_type AS category FROM logs EXCEPT SELECT unnest(['view', 'click'])"))
def invalid_categories(spark, sf):
    allowed = views.logs(spark, sf).filter(F.col("event_type").isin("view", "click")).select(F.col("event_type").alias("category"))
    return views.logs(spark, sf).select(F.col("event_type").alias("category")).distinct().exceptAll(allowed.distinct())


@book.query("drift_psi", on_logs("SELECT round(sum((a - e) * ln(a / e)), 6) AS psi, sum((a - e) * ln(a / e)) > 0.1 AS drifted FROM (SELECT greatest(avg(CASE WHEN expected_category = c THEN 1.0 ELSE 0 END), 1e-4) AS e, greatest(avg(CASE WHEN category = c THEN 1.0 ELSE 0 END), 1e-4) AS a FROM decisions, (SELECT unnest(['critical', 'suspicious', 'routine', 'noise']) AS c) GROUP BY c)", decided()))
def drift_psi(spark, sf):
    rows_ = views.decisions(spark, sf)
    out = metrics.psi(rows_.select(F.col("expected_category").alias("k")), rows_.select(F.col("category").alias("k")), "k")
    return out.withColumn("psi", SIX(F.col("psi")))
