import corpus_pipeline
import numpy as np
import pandas as pd
from logsluice.llm import decontaminate, quality, secrets
from logsluice.llm.common import word_hashes
from logsluice.llm.tokens import WORD_BPE, tokenizer, tokenizer_path
from pyspark.sql import functions as F

AT = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs, kept = spark.read.parquet(f"{AT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, AT), "test")
        kept.append(docs.toPandas().sort_values("doc_id").reset_index(drop=True))
    raw = pd.read_parquet(f"{AT}/documents.parquet").sort_values("doc_id")
    good, single, clean, masked, packed = kept
    for frame in kept[:4]:
        assert list(frame.columns) == list(raw.columns)
    weights, bias = quality.fit(spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet"))
    odds = [bias + (weights[quality.features(t)].mean(dtype=float) if t.strip() else 0) for t in raw.text]
    assert good.doc_id.tolist() == raw.doc_id[[1 / (1 + np.exp(-o)) >= quality.THRESHOLD for o in odds]].tolist()
    assert 0.6 * len(raw) < len(good) < len(raw)
    sets, group = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.encode().lower().split() for t in good.text)], list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 4 * len(sets[i]) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert single.doc_id.tolist() == [good.doc_id[i] for i in range(len(good)) if group[i] == i] and len(single) < len(good)
    words = lambda t: word_hashes([t])[0].tolist()
    items = [words(t) for t in pd.read_parquet(f"{AT}/benchmark.parquet").text]
    runs = {tuple(t[k : k + 13]) for t in items for k in range(len(t) - 12)} | {tuple(t) for t in items if len(t) < 13}
    holds = lambda t: any(tuple(t[k : k + n]) in runs for n in {len(r) for r in runs} for k in range(len(t) - n + 1))
    dropped = set(single.doc_id) - set(clean.doc_id)
    assert dropped == {key for key, text in zip(single.doc_id, single.text) if holds(words(text))} and dropped
    field = secrets.fit(spark.createDataFrame(clean))
    for before, after in zip(clean.text, masked.text):
        spans = secrets.all_spans(before, field)
        assert (before == after) == (not spans) and "[SECRET]" in after if spans else before == after
        assert not secrets.base_spans(after)
    tool = tokenizer(tokenizer_path(WORD_BPE))
    lengths = {k: len(tool.encode(t, add_special_tokens=False).ids) + 1 for k, t in zip(masked.doc_id, masked.text)}
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert decontaminate.enough(24, 400) and not decontaminate.enough(7, 30)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, AT).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]


def test_run_over_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "good words in a text " * 9, "en", "s", 5), (3, "good words in a text " * 9, "en", "s", 5), (None, "no id but words enough for it", None, None, None)]
    rows += [(4, f"before it {item} after it", "en", "s", 1), (5, 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is here', "en", "s", 1), (6, "very long " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({n: F.lit(None).cast("string") for n in ("mark", "same", "key", "h", "seed", "region", "score", "label", "_id", "_same", "grp", "spans")})
    labels, bench = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    for name, table in (("full", clash), ("none", clash.limit(0))):
        at = str(tmp_path / name)
        table.write.parquet(f"{at}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{at}/labels.parquet")
        (bench if name == "full" else bench.limit(0)).write.parquet(f"{at}/benchmark.parquet")
        found = corpus_pipeline.run(spark, at).collect()
        assert (not found) == (name == "none")
    full = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect() if r.start == 0]
    assert sorted(full, key=str) == sorted([1, 3, 3, 5, 6, None], key=str)  # 2 is a copy of 1, 4 holds an item
