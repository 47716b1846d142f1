"""Extra columns whose names the operators use themselves, and nulls in all of them."""

import pytest
from logsluice.llm import common, dac, decontaminate, digest, html, packing, quality, rollup, secrets, sentences, simhash
from pyspark.sql import functions as F

NAMES = ["score", "predicted", "held_out", "spans", "n_hex", "fingerprint", "component_id", "component", "node", "bits", "least", "start", "length", "grp", "sequence_id", "offset", "ids", "part", "seq", "file", "near_next", "kind", "key", "id", "label", "h", "hit", "seed", "seeds", "region", "item_id", "bad", "covered", "covered_id", "n_sentences", "n_removed", "at", "n", "same", "bpe", "words", "sign", "host", "page", "token", "vector", "fixed", "main", "n_tokens", "_k", "url", "text2"]
TEXTS = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', None, ""]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(TEXTS * 2)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.lit("clash") if k % 2 else F.lit(None).cast("double") for k, n in enumerate(NAMES)})


def test_operators(spark, crowded, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (1, 0, 0, None), (5, 1, None, None)], "doc_id long, quality int, toxic int, score string")
    bench = spark.createDataFrame([(1, TEXTS[0], "x"), (None, None, None)], "item_id long, text string, seed string")
    n = crowded.count()
    assert quality.quality(crowded, labels).count() == n
    assert secrets.secrets(crowded).count() == n
    assert simhash.near_groups(crowded).count() == n
    assert digest.with_neighbours(crowded).count() == n
    assert digest.digests(crowded).count() == n
    assert dac.read_files(dac.write_files(crowded, str(tmp_path / "f"))).count() == n
    assert packing.pack(crowded).count() == n
    assert rollup.ledger(crowded).count() == n
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(crowded, bench).collect()) == [(0, 1), (4, 1)]
    cleaned = sentences.cleaned(crowded)
    assert cleaned.count() == n and cleaned.columns.count("n_removed") == 1
    for out in (quality.keep_good(crowded, labels, 0.0), secrets.masked(crowded), decontaminate.without(crowded, bench), simhash.keep_one(crowded)):
        assert out.columns == crowded.columns and 0 < out.count() <= n


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example", "<article><p>Hello</p></article>"), (None, None, None)], "page_id long, url string, html string")
    crowded = pages.withColumns({n: F.lit("clash") for n in NAMES if n != "url"})
    assert sorted(r.text for r in html.extracted(crowded).collect()) == ["", "Hello"]


def test_arrow_batches_are_bounded_in_bytes_and_no_more_than_needed(spark):
    key, before = common._BATCH, spark.conf.get(common._BATCH)
    try:
        for said, then in (("64m", str(common.BATCH_BYTES)), ("67108864b", str(common.BATCH_BYTES)), ("2m", "2m"), ("1024", "1024"), ("1gb", str(common.BATCH_BYTES))):
            spark.conf.set(key, said)
            common.small_batches(spark)
            assert spark.conf.get(key) in (then, then + "b")
    finally:
        spark.conf.set(key, before)


def test_ranges_follow_the_key(spark):
    df = spark.createDataFrame([(k * k % 101 if k % 9 else None, k) for k in range(300)], "doc_id long, n int")
    rows = common.in_order(df, "doc_id").collect()
    assert len(rows) == 300 and len({r.part for r in rows}) > 4
    ends = {}
    for r in rows:
        ends.setdefault(r.part, []).append(-1 if r.doc_id is None else r.doc_id)
    assert all(x == sorted(x) for x in ends.values())
    assert all(max(ends[a]) < min(ends[b]) for a, b in zip(sorted(ends), sorted(ends)[1:]))
    assert common.in_order(df.limit(0), "doc_id").count() == 0
