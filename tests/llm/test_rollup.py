from collections import Counter

import pytest
from logsluice.llm import rollup
from logsluice.llm.tokens import BYTE_BPE, tokenizer, tokenizer_path
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()))])


def counted(rows, sign=1):
    tool, sums = tokenizer(tokenizer_path(BYTE_BPE)), Counter()
    for _, text, lang, source in rows:
        for name, n in ((rollup.BPE, len(tool.encode(text or "", add_special_tokens=False).ids)), (rollup.WORDS, len((text or "").split()))):
            sums[source, lang, name, "docs"] += sign
            sums[source, lang, name, "tokens"] += sign * n
    return sums


def totals(sums):
    found = Counter()
    for r in sums.totals().collect():
        found[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        found[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
    return {k: v for k, v in found.items() if v}


def test_inserts_deletes_revisions_and_replays(spark, tmp_path, corpus):
    rows = [(k, t, ("en", "de", None)[k % 3], ("a", "b")[k % 2]) for k, t in corpus[:50]] + [(900, None, "en", "a"), (None, "x y", None, None)]
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    assert totals(sums) == {}
    table = lambda rows: rollup.ledger(spark.createDataFrame(rows, SCHEMA))
    assert sums.commit("1", table(rows)) and not sums.commit("1", table(rows))
    expected = counted(rows)
    assert totals(sums) == {k: v for k, v in expected.items() if v}
    old, new = rows[3], (*rows[3][:1], "a revised text", *rows[3][2:])
    change = table([old]).selectExpr("*", "-1 AS by").unionByName(table([new]).selectExpr("*", "1 AS by"))
    for k in range(2):
        assert sums.commit("2", change, change["by"]) == (not k)
    expected.update(counted([new]))
    expected.update(counted([old], -1))
    sums.commit("3", table(rows[10:20]), -1)
    expected.update(counted(rows[10:20], -1))
    assert totals(sums) == {k: v for k, v in expected.items() if v}
    with pytest.raises(ValueError, match="other rows"):
        sums.commit("3", table(rows[10:21]), -1)
    again = rollup.Rollup(spark, str(tmp_path / "sums"))  # as after a restart
    assert totals(again) == totals(sums) and not again.commit("1", table(rows[::-1]))
    assert sorted(r.batch for r in again.batches().collect()) == ["1", "2", "3"]


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    rows = rollup.ledger(spark.createDataFrame([(1, "a b c", "en", "s"), (2, None, None, None)], SCHEMA))
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    sums.prepared(rows, 1, "crashed")  # the sums are there, the marker is not
    assert totals(sums) == {} and sums.digest_of("1") is None
    assert sums.commit("1", rows) and totals(sums)["s", "en", rollup.WORDS, "tokens"] == 3
    before = totals(sums)
    bad = rows.withColumn("bpe", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        sums.commit("2", bad)
    assert totals(rollup.Rollup(spark, str(tmp_path / "sums"))) == before
    # two sessions that raced for a batch left a marker each: one of them counts
    digest = sums.prepared(rows, 1, "racing")
    spark.createDataFrame([("1", "racing", digest)], rollup._MARK).write.mode("append").parquet(str(tmp_path / "sums" / "markers"))
    assert totals(sums) == before
    assert sums.commit("3", rows.limit(0)) and totals(sums) == before


def test_folds_change_no_total_and_are_what_is_read(spark, tmp_path):
    import shutil

    folder = tmp_path / "sums"
    sums = rollup.Rollup(spark, str(folder))
    assert sums.fold() == 0 and totals(sums) == {} and sums.folded().count() == 0
    rows = [(k, f"text of {k}", "en" if k % 2 else None, "s" if k % 3 else None) for k in range(12)]
    table = lambda rows: rollup.ledger(spark.createDataFrame(rows, SCHEMA))
    for k in range(3):
        sums.commit(str(k), table(rows[4 * k : 4 * k + 4]))
    expected = counted(rows)
    assert sums.fold() == 3 and totals(sums) == expected
    for r in sums.folded().collect():  # nothing reads them again
        shutil.rmtree(folder / "sums" / f"attempt={r.attempt}")
    assert totals(rollup.Rollup(spark, str(folder))) == expected
    assert not sums.commit("1", table(rows[4:8])) and totals(sums) == expected  # a batch in a fold is still known
    # a marker that lost a race for a batch of the fold comes late, with an attempt before all others
    digest = sums.prepared(table(rows[:4]), 1, "0-late")
    spark.createDataFrame([("0", "0-late", digest)], rollup._MARK).write.mode("append").parquet(str(folder / "markers"))
    assert totals(sums) == expected
    sums.commit("gone", table(rows[:2]), -1)
    expected.update(counted(rows[:2], -1))
    expected = Counter({k: v for k, v in expected.items() if v})
    assert totals(sums) == expected
    # two sessions fold at once: either may be read
    assert rollup.Rollup(spark, str(folder)).fold() == 4 and sums.fold() == 4
    assert totals(sums) == expected and sums.folded().count() == 4
    # a fold that crashed before its marker is nothing
    spark.createDataFrame([("s", "en", rollup.WORDS, 99, 99)], rollup._DELTA).write.parquet(str(folder / "sums" / "attempt=crashed"))
    assert totals(sums) == expected


def test_other_rows_with_equal_sums_are_refused(spark, tmp_path):
    sums = rollup.Rollup(spark, str(tmp_path / "sums"))
    table = lambda rows: rollup.ledger(spark.createDataFrame(rows, SCHEMA))
    assert sums.commit("1", table([(1, "one two", "en", "s")]))
    for rows in ([(2, "one two", "en", "s")], [(1, "two one", "en", "s")]):
        with pytest.raises(ValueError, match="other rows"):
            sums.commit("1", table(rows))
    assert totals(sums) == counted([(1, "one two", "en", "s")])


def test_copies_of_a_common_text(spark):
    docs = spark.createDataFrame([(k, "same text" if k % 3 else f"own {k}", "en", "s") for k in range(90)] + [(None, "same text", "en", "s"), (1, "same text", "de", "s")], SCHEMA)
    gone = rollup.copies(rollup.ledger(docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in gone) == [(False, k) for k in range(2, 90) if k % 3] + [(True, 0)]
    assert rollup.copies(rollup.ledger(docs.limit(0))).count() == 0


def test_query_against_brute_force(spark):
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    keep = docs.sort_values("doc_id").drop_duplicates("text")
    keep["text"] = keep.text.map(lambda t: "\n".join(dict.fromkeys(t.split("\n"))))
    assert (keep.text != docs.loc[keep.index].text).any()
    expected = counted(keep[["doc_id", "text", "lang", "source"]].itertuples(index=False))
    found = rollup.op3_token_counts(spark, "/root/testdata/sf0.001").collect()
    got = Counter()
    for r in found:
        got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
    assert got == expected
