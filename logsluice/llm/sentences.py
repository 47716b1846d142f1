"""Substring dedup over runs of sentences.

Every sentence begins a run: the shortest one of LEAST_SENTENCES sentences or more with LEAST_WORDS words. Runs are hashed
(96 bits) and counted over the whole corpus; the first place of each repeated run is its least (doc_id, text's hash,
sentence). Sentences that a run covers at any other place are removed.

1. One Arrow pass writes the runs, rows of five numbers.
2. Counts by hash, combined before the shuffle, are written; so the join of runs with those that repeat has two plain sides.
   Very common runs are broadcast.
3. First places are a minimum by hash, combined before the shuffle; all others are told by an anti-join on the whole place.
4. Texts cross the network once, to meet their list of covered sentences.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, map_rows, small_batches, texts_of, written

LEAST_SENTENCES, LEAST_WORDS = 2, 16
#: A sentence of more words is cut into parts that count as sentences: after each word whose checksum divides by CUT, and after
#: MOST words at all events. So lists and texts without full stops have parts too, and equal passages equal parts wherever they begin.
LONG, CUT, MOST = 24, 8, 64
_END = re.compile(r"[.!?]['\")\]]*\s+|[。！？]+\s*|\n\s*")
# A word: a letter of a script without spaces (kana, ideographs, Thai to Khmer), or a run of other signs than these and space.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿\U00020000-\U0003ffff"
_WORD = re.compile(rf"([{_ALONE}]|[^\s{_ALONE}]+)\s*")
_DENSE = re.compile(rf"[{_ALONE}]")
_NO_ID = -(1 << 63)


def _words(text: str) -> list[str]:
    return text.split() if text.isascii() or not _DENSE.search(text) else _WORD.findall(text)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; each takes the white space after it along, so together they are the text."""
    cuts, out = [0, *(m.end() for m in _END.finditer(text)), len(text)], []
    for a, b in zip(cuts, cuts[1:]):
        if b - a > LONG:
            part = text[a:b]
            if len(_words(part)) > LONG:
                start, n = a, 0
                for m in _WORD.finditer(part):
                    n += 1
                    if n >= MOST or not zlib.crc32(m[1].lower().encode("utf-8", "replace")) % CUT:
                        out.append((start, a + m.end()))
                        start, n = a + m.end(), 0
                a = start
        if b > a:
            out.append((a, b))
    return out


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """(first sentence, sentences, hash, check) of the run that each sentence begins. Case and white space make no difference."""
    words = [_words(text[a:b].lower()) for a, b in sentences(text)]
    sizes = [len(w) for w in words]
    joined = [" ".join(w) for w in words]
    out, n, end, held = [], len(words), 0, 0
    for i in range(n):
        while end < n and (held < LEAST_WORDS or end - i < LEAST_SENTENCES):
            held += sizes[end]
            end += 1
        if held < LEAST_WORDS or end - i < LEAST_SENTENCES:
            break
        both = xxhash.xxh3_128_intdigest(" ".join(joined[i:end]).encode("utf-8", "replace"))
        out.append((i, end - i, both & (1 << 64) - 1, both >> 96))
        held -= sizes[i]
    return out


def _named(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least), the text's hash and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, same, covered): for each text with any, its sentences that a non-first repeated run covers."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(k, s, *r) for k, s, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), texts_of(batch.column(2))) for r in runs(t)]
            key, same, at, n, h, c = zip(*rows) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(same, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(c, np.uint32).view(np.int32))],
                ["doc_id", "same", "at", "n", "h", "c"],
            )

        return each

    found = written(map_rows(_named(docs), make, "doc_id long, same long, at int, n int, h long, c int"), "runs")
    known = written(found.groupBy("h", "c").agg(F.count("*").alias("times")).filter("times > 1"), "known")
    places = written(join_counted(found, known, ["h", "c"], found.count()), "places")
    place = ["doc_id", "same", "at"]
    first = places.groupBy("h", "c").agg(F.min(F.struct(*place)).alias("p")).select("h", "c", "p.*")
    later = places.join(first, ["h", "c", *place], "left_anti")
    return later.groupBy("doc_id", "same").agg(F.collect_set(F.struct("at", "n")).alias("covered"))  # no more than the text has sentences


def cleaned(docs: DataFrame, changed_only: bool = False) -> DataFrame:
    """docs (doc_id, text and all others) with n_sentences, n_removed and the text without covered sentences.

    Columns of docs that are named n_sentences or n_removed give way to these.
    Null and empty texts stay as they are; a text may become empty. Rows with equal doc_id and text count as one, so they do
    not remove each other and lose the same sentences; unequal texts of one doc_id are texts of their own. A null id counts
    as one before all others.
    """
    docs = docs.drop("n_sentences", "n_removed")
    covered = written(repeats(docs), "covered").toDF("_id", "_same", "_covered")
    text = F.col("text").cast("string")
    both = docs.join(covered, (F.coalesce(docs.doc_id.cast("long"), F.lit(_NO_ID)) == covered["_id"]) & (F.xxhash64(text) == covered["_same"]), "inner" if changed_only else "left")
    names, at = docs.columns, docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, whole, less = batch.column(at).to_pylist(), [], []
            for i, (text, spans) in enumerate(zip(texts, batch.column(len(names)).to_pylist())):
                parts = sentences(text or "")
                gone = {k for s in spans or () for k in range(s["at"], min(s["at"] + s["n"], len(parts)))}
                whole.append(len(parts))
                less.append(len(gone))
                if gone:
                    texts[i] = "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone).rstrip()
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole, pa.int32()), pa.array(less, pa.int32())], [*names, "n_sentences", "n_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.select(*[docs[f"`{c}`"] for c in names], covered["_covered"].alias("_covered")).mapInArrow(run, f"{fields}, n_sentences int, n_removed int")


def op5_sentences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "n_sentences", "n_removed", "text")
