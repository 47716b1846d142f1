import hashlib
import random

import numpy as np
import pytest
from logsluice.llm import bpe
from logsluice.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer, tokenizer_path

BITS = ["a", "B", " ", "  ", "   ", "\n", "\t", "é", "é", "1", "23", "'s", "'", "'re", "'ll", "'l", "'ve", "'S", "!", "...", " ", "ß", "Σ", "İ", "中", "\u0085", "​", "<|endoftext|>", "<|", "\x1c", "\0", "🎉", "ﬁ", "\r\n", "word", "###", "²", "Ⅷ", "　", "करो", "สวัสดี", "𐵀", "Ꟛ", "don't", "x86"]


@pytest.fixture(scope="module")
def tools():
    path = tokenizer_path(BYTE_BPE)
    return bpe.Coder(path), tokenizer(path)


def test_ids_and_texts_are_the_librarys(tools, corpus, odd):
    coder, tool = tools
    rng = random.Random(5)
    texts = [t or "" for _, t in corpus + odd] + ["".join(rng.choice(BITS) for _ in range(rng.randrange(15))) for _ in range(6000)]
    ids, ends = coder.encode(texts)
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        expected = tool.encode(text, add_special_tokens=False).ids
        assert ids[begin:end].tolist() == expected, text
        assert coder.decode(ids[begin:end]) == tool.decode(expected, skip_special_tokens=False) == text
        begin = end
    for _ in range(500):  # ids that are no encoding of a text
        some = np.array([rng.randrange(50_257) for _ in range(rng.randrange(8))], np.int64)
        assert coder.decode(some) == tool.decode(some.tolist(), skip_special_tokens=False)
    assert coder.decode(np.array([-1, 64, 60_000])) == "a"


def test_no_token_spans_a_forced_cut_and_most_cuts_are_forced(tools, corpus):
    coder, tool = tools
    assert 0.5 < coder.apart.mean() < 1
    text = "".join(t or "" for _, t in corpus[:50])
    data, starts, _ = coder.fragments_of([text])
    at, token_starts = 0, set()
    for i in tool.encode(text, add_special_tokens=False).ids:
        token_starts.add(at)
        at += len(coder.pieces[i])
    assert at == len(data) - 1 and set(starts.tolist()) - {at} <= token_starts


def test_long_fragments_and_parts(tools, monkeypatch):
    coder, tool = tools
    rng = random.Random(6)
    for text in ("a" * 5000, "".join(rng.choice("ab") for _ in range(3000)), " " * 3000 + "x", "é" * 999):
        assert coder.encode([text])[0].tolist() == tool.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PART", 7)
    for _ in range(800):
        text = "".join(rng.choice(BITS) for _ in range(40))
        assert coder.encode([text, text])[0].tolist() == 2 * tool.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(bpe, "MEMORY", 3)
    assert coder.encode(["one two three four five"])[0].tolist() == tool.encode("one two three four five", add_special_tokens=False).ids
    with pytest.raises(ValueError, match="no plain byte-level"):
        bpe.Coder(tokenizer_path(WORD_BPE))


def test_query_and_odd_rows(spark, documents, corpus, odd, tmp_path):
    rows = corpus[:60] + odd
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    tool = tokenizer(tokenizer_path(BYTE_BPE))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for k, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        expected.append((str(k), len(ids), sha(",".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_bpe(spark, str(tmp_path)).collect()) == sorted(expected)
    assert bpe.encoded(documents([])).count() == 0
    tokens = spark.createDataFrame([(1, None), (2, [64, None, 60_000]), (None, [])], "doc_id long, ids array<int>")
    assert sorted((str(r.doc_id), r.ids, r.text) for r in bpe.decoded(tokens).collect()) == [("1", [], ""), ("2", [64, 60_000], "a"), ("None", [], "")]
