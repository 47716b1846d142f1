import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from logsluice.llm import packing
from logsluice.llm.tokens import BYTE_BPE, WORD_BPE, encoder, tokenizer, tokenizer_path


def test_segments_give_the_library_ids(corpus, odd):
    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "1", "23", "'s", "'", "!", "...", " ", "ß", "Σ", "ς", "İ", "中", "\u0085", "​", "<|endoftext|>", "\x1c", "🎉", "ﬁ", "\r\n", "word", "###"]
    texts = [t or "" for _, t in corpus[:80] + odd] + ["".join(rng.choice(bits) for _ in range(rng.randrange(15))) for _ in range(4000)]
    for name, spaced in ((BYTE_BPE, True), (WORD_BPE, False)):
        path = tokenizer_path(name)
        encode, tool = encoder(path, spaced), tokenizer(path)
        for text in texts:
            assert encode(text).tolist() == tool.encode(text, add_special_tokens=False).ids, text


def best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


def test_segment_tree_packs_as_plain_best_fit():
    rng = random.Random(2)
    for window in (7, 64, 100, 2048):
        lengths = [rng.randint(1, window) for _ in range(400)]
        sequence, offset = packing.best_fit_decreasing(np.array(lengths), window)
        used = np.bincount(sequence, weights=lengths)
        assert sorted((window - used).astype(int).tolist()) == best_fit(lengths, window)
        for s in set(sequence.tolist()):
            spans = sorted((int(offset[i]), lengths[i]) for i in np.flatnonzero(sequence == s))
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_every_id_once_and_little_padding(spark, documents, corpus, odd):
    rows = [(100 + k, t) for k, t in corpus] + odd
    found = packing.pack(documents(rows), group=64, with_ids=True).toPandas()
    tool = tokenizer(tokenizer_path(WORD_BPE))
    expected = sorted((str(k), [*tool.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows)
    ids = found.sort_values(["doc_id", "start"]).assign(doc_id=lambda x: x.doc_id.map(lambda k: str(int(k)) if k == k else "None"))
    once = ids[ids.doc_id != "5"]
    got = {k: [i for part in g.ids for i in part] for k, g in once.groupby("doc_id")}
    assert got == {k: v for k, v in expected if k != "5"}
    assert len(ids[ids.doc_id == "5"]) == 2
    for r in found.itertuples():
        assert r.length == len(r.ids) <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    fill = found.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack(documents([])).count() == 0


def test_long_documents_do_not_fill_groups(spark, documents):
    rows = [(k, "word " * (30 if k % 9 else 9000)) for k in range(60)] + [(100, " ".join(["word"] * 2047)), (101, " ".join(["word"] * 2047))]
    found = packing.pack(documents(rows), group=10).toPandas()
    full = found[found.length == 2048]
    assert len(full) >= 7 * 4 and (full.offset == 0).all()
    by = found.groupby("sequence_id").length.agg(["sum", "size"])
    assert (by.loc[full.sequence_id, "size"] == 1).all() and full.sequence_id.is_unique and by["sum"].max() <= 2048
    rest = found[found.length < 2048]
    assert rest.groupby(rest.sequence_id // (1 << 32)).size().max() < 25 and not set(rest.sequence_id) & set(full.sequence_id)
    for key, g in found.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]


class Counting:
    """A file that counts the bytes read."""

    def __init__(self, file):
        self.file, self.read = file, 0

    def read_at(self, size, at):
        self.read += size
        return self.file.read_at(size, at)


def test_random_access_reads_next_to_nothing(tmp_path):
    from logsluice.llm import dac

    ids = np.random.default_rng(2).integers(0, 50_000, 300_000).astype(np.uint32)
    path = tmp_path / "x.dac"
    path.write_bytes(dac.packed(np.arange(300), np.arange(301) * 1000, ids))
    with pa.OSFile(str(path)) as f:
        file = Counting(f)
        reader = dac.Reader(file)
        head = file.read
        assert reader[123_456] == ids[123_456] and reader.document(250).tolist() == ids[250_000:251_000].tolist()
        assert head < 200 and file.read < 5000 and len(reader) == 300_000
    fs, name = dac.file_system(f"file://{path}")
    assert name == str(path) and dac.file_system(str(path))[1] == str(path)
    with pytest.raises(ValueError, match="token files can lie"):
        dac.file_system("viewfs://x/y")


def test_byte_files_round_trip():
    from logsluice.llm import dac

    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        reader = dac.Reader(dac.packed(np.array([4, 5]), np.array([0, n // 3, n]), ids))
        assert len(reader) == n and reader.slice(0, n).tolist() == ids.tolist()
        assert [reader[i] for i in range(0, n, 37)] == ids[::37].tolist()
        assert reader.document(0).tolist() == ids[: n // 3].tolist() and reader.document(1).tolist() == ids[n // 3 :].tolist()
        assert [dac.Reader(Counting(reader._file))[i] for i in range(0, n, 997)] == ids[::997].tolist()
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert reader.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()


def test_token_files(spark, documents, corpus, odd, tmp_path):
    from logsluice.llm import dac

    rows = corpus + [(k, t) for k, t in odd if k not in {c[0] for c in corpus}] + [(10_000, None), (10_001, "x y"), (10_002, "word " * 6000)]
    manifest = dac.write_files(documents(rows), str(tmp_path / "files"), file_ids=20_000)
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in dac.read_files(manifest).collect())
    tool, at, expected = tokenizer(tokenizer_path(BYTE_BPE)), 0, []
    for k, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((-1 if k is None else k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert found == expected and manifest.count() > 1
    assert dac.read_files(dac.write_files(documents([]), str(tmp_path / "none"))).count() == 0


def test_arrow_schema_of_pieces(spark, documents):
    assert isinstance(pa.int64(), pa.DataType)
    assert packing.pack(documents([(1, "a b")])).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
