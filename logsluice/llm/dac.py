"""Token ids in binary files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 has the lowest chunk of every id and a bitmap of the ids that go
on; level 1 has the next chunk of just those, and so forth. A rank directory (ones before every 512th bit) finds an id's
place on the next level, so any id is read in constant time without decoding those before it.

A file: b"DAC1"; counts of documents, ids and levels (u8 each); document ids (i8); their first positions (u8, one more
than documents); then by level the number of values (u8), the chunks, the bitmap and its rank directory (u4). Little-endian.

A reader of an open file reads an id's bytes, its directory entries and blocks, and nothing else.

Documents are dealt out by ranges of doc_id, so each task writes its files in document order straight into the shared
folder. Only files in the manifest count; the manifest is a table that Spark commits, so a lost task's files are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, map_rows, new_path, small_batches, texts_of, written
from .tokens import BYTE_BPE, encoder, tokenizer_path

MAGIC = b"DAC1"
BLOCK = 512
END = 0
#: A file is closed once it holds so many ids.
FILE_IDS = 4_000_000


def packed(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    out, levels = [], []
    values = ids.astype(np.uint32)
    while not levels or len(values):
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        levels.append((len(values), (values & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u4")))
        values = values[more] >> np.uint32(8)
    out += [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for n, chunks, bits, ranks in levels:
        out += [np.array([n], "<u8").tobytes(), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Reader:
    """Random access to the ids of one file: bytes, or an open file of which only what is asked for is read."""

    def __init__(self, source: bytes | pa.NativeFile) -> None:
        self._file = pa.BufferReader(source) if isinstance(source, bytes) else source
        if self._take("S4", 1, 0)[0] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.docs, self.n, levels = map(int, self._take("<u8", 3, 4))
        at = 28 + 16 * self.docs + 8
        self.levels = []  # number of values, and where chunks, bits and ranks begin
        for _ in range(levels):
            n = int(self._take("<u8", 1, at)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((n, at + 8, at + 8 + n, at + 8 + n + blocks * (BLOCK // 8)))
            at += 8 + n + blocks * (BLOCK // 8 + 4)

    def _take(self, kind: str, n: int, at: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        return np.frombuffer(self._file.read_at(size, at), kind, n) if n else np.zeros(0, kind)

    def __len__(self) -> int:
        return self.n

    @cached_property
    def doc_ids(self) -> np.ndarray:
        return self._take("<i8", self.docs, 28)

    @cached_property
    def starts(self) -> np.ndarray:
        return self._take("<u8", self.docs + 1, 28 + 8 * self.docs).astype(np.int64)

    def _rank(self, level: int, at: int) -> int:
        """Ones before bit at, from one entry of the directory and one block."""
        n, _, bits, ranks = self.levels[level]
        block, left = divmod(at, BLOCK)
        if block * BLOCK >= n:  # behind a last block that is full
            block, left = block - 1, BLOCK
        if block < 0:
            return 0
        inside = np.unpackbits(self._take("u1", (left + 7) // 8, bits + block * (BLOCK // 8)), count=left, bitorder="little")
        return int(self._take("<u4", 1, ranks + 4 * block)[0]) + int(inside.sum(dtype=np.int64))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= int(self._take("u1", 1, chunks + i)[0]) << 8 * level
            if not self._take("u1", 1, bits + (i >> 3))[0] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a up to b, reading no others."""
        value = np.zeros(max(0, b - a), np.uint32)
        where = np.arange(len(value))
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            value[where] |= self._take("u1", b - a, chunks + a).astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(self._take("u1", (b + 7 >> 3) - (a >> 3), bits + (a >> 3)), bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            where = where[more]
            a = self._rank(level, a)
            b = a + len(where)
        return value

    def document(self, k: int) -> np.ndarray:
        a, b = self._take("<u8", 2, 28 + 8 * self.docs + 8 * k)
        return self.slice(int(a), int(b))


#: What other libraries call a store, by the name that Spark's paths give it.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path of Spark's and the path in it; an error names the schemes that tasks can write to themselves."""
    scheme, sep, rest = path.partition("://")
    try:
        return pa.fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + sep + rest if sep else path)
    except (pa.ArrowInvalid, OSError) as why:
        raise ValueError(f"token files can lie in local or shared folders, s3, gs, abfs and hdfs, not in {path}: {why}") from why


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the documents' ids to files below folder; the manifest: rows (part, seq, file, docs, ids), committed by Spark.

    Null and empty texts are the end id alone; rows with equal ids stay rows of their own, in any order; a null id
    comes first and is written as the least long. An empty table writes no file.
    """
    path = path or tokenizer_path(BYTE_BPE)
    small_batches(docs.sparkSession)
    where = folder if "://" in folder or folder.startswith("/") else "/" + folder.split(":", 1)[1].lstrip("/")

    def run(batches):
        encode = encoder(path, True)
        fs, top = file_system(where)
        fs.create_dir(top, recursive=True)
        keys, sizes, ids, part, seq = [], [], [], 0, 0

        def flush():
            nonlocal keys, sizes, ids, seq
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{top}/{name}") as out:
                out.write(packed(np.array(keys, np.int64), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(ids)))
            row = [part, seq, f"{where}/{name}", len(keys), int(sum(sizes))]
            keys, sizes, ids, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]]), pa.array(row[3:4], pa.int64()), pa.array(row[4:], pa.int64())], ["part", "seq", "file", "docs", "ids"])

        held = 0
        for batch in batches:
            for key, text, k in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                part = k
                own = np.append(encode(text), np.uint32(end))
                keys.append(-(1 << 63) if key is None else key)
                sizes.append(len(own))
                ids.append(own)
                held += len(own)
                if held >= file_ids:
                    held = 0
                    yield flush()
        if keys:
            yield flush()

    dealt = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    return written(dealt.mapInArrow(run, "part int, seq int, file string, docs long, ids long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files that the manifest names."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))  # a row for each range
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    files = manifest.withColumn("inside", inside).join(before, "part").select("file", (F.col("base") + F.col("inside")).alias("base"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(file)
                with fs.open_input_stream(name) as f:  # all of it, in one go
                    reader = Reader(f.read())
                whole, starts = reader.slice(0, len(reader)).astype("<u4"), reader.starts.tolist()
                for key, a, b in zip(reader.doc_ids.tolist(), starts, starts[1:]):
                    rows.append((None if key == -(1 << 63) else key, base + a, b - a, zlib.crc32(whole[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return each

    return map_rows(files.repartition(max(1, manifest.count())), make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return read_files(write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-files")))
