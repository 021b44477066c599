"""Token-ID output: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed by zstandard.

File: magic ``TIDP0001``; for each chunk its planes; a compressed block of the documents (ids, then lengths); the
chunk index (for each chunk: offset, number of ids, length of each plane); a footer with the places of both, and the
magic again. A plane of zeros only has length 0. One chunk is read by its index entry alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices
from .tokenids import END_ID, SLICE, encoder

MAGIC = b"TIDP0001"
CHUNK = 65_536
FILE_BYTES = 64_000_000
MISSING = -(2**63)  # stands for a null doc_id


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The 4 byte planes, or 32 bit planes, of ids; a plane without a set bit is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = np.ascontiguousarray(raw.T)
    else:
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((4, n), np.uint8)
        for row, p in zip(raw, planes):
            if p:
                row[:] = np.frombuffer(p, np.uint8)
        return np.ascontiguousarray(raw.T).view("<u4").ravel()
    bits = np.zeros((32, n), np.uint8)
    for row, p in zip(bits, planes):
        if p:
            row[:] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Takes documents one by one; holds one open chunk and eight bytes for each document."""

    def __init__(self, sink, kind: str = "byte", chunk: int = CHUNK, level: int = 1):
        import zstandard

        self.sink, self.kind, self.chunk = sink, kind, chunk
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.open, self.held = len(MAGIC), [], 0
        self.index, self.docs, self.lengths, self.total = [], [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.chunk:
            ready = b"".join(self.open)
            whole = len(ready) // (4 * self.chunk) * 4 * self.chunk
            for i in range(0, whole, 4 * self.chunk):
                self._put(ready[i : i + 4 * self.chunk])
            self.open, self.held = [ready[whole:]], len(ready) - whole

    def _put(self, raw: bytes) -> None:
        sizes, start = [], self.at
        for p in to_planes(np.frombuffer(raw, "<u4"), self.kind):
            c = self.press.compress(p) if p else b""
            self.sink.write(c)
            sizes.append(len(c))
            self.at += len(c)
        self.index.append((start, len(raw) // 4, *sizes))

    def close(self) -> None:
        if self.held:
            self._put(b"".join(self.open))
        docs = self.press.compress(np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.lengths, "<i8").tobytes())
        index = np.asarray(self.index, "<i8").tobytes()
        self.sink.write(docs)
        self.sink.write(index)
        foot = json.dumps({"kind": self.kind, "docs": [self.at, len(docs), len(self.docs)], "index": [self.at + len(docs), len(self.index)], "ids": self.total}).encode()
        self.sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)


class Reader:
    """Random access to chunks through the index; ``documents`` walks the file with one chunk in memory."""

    def __init__(self, source):
        import zstandard

        self.source, self.press = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2) or source.tell()
        tail = self._read(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token-id file")
        n = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self._read(size - 12 - n, n))
        planes = 4 if self.foot["kind"] == "byte" else 32
        at, chunks = self.foot["index"]
        self.index = np.frombuffer(self._read(at, chunks * (planes + 2) * 8), "<i8").reshape(chunks, planes + 2)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, i: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.index[i])
        raw, planes = self._read(at, sum(sizes)), []
        for s in sizes:
            planes.append(self.press.decompress(raw[:s]) if s else b"")
            raw = raw[s:]
        return from_planes(planes, n, self.foot["kind"])

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        at, size, n = self.foot["docs"]
        both = np.frombuffer(self.press.decompress(self._read(at, size)), "<i8") if n else np.zeros(0, "<i8")
        left, nxt = np.zeros(0, "<u4"), 0
        for doc, length in zip(both[:n].tolist(), both[n:].tolist()):
            parts, have = [], 0
            while have < length:
                if not len(left):
                    left, nxt = self.chunk(nxt), nxt + 1
                take = left[: length - have]
                parts.append(take)
                have += len(take)
                left = left[len(take) :]
            yield doc, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_output_stream(path, compression=None) if mode == "w" else where.open_input_file(path)


def write_ids(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", end_id: int = END_ID) -> list:
    """Write the ids of every text in ascending order of ``id_col`` as files in ``folder``; return the manifest in order.

    One range of ids makes one file of about ``FILE_BYTES`` of text, or less where that makes fewer files than shuffle
    partitions; the manifest has one row a file. An attempt that is lost or repeated leaves a file that no manifest names. A null text has no ids but the end
    id; null ids come first; repeated ids stay, in order of their text; an empty table makes no file. Other columns are
    not read.
    """
    from pyspark import TaskContext

    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    end = np.asarray([end_id], "<u4").tobytes()

    def put(batches):
        enc, out, place = encoder(tokenizer), None, ""
        for b in slices(batches, limit=SLICE, rows=8192):
            if out is None:
                place = f"{folder}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tid"
                stream = _open(place, "w")
                out = Writer(stream, kind)
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                out.add(MISSING if doc is None else doc, bytes(ids) + end)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [place], "docs": [len(out.docs)], "ids": [out.total]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(ordered.mapInArrow(put, "part int, path string, docs long, ids long").collect(), key=lambda r: r["part"])


def read_ids(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, ``start`` counting the ids of all files before."""
    schema = "path string, base long"
    rows, base = [], 0
    for r in manifest:
        rows.append((r["path"], base))
        base += r["ids"]

    def get(batches):
        for b in batches:
            for place, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = ([], [], [], [])
                with _open(place, "r") as source:
                    for doc, ids in Reader(source).documents():
                        for column, x in zip(out, (None if doc == MISSING else doc, start, len(ids), zlib.crc32(ids.tobytes()))):
                            column.append(x)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, schema)
    return files.repartition(max(1, len(rows)), "path").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_files(df: DataFrame, tokenizer: str, kind: str = "byte") -> DataFrame:
    """Write all texts' ids and read the files back. An empty table gives an empty result."""
    spark = df.sparkSession
    return read_ids(spark, write_ids(df, shared_dir(spark), tokenizer, kind=kind))
