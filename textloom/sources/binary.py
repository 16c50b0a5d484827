"""Binary formats as Spark data sources: length-framed documents, forward and inverted indexes, IDX matrices.

Each file is a partition, read as a stream in bounded batches; no file is held whole. Paths may be folders, files or lists with commas.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 1000


def _open(path: str) -> BinaryIO:
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    raw = system.open_input_stream(where, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _files(paths: str) -> list[str]:
    out = []
    for p in paths.split(","):
        system, where = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("/") else (fs.LocalFileSystem(), p)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            out += sorted(f.path for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        else:
            out.append(where)
    return out


def _exactly(f: BinaryIO, n: int) -> bytes | None:
    """n bytes, or None at the end of the file; a file that ends within them is broken."""
    parts = b""
    while len(parts) < n:
        more = f.read(n - len(parts))
        if not more:
            if parts:
                raise ValueError("the file ends within a record")
            return None
        parts += more
    return parts


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> dict[int, bytes]:
    """The length-delimited fields of a protobuf message, the last of each number; others are skipped."""
    out, at = {}, 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 2:
            n, at = varint(data, at)
            out[tag >> 3] = data[at : at + n]
            at += n
        elif kind == 0:
            _, at = varint(data, at)
        else:
            at += {1: 8, 5: 4}[kind]
    return out


def document(url: str, body: str | None = None, text: str | None = None) -> bytes:
    """A framed document: 4-byte length and the message (1: url, 2: body, 3: text)."""

    def size(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    msg = b""
    for k, v in ((1, url), (2, body), (3, text)):
        if v is not None:
            data = v.encode()
            msg += bytes([k << 3 | 2]) + size(len(data)) + data
    return struct.pack("<i", len(msg)) + msg


@dataclass
class File(InputPartition):
    path: str
    number: int


class _Reader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths = paths

    def partitions(self) -> list[File]:
        return [File(p, k) for k, p in enumerate(_files(self.paths))]

    def rows(self, f: BinaryIO, part: File) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        with _open(partition.path) as f:
            for row in self.rows(f, partition):
                held.append(row)
                if len(held) >= BATCH:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.kinds, strict=True)], self.names)


class _Documents(_Reader):
    names, kinds = ["file", "pos", "url", "body", "text"], [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(self, f, part):
        pos = 0
        while (head := _exactly(f, 4)) is not None:
            got = fields(_exactly(f, struct.unpack("<i", head)[0]) or b"")
            yield (part.number, pos, *(got[k].decode("utf-8", "replace") if k in got else None for k in (1, 2, 3)))
            pos += 1


class _Forward(_Reader):
    names, kinds = ["doc", "words"], [pa.int64(), pa.list_(pa.int64())]

    def __init__(self, paths: str, order: str):
        super().__init__(paths)
        self.order = order

    def rows(self, f, part):
        while (head := _exactly(f, 12)) is not None:
            doc, n = struct.unpack(self.order + "QI", head)
            yield doc, list(struct.unpack(f"{self.order}{n}Q", _exactly(f, 8 * n) or b""))


class _Inverted(_Reader):
    """The dictionary comes first: (word, offset) pairs up to (0, 0), then for each word a list of documents."""

    names, kinds = ["word", "docs"], [pa.int64(), pa.list_(pa.int64())]

    def rows(self, f, part):
        words = []
        while True:
            word, at = struct.unpack("<QQ", _exactly(f, 16) or bytes(16))
            if not at:
                break
            words.append((at, word))
        for _, word in sorted(words):
            (n,) = struct.unpack("<I", _exactly(f, 4))
            yield word, list(struct.unpack(f"<{n}Q", _exactly(f, 8 * n) or b""))


class _Idx(_Reader):
    names, kinds = ["file", "pos", "values"], [pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def rows(self, f, part):
        _, _, kind, dims = _exactly(f, 4)
        if kind != 8:
            raise ValueError("only IDX files of unsigned bytes are read")
        shape = struct.unpack(f">{dims}I", _exactly(f, 4 * dims))
        width = 1
        for d in shape[1:]:
            width *= d
        for k in range(shape[0]):
            yield part.number, k, list(_exactly(f, width))


class FramedDocuments(DataSource):
    """format("framed_documents"): file, pos, url, body, text; gzip by suffix."""

    @classmethod
    def name(cls) -> str:
        return "framed_documents"

    def schema(self) -> str:
        return "file int, pos bigint, url string, body string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options["path"])


class ForwardIndex(DataSource):
    """format("forward_index"): doc, words; option order: little (default) or big."""

    @classmethod
    def name(cls) -> str:
        return "forward_index"

    def schema(self) -> str:
        return "doc bigint, words array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _Forward(self.options["path"], ">" if self.options.get("order") == "big" else "<")


class InvertedIndex(DataSource):
    """format("inverted_index"): word, docs."""

    @classmethod
    def name(cls) -> str:
        return "inverted_index"

    def schema(self) -> str:
        return "word bigint, docs array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _Inverted(self.options["path"])


class Idx(DataSource):
    """format("idx"): file, pos, values (unsigned bytes, flat)."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "file int, pos bigint, values array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Idx(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (FramedDocuments, ForwardIndex, InvertedIndex, Idx):
        spark.dataSource.register(source)


def documents(spark: SparkSession, *paths: str, first_id: int = 1) -> DataFrame:
    """doc_id, url, body, text of framed archives; ids go on from one archive to the next in the order of (file, pos)."""
    from pyspark.sql import functions as F

    from textloom.operators.invert import ranked

    register(spark)
    rows = spark.read.format("framed_documents").load(",".join(paths))
    return ranked(rows, "file", "pos").select((F.col("rank") - 1 + first_id).alias("doc_id"), "url", "body", "text")
