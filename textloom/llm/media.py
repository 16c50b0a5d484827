"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

store() writes every distinct payload once, as a member named by its SHA-256, into tar shards of about SHARD bytes in the shared folder.
Rows keep digest, shard, offset and length (of the stored bytes) instead of the payload. Payloads that deflate well are stored
deflated (encoding deflate), others as they are (identity). describe() then reads the first HEADER bytes of each member's range,
more only as long as a header says that it goes on, however far that is, and fills the metadata columns: PNG, GIF, BMP, JPEG, WAV and HTML (told by
the tag that it begins with, behind any white space, as browsers do).

A shard gets its name when it is complete and no name is used twice, so a task that runs again after a loss writes shards of its own
and its rows refer to those; what the lost attempt wrote stays unreferenced. Of equal payloads the row with the smallest key owns the
stored one; which rows own is settled on digests alone, payloads are not shuffled.

Defined cases: an empty table gives no rows; a null payload has null media columns; an empty one has a digest, length 0 and media type
application/x-empty; unknown bytes are application/octet-stream; a header that ends with the payload gives null metadata; payloads of any length are one
member (a shard is then longer); rows with equal keys and payloads, and other equal payloads, share a member, a null key is a key; the key may
have any name but those of the result's columns, which get it in its stead; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_IDS, cut, shared_dir

SHARD, HEADER = 64 << 20, 1024
WHERE = "digest string, shard string, offset bigint, length bigint, encoding string, size bigint"
ABOUT = "media_type string, width int, height int, channels int, sample_rate int, duration_s double, charset string, lang string, title string"
EMPTY = dict.fromkeys(c.split()[0] for c in ABOUT.split(", "))


class Shards:
    """Writes tar members and knows their offsets; a shard is moved to its name when it is closed."""

    def __init__(self, root: str, limit: int):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.uri, self.limit = root.rstrip("/"), limit
        self.rows: list[tuple] = []
        self.out = None

    def add(self, digest: str, payload: bytes) -> None:
        if self.out is None:
            self.name, self.at, self.rows = f"shard-{uuid.uuid4().hex}.tar", 0, []
            self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}.part")
        packed = zlib.compress(payload, 6)
        how, data = ("deflate", packed) if len(packed) < 0.9 * len(payload) else ("identity", payload)
        info = tarfile.TarInfo(digest + (".z" if how == "deflate" else ""))
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        self.rows.append((digest, f"{self.uri}/{self.name}", self.at + len(head), len(data), how, len(payload)))
        self.at += len(head) + len(data) + -len(data) % 512

    def full(self) -> bool:
        return self.out is not None and self.at >= self.limit

    def close(self) -> pa.RecordBatch | None:
        if self.out is None:
            return None
        self.out.write(b"\0" * 1024)
        self.out.close()
        self.out = None
        self.fs.move(f"{self.root}/.{self.name}.part", f"{self.root}/{self.name}")
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), kinds, strict=True)], [c.split()[0] for c in WHERE.split(", ")])


def _stored(batches: Iterator[pa.RecordBatch], root: str, limit: int) -> Iterator[pa.RecordBatch]:
    shards, seen = Shards(root, limit), set()
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            digest = hashlib.sha256(payload).hexdigest()
            if digest in seen:
                continue
            seen.add(digest)
            shards.add(digest, payload)
            if shards.full():
                yield shards.close()
    if (last := shards.close()) is not None:
        yield last


def _range(files: dict, shard: str, offset: int, length: int) -> bytes:
    if shard not in files:
        for f in files.values():
            f.close()
        files.clear()
        source, path = fs.FileSystem.from_uri(shard)
        files[shard] = source.open_input_file(path)
    files[shard].seek(offset)
    return files[shard].read(length)


def header(data: bytes) -> dict | None:
    """Metadata from a payload's first bytes; None if more bytes are needed to tell."""
    out = dict(EMPTY)
    if not data:
        return out | {"media_type": "application/x-empty"}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if len(data) >= 26:
            w, h, _, colour = struct.unpack(">IIBB", data[16:26])
            out |= {"width": w, "height": h, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)}
        return out | {"media_type": "image/png"}
    if data[:6] in (b"GIF87a", b"GIF89a"):
        if len(data) >= 10:
            out["width"], out["height"] = struct.unpack("<HH", data[6:10])
        return out | {"media_type": "image/gif"}
    if data[:2] == b"BM" and len(data) >= 30 and data[14:18] in (b"\x28\0\0\0", b"\x6c\0\0\0", b"\x7c\0\0\0"):
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return out | {"media_type": "image/bmp", "width": w, "height": abs(h), "channels": max(1, bits // 8)}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at = 12
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if name == b"fmt " and at + 24 <= len(data):
                out["channels"], out["sample_rate"], rate = struct.unpack("<HII", data[at + 10 : at + 20])
            elif name == b"data":
                out["duration_s"] = round(size / rate, 6) if out["sample_rate"] and rate else None
                return out | {"media_type": "audio/wav"}
            at += 8 + size + size % 2
        return None
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                return out | {"media_type": "image/jpeg"}
            mark = data[at + 1]
            if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD8:  # filling, or a marker without a length
                at += 1 + (mark != 0xFF)
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                if at + 10 > len(data):
                    return None
                out["height"], out["width"], out["channels"] = struct.unpack(">HHB", data[at + 5 : at + 10])
                return out | {"media_type": "image/jpeg"}
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    begin = next((k for k, c in enumerate(data) if c not in b" \t\r\n\f"), None) if data[0] in b" \t\r\n\f" else 0
    if begin is None or _may_be_html(data, begin):
        return None
    if _HTML.match(data, begin):
        text = data.decode("utf-8", "ignore")
        if not re.search(r"</title|<body|</head", text, re.I):
            return None
        pick = lambda p: (m := re.search(p, text, re.I | re.S)) and m[1].strip()
        return out | {"media_type": "text/html", "charset": pick(r"<meta[^>]*?charset=[\"']?([\w-]+)"), "lang": pick(r"<html[^>]*?\blang=[\"']?([\w-]+)"), "title": pick(r"<title[^>]*>(.*?)</title")}
    return out | {"media_type": "application/octet-stream"}


_HTML = re.compile(rb"(?:\xef\xbb\xbf\s*)?<(?:!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p|meta|link|!--)(?=[\s>/-])|(?:\xef\xbb\xbf\s*)?<!--", re.I)


def _may_be_html(data: bytes, begin: int) -> bool:
    """Whether the bytes end before they can tell a tag."""
    return len(data) - begin < 20 and (data[begin : begin + 1] == b"<" or data[begin : begin + 3] == b"\xef\xbb\xbf")


def whole(data: bytes) -> dict:
    """Metadata of a payload whose header isn't complete though all of it was read."""
    if data[:4] == b"RIFF":
        return EMPTY | {"media_type": "audio/wav"}
    if data[:3] == b"\xff\xd8\xff":
        return EMPTY | {"media_type": "image/jpeg"}
    if _HTML.match(data.lstrip()):
        return header(data + b"</head>") or EMPTY | {"media_type": "text/html"}
    return EMPTY | {"media_type": "application/octet-stream"}


def _inflated(data: bytes, encoding: str) -> bytes:
    """What the (maybe incomplete) stored bytes hold of the payload's beginning."""
    return zlib.decompressobj().decompress(data) if encoding == "deflate" else data


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict = {}
    kind = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in ABOUT.split(", ")])
    for batch in batches:
        found = []
        for shard, offset, length, how in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "encoding")), strict=True):
            n, about = HEADER, None
            while about is None:
                data = _inflated(_range(files, shard, offset, min(n, length)), how)
                about = header(data)
                if about is None and n >= length:
                    about = whole(data)
                n *= 4
            found.append(about)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[c] for f in found], kind.field(c).type) for c in kind.names]], [*batch.schema.names, *kind.names])


def store(table: DataFrame, key: str, payload: str, shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(rows, members): rows has key and digest of each row; members has digest, shard, offset, length, encoding, size."""
    src = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    rows = cut(src.select("key", F.sha2("payload", 256).alias("digest")), "digests")
    # a copy is a row whose digest has a smaller key elsewhere; within equal keys the writing task sees to it
    copies = cut(rows.where("digest is not null").groupBy("digest").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner"), "copies")
    n = copies.count()
    todo = src.where("payload is not null")
    if n:
        hashed = todo.withColumn("digest", F.sha2("payload", 256))
        todo = hashed.join(F.broadcast(copies) if n <= BROADCAST_IDS else copies, "digest", "left").where("owner is null or owner <=> key").select("payload")
    else:
        todo = todo.select("payload")
    root = os.path.join(shared_dir(table.sparkSession), f"media-{uuid.uuid4().hex}")
    target, path = fs.FileSystem.from_uri(root)
    target.create_dir(path, recursive=True)
    members = cut(todo.mapInArrow(lambda it: _stored(it, root, shard_bytes), WHERE), "members")
    return rows, members.dropDuplicates(["digest"]) if n else members


def describe(members: DataFrame) -> DataFrame:
    """members with the metadata columns."""
    return members.mapInArrow(_described, f"{WHERE}, {ABOUT}")


def media_columns(table: DataFrame, key: str, payload: str, shard_bytes: int = SHARD) -> DataFrame:
    """key, digest, shard, offset, length, encoding, size and the metadata columns of every row of table."""
    rows, members = store(table, key, payload, shard_bytes)
    names = [c.split()[0] for c in f"{WHERE}, {ABOUT}".split(", ")]
    return rows.join(describe(members), "digest", "left").select(F.col("key").alias(key), *[c for c in names if c != key.lower()])


def fetch(rows: DataFrame, key: str) -> DataFrame:
    """key and payload, read back from the shards (null where the digest of what was read is another)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            out = []
            for digest, shard, offset, length, how in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "encoding")), strict=True):
                data = _inflated(_range(files, shard, offset, length), how) if shard else None
                out.append(data if data is not None and hashlib.sha256(data).hexdigest() == digest else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], [key, "payload"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "digest", "shard", "offset", "length", "encoding").mapInArrow(read, f"`{key}` {kind}, payload binary")
