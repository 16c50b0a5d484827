"""Posting lists in binary files with a dictionary and jumps, and reading a term back without reading the rest.

Each task writes one file of coded lists and, as Parquet, the dictionary rows of what it wrote: term, block, df, file, offset, length and jumps. A list is coded in
chunks of SKIP documents; a jump is the last document before a chunk and the chunk's place, so that a reader that wants documents from some identifier on
begins at the chunk that may hold it. A file gets its name when it is complete and no name is used twice: the dictionary of a task that runs again refers to
its own file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codecs

SKIP = 50
CODECS = {"varbyte": (codecs.varbyte, codecs.from_varbyte), "simple9": (codecs.simple9, codecs.from_simple9)}
ENTRY = "term string, block bigint, df bigint, file string, offset bigint, length bigint, jumps array<struct<doc:bigint,at:bigint>>"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def write(posting: DataFrame, path: str, codec: str = "varbyte", skip: int = SKIP) -> None:
    """Writes posting (term, block, df, docs) to the folder path."""
    encode = CODECS[codec][0]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = _system(path)
        system.create_dir(f"{where}/lists", recursive=True)
        name, at, out = f"{where}/lists/{uuid.uuid4().hex}.{codec}", 0, None
        rows = []
        for b in batches:
            for term, block, df, docs in zip(b["term"], b["block"], b["df"], b["docs"], strict=True):
                out = out or system.open_output_stream(name + ".part")
                docs = np.asarray(docs, np.int64)
                gaps, parts, jumps, size = np.diff(docs, prepend=0), [], [], 0
                for k in range(0, len(docs), skip):
                    jumps.append({"doc": int(docs[k - 1]) if k else 0, "at": size})
                    parts.append(encode(gaps[k : k + skip]))
                    size += len(parts[-1])
                out.write(b"".join(parts))
                rows.append((term, block, df, name, at, size, jumps))
                at += size
        if out:
            out.close()
            system.move(name + ".part", name)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("term", "block", "df", "file", "offset", "length", "jumps")])

    ordered = posting.repartitionByRange("term").sortWithinPartitions("term", "block")
    ordered.select("term", "block", "df", "docs").mapInPandas(lists, ENTRY).write.mode("overwrite").parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, *terms: str, first: int = 0) -> DataFrame:
    """term, doc_id of the terms (of all, if none is named) from document `first` on: by range reads of their lists, from the jump before `first`."""
    entries = spark.read.schema(ENTRY).parquet(f"{path}/dictionary")
    entries = entries.where(F.col("term").isin(*terms)) if terms else entries

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict = {}
        for b in batches:
            out = []
            for e in b.itertuples():
                if e.file not in files:
                    for f in files.values():
                        f.close()
                    files.clear()
                    system, where = _system(e.file)
                    files[e.file] = system.open_input_file(where)
                jumps = [(j["doc"], j["at"]) for j in e.jumps]
                k = max(0, np.searchsorted([d for d, _ in jumps], first, "left") - 1)
                files[e.file].seek(e.offset + jumps[k][1])
                data = files[e.file].read(e.length - jumps[k][1])
                decode = CODECS[e.file.rpartition(".")[2]][1]
                ends = [a - jumps[k][1] for _, a in jumps[k:]] + [len(data)]
                docs = np.cumsum(np.concatenate([decode(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)])) + jumps[k][0]
                out.append((e.term, docs[docs >= first]))
            yield pd.DataFrame(out, columns=["term", "docs"])

    return entries.mapInPandas(lists, "term string, docs array<bigint>").select("term", F.explode("docs").alias("doc_id"))
