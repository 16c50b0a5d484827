"""Text formats: lines, tab fields, label and features, delimited and matrix files, JSON lines, base64 pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.pages import base64_pages
from textloom.operators.spell import query_log

lines = lambda spark, path: spark.read.text(path)


def tab_pairs(spark: SparkSession, path: str) -> DataFrame:
    """raw, fixed: one or two fields a line."""
    return query_log(spark.read.text(path))


def labelled_rows(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """label, features from lines whose first field is the label; a field that isn't a number is null and keeps its place."""
    p = F.filter(F.split(F.trim("value"), sep), lambda x: x != "")
    num = F.transform(p, lambda x: x.try_cast("double"))
    return spark.read.text(path).select(num.alias("n")).where(F.size("n") > 0).select(F.col("n")[0].alias("label"), F.slice("n", F.lit(2), F.size("n")).alias("features"))


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False, sep: str = ",") -> DataFrame:
    r = spark.read.option("header", header).option("sep", sep)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row: array<double> of each line's white-space-separated numbers; lines that begin with # are comments."""
    return spark.read.text(path).where("value rlike '^\\\\s*[^#\\\\s]'").select(F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.cast("double")).alias("row"))


def json_lines(spark: SparkSession, path: str, schema: str = "Paragraph string, Sentences array<string>") -> DataFrame:
    return spark.read.schema(schema).json(path)


def encoded_pages(spark: SparkSession, path: str) -> DataFrame:
    return base64_pages(spark.read.text(path))


def som_vectors(spark: SparkSession, path: str, header: str = "[$]") -> DataFrame:
    """v, name from lines of numbers and a label; lines of the header are left out."""
    rows = spark.read.text(path).where(~F.col("value").rlike(f"^{header}")).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 1)
    return rows.select(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x.cast("double")).alias("v"), F.element_at("p", -1).alias("name"))


def backends(spark: SparkSession, path: str) -> DataFrame:
    """place, value of a configuration file's white-space-separated values: a port, then the backends."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.filter(F.split("value", "\\s+"), lambda x: x != "")).alias("place", "value"))


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, row, values of .npy files of one or two dimensions, a file a task. Files with objects in them, which would run code when read, are refused."""

    def rows(batches):
        import io

        import numpy as np

        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(data), allow_pickle=False).astype(float))
                yield pd.DataFrame({"file": name, "row": np.arange(len(a)), "values": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, row bigint, values array<double>")


def bitmap(data: bytes) -> list[int] | None:
    """Grey values of an uncompressed bitmap of 8, 24 or 32 bits a pixel, row by row from the top; None for other data."""
    import struct

    import numpy as np

    if len(data) < 54 or data[:2] != b"BM":
        return None
    at, head, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (8, 24, 32) or packed not in (0, 3) or w <= 0 or not h:
        return None
    step = (w * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, step * abs(h), at).reshape(abs(h), step)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (at - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        pixels = colours[pixels[:, :, 0]] if len(colours) else np.repeat(pixels, 3, axis=2)
    grey = np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(int)
    return (grey if h < 0 else grey[::-1]).ravel().tolist()


def bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """path, values: the grey values of each bitmap file, flat."""
    @F.pandas_udf("array<int>")
    def read(data: pd.Series) -> pd.Series:
        return data.map(bitmap)

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("values"))
