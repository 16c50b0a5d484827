"""Writers. All write a folder with a file for each task; none gathers rows on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_file(counts: DataFrame, path: str, name: str = "feature", n: str = "cnt") -> None:
    """name and count, tab-separated, by descending count and name."""
    counts.orderBy(F.desc(n), F.desc(name)).select(name, n).write.mode("overwrite").option("sep", "\t").csv(path)


def search_report(hits: DataFrame, docs: DataFrame, path: str, shown: str = "url") -> None:
    """For each query a line of the query, one of the number of documents and one for each document, in the order of doc_id.

    The lines are sorted, not gathered: a query that most documents match is many rows."""
    lines = hits.select("query", F.lit(2).alias("k"), "doc_id").join(docs.select("doc_id", F.col(shown).cast("string").alias("value")), "doc_id").select("query", "k", "doc_id", "value")
    n = lines.groupBy("query").agg(F.count("*").cast("string").alias("n"))
    heads = n.select("query", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("query").alias("value")), F.struct(F.lit(1).alias("k"), F.col("n").alias("value")))).alias("h"))
    rows = lines.unionAll(heads.select("query", "h.k", F.lit(None).cast("bigint"), "h.value"))
    rows.repartitionByRange("query", "k", "doc_id").sortWithinPartitions("query", "k", "doc_id").select("value").write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def matrix_text(df: DataFrame, array: str, path: str, sep: str = "\t") -> None:
    df.select(F.array_join(F.transform(array, lambda x: x.cast("string")), sep).alias("value")).write.mode("overwrite").text(path)


def som_vectors(df: DataFrame, array: str, name: str, path: str) -> None:
    """The vector file of a self-organising map: a header of type, rows, columns and width, then values and name. Header and rows are sorted apart."""
    n, width = df.count(), df.select(F.max(F.size(array))).first()[0] or 0
    head = df.sparkSession.createDataFrame([(k, s) for k, s in enumerate(["$TYPE vec", f"$XDIM {n}", "$YDIM 1", f"$VEC_DIM {width}"])], "k int, value string")
    rows = df.select(F.lit(9).alias("k"), F.concat_ws(" ", F.transform(array, lambda x: x.cast("string")), F.col(name)).alias("value"))
    head.unionAll(rows).repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def forward_index(df: DataFrame, path: str, order: str = "little") -> None:
    """(doc, words) as binary records, a file for each partition, named by what it holds so that a task run again writes the same name."""
    mark = "<" if order == "little" else ">"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where, recursive=True)
        name, n = f"{where}/part-{uuid.uuid4().hex}.bin", 0
        out = None
        for b in batches:
            for doc, words in zip(b["doc"], b["words"], strict=True):
                out = out or system.open_output_stream(name + ".part")
                w = np.asarray(words, mark + "u8")
                out.write(np.array([doc], mark + "u8").tobytes() + np.array([len(w)], mark + "u4").tobytes() + w.tobytes())
                n += 1
        if out:
            out.close()
            system.move(name + ".part", name)
            yield pd.DataFrame({"file": [name], "n": [n]})

    df.select("doc", "words").mapInPandas(write, "file string, n bigint").collect()


def inverted_index(lists: DataFrame, path: str) -> None:
    """(word, docs) as binary files, one for each task: (word, offset) pairs up to (0, 0), then the lists at their offsets, each its length and documents."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        words, docs = [], []
        for b in batches:
            words += b["word"].to_list()
            docs += [np.array([len(d)], "<u4").tobytes() + np.asarray(d, "<u8").tobytes() for d in b["docs"]]
        if words:
            system, where = fs.FileSystem.from_uri(path)
            system.create_dir(where, recursive=True)
            at = 16 * (len(words) + 1) + np.cumsum([0, *map(len, docs)])[:-1]
            name = f"{where}/part-{uuid.uuid4().hex}.idx"
            with system.open_output_stream(name + ".part") as out:
                out.write(np.array([*zip(words, at.tolist(), strict=True), (0, 0)], "<u8").tobytes() + b"".join(docs))
            system.move(name + ".part", name)
            yield pd.DataFrame({"file": [name], "n": [len(words)]})

    lists.select("word", "docs").mapInPandas(write, "file string, n bigint").collect()


def save_model(model, path: str) -> None:
    """A fitted Spark ML model, or a numpy network of operators.neural."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
        return
    import io
    import json

    from pyarrow import fs

    kept = {k: v for k, v in vars(model).items() if not isinstance(v, np.random.Generator)}
    arrays = {f"{k}.{i}": a for k, v in kept.items() if isinstance(v, list) and v and isinstance(v[0], np.ndarray) for i, a in enumerate(v)} | {k: v for k, v in kept.items() if isinstance(v, np.ndarray)}
    plain = {k: v for k, v in kept.items() if not any(a == k or a.startswith(f"{k}.") for a in arrays)}
    data = io.BytesIO()
    np.savez(data, plain=np.frombuffer(json.dumps({"kind": type(model).__name__} | plain).encode(), np.uint8), **arrays)
    system, where = fs.FileSystem.from_uri(path)
    with system.open_output_stream(where) as out:
        out.write(data.getvalue())


def load_network(path: str):
    """A network that save_model() wrote."""
    import io
    import json

    from pyarrow import fs

    from textloom.operators import neural

    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        got = dict(np.load(io.BytesIO(f.read()), allow_pickle=False))
    values = json.loads(got.pop("plain").tobytes())
    lists: dict[str, dict[int, np.ndarray]] = {}
    for k, a in got.items():
        name, _, i = k.partition(".")
        if i:
            lists.setdefault(name, {})[int(i)] = a
        else:
            values[k] = a
    values |= {k: [v[i] for i in sorted(v)] for k, v in lists.items()}
    return {"Net": neural.Net, "Rbm": neural.Rbm}[values.pop("kind")](**values)


def dump_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of counts under its name, as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_statistics(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
