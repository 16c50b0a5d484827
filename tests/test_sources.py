import gzip
import random
import struct

import numpy as np
import pytest

from textloom.operators import index
from textloom.sources import binary, files, postings, sinks
from textloom.streaming import kv as stream
from textloom.streaming.sources import admit_batch


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_framed_documents_number_on(spark, tmp_path):
    a = put(tmp_path / "a.bin", b"".join(binary.document(f"u{k}", None, f"text {k} ñ" * 40) for k in range(3)))
    b = put(tmp_path / "b.gz", gzip.compress(binary.document("v", "body", None)))
    rows = sorted(binary.documents(spark, a, b).collect())
    assert [(r.doc_id, r.url) for r in rows] == [(1, "u0"), (2, "u1"), (3, "u2"), (4, "v")]
    assert rows[0].text.startswith("text 0 ñ") and rows[0].body is None and rows[3].body == "body"


def test_broken_frame(spark, tmp_path):
    p = put(tmp_path / "x.bin", binary.document("u", "b", "t")[:-1])
    with pytest.raises(Exception):
        binary.documents(spark, p).collect()


def test_forward_index_round_trip(spark, tmp_path):
    rows = [(k, list(range(k))) for k in range(5)]
    df = spark.createDataFrame(rows, "doc bigint, words array<bigint>")
    binary.register(spark)
    for order in ("little", "big"):
        sinks.forward_index(df, str(tmp_path / order), order)
        got = spark.read.format("forward_index").option("order", order).load(str(tmp_path / order)).collect()
        assert sorted((r.doc, r.words) for r in got) == rows


def test_inverted_index_and_idx(spark, tmp_path):
    body = [struct.pack("<I2Q", 2, 1, 5), struct.pack("<IQ", 1, 9)]
    at = 16 * 3
    head = struct.pack("<6Q", 7, at, 8, at + len(body[0]), 0, 0)
    p = put(tmp_path / "inv", head + b"".join(body))
    binary.register(spark)
    assert {r.word: r.docs for r in spark.read.format("inverted_index").load(p).collect()} == {7: [1, 5], 8: [9]}
    q = put(tmp_path / "idx", bytes([0, 0, 8, 3]) + struct.pack(">3I", 2, 2, 2) + bytes(range(8)))
    assert [r["values"] for r in spark.read.format("idx").load(q).orderBy("pos").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_text_formats(spark, tmp_path):
    p = put(tmp_path / "log", "teh\tthe\nright\n")
    assert [(r.raw, r.fixed) for r in files.tab_pairs(spark, p).collect()] == [("teh", "the"), ("right", None)]
    p = put(tmp_path / "lab", "1 0.5 2\n0 3 x 4\n\n")
    assert [(r.label, r.features) for r in files.labelled_rows(spark, p).collect()] == [(1.0, [0.5, 2.0]), (0.0, [3.0, None, 4.0])]
    p = put(tmp_path / "mat", "# c\n1 2\n 3  4\n")
    assert [r.row for r in files.matrix(spark, p).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    p = put(tmp_path / "js", '{"Paragraph": "a. b", "Sentences": ["a.", "b"]}\n')
    assert files.json_lines(spark, p).first().Sentences == ["a.", "b"]
    p = put(tmp_path / "b64", "7 1 http://x PHA+aGk8L3A+\nshort line\n")
    r = files.encoded_pages(spark, p).collect()
    assert len(r) == 1 and (r[0].id, r[0].mark, r[0].html) == (7, 1, "<p>hi</p>")
    p = put(tmp_path / "csv", "1,2.5\n2,3.5\n")
    assert files.csv(spark, p, "k int, x double").count() == 2


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 2), ("b", 5), ("c", 5)], "feature string, cnt bigint")
    sinks.counts_file(d, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["c\t5", "b\t5", "a\t2"]
    v = spark.createDataFrame([([1.0, 2.0], "n")], "v array<double>, name string")
    sinks.som_vectors(v, "v", "name", str(tmp_path / "s"))
    assert [(r.v, r.name) for r in files.som_vectors(spark, str(tmp_path / "s")).collect()] == [([1.0, 2.0], "n")]
    docs = spark.createDataFrame([(1, "a b", "u1"), (2, "a", "u2")], "doc_id bigint, text string, url string")
    hits = spark.createDataFrame([("a", 1), ("a", 2)], "query string, doc_id bigint")
    sinks.search_report(hits, docs, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "2", "u1", "u2"]
    index.store(docs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/postings")).where("term = 'a'").first().docs == [1, 2]
    sinks.matrix_text(v, "v", str(tmp_path / "m"))
    assert files.matrix(spark, str(tmp_path / "m")).first().row == [1.0, 2.0]
    sinks.json_lines(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_streamed_admission(spark, tmp_path):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "arrival bigint, cluster string")
    rows.write.parquet(str(tmp_path / "in"))
    quotas = spark.createDataFrame([("a", 1.5), ("b", 3.0)], "cluster string, quota double")
    src = spark.readStream.schema("arrival bigint, cluster string").parquet(str(tmp_path / "in"))
    got = stream.run_once(spark, admit_batch(quotas, src), 120).where("accepted").collect()
    assert sorted(r.arrival for r in got) == [0, 1, 2, 3, 5]


@pytest.mark.parametrize("codec", ["varbyte", "simple9"])
def test_posting_files(spark, tmp_path, codec):
    rng = random.Random(7)
    lists = {f"t{k}": sorted(rng.sample(range(1, 5000), rng.choice([1, 49, 50, 51, 400]))) for k in range(12)}
    path = str(tmp_path / "post")
    postings.write(spark.createDataFrame([(t, 0, len(d), d) for t, d in lists.items()], "term string, block bigint, df bigint, docs array<bigint>"), path, codec)
    got = {}
    for r in postings.read(spark, path).collect():
        got.setdefault(r.term, []).append(r.doc_id)
    assert {t: sorted(d) for t, d in got.items()} == lists
    for first in (0, lists["t3"][0], 2500, 9999):
        assert sorted(r.doc_id for r in postings.read(spark, path, "t3", first=first).collect()) == [d for d in lists["t3"] if d >= first]
    assert postings.read(spark, path, "none").count() == 0


def test_inverted_index_sink(spark, tmp_path):
    lists = [(7, [1, 5]), (8, [9]), (2**40, [3, 2**50])]
    sinks.inverted_index(spark.createDataFrame(lists, "word bigint, docs array<bigint>").repartition(2), str(tmp_path / "inv"))
    binary.register(spark)
    assert {r.word: r.docs for r in spark.read.format("inverted_index").load(str(tmp_path / "inv")).collect()} == dict(lists)


def test_arrays_bitmaps_and_settings(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(2, 3))
    assert [(r.row, r["values"]) for r in files.arrays(spark, str(tmp_path / "a.npy")).orderBy("row").collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    pixels = bytes([0, 0, 255, 0, 255, 0, 0, 0]) + bytes([255, 0, 0, 255, 255, 255, 0, 0])  # two rows of two, filled up to 4 bytes
    for height, want in ((2, [29, 255, 76, 150]), (-2, [76, 150, 29, 255])):
        put(tmp_path / "b.bmp", b"BM" + struct.pack("<IHHI", 70, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, height, 1, 24, 0, 16, 0, 0, 0, 0) + pixels)
        assert files.bitmaps(spark, str(tmp_path / "b.bmp")).first()["values"] == want
    assert files.bitmap(b"nothing") is None
    p = put(tmp_path / "conf", "8080\nhost1:1  host2:2\n")
    assert [(r.place, r.value) for r in files.backends(spark, p).collect()] == [(0, "8080"), (1, "host1:1"), (2, "host2:2")]


def test_models_and_statistics_come_back(spark, tmp_path):
    from pyspark.ml.regression import DecisionTreeRegressionModel

    from textloom.operators import neural, trees

    net = neural.Net([3, 2, 3], seed=4)
    rbm = neural.Rbm(2, rate=0.5).prepared(3)
    x = np.ones((2, 3))
    sinks.save_model(net, str(tmp_path / "net.npz"))
    sinks.save_model(rbm, str(tmp_path / "rbm.npz"))
    assert np.array_equal(sinks.load_network(str(tmp_path / "net.npz")).layers(x)[-1], net.layers(x)[-1])
    again = sinks.load_network(str(tmp_path / "rbm.npz"))
    assert np.array_equal(again.up(x), rbm.up(x)) and again.rate == 0.5
    v = trees.vectors(spark.createDataFrame([(k, [float(k)], k % 2) for k in range(20)], "id bigint, x array<double>, y int"), "id", "x", "y")
    model = trees.cart().fit(v)
    sinks.save_model(model, str(tmp_path / "cart"))
    assert DecisionTreeRegressionModel.load(str(tmp_path / "cart")).toDebugString == model.toDebugString
    sinks.dump_statistics({"n": spark.range(3)}, str(tmp_path / "stats"))
    assert sinks.load_statistics(spark, str(tmp_path / "stats"), "n")["n"].count() == 3


def test_generators_are_the_same_for_any_number_of_tasks(spark):
    from textloom.operators import generators as g

    for make in (lambda: g.integers(spark, 50, 9), lambda: g.forward_documents(spark, 20, 30), lambda: g.urls(spark, 30)):
        a = make()
        assert sorted(map(str, a.collect())) == sorted(map(str, a.repartition(3).collect())) and a.count() in (50, 20, 30)
    assert g.urls(spark, 9).where("url rlike '^http://host[0-9]+.org/[a-z]+[0-9]+(/[a-z]+[0-9]+){0,3}([?]page=[0-9])?$'").count() == 9
