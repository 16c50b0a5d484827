"""Hand-made rows for each quirk, against values worked out by hand or by brute force."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.words import splitter, word_edges
from textloom.operators import boolquery, index, invert, kv, neardup, segment, sentences, spell, stats, urlfeatures
from textloom.streaming.sources import search_stream, socket_sink, table_stream

DOCS = "doc_id bigint, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), DOCS)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def idx(spark, tmp_path_factory):
    return index.store(docs(spark, "a b", "b c", "c d A", None, ""), str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize(
    "query,want",
    [("a", [1, 3]), ("a & c", [3]), ("!a", [2, 4, 5]), ("!(!a)", [1, 3]), ("a | b & c", [1, 2, 3]), ("(a | b) & c", [2, 3]), ("zzz", []), ("a & !zzz", [1, 3]), ("!(a | b)", [4, 5]), ("!a & !b", [4, 5]), ("!!a", [1, 3]), ("A", [1, 3])],
)
def test_boolean_search(idx, query, want):
    assert ids(boolquery.search(idx, query)) == want


def test_boolean_compat_leaves_the_last_document_out(idx):
    assert ids(boolquery.search(idx, "!a", compat=True)) == [2, 4]
    assert ids(boolquery.search(idx, "!(!a)", compat=True)) == [2, 4]


@pytest.mark.parametrize("query", ["a b", "", "a &", "(a", "a)", "& a", "!"])
def test_malformed_queries(query):
    with pytest.raises(ValueError):
        boolquery.parse(query)


def test_batch_search_equals_single(spark, tmp_path):
    d = docs(spark, "a b", "b c", "c d A", "x", "", None)
    one = index.store(d, str(tmp_path))
    asked = ["a", "!a & b", "(a | b) & !c", "!zzz"]
    want = {(q, k) for q in asked for k in ids(boolquery.search(one, q))}
    for at_once in (64, 1):
        assert {(r.query, r.doc_id) for r in boolquery.search_many(one, asked, at_once).collect()} == want
    assert {(r.query, r.doc_id) for r in boolquery.scan_many(d, asked).collect()} == want
    assert boolquery.search_many(one, []).count() == 0 and one.df("a", "zzz") == {"a": 2}


def test_a_leaf_reads_only_its_term(idx):
    plan = idx.docs("a")._jdf.queryExecution().toString()
    assert "EqualTo(term,a)" in plan.split("PushedFilters")[1]


def test_stream_of_queries(spark, idx, tmp_path):
    spark.createDataFrame([("a",), ("!a & b",), ("a &",), (None,), ("a",)], "query string").write.parquet(str(tmp_path / "q.parquet"))
    asked = table_stream(spark, str(tmp_path), "q")
    assert sorted((r.query, r.n) for r in search_stream(asked, idx, str(tmp_path / "out")).collect()) == [("!a & b", 1), ("a", 2), ("a &", None)]


def test_lines_are_sent_to_a_socket(spark):
    import socket
    import threading

    got, server = [], socket.create_server(("127.0.0.1", 0))

    def listen():
        server.settimeout(30)
        while b"".join(got).count(b"\n") < 3:
            c, _ = server.accept()
            while part := c.recv(4096):
                got.append(part)

    t = threading.Thread(target=listen)
    t.start()
    socket_sink("127.0.0.1", server.getsockname()[1])(spark.createDataFrame([("one",), ("two",), (None,), ("three",)], "line string"), 0)
    t.join(30)
    server.close()
    assert sorted(b"".join(got).split()) == [b"one", b"three", b"two"]


def test_expired_state_is_dropped(spark, tmp_path):
    """Two runs of one stream: values that ended before the watermark are no rows of the state store any more."""
    from textloom.streaming import kv as stream

    stream.use_rocksdb(spark)
    at = datetime(2024, 1, 1)
    kind = "event_id bigint, ts timestamp, key bigint, op string, value double, ttl int"
    out, first = str(tmp_path / "out"), [(k, at + timedelta(seconds=k), k, "set", float(k), 0 if k == 7 else 60) for k in range(20)]
    later = [(100, at + timedelta(days=2), 50, "set", 1.0, 60), (101, at + timedelta(days=2), 7, "get", None, None), (102, at + timedelta(days=2), 3, "get", None, None)]
    last = [(200, at + timedelta(days=4), 60, "set", 1.0, 60), (201, at + timedelta(days=4, seconds=1), 60, "get", None, None)]
    answers = []
    for k, rows in enumerate((first, later, last)):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in/*"))
        answers = stream.run_once(spark, stream.answers(source), path=out).collect()
    assert {r.event_id: r.answer for r in answers} == {101: 7.0, 102: None, 201: 1.0}
    state = spark.read.format("statestore").option("stateVarName", "kept").load(out + "-checkpoint")
    left = {r[0] for r in state.select("key.key").collect()}
    assert left <= {7, 60, 50} and 7 in left


def test_postings_blocks_and_codes(spark):
    d = spark.createDataFrame([(k, "w " + ("x" if k % 3 == 0 else "y")) for k in (1, 2, 3, 9, 10, 27, 30)] + [(3, "w x"), (None, "w"), (5, None)], DOCS)
    p = index.postings(d, block=10)
    got = {(r.term, r.block): r.docs for r in p.collect()}
    assert got[("w", 0)] == [1, 2, 3, 9] and got[("w", 1)] == [10] and got[("w", 2)] == [27] and got[("w", 3)] == [30]
    coded = index.deltas(p)
    assert {(r.term, r.block): r.gaps for r in coded.collect()}[("w", 0)] == [1, 1, 1, 6]
    assert {(r.term, r.block): r.docs for r in index.undelta(coded).collect()} == got
    assert index.postings(d.where("doc_id > 100")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (30, 60, 200, 25, 24)]
    rows = [" ".join(b) for b in base] + [" ".join(base[2][:-4]), " ".join(base[1]), " ".join(base[1]), " ".join(base[2][:150]), None, ""]
    d = docs(spark, *rows)
    sig = {r.doc_id: set(r.sig) for r in neardup.sketch(d).collect()}
    assert 5 not in sig and 4 in sig  # 24 words have 19 shingles, 25 have 20
    rep = {a: min(b for b in sig if sig[b] == sig[a]) for a in sig}
    every = {(a, b) for a in sig for b in sig if a < b and len(sig[a] & sig[b]) > 0.75 * len(sig[a] | sig[b])}
    # classes of equal sketches are paired by their first documents, and these with the others
    want = {(a, b) for a, b in every if a == rep[a] and b in (rep[b], *[x for x in sig if rep[x] == a])}
    assert {(r.doc_a, r.doc_b) for r in neardup.pairs(d).collect()} == want and (2, 8) in want and (7, 8) not in want
    assert {(rep[a], rep[b]) for a, b in every if rep[a] != rep[b]} <= want


def test_jaccard_of_exactly_the_limit_is_out(spark):
    d = docs(spark, *[" ".join(f"{p}{k}" for k in range(40)) for p in "ab"])
    assert neardup.pairs(d).count() == 0


def test_url_overlap_and_sample(spark):
    p = spark.createDataFrame([(k, f"http://x/a/{k}?p=1") for k in range(20)] + [(99, None)], "page_id bigint, url string")
    got = {r.feature: r.cnt for r in urlfeatures.feature_counts(p, 0.5).collect()}
    assert got == {"segments:2": 20, "param_name:p": 20, "param:p=['1']": 20, "segment_name_0:a": 20, "segment_len_0:1": 20, "segment_[0-9]_1:1": 20, "segment_len_1:1": 10, "segment_len_1:2": 10}
    assert urlfeatures.sample(p, 5).count() == 5
    assert urlfeatures.feature_counts(p.where("page_id > 100")).count() == 0


@pytest.mark.parametrize("cap,block", [(3, 4), (100, 1 << 16)])
def test_admission_against_a_loop(spark, cap, block):
    rng = random.Random(5)
    stream = [(k, rng.choice("abc")) for k in range(60)]
    quota = {"a": 2.5, "b": 0.0}
    left, total, want = dict(quota), 0, {}
    for k, c in stream:
        ok = total < cap and left.get(c, 0) > 0
        if left.get(c, 0) > 0:
            left[c] -= 1
            total += 1
        want[k] = ok
    got = segment.admit(spark.createDataFrame(stream, "arrival bigint, cluster string"), spark.createDataFrame(list(quota.items()), "cluster string, quota double"), cap, block=block)
    assert {r.arrival: r.accepted for r in got.collect()} == want


def test_fuzzy_join_is_exact(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(80)})
    d = spark.createDataFrame([(w, len(w)) for w in words], "word string, cnt int")
    q = spark.createDataFrame([(w,) for w in words[::3]] + [(None,)], "q string")
    got = {(r.q, r.word) for r in spell.candidates(q, d, 2).collect()}
    want = {(r.q, r.word) for r in q.join(d, F.levenshtein("q", "word") <= 2).collect()}
    assert got == want
    near = {r.q: r.word for r in spell.nearest(q, d).collect()}
    assert all(near[w] == w for w in words[::3])


def test_error_model_and_correction(spark):
    m = spell.error_model(spark.createDataFrame([("hte", "the"), ("teh", "the"), ("cat", "bat"), (None, "x")], "wrong string, right string"))
    assert abs(sum(r.p for r in m.collect() if r.op == "replace") - 1) < 1e-9
    d = spark.createDataFrame([("bat", 10), ("the", 100), ("rat", 1)], "word string, cnt int")
    got = {r.q: r.word for r in spell.correct(spark.createDataFrame([("cat",), ("te",), ("qqqqqq",)], "q string"), d, m).collect()}
    assert got == {"cat": "bat", "te": "the"}


def test_valid_words(spark):
    w = spark.createDataFrame([("Don't ",), ("a1",), ("",), (None,)], "w string")
    assert [r[0] for r in w.select(spell.valid(F.col("w"))).collect()] == ["dont", None, None, None]


def test_log_pairs(spark):
    log = spell.query_log(spark.createDataFrame([("teh cat\tthe cat",), ("only",), ("a b\tc",)], "value string"))
    assert [(r.wrong, r.right) for r in spell.log_pairs(log).collect()] == [("teh", "the")]


def test_total_order_and_runs(spark):
    rng = random.Random(9)
    v = [(rng.randint(0, 50), k) for k in range(300)]
    got = invert.ranked(spark.createDataFrame(v, "a int, b int"), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == sorted(v) and sorted(r.rank for r in got) == list(range(1, 301))
    r = invert.runs(spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x"), (2, 1, "x")], "p int, o int, v string"), "p", "o", "v")
    assert sorted((x.p, x.first, x.length) for x in r.collect()) == [(1, 1, 2), (1, 3, 2), (1, 5, 1), (2, 1, 1)]


def test_inversion_has_set_semantics(spark):
    p = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (1, 8), (None, 8), (3, None)], "d bigint, w bigint")
    lists = invert.inverted(p, "d", "w", "word", "docs")
    assert {r.word: r.docs for r in lists.collect()} == {7: [1, 2], 8: [1]}
    assert {r.doc: r.words for r in invert.reinverted(lists, "word", "docs", "doc", "words").collect()} == {1: [7, 8], 2: [7]}
    assert {(r.word, r.block): r.docs for r in invert.inverted(p, "d", "w", "word", "docs", 2).collect()} == {(7, 0): [1], (7, 1): [2], (8, 0): [1]}


def test_sentences(spark):
    d = docs(spark, "Hi there.  Go 3.5 on! Really?", "no end", "   ", "Wait... what?", None)
    f = sentences.features(d)
    got = {(r.doc_id, r.pos): r for r in f.collect()}
    assert sorted(got) == [(1, 9), (1, 16), (1, 21), (1, 29), (4, 5), (4, 6), (4, 7), (4, 13)]
    assert got[(1, 16)].prev_digit == 1 and got[(1, 29)].is_last == 1 and got[(4, 6)].prev_dot == 1 and got[(4, 5)].next_dot == 1 and got[(1, 9)].prev_word_len == 5
    s = {}
    for r in sorted(sentences.split_at(d, sentences.rule_ends(f)).collect(), key=lambda r: (r.doc_id, r.n)):
        s.setdefault(r.doc_id, []).append(r.sentence)
    assert s == {1: ["Hi there.", "Go 3.5 on!", "Really?"], 2: ["no end"], 4: ["Wait...", "what?"]}


def test_sentence_score(spark):
    kind = "id bigint, sentences array<string>"
    gold = spark.createDataFrame([(1, ["A b.", "C."]), (2, ["X. Y?"]), (3, ["Q."])], kind)
    found = spark.createDataFrame([(1, ["A b.", "C."]), (2, ["X.", "Y?"]), (3, ["other"])], kind)
    r = sentences.score(gold, found).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (3, 0, 1, 1)


def test_best_split_with_ties(spark):
    d = spark.createDataFrame([(1.0, 1.0, 5.0), (1.0, 2.0, 5.0), (2.0, 2.0, 9.0), (2.0, None, 9.0)], "a double, b double, y double")
    got = {r.feature: (r.threshold, r.n_left) for r in stats.best_split(d, ["a", "b"], "y").collect()}
    assert got["a"] == (1.5, 2) and got["b"] == (1.5, 1)


def test_greedy_merit():
    assert [f for f, _ in stats.greedy_merit({"a": 0.9, "b": 0.89, "c": 0.1}, {("a", "b"): 0.99, ("a", "c"): 0.0, ("b", "c"): 0.0})][0] == "a"


def test_prf_of_nothing(spark):
    r = stats.prf(spark.createDataFrame([], "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    assert r.tp == 0 and r.f1_pos == 0


T0 = datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), key, op, v, ttl) for k, (s, key, op, v, ttl) in enumerate(rows)], "event_id bigint, ts timestamp, key bigint, op string, value double, ttl int")


def test_expiry(spark):
    e = events(spark, (0, 1, "set", 5.0, 10), (9, 1, "get", None, 0), (10, 1, "get", None, 0), (11, 1, "set", 6.0, 0), (999, 1, "get", None, 0), (1000, 1, "set", 7.0, 1), (1000, 1, "get", None, 0), (1001, 1, "get", None, 0), (5, 2, "get", None, 0))
    assert {r.event_id: r.answer for r in kv.answers(e).collect()} == {1: 5.0, 2: None, 4: 6.0, 6: 7.0, 7: None, 8: None}
    assert [(r.key, r.value) for r in kv.last_write(e).collect()] == [(1, 7.0)]


def test_commands(spark):
    lines = ["set 5 k some words", "get k", "set -1 k v", "set x k v", "get", "drop k", "", "get " + "k" * 33, "set 1 k"]
    got = kv.commands(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.valid for r in got] == [True, True] + [False] * 7 and got[0].value == "some words" and got[0].ttl == 5


def test_fan_out(spark):
    m = spark.createDataFrame([(1, T0 + timedelta(days=3), 0), (2, T0 + timedelta(days=9), 0), (3, T0, 1)], "event_id bigint, ts timestamp, room int")
    s = spark.createDataFrame([(10, T0, T0 + timedelta(days=5), 0), (11, T0 + timedelta(days=3), None, 0), (12, T0 + timedelta(days=4), T0 + timedelta(days=9), 0)], "user_id bigint, connect timestamp, disconnect timestamp, room int")
    assert sorted((r.event_id, r.receiver) for r in kv.fan_out(m, s).collect()) == [(1, 10), (1, 11), (2, 11)]


def test_framing(spark):
    d = spark.createDataFrame([("a", "hello\nworld and more\nrest")], "sender string, data string")
    assert [(r.n, r.part) for r in kv.framed(d, 6).collect()] == [(0, "hello"), (1, "world "), (2, "and mo"), (3, "re")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_lists_are_shuffled_in_parts(spark, monkeypatch):
    """A task inverts its documents first: a row a term and chunk goes to the shuffle, not one a document, and it is shuffled once."""
    rows = [(k, f"all t{k % 7} {'z' * (k % 3)}") for k in (*range(-9, 400), 5, 5)] + [(None, "all"), (1, None)]
    want = {}
    for k, text in rows:
        for w in set((text or "").split()) if k is not None else ():
            want.setdefault((w, -(-k // 100) if k < 0 else k // 100), set()).add(k)
    want = {t: sorted(v) for t, v in want.items()}
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    for chunk in (1 << 20, 500):
        monkeypatch.setattr(index, "CHUNK", chunk)
        assert {(r.term, r.block): r.docs for r in index.postings(d, block=100).collect()} == want
    monkeypatch.undo()
    seen = list(index.parts_of(1 << 20)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "w": [["all", "x"]] * 5000})])))
    assert sum(map(len, seen)) == 2
    assert exchanges(index.postings(spark.range(9).selectExpr("id doc_id", "'a b' text"))) == 1


def test_parts_of_a_list_meet_over_batches():
    parts = [("a", 0, [1, 5]), ("a", 0, [3, 5]), ("a", 0, [9]), ("a", 1, [2]), ("b", 0, [-4, 2]), ("c", 2, [0]), ("c", 2, [1])]
    for size in (1, 2, 3, 7):
        few = [parts[k : k + size] for k in range(0, len(parts), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([p[0] for p in f]), pa.array([p[1] for p in f], pa.int64()), pa.array([p[2] for p in f], pa.list_(pa.int32()))], ["term", "block", "at"]) for f in few]
        lists = [(r["term"], r["block"], r["df"], r["docs"]) for b in index.merged(10, False)(iter(batches)) for r in b.to_pylist()]
        assert lists == [("a", 0, 4, [1, 3, 5, 9]), ("a", 1, 1, [12]), ("b", 0, 2, [-4, 2]), ("c", 2, 2, [20, 21])]
        long = [(r["term"], r["doc_id"], r["gap"], r["nth"]) for b in index.merged(10, True)(iter(batches)) for r in b.to_pylist()]
        assert long == [("a", 1, 1, 1), ("a", 3, 2, 2), ("a", 5, 2, 3), ("a", 9, 4, 4), ("a", 12, 12, 1), ("b", -4, -4, 1), ("b", 2, 6, 2), ("c", 20, 20, 1), ("c", 21, 1, 2)]
    assert list(index.merged(10, True)(iter([]))) == []


def test_gaps_are_shuffled_once(spark):
    d = spark.range(2000).selectExpr("id * 3 as doc_id", "concat('all ', id % 5) as text")
    assert exchanges(index.delta_rows(d)) == 1
    got = sorted((r.doc_id, r.gap) for r in index.delta_rows(d).where("term = 'all'").collect())
    assert got == [(3 * k, 3 if k else 0) for k in range(2000)]
    assert sorted((r.nth, r.doc_id, r.gap) for r in index.skips(d, 50).where("term = '1'").collect()) == [(50 * k, 3 * (250 * k - 4), 738 if k == 1 else 750) for k in range(1, 9)]


def test_a_sample_for_the_driver_sends_about_its_rows(spark):
    """The first rows in hash order, of which the tasks send about as many as are asked for in all, not each."""
    rows = spark.range(0, 40_000, 1, 16)
    few = invert.sampled(rows, "id", 500)
    assert [r.id for r in few.collect()] == [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    limit = int(plan.split("<= ")[1].split(")")[0])
    assert 500 <= rows.where(F.shiftright(F.xxhash64("id"), 48) <= limit).count() < 510
    assert invert.sampled(rows.limit(0), "id", 5).count() == 0 and invert.sampled(rows, "id", 50_000).count() == 40_000
    assert sorted(r.id for r in invert.sampled(spark.range(3).union(spark.range(3)), "id", 6).collect()) == [0, 0, 1, 1, 2, 2]


def test_sketches_need_no_shuffle(spark):
    rng = random.Random(8)
    texts = [" ".join(f"Wö{rng.randint(0, 60)}" for _ in range(n)) for n in (0, 5, 6, 24, 25, 26, 40, 400, 3000)]
    d = docs(spark, *texts, None).unionAll(spark.createDataFrame([(None, texts[8])], DOCS)).coalesce(1)
    assert exchanges(neardup.sketch(d)) == 0
    for n, k, last in ((20, 5, True), (20, 5, False), (3, 2, True)):
        h = {}
        for r in neardup.shingles(d, k, last).collect():
            h.setdefault(r.doc_id, []).append(r.h)
        mins = {i: {b: min(x for x in v if x % n == b) for b in {x % n for x in v}} for i, v in h.items()}
        want = {i: sorted(set(m.values())) if len(m) == n else sorted(set(sorted(h[i])[:n])) for i, m in mins.items() if len(m) == n or len(h[i]) >= n}
        assert {r.doc_id: r.sig for r in neardup.sketch(d, n, k, last).collect()} == want
    assert neardup.sketch(d.limit(0)).count() == 0


def test_sentence_score_stays_in_the_row(spark):
    """As score() gives it from lists that were gathered by document, but nothing is shuffled except counts."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B ", ".", ". ", "?", "! ", "  ", "\n", "é", "..."]) for _ in range(n)) for n in range(120)] + ["", " ", ".", " .", "a. .b", "x.\n", "e.g. this", "𝒳. 𝒴.z"]
    d = docs(spark, *texts, None)
    here = d.where("text is not null")
    feats = sentences.features(here)
    lists = lambda ends: sentences.split_at(here, ends).groupBy(F.col("doc_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]).alias("sentences"))
    want = sentences.score(lists(feats.select("doc_id", "pos")), lists(sentences.rule_ends(feats))).first().asDict()
    got = sentences.rule_score(d)
    assert got.first().asDict() == want and want["tp"] and want["fn"] and exchanges(got) == 0
    assert sentences.rule_score(d.limit(0)).first().asDict() == {"tp": 0, "tn": 0, "fp": 0, "fn": 0, "accuracy": None}


def test_a_key_makes_few_calls_to_its_state():
    """Each call is a round trip: one get, one update, and a timer only where its time changes."""
    from pyspark.sql import Row

    from textloom.streaming.kv import Expiring, micros

    class Fake:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.calls.append(("register", at))

        def deleteTimer(self, at):
            self.calls.append(("delete", at))

    fake, p, t = Fake(), Expiring(), datetime(2024, 1, 1)
    p.init(fake)
    row = lambda k, s, op, value=None, ttl=60: Row(event_id=k, ts=t + timedelta(seconds=s), us=micros(t + timedelta(seconds=s)), op=op, value=value, ttl=ttl)
    feed = lambda *rows: [(r.event_id, r.answer) for r in p.handleInputRows((1,), iter(rows), None)]
    end, ms = lambda s: micros(t) // 1000 + s * 1000, fake.calls
    assert feed(row(4, 30, "get"), row(1, 0, "get"), row(3, 20, "get"), row(2, 20, "set", 5.0), row(5, 79.999999, "get"), row(6, 80, "get")) == [(1, None), (3, 5.0), (4, 5.0), (5, 5.0), (6, None)]
    assert ms == ["get", "update", ("register", end(80))]
    ms.clear()
    assert feed(row(7, 50, "get")) == [(7, 5.0)] and ms == ["get"]
    ms.clear()
    assert feed(row(8, 60, "set", 6.0, 0), row(9, 99_999, "get")) == [(9, 6.0)] and ms == ["get", "update", ("delete", end(80))]
    assert list(p.handleInputRows((1,), iter([row(10, 60, "set", None)]), None)) == [] and fake.value[2] is None


def test_texts_are_split_outside_the_jvm(spark):
    """A text goes to Python as it is, not as a list of words, and only the columns asked for come back; its words are those of the regular expression."""
    plan = index.delta_rows(spark.range(9).selectExpr("id doc_id", "'a b' text")).select("term", "doc_id", "gap")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "nth" not in plan
    rng = random.Random(7)
    some = [*"aZ _09\n\0éЯ中ßİΣ́", "\U0001f600", "\U00020000", "\U00010400", *map(chr, range(0x80, 0xD800, 61)), *map(chr, range(0xE000, 0x110000, 4999))]
    texts = ["", *("".join(rng.choices(some[:16] if k % 2 else some, k=rng.choice([0, 1, 2, 9, 200]))) for k in range(600)), "a", "b", ""]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = d.select("doc_id", F.lower("text").alias("low"), T.words(F.col("text")).alias("w")).orderBy("doc_id").toArrow().combine_chunks()
    low, want = got.column("low").combine_chunks(), got.column("w").to_pylist()
    split = splitter(word_edges())
    for part, lists in ((low, want), (low.slice(5, 90), want[5:95]), (low.slice(0, 1), [[]]), (low.slice(0, 0), [])):
        words, n = split(part)
        assert words.to_pylist() == sum(lists, []) and n.tolist() == list(map(len, lists))
    pairs = {(w, k) for k, lists in enumerate(want) for w in lists}
    assert {(r.term, r.doc_id) for r in index.delta_rows(d).collect()} == pairs


def test_parts_are_shuffled_in_buckets(spark, monkeypatch):
    """A bucket's parts go to the shuffle as one row, and come back one list after another whatever was cut between them."""
    rows = [(f"t{k % 37}é" * (1 + k % 30), k % 3 - 1, [k, k + 1]) for k in range(400)]
    few = [pa.RecordBatch.from_pydict({"term": [r[0] for r in f], "block": [r[1] for r in f], "at": [r[2] for r in f]}, schema=index.PARTS) for f in (rows[:150], rows[150:399], rows[399:])]
    for chunk, size, batch in ((1 << 21, 1 << 25, 1000), (300, 8, 3)):
        monkeypatch.setattr(index, "CHUNK", chunk)
        monkeypatch.setattr(index, "CHUNK_BYTES", size)
        sent = pa.Table.from_batches(index.packed(iter(few), 7))
        assert len(sent) <= 7 * (1 if chunk > 300 else 3)
        back = pa.Table.from_batches(index.unpacked(iter(sent.sort_by("bucket").combine_chunks().to_batches(batch)))).to_pylist()
        assert sorted((r["term"], r["block"], r["at"]) for r in back) == sorted(rows)
        keys = [(r["term"], r["block"]) for r in back]
        assert sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys)) - 1
    assert list(index.packed(iter([]), 7)) == list(index.unpacked(iter([]))) == []
    files = index.postings(spark.range(500).selectExpr("id * 9999 doc_id", "concat('w', id % 91, ' w', id % 7) text")).rdd.glom().collect()
    assert all(f == sorted(f, key=lambda r: (r.term, r.block)) for f in files)
    plan = index.delta_rows(spark.range(9).selectExpr("id doc_id", "'a b' text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(bucket" in plan
