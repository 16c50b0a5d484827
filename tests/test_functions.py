import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import codecs as C
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.functions.edits import edit_script
from textloom.functions.html import zones_of


def one(spark, expr, *values, kinds=None):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], kinds or ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()[0]


def test_words_of_any_script(spark):
    assert one(spark, T.words, "Привет, A1_b — ñandú!") == ["привет", "a1_b", "ñandú"]
    assert one(spark, T.words, "") == []
    assert one(spark, T.words, None) is None


@pytest.mark.parametrize("n,want", [(4, 0), (5, 0), (6, 1), (24, 19), (25, 20)])
def test_shingles_leave_the_last_out(spark, n, want):
    assert len(one(spark, lambda t: T.word_grams(T.words(t), 5, True), " ".join(f"w{k}" for k in range(n)))) == want


def test_shingles_with_the_last(spark):
    assert one(spark, lambda t: T.word_grams(T.words(t), 5), "a b c d e") == ["a b c d e"]


def test_cleaning(spark):
    assert one(spark, T.strip_punctuation, "a.b,c!{d}~`[e]") == "abcde"
    assert one(spark, T.squeeze, "a    b") == "a  b"
    assert one(spark, T.strip, "\n a \t") == "a"
    assert one(spark, lambda s: T.occurrences(s, "aa"), "aaaaa") == 2
    assert one(spark, lambda s: T.occurrences(s, ""), "aaaaa") == 0
    assert one(spark, T.other_layout, "ghbdtn") == "привет"
    assert one(spark, T.other_layout, "привет") == "ghbdtn"


def test_decoding_keeps_plus_and_malformed_signs(spark):
    assert one(spark, U.decoded, "http://a/b%20c+d%zz%41") == "http://a/b c+d%zzA"
    assert one(spark, U.decoded, None) is None


def test_url_parts(spark):
    u = "https://m.x.org/a//b.c/12/x9y.tar.gz?p=1&q=&p=2;r=z%20z#top"
    assert one(spark, U.segments, u) == ["a", "b.c", "12", "x9y.tar.gz"]
    assert one(spark, U.params, u) == [("p", ["1", "2"]), ("r", ["z z"])]
    got = one(spark, U.features, u)
    for f in ["segments:4", "param_name:p", "param:p=['1', '2']", "segment_name_0:a", "segment_[0-9]_2:1", "segment_ext_1:c", "segment_substr[0-9]_3:1", "segment_ext_3:gz", "segment_ext_substr[0-9]_3:gz", "segment_len_3:10"]:
        assert f in got
    assert not any(f.startswith("param_name:q") for f in got)
    assert one(spark, U.features, "http://x.org") == ["segments:0"]


def test_segment_length_is_in_bytes(spark):
    assert "segment_len_0:4" in one(spark, U.features, "http://x/%C3%A9%C3%A9")


def test_zones():
    z = zones_of('<title>T <b>x</b></title><p>one<br>two<br/>three &amp; <a href="#">link <em>deep</em></a><script>var a;</script>')
    assert z["title"] == "T x" and z["a"] == "link deep" and z["em"] == "deep"
    assert "one\ntwo\n\nthree" in z["text"] and "&amp;" not in z["text"] and "var a;" in z["text"]
    assert zones_of("")["text"] == "" and zones_of(None) is None


@given(st.lists(st.integers(0, 2**40)))
@settings(max_examples=60, deadline=None)
def test_varbyte_round_trip(values):
    assert C.from_varbyte(C.varbyte(values)).tolist() == values


def test_varbyte_of_multiples_of_128():
    assert C.varbyte([0, 127, 128, 256]) == b"\x80\xff\x01\x80\x02\x80"


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 2**28 - 1))))
@settings(max_examples=60, deadline=None)
def test_simple9_round_trip(values):
    assert C.from_simple9(C.simple9(values)).tolist() == values


def test_simple9_packs_and_refuses():
    assert len(C.simple9([1] * 28)) == 8
    with pytest.raises(ValueError):
        C.simple9([1 << 28])


def test_murmur_known_values():
    assert [C.murmur3_32(x) for x in (b"", b"a", b"abc", b"hello")] == [0, 1009084850, -1277324294, 613153351]


def applied(a, script):
    out, i = [], 0
    for op, x, y in script:
        if op == "add":
            out.append((i, "add", x))
        else:
            out.append((i, op, x))
    return out


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=80, deadline=None)
def test_edit_script_is_shortest(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(d[j] + (x != y), d[j + 1] + 1, new[j] + 1))
        d = np.array(new)
    s = edit_script(a, b)
    assert len(s) == d[-1]
    assert len(b) - len(a) == sum({"add": 1, "del": -1, "replace": 0}[o] for o, _, _ in s)


def test_edit_script_ties():
    assert edit_script("ab", "ba") == [("add", "b", ""), ("del", "b", "")] or edit_script("ab", "ba") == [("del", "a", ""), ("add", "a", "")]
    assert edit_script("", "x") == [("add", "x", "")] and edit_script("abc", "abc") == []


def test_random_pairs_agree_with_levenshtein(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(0, 8))), "".join(rng.choices("abcd", k=rng.randint(0, 8)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(len(edit_script(r.a, r.b)) == r.d for r in df.select("a", "b", F.levenshtein("a", "b").alias("d")).collect())


def test_codecs_of_many_lists(spark):
    rng = random.Random(3)
    lists = [None, [], [0], [1 << 27], [rng.randrange(1 << rng.randrange(1, 28)) for _ in range(300)], [1] * 90, [5, 1 << 20] * 40]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<bigint>").coalesce(1)
    out = d.select("v", C.varbyte_encode("v").alias("a"), C.simple9_encode("v").alias("b"))
    for r in out.select("*", C.varbyte_decode("a").alias("va"), C.simple9_decode("b").alias("vb")).collect():
        assert r.va == r.v and r.vb == r.v
        if r.v is not None:
            assert bytes(r.a) == C.varbyte(r.v) and bytes(r.b) == C.simple9(r.v)


def test_murmur_of_many(spark):
    texts = [b"", b"a", b"ab", b"abc", b"abcd", b"hello, world", "ÀÉñ€".encode(), b"x" * 1001]
    assert C.murmur3_many(texts, 7).tolist() == [C.murmur3_32(t, 7) for t in texts]
    got = spark.createDataFrame([("abc",), (None,), ("",)], "t string").select("t", C.murmur3("t").alias("h")).collect()
    assert {r.t: r.h for r in got} == {"abc": C.murmur3_32(b"abc"), None: None, "": 0}


def test_common_prefix_and_scaling(spark):
    d = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("same", "same"), ("é1", "é2"), (None, "a"), ("ab", "abc")], "a string, b string")
    assert [r[0] for r in d.select(T.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 4, 1, None, 2]
    assert spark.sql("SELECT array(0, 51, 255) AS v").select(T.scaled(F.col("v"))).first()[0] == [0.0, 0.2, 1.0]


def test_costs_and_sign():
    from textloom.operators.neural import Net

    x, y = np.array([[1.0, -2.0]]), np.array([[0.5]])
    for kind, want in (("l1", np.sign), ("l2", lambda w: w)):
        net = Net([2, 1], rate=0.1, decay=0.3, decay_kind=kind, seed=2)
        w = net.w[0].copy()
        error = net.layers(x)[-1] - y
        net.step(x, y)
        g = np.hstack([x, np.ones((1, 1))]).T @ error
        g[:-1] += 0.3 * want(w[:-1])
        assert np.allclose(net.w[0], w - 0.1 * g)


def test_table_functions_give_the_builders_rows(spark):
    from textloom.functions import tables
    from textloom.functions import urls as U
    from textloom.operators import neardup, sentences

    tables.register(spark)
    urls = ["http://a.org/x/12/a1b/p.html?page=2&q=&page=3;z=1#f", "https://m.b.de/", "http://c.fr/%C3%A9t%C3%A9/y%2Fz.tar.gz?a=b%20c", "nonsense", "http://d.org?x=1"]
    for u in urls:
        want = sorted(r[0] for r in spark.createDataFrame([(u,)], "url string").select(F.explode(U.features(F.col("url")))).collect())
        assert sorted(r[0] for r in spark.sql("SELECT * FROM url_features(:u)", {"u": u}).collect()) == want
    text = "One. Two words! Is it 3.5? Yes... And A.B. Cé"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    want = sorted(tuple(r) for r in sentences.features(d).select("pos", *tables.FEATURES).collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM sentence_candidates(:t)", {"t": text}).collect()) == want and len(want) == 9
    want = [r.h for r in neardup.shingles(d, 3, False).collect()]
    assert [r.h for r in spark.sql("SELECT * FROM shingles(:t, 3)", {"t": text}).orderBy("pos").collect()] == want


def test_codecs_decode_many_lists_at_once():
    """Lists of a task are decoded together, whatever their lengths; a long one takes no step of its own for each word."""
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 1 << rng.integers(1, 28), n) for n in (0, 1, 0, 29, 500, 3, 70_000, 0)]
    ends = np.cumsum([0, *map(len, lists)])
    words, n = C.simple9_lists(np.concatenate(lists), ends)
    at = np.cumsum([0, *n])
    assert [words[a:b].tobytes() for a, b in zip(at, at[1:])] == [C.simple9(x) for x in lists]
    v, size = C.from_simple9_lists(words, at)
    assert v.tolist() == np.concatenate(lists).tolist() and size.tolist() == [len(x) for x in lists]
    data, size = C.varbytes(np.concatenate(lists))
    v, n = C.from_varbytes(data, np.concatenate([[0], np.cumsum(size)])[ends])
    assert v.tolist() == np.concatenate(lists).tolist() and n.tolist() == [len(x) for x in lists]


def test_sums_and_differences_of_lists(spark):
    d = spark.createDataFrame([(k, v) for k, v in enumerate([[3, 4, 9], [], None, [-5, 2], [7]])], "k int, v array<bigint>").coalesce(1)
    got = d.select("k", C.differences("v").alias("d"), C.cumulated(C.differences("v")).alias("v")).orderBy("k").collect()
    assert [r.d for r in got] == [[3, 1, 5], [], None, [-5, 7], [7]] and [r.v for r in got] == [[3, 4, 9], [], None, [-5, 2], [7]]
    assert [r.v for r in d.where("k > 1").select("k", C.varbyte_decode(C.varbyte_encode(F.expr("transform(v, x -> abs(x))"))).alias("v")).orderBy("k").collect()] == [None, [5, 2], [7]]


def test_pages_are_read_a_few_at_a_time(monkeypatch):
    """However many pages a batch has, only some are held as strings."""
    from textloom.functions import html

    pages = pa.array([f"<title>t{k}</title>x<a>y</a>" if k % 7 else None for k in range(1000)])
    made = []
    monkeypatch.setattr(html.pa, "array", lambda v, *a, f=pa.array: made.append(len(v)) or f(v, *a))
    got = html.by_page(pages, html.text_of, pa.string()).to_pylist()
    assert got == [f"t{k}\nx\ny" if k % 7 else None for k in range(1000)] and max(made) <= html.PAGES
    assert len(html.by_page(pages.slice(0, 0), html.text_of, pa.string())) == 0
