"""Boosting, feature searches, networks trained where the rows are, page spam, spelling over whole dictionaries: against plain versions."""

import itertools
import math
import sys

import numpy as np
import pytest

from tests.support import SMALL
from textloom.functions.html import zones_of
from textloom.operators import boost, neural, pages, segment, spell, stats, trees
from textloom.plans import QUERIES
from textloom.storage import table

LARGER = "/root/testdata/sf0.1"


def test_a_tree_splits_where_the_error_falls_most():
    rng = np.random.default_rng(2)
    b, y = rng.integers(0, 6, (60, 3)), rng.normal(size=60)
    t = boost.grow(b, y, 1, 4)
    best = min((sum(((y[m] - y[m].mean()) ** 2).sum() for m in (b[:, f] <= c, b[:, f] > c)), f, c) for f, c in itertools.product(range(3), range(5)) if 4 <= (b[:, f] <= c).sum() <= 56)
    assert (t.feature[0], t.bin[0]) == best[1:] and math.isclose(((y - t.predict(b)) ** 2).sum(), best[0])


def test_boosting_learns_and_pruning_drops_what_says_little():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1])
    b = boost.binned(x)
    plain = boost.Boosted(trees=80, rate=0.1, depth=3).fit(b[:450], y[:450])
    error = [float(np.mean((p - y[450:]) ** 2)) for p in plain.stages(b[450:])]
    assert error[-1] < 0.25 * np.var(y[450:]) and error[-1] < error[10] < error[0]
    pruned = boost.Boosted(trees=80, rate=0.1, depth=3, prune=0.01).fit(b[:450], y[:450])
    assert pruned.pruned > 0 and all(set(t.used()) <= {0, 1, 2, 3, 4, 5} for t in pruned.fitted)
    t = plain.fitted[0]
    f = t.used()[0]
    before = t.predict(b, without=f)
    t.prune(f)
    assert np.array_equal(before, t.predict(b)) and f not in t.used()
    odds = boost.Boosted(trees=40, rate=0.1, loss="log", rows=0.7, columns=0.7).fit(b[:450], (y[:450] > 0).astype(float))
    assert np.mean((odds.predict(b[450:]) > 0) == (y[450:] > 0)) > 0.85


def test_wrapper_search_takes_the_features_that_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in x], float(3 * x[4] + x[1] * x[1])) for k, x in enumerate(rng.normal(size=(300, 6)))]
    v = trees.vectors(spark.createDataFrame(rows, "id bigint, x array<double>, y double"), "id", "x", "y")
    got = boost.forward_selection(v, "id", 2, trees=30, depth=3, rate=0.1).orderBy("place").collect()
    assert [r.feature for r in got] == [4, 1] and got[1].mse < got[0].mse
    curve = boost.error_by_features(v, "id", [4, 1, 0], trees=30, depth=3, rate=0.1).orderBy("n_features").collect()
    assert [r.n_features for r in curve] == [1, 2, 3] and [round(r.mse, 9) for r in curve[:2]] == [round(r.mse, 9) for r in got]
    b, y = boost.sampled(v, "id")
    fold = np.arange(len(y)) % 4
    sse = sum(((boost.Boosted(trees=30, depth=3, rate=0.1).fit(b[fold != k][:, [4]], y[fold != k]).predict(b[fold == k][:, [4]]) - y[fold == k]) ** 2).sum() for k in range(4))
    assert math.isclose(curve[0].mse, sse / len(y), rel_tol=1e-9)
    assert boost.forward_selection(v.limit(0), "id").count() == 0 and boost.pruned_boosting(v.limit(0), "id").count() == 0
    both = boost.pruned_boosting(v, "id", trees=10, depth=3).collect()
    assert len(both) == 10 and both[-1].plain < both[0].plain


def test_cfs_over_all_elements_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 12))
    x[:, 3] = 1.0  # constant
    y = x[:, 5] + 0.5 * x[:, 2] + 0.1 * rng.normal(size=200)
    d = spark.createDataFrame([([float(a) for a in r], float(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0)], "x array<double>, y double")
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.corrcoef(np.column_stack([x, y]).T))
    name = [f"{k:02d}" for k in range(12)]
    want = stats.greedy_merit({name[k]: r[k, 12] for k in range(12)}, {(name[a], name[b]): r[a, b] for a in range(12) for b in range(a + 1, 12)})
    got = [(r.feature, r.merit) for r in stats.cfs_array(d, "x", "y").orderBy("place").collect()]
    assert got == [(int(f), round(m, 6)) for f, m in want] and got[0][0] == 5
    assert stats.cfs_array(d.limit(0), "x", "y").count() == 0


def test_networks_learn_from_all_rows(spark):
    """Codes of two numbers of vectors that lie on a plane, but for rows of another kind that only one task has."""
    rng = np.random.default_rng(7)
    base, other = rng.normal(size=(2, 10)) * 0.5, rng.normal(size=(1, 10))
    x = [*(rng.normal(size=(900, 2)) @ base), *(rng.normal(size=(300, 1)) @ other)]
    d = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(5000, None)], "id bigint, v array<double>").repartition(4)
    got = neural.autoencoder_codes(d, "id", "v", code=3, noise=0.0, rounds=12).toPandas()
    var = float(np.mean(np.var(np.stack(x), axis=0)))
    assert len(got) == 1200 and got.error.mean() < 0.35 * var and got[got.id >= 900].error.mean() < 0.6 * float(np.mean(np.stack(x[900:]) ** 2))
    assert all(len(c) == 3 for c in got.code)
    deep = neural.autoencoder_codes(d, "id", "v", code=3, noise=0.01, hidden=(6,), rounds=12).toPandas()
    assert deep.error.mean() < 0.6 * var and all(len(c) == 3 for c in deep.code)
    for f in (neural.autoencoder_codes, neural.rbm_codes, neural.stacked_codes):
        assert f(d.limit(0), "id", "v").count() == 0


def test_machines_reconstruct_better_with_training(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(400, 2)) @ rng.normal(size=(2, 8)) * 0.5)
    d = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id bigint, v array<double>")
    start = neural.Rbm(6, rate=0.1).prepared(8)
    assert neural.averaged(d.repartition(2), "v", start, 12).error(x) < 0.8 * start.error(x)
    net = neural.stacked(d, "v", 8, [6, 3], rounds=6)
    assert net.sizes == [8, 6, 3, 6, 8] and np.mean((net.layers(x)[-1] - x) ** 2) < np.var(x)


def test_page_features_against_counting(spark):
    html = "<html><head><title>Cheap  pills, now</title></head><body>Buy the <a href=x>best pills here</a> at <strong>once</strong>! <em>Now or never</em> the the</body></html>"
    d = spark.createDataFrame([(1, html, "http://a-b.org/x_1/22"), (2, None, None), (3, "", "u")], "page_id bigint, html string, url string")
    got = {r.page_id: r for r in pages.page_features(d, ["the", "pills", "e"]).collect()}
    z = zones_of(html)
    r = got[1]
    assert r.numbers[:2] == [z["text"].replace("!", "").replace("  ", " ").count(" "), 2] and r.numbers[3] == 2 and r.numbers[5:7] == [0, 2] and r.numbers[7:] == [7, 3]
    assert r.words == [3, 0, z["text"].count("e")] and r.tag_words[1] == 1
    assert got[2].numbers == [0.0] * 9 and got[2].words == [0, 0, 0] and got[3].tag_words == [0, 0, 0]


def test_spam_gates(spark):
    """F1 of both classes, and their balance, over folds of the labelled documents as pages."""
    got = QUERIES["spam_f1"](spark, LARGER).collect()
    n = sum(r.n for r in got)
    assert n == table(spark, LARGER, "labels").where("quality in (0, 1)").count()
    assert sum(r.f1_spam * r.n for r in got) / n >= 0.9 and sum(r.f1_clean * r.n for r in got) / n >= 0.9
    scored = spark.createDataFrame([(0, 1, 0.9), (0, 1, 0.2), (0, 0, 0.6), (0, 0, 0.1), (1, 0, 0.1)], "fold bigint, label int, p_spam double")
    assert {r.fold: (r.f1_spam, r.f1_clean, r.imbalance) for r in pages.f1_by_fold(scored).collect()} == {0: (0.5, 0.5, 0.0), 1: (0.0, 1.0, 1.0)}


def test_clusters_are_made_again_on_the_best_features(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(9)
    rows = [(float(k % 3), Vectors.dense([rng.normal(), k % 3 + 0.1 * rng.normal(), rng.normal(), (k % 3 > 0) + 0.1 * rng.normal()])) for k in range(90)]
    best = segment.best_features(2, "label").fit(spark.createDataFrame(rows, ["label", "features"]))
    assert sorted(best.selectedFeatures) == [1, 3]
    d = spark.createDataFrame([(k, f"http://a.org/{'news' if k % 2 else 'shop'}/x{k % 3}") for k in range(60)] + [(99, None)], "page_id bigint, url string")
    got = segment.url_clusters(d, 3, k=3).toPandas()
    assert len(got) == 60 and 1 < got.cluster.nunique() <= 3 and got.groupby(got.page_id % 6).cluster.nunique().tolist() == [1] * 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_word_of_the_whole_dictionary(spark):
    words = {"apple": 5, "apply": 9, "été": 3, "banana": 2, "a": 1, "extraordinarily": 1, "zzz": 4}
    asked = ["appl", "aple", "ete", "qqqqqqqqqqqq", "x", "extraordinary", "apple", "banananananana"]
    d = spark.createDataFrame(list(words.items()), "word string, cnt bigint")
    got = {r.q: (r.dist, -r.cnt, r.word) for r in spell.nearest_any(spark.createDataFrame([(q,) for q in asked] + [(None,)], "q string"), d).collect()}
    assert got == {q: min((distance(q, w), -n, w) for w, n in words.items()) for q in asked}


def test_corrections_equal_a_loop(spark):
    dictionary = {"their": 50, "there": 80, "three": 20, "tree": 30, "then": 60, "été": 4}
    model = {("add", "e", ""): 0.5, ("add", "h", ""): 0.25, ("replace", "e", "é"): 0.7, ("del", "e", ""): 0.4}
    from textloom.functions.edits import edit_script

    asked, total, want = ["thee", "thre", "ete", "three", "xyzxyzxyz"], sum(dictionary.values()), {}
    for q in asked:
        near = []
        for w, n in dictionary.items():
            if (dist := distance(q, w)) <= 2:
                log = sum(math.log(model.get(e, 0.0005)) for e in edit_script(q, w))
                near.append((log < math.log(0.001), -(log + math.log(n / total)), dist, w))
        if near:
            unlikely, score, dist, w = min(near)
            want[q] = (w, dist, round(-score, 6))
    m = spark.createDataFrame([(*k, p) for k, p in model.items()], "op string, a string, b string, p double")
    got = spell.correct(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame(list(dictionary.items()), "word string, cnt bigint"), m)
    assert {r.q: (r.word, r.dist, round(r.score, 6)) for r in got.collect()} == want and len(want) == 4


def test_an_outside_program_is_asked(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.5, 0.25])], "id int, x array<double>")
    lines = [sys.executable, "-c", "import sys\nfor line in sys.stdin: print(sum(map(float, line.split())))"]
    arguments = [sys.executable, "-c", "import sys; print(sum(map(float, sys.argv[1:])))"]
    for command, each in ((lines, False), (arguments, True)):
        assert {r.id: r.y for r in trees.asked_program(d, command, as_arguments=each).collect()} == {1: 3.0, 2: None, 3: 0.75}
    with pytest.raises(Exception, match="returned non-zero|CalledProcessError"):
        trees.asked_program(d, [sys.executable, "-c", "import sys; sys.exit(3)"]).collect()


def test_zone_counts_of_pages_against_patterns(spark):
    """The parser's words of links and titles against those a pattern finds, on pages whose tags aren't nested."""
    import re

    p = table(spark, SMALL, "pages")
    got = {r.page_id: (r.header_words, r.links_words) for r in pages.zone_counts(p).collect()}
    for r in p.collect():
        inside = lambda tag, html=r.html: " ".join(" ".join(re.findall(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", html)).split())
        if "<" not in inside("a") + inside("title") and "&" not in inside("a") + inside("title"):
            assert got[r.page_id] == (inside("title").count(" "), inside("a").count(" "))


def test_least_squares_on_a_held_out_fold_equals_numpy(spark):
    v = trees.vectors(table(spark, SMALL, "embeddings"), "vec_id", "embedding", "label")
    train, test = trees.split(v, "vec_id")
    x, y = (np.array([[*r.features, 1.0] for r in p.collect()]) for p in (train, test)), [np.array([r.label for r in p.collect()]) for p in (train, test)]
    x = list(x)
    if len(y[0]) > x[0].shape[1]:
        w = np.linalg.lstsq(x[0], y[0], rcond=None)[0]
        got = trees.linear(v, "vec_id").first()
        assert got.n == len(y[1]) and math.isclose(got.rmse, float(np.sqrt(np.mean((x[1] @ w - y[1]) ** 2))), rel_tol=1e-3)


def test_simple9_sizes_of_the_index(spark):
    """The query's bytes for every posting list against a packer that takes a word at a time."""
    sizes = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))
    from textloom.operators import index

    want = {}
    for r in index.deltas(index.postings(table(spark, SMALL, "documents"))).collect():
        at, n = 0, 1
        while at < len(r.gaps):
            at += next(k for k, bits in sizes if all(g < 1 << bits for g in r.gaps[at : at + k]))
            n += 1
        want[r.term] = 4 * n
    got = {r.term: (r.n_bytes, r.same) for r in QUERIES["simple9_roundtrip"](spark, SMALL).collect()}
    assert got == {t: (n, True) for t, n in want.items()}


def test_shuffling_and_the_top_features(spark):
    from textloom.operators import invert

    d = spark.range(50)
    a, b = ([r.id for r in invert.shuffled(x, "id", 3).collect()] for x in (d, d.repartition(5)))
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50)) and a != [r.id for r in invert.shuffled(d, "id", 4).collect()]
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in x], float(3 * x[2] + x[0])) for k, x in enumerate(rng.normal(size=(200, 4)))]
    v = trees.vectors(spark.createDataFrame(rows, "id bigint, x array<double>, y double"), "id", "x", "y")
    assert [r.feature for r in trees.top_features(v, 2).collect()] == [2, 0]
    train, held = trees.hold_out(v, "id")
    assert train.count() + held.count() == 200 and 5 < held.count() < 40
