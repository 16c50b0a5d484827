"""Near, exact, suffix and line deduplication against brute force on small made-up tables, and the defined cases of each."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import exact, lines, near, suffix

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "doc_id bigint, text string, rep bigint, gid string, h1 int, cuts string, cut_id int, keeper string, `a.b` string, keep_id int, kept_spans int, cut_text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], KIND)


def corpus(seed=1, n=60):
    """Random texts over a small vocabulary with exact copies, edited copies, shared passages and hot lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    vocab = [word() for _ in range(300)]
    shared = [" ".join(rng.choices(vocab, k=70)) for _ in range(3)]
    texts = []
    for _ in range(n):
        t = [" ".join(rng.choices(vocab, k=rng.randint(3, 20))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            t.insert(rng.randrange(len(t)), rng.choice(shared))
        if rng.random() < 0.4:
            t.append("this is a hot line of boilerplate")
        texts.append("\n".join(t))
    for k in range(0, n, 6):
        texts.append(texts[k])
        w = texts[k + 1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


ODD = [(900, None), (901, ""), (902, "   \n "), (None, "some text here of no one"), (903, "x " * 40_000), (904, "x " * 40_000), (905, "one"), (906, "one"), (905, "one")]


def grams(text, n=3):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def test_near_pairs_equal_brute_force(spark):
    rows = corpus() + ODD
    sets = {i: grams(t) for i, t in rows if i is not None and grams(t)}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                want[a, b] = (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6))
    got = near.similar_pairs(frame(spark, rows)).collect()
    assert len(got) == len({(r.doc_a, r.doc_b) for r in got})
    assert {(r.doc_a, r.doc_b): (r.n_common, r.jaccard) for r in got} == want and len(want) > 20


def test_signature_trees_lose_nothing():
    """The dual traversal against all pairs, without routing."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, rng.integers(1, 90), dtype=np.uint64) for _ in range(40)]
    sets = base + [np.unique(np.concatenate([b[: max(1, len(b) * 3 // 4)], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for b in base]
    sets = [np.unique(s) for s in sets]
    bits, size = [near.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    found = {(min(i, j), max(i, j)) for a, b in near.tree_join(bits, size, np.arange(len(sets)), 0.5) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert want <= found and len(want) >= 20 and len(found) < len(sets) * (len(sets) - 1) / 4


def test_one_of_each_near_group_stays(spark):
    rows = corpus(2) + ODD
    pairs = near.similar_pairs(frame(spark, rows)).collect()
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        a, b = sorted((top(r.doc_a), top(r.doc_b)))
        root[b] = a
    want = [(-1 if i is None else i, t) for i, t in rows if i is None or top(i) == i]
    got = near.drop_near_copies(frame(spark, rows)).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in got) == sorted((i, t or "") for i, t in want)


@pytest.mark.parametrize("block", [2048, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    """Also with groups split into many cells, and with a doc_id that has several texts."""
    monkeypatch.setattr(near, "BLOCK", block)
    family = "one family of texts that differ by a word here or there but not by many of them so that all are alike".split()
    rows = corpus(8, 30) + ODD + [(1000 + k, " ".join([*family[:k], f"w{k}", *family[k + 1 :]])) for k in range(20)] + [(7, "x y z of another text"), (1030, "x y z of another text")]
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i].add(frozenset(grams(t)))
    links, root = defaultdict(int), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = sum(len(x & y) >= 0.5 * len(x | y) for x in sets[a] for y in sets[b] if x and y)
            if a != b and n:
                links[a] += n
                low, high = sorted((top(a), top(b)))
                root[high] = low
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.classes(frame(spark, rows)).collect()}
    assert got == {i: (top(i), links[i]) for i in sets} and links[1005] == 19 and got[7][0] == got[1030][0]


@pytest.mark.parametrize("memtable", [200_000, 3])
def test_exact_copies_equal_brute_force(spark, memtable):
    rows = corpus(3) + ODD
    first, want = {}, set()
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t is not None)):
        if first.setdefault(t, i) != i:
            want.add((i, first[t]))
    got = [(r.doc_id, r.keep_id) for r in exact.exact_copies(frame(spark, rows), memtable).collect()]
    assert sorted(got) == sorted(want) and (906, 905) in want and (904, 903) in want
    kept = sorted((r.doc_id or -1, r.text or "") for r in exact.drop_copies(frame(spark, rows)).collect())
    assert kept == sorted((i or -1, t or "") for i, t in rows if i not in {x for x, _ in want})


@pytest.mark.parametrize("salt", [10_000, 2])
def test_digest_collision_is_not_a_copy(spark, monkeypatch, salt):
    """Digests of one byte: most collide, and only equal bytes are copies; with hot keepers in several tasks too."""
    monkeypatch.setattr(exact, "SALT", salt)
    rows = [(k, f"text {k % 300}") for k in range(900)] + [(2000 + k, "hot") for k in range(50)]
    got = sorted((r.doc_id, r.keep_id) for r in exact.exact_copies(frame(spark, rows), 100, digest_bytes=1).collect())
    assert got == [(k, k % 300) for k in range(300, 900)] + [(2000 + k, 2000) for k in range(1, 50)]


def test_index_levels_find_what_was_added():
    rng = np.random.default_rng(3)
    digests = np.unique(np.frombuffer(rng.bytes(16 * 500), exact.DIGEST))
    digests["hi"] //= np.uint64(2**62)  # equal first halves
    digests, index, lost, least = np.unique(digests), exact.Index(), defaultdict(set), {}
    for _ in range(40):
        k = np.unique(rng.integers(0, len(digests), 60))
        ids = rng.integers(0, 10**6, len(k))
        for d, i in zip(k, ids, strict=True):
            if d in least and least[d] != i:
                lost[d].add(max(least[d], i))
            least[d] = min(least.get(d, i), i)
        ld, li = index.add(digests[k], ids, np.zeros(len(k), bool))
        for d, i in zip(ld, li, strict=True):
            lost[int(np.flatnonzero(digests == d)[0])].remove(i)
    have = {int(np.flatnonzero(digests == d)[0]): int(i) for level in index.levels for d, i in zip(level.d, level.i, strict=True)}
    assert have == least and not any(lost.values()) and len(index.levels) <= 10
    assert sum(len(x.d) for x in index.levels) == len(least)


def test_bloom_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    d = np.frombuffer(rng.bytes(16 * 1000), exact.DIGEST)
    assert exact.Filter.of(d).may_hold(d).all()
    assert exact.Filter.of(d).may_hold(np.frombuffer(rng.bytes(16 * 1000), exact.DIGEST)).mean() < 0.1


def brute_spans(rows, length):
    seen, out = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        w = re.split("[ \t\r\n\f\v]+", t)
        w = [x for x in w if x]
        for k in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[k : k + length]), (i, k)) != (i, k):
                out[i].add(k)
    spans = set()
    for i, ks in out.items():
        a = b = None
        for k in sorted(ks):
            if a is not None and k <= b:
                b = k + length
            else:
                if a is not None:
                    spans.add((i, a, b))
                a, b = k, k + length
        spans.add((i, a, b))
    return spans


@pytest.mark.parametrize("length,anchor,per", [(50, None, 40_000), (8, None, 40_000), (8, 1, 300), (5, 3, 100)])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, length, anchor, per):
    # many suffixes with one first word, and one passage in many documents
    hot = [(970 + k, f"{k} the lead " + " ".join(f"the w{(k * 7 + j) % 40}" for j in range(30)) + " one hot passage of words that each of these holds and that is long enough to count as one " * 3 + f"end {k}") for k in range(25)]
    rows = corpus(5, 40) + [(i, t if t is None else t[:2000]) for i, t in ODD] + [(950, "y z " * 60), (951, "y z " * 55)] + hot + [hot[3], (1100, hot[3][1])]
    monkeypatch.setattr(suffix, "PER_TARGET", per)
    monkeypatch.setattr(suffix, "CHUNK", 50)
    monkeypatch.setattr(suffix, "RUN_BYTES", 5000)
    got = {(r.doc_id, r.start, r.stop) for r in suffix.repeated_spans(frame(spark, rows), length, anchor).collect()}
    assert got == brute_spans(rows, length) and got


def test_spans_are_cut(spark):
    rows = [(1, "a b c d e f"), (2, "x  b c d\n e y"), (3, None)]
    d = frame(spark, rows)
    got = {r.doc_id: r.text for r in suffix.without_spans(d, suffix.repeated_spans(d, 4)).collect()}
    assert got == {1: "a b c d e f", 2: "x  y", 3: None}


def test_loser_tree_sorts_and_knows_prefixes():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choices("ab ", k=rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(5)]
    coded = []
    for r in runs:
        shared, rest = suffix.front_code(r) if r else (np.zeros(0, int), [])
        coded.append({"shared": np.array(shared, np.int32).tobytes(), "rest_len": np.array([len(x) for x in rest], np.int32).tobytes(), "rest": b"".join(rest)})
    got = list(suffix.LoserTree([suffix._decoded(c, 0) for c in coded]))
    assert [s for s, _, _ in got] == sorted(x for r in runs for x in r)
    for (a, _, _), (b, shared, _) in zip(got, got[1:], strict=False):
        assert shared == suffix.mismatch(a, b, 0)


def brute_passages(rows, length, ends=".!?,;:"):
    """Removed spans as lines.repeats() gives them, from the texts' words one by one."""
    first, found = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        units, at = [], 0
        for line in t.split("\n"):
            fresh = True
            for m in re.finditer("[^ \t\r\f\v]+", line):
                if fresh:
                    units.append([])
                units[-1].append((m[0].lower(), at + m.start(), at + m.end()))
                fresh = bool(ends) and m[0][-1] in ends
            at += len(line) + 1
        before = 0
        for k in range(len(units)):
            m, w = k, []
            while m < len(units) and len(w) < length:
                w, m = w + units[m], m + 1
            if len(w) >= length:
                keep = first.setdefault(" ".join(x[0] for x in w), (i, k))
                if keep != (i, k):
                    found[i].add((before, k, m - 1, w[0][1], w[-1][2], before + len(w), *keep))
            before += len(units[k])
    out = []
    for i, passages in found.items():
        reach = -1
        for word, k, last, start, stop, end, *keep in sorted(passages):
            if word > reach:
                out.append([i, k, last, start, stop, word, end, *keep])
            else:
                out[-1][2], out[-1][4], out[-1][6] = last, stop, end
            reach = end
    return sorted((i, k, last, start, stop, *keep) for i, k, last, start, stop, word, end, *keep in out)


LINES = [
    (960, "ÀÉ ñ one two three, four\nother line"),
    (961, "x\n àé  ñ one TWO three, four five"),
    (962, "start in the middle of " + "a passage. It has parts, some long: others short! Then it goes on " * 2 + "and ends somewhere else"),
    (963, "Another beginning with a passage. It has parts, some long: others short! Then it goes on to other things\nthis is a hot line of boilerplate"),
    (964, "this is a hot line of boilerplate\nclean text of its own that nobody has copied from anywhere at all"),
]


@pytest.mark.parametrize("kind,length", [(lines.PART, 30), (lines.PART, 8), (lines.LINE, 6)])
def test_passages_equal_brute_force(spark, kind, length):
    rows = corpus(6) + ODD + LINES
    got = sorted(tuple(r) for r in lines.repeats(frame(spark, rows), kind, length).select("doc_id", "unit", "last_unit", "start", "stop", "keep_doc_id", "keep_unit").collect())
    assert got == brute_passages(rows, length, ".!?,;:" if kind == lines.PART else "") and len(got) > 10


def test_passage_inside_lines_is_found_and_stock_lines_are_not(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passage, stock = say(60), "all rights reserved by the owners of this page"
    rows = [(k, f"{say(20)} {passage} {say(20)}\n{stock}" if k % 2 else f"{say(40)}\n{stock}\n{say(9)}") for k in range(20)]
    got = lines.repeats(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(3, 20, 2)) and {r.keep_doc_id for r in got} == {1}
    assert all(dict(rows)[r.doc_id][r.start : r.stop] in passage for r in got)


def test_spans_of_lines_are_cut_with_offsets(spark):
    d = frame(spark, [(1, "a b c d e\nkeep me"), (2, "first\nA b  c d e\nlast"), (3, None), (4, "")])
    got = {r.doc_id: r for r in lines.without_repeats(d, length=5).collect()}
    assert got[1].text == "a b c d e\nkeep me" and got[2].text == "first\n\nlast" and got[3].text is None and got[4].text == ""
    assert ["first\nA b  c d e\nlast"[s.start : s.stop] for s in got[2].kept_spans] == ["first\n", "\nlast"]


def test_paragraphs(spark):
    d = frame(spark, [(1, "one two three\nfour five\n\nrest"), (2, "intro\n \none  two three four five")])
    assert [(r.doc_id, r.unit) for r in lines.repeats(d, lines.PARAGRAPH, 5).collect()] == [(2, 1)]


OPS = {
    "near": near.similar_pairs, "near_classes": near.classes, "near_drop": near.drop_near_copies, "exact": exact.exact_copies, "exact_drop": exact.drop_copies,
    "suffix": suffix.repeated_spans, "lines": lines.repeats, "lines_drop": lines.without_repeats, "suffix_drop": lambda d: suffix.without_spans(d, suffix.repeated_spans(d)),
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_all_null(spark, name):
    rows = OPS[name](frame(spark, [(None, None), (None, ""), (1, None), (None, "a b c d e f")])).count()
    assert rows == (4 if name.endswith("drop") else 1 if name == "near_classes" else 0)


@pytest.mark.parametrize("name", OPS)
def test_clashing_columns(spark, name):
    t = "w1 w2 w3 w4 w5 w6 " * 12
    d = spark.createDataFrame([(k, t, 1, "g", 2, "c", 3, "k", "q", 4, 5, "z") for k in (1, 2)], CLASH)
    out = OPS[name](d)
    assert out.count() >= 1
    if name.endswith("drop"):
        assert set(d.columns) <= set(out.columns)
