"""Plain versions of the quality score, of convolution and of grouping, a line, a word or a pair at a time."""

import math
import re

SYMBOLS = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"}
POINTS = set(b".,;:?!")


def line_features(line: bytes) -> list[float]:
    words = re.findall(rb"[^ \t\n\r\f\v]+", line)
    n, size = len(words), len(line)
    count = lambda inside: sum(c in inside for c in line)
    upper, digits, symbols = count(set(range(65, 91))), count(set(range(48, 58))), count(SYMBOLS)
    letters = count({*range(65, 91), *range(97, 123), *range(128, 256)})
    up, dig, sym = upper / max(letters, 1), digits / size, symbols / size
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    tail = sum(w[-1] in SYMBOLS for w in words) / n
    return [1, math.log1p(size) / 6, up, up > 0.5, dig, dig > 0.2, sym, sym > 0.08, count(POINTS) / size, again, again > 0.3, tail, tail > 0.4, size / n / 10, line[-1] in POINTS, n <= 2]


def quality(text, model) -> tuple[float, int, int, bool]:
    """quality, n_lines, n_bad, keep of one text by the weights of a model: sums over all paths, forwards and backwards."""
    lines = [x for x in (text or "").encode().split(b"\n") if re.search(rb"[^ \t\n\r\f\v]", x)]
    if not lines:
        return 0.0, 0, 0, False
    x = [line_features(line) for line in lines]
    none = [0.0] * len(x[0])
    score = [sum(a * w for a, w in zip([*mine, *before, *after], model.weights, strict=True)) for mine, before, after in zip(x, [none, *x], [*x[1:], none], strict=False)]
    psi = [[math.exp(model.trans[a][b]) for b in (0, 1)] for a in (0, 1)]
    fwd, good = [], []
    for k, s in enumerate(score):
        e = (1.0, math.exp(s))
        now = [e[b] * (sum(fwd[-1][a] * psi[a][b] for a in (0, 1)) if k else 1) for b in (0, 1)]
        fwd.append([v / sum(now) for v in now])
    back = [1.0, 1.0]
    for k in range(len(score) - 1, -1, -1):
        both = [fwd[k][b] * back[b] for b in (0, 1)]
        good.append(both[1] / sum(both))
        e = (1.0, math.exp(score[k]))
        back = [sum(psi[a][b] * e[b] * back[b] for b in (0, 1)) for a in (0, 1)]
        back = [v / sum(back) for v in back]
    good.reverse()
    q = sum(p * len(line) for p, line in zip(good, lines, strict=True)) / sum(map(len, lines))
    return q, len(lines), sum(p < 0.5 for p in good), q >= model.threshold


def grams(text, n=3):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def roots(ids, links):
    """The smallest member of each one's connected part."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {i: top(i) for i in ids}
