"""Table functions for SQL, by name after register(spark): url_features(url), shingles(text, k), sentence_candidates(text).

They give the rows of the Column builders of urls, text and operators.sentences; inside the engine those are used, as they stay on the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_PAIR = re.compile(r"^([^=]*)=(.+)$", re.S)


@udtf(returnType="feature string")
class UrlFeatures:
    def eval(self, url: str) -> Iterator[tuple[str]]:
        if url is None:
            return
        url = unquote(url, errors="replace")
        path, query = re.match(r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", url)[1], re.match(r"^(?:[^?#]*\?([^#]*))?", url)[1] or ""
        parts = [s for s in path.split("/") if s]
        out, named = {f"segments:{len(parts)}": None}, {}
        for kv in re.split("[&;]", query):
            if p := _PAIR.match(kv):
                name, value = (unquote(x.replace("+", " "), errors="replace") for x in p.groups())
                named.setdefault(name, []).append(value)
        for name, values in named.items():
            out[f"param_name:{name}"] = None
            out[f"param:{name}=[" + ", ".join(f"'{v}'" for v in values) + "]"] = None
        for i, s in enumerate(parts):
            out[f"segment_name_{i}:{s}"] = None
            out[f"segment_len_{i}:{len(s.encode())}"] = None
            if re.fullmatch("[0-9]+", s):
                out[f"segment_[0-9]_{i}:1"] = None
            if re.fullmatch("[^0-9]+[0-9]+[^0-9]+", s):
                out[f"segment_substr[0-9]_{i}:1"] = None
            if re.fullmatch(r".+\..+", s):
                out[f"segment_ext_{i}:{s.rpartition('.')[2]}"] = None
            if re.fullmatch(r"[^0-9]+[0-9]+[^0-9]+\..+", s):
                out[f"segment_ext_substr[0-9]_{i}:{s.rpartition('.')[2]}"] = None
        for feature in out:
            yield (feature,)


@udtf(returnType="pos bigint, h bigint")
class Shingles:
    def eval(self, text: str, k: int) -> Iterator[tuple[int, int]]:
        import hashlib

        w = re.findall(r"\w+", text or "")
        for at in range(len(w) - k + 1):
            yield at, int(hashlib.md5(" ".join(w[at : at + k]).encode()).hexdigest()[:8], 16)


FEATURES = ("is_excl", "is_quest", "is_dot", "next_upper", "next_space", "prev_word_len", "words_since", "words_since_end", "prev_word_upper", "prev_dot", "is_last", "prev_digit", "next_dot")


@udtf(returnType="pos bigint, " + ", ".join(f"{f} bigint" for f in FEATURES))
class SentenceCandidates:
    def eval(self, text: str) -> Iterator[tuple]:
        text, before = text or "", 0
        for m in re.finditer("[.?!]", text):
            at, ch, nxt = m.start(), m[0], text[m.end() : m.end() + 1]
            body, prev = text[before:at], text[at - 1 : at] if at else ""
            word = body.rpartition(" ")[2]
            row = (
                ch == "!", ch == "?", ch == ".", nxt.isupper(), nxt == " ", len(word), len(body.split(" ")) - body.split(" ").count(""),
                len((body if before else body[1:]).split(" ")) - (body if before else body[1:]).split(" ").count(""), word[:1].isupper(), prev == ".", nxt == "", prev in set("0123456789"), nxt == ".",
            )
            yield m.end(), *map(int, row)
            before = m.end()


def register(spark: SparkSession) -> None:
    for name, f in (("url_features", UrlFeatures), ("shingles", Shingles), ("sentence_candidates", SentenceCandidates)):
        spark.udtf.register(name, f)
