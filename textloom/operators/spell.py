"""Query spelling: language model counts, nearest dictionary words, and a noisy channel with a learned error model.

Fuzzy joins don't cross the query words with the dictionary. Two words within k edits share at least one deletion variant of up to k characters
removed from each, so both sides are exploded into variants and joined on equality; the distance is then checked on the candidates. Exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.functions import text as T
from textloom.functions.edits import edits
from textloom.storage import cut


def valid(word: Column) -> Column:
    """Lower case without spaces and punctuation, or null where something other than letters is left."""
    w = F.lower(T.strip_punctuation(F.replace(word, F.lit(" "), F.lit(""))))
    return F.when(w.rlike("^\\p{L}+$"), w)


def unigrams(lines: DataFrame, text: str = "text") -> DataFrame:
    """word, cnt."""
    return lines.where(F.col(text).isNotNull()).select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def bigrams(lines: DataFrame, text: str = "text") -> DataFrame:
    """w1, w2, cnt of adjacent words, made within the row: no window, no sort."""
    w = lines.where(F.col(text).isNotNull()).select(T.words(F.col(text)).alias("w"))
    two = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return w.select(F.explode(two).alias("b")).where("b.w2 is not null").groupBy("b.w1", "b.w2").agg(F.count("*").alias("cnt"))


@F.pandas_udf(ArrayType(StringType()))
def deletions(word: pd.Series, k: pd.Series) -> pd.Series:
    """The distinct strings that are left of each word when up to k characters are removed."""

    def of(w: str | None, k: int) -> list[str] | None:
        if w is None:
            return None
        every, last = {w}, {w}
        for _ in range(k):
            last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
            every |= last
        return sorted(every)

    return pd.Series([of(w, n) for w, n in zip(word, k, strict=True)])


def candidates(words: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """q, word, dist of the dictionary words (column word) within k edits of each distinct q."""
    q = words.select("q").where("q is not null").distinct().select("q", F.explode(deletions("q", F.lit(k))).alias("v"))
    d = dictionary.select("word").where("word is not null").distinct().select("word", F.explode(deletions("word", F.lit(k))).alias("v"))
    both = q.join(d, "v").select("q", "word").distinct()
    return both.withColumn("dist", F.levenshtein("q", "word").cast("bigint")).where(F.col("dist") <= k)


def nearest(words: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """q, word, dist, cnt: of the words within k edits the nearest, then the most frequent (cnt), then the first by name."""
    w = W.partitionBy("q").orderBy("dist", F.desc("cnt"), "word")
    return candidates(words, dictionary, k).join(dictionary.select("word", "cnt"), "word").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("q", "word", "dist", "cnt")


def nearest_any(words: DataFrame, dictionary: DataFrame, k: int = 2) -> DataFrame:
    """As nearest(), but over the whole dictionary: a q without a word within k edits is looked for among all words.

    What is left is few: a bound for each comes from its distance to the most frequent word of every length, and it meets only
    the words whose length can be within the bound, by a join on the length."""
    near = cut(nearest(words, dictionary, k), "nearest")
    far = cut(words.select("q").where("q is not null").distinct().join(near, "q", "left_anti"), "far")
    if far.isEmpty():
        return near
    # a first bound: the distance to the most frequent word of each length, one row a length
    top = dictionary.where("word is not null").groupBy(F.length("word").alias("n")).agg(F.max(F.struct("cnt", "word")).alias("m"))
    bound = far.join(F.broadcast(top.select("n", "m.word")), F.lit(True)).groupBy("q").agg(F.min(F.levenshtein("q", "word")).alias("bound"))
    sized = dictionary.where("word is not null").select("word", "cnt", F.length("word").alias("n"))
    at = bound.withColumn("n", F.explode(F.sequence(F.greatest(F.length("q") - F.col("bound"), F.lit(0)), F.length("q") + F.col("bound"))))
    found = at.join(sized, "n").withColumn("dist", F.levenshtein("q", "word").cast("bigint")).where(F.col("dist") <= F.col("bound"))
    best = found.groupBy("q").agg(F.min(F.struct("dist", (-F.col("cnt")).alias("less"), "word")).alias("m")).select("q", "m.word", "m.dist", (-F.col("m.less")).alias("cnt"))
    return near.unionByName(best)


def error_model(pairs: DataFrame) -> DataFrame:
    """op, a, b, cnt, p from pairs (wrong, right): counts of the edits that turn wrong into right, and their share of the operation's."""
    ops = pairs.where("wrong is not null and right is not null").select(F.explode(edits("wrong", "right")).alias("e"))
    counts = ops.groupBy("e.op", "e.a", "e.b").agg(F.count("*").alias("cnt"))
    return counts.withColumn("p", F.col("cnt") / F.sum("cnt").over(W.partitionBy("op")))


def correct(words: DataFrame, dictionary: DataFrame, model: DataFrame, k: int = 2, floor: float = 0.001, unseen: float = 0.0005) -> DataFrame:
    """q, word, dist, score of the best correction: log P(edits) + log P(word).

    An edit the model hasn't seen has the probability `unseen`; a candidate whose edits come to less than `floor` is kept only if
    nothing else is. A word of the dictionary is its own candidate with no edits. Ties go to the nearer, then the first by name."""
    total = dictionary.agg(F.sum("cnt").alias("total"))
    near = candidates(words, dictionary, k).withColumn("script", edits("q", "word"))
    edge = near.select("q", "word", "dist", F.explode_outer("script").alias("e")).select("q", "word", "dist", "e.op", "e.a", "e.b")
    priced = edge.join(model.select("op", "a", "b", "p"), ["op", "a", "b"], "left")
    cost = F.sum(F.when(F.col("op").isNull(), 0.0).otherwise(F.log(F.coalesce("p", F.lit(unseen)))))
    scored = priced.groupBy("q", "word", "dist").agg(cost.alias("log_edit")).join(dictionary.select("word", "cnt"), "word")
    scored = scored.join(F.broadcast(total), F.lit(True)).withColumn("score", F.col("log_edit") + F.log(F.col("cnt") / F.col("total")))
    scored = scored.withColumn("unlikely", F.col("log_edit") < F.log(F.lit(floor)))
    best = W.partitionBy("q").orderBy("unlikely", F.desc("score"), "dist", "word")
    return scored.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("q", "word", "dist", F.round("score", 6).alias("score"))


def query_log(lines: DataFrame) -> DataFrame:
    """raw, fixed from lines (column value) of one or two tab-separated fields; fixed is null where there is one."""
    p = F.split("value", "\t", -1)
    return lines.select(p[0].alias("raw"), F.when(F.size(p) > 1, F.try_element_at(p, F.lit(2))).alias("fixed"))


def log_pairs(log: DataFrame) -> DataFrame:
    """wrong, right: the words at the same place of raw and fixed, where both have as many words and these differ."""
    rows = log.where("fixed is not null").select(T.words(F.col("raw")).alias("r"), T.words(F.col("fixed")).alias("f")).where(F.size("r") == F.size("f"))
    return rows.select(F.explode(F.arrays_zip("r", "f")).alias("z")).select(F.col("z.r").alias("wrong"), F.col("z.f").alias("right")).where("wrong <> right")
