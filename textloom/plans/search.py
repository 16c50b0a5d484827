"""Queries over documents: near duplicates, the inverted index, boolean search, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codecs as C
from textloom.functions import text as T
from textloom.operators import boolquery, index, neardup
from textloom.plans.registry import query
from textloom.streaming.sources import search_stream, table_stream
from textloom.storage import cut, scratch, spread, table

WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
CASED, LOWER = WORDS.format("text"), WORDS.format("lower(text)")

HASHED = f"""
WITH w AS (SELECT doc_id, {CASED} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 4),
  lambda i: ('0x' || substr(md5(array_to_string(w[i:i+4], ' ')), 1, 8))::BIGINT) ELSE [] END AS h FROM w),
b AS (SELECT doc_id, h, list_transform(range(0, 20), lambda b: list_min(list_filter(h, lambda x: x % 20 = b))) AS m FROM h WHERE len(h) >= 20),
sig AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(list_filter(m, lambda x: x IS NOT NULL)) = 20 THEN m ELSE list_sort(h)[1:20] END)) AS sig FROM b)
"""

TERMS = f"WITH t AS (SELECT DISTINCT doc_id, unnest({LOWER}) AS term FROM documents WHERE doc_id IS NOT NULL)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(HASHED + """, c AS (SELECT min(doc_id) AS rep, sig FROM sig GROUP BY sig), l AS (SELECT rep, len(sig) AS n, unnest(sig) AS h FROM c),
p AS (SELECT a.rep AS doc_a, b.rep AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM l a JOIN l b ON a.h = b.h AND a.rep < b.rep GROUP BY ALL)
SELECT doc_a, doc_b, shared, round(100 * shared / (na + nb - shared))::BIGINT AS pct FROM p WHERE shared > 0.75 * (na + nb - shared)
UNION ALL SELECT rep, doc_id, len(sig), 100 FROM sig JOIN c USING (sig) WHERE doc_id <> rep""")
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(documents(spark, sf_dir))


@query(HASHED + "SELECT doc_id, n_words, len(h) AS n_shingles, list_min(h) AS min_hash FROM h")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.shingle_stats(documents(spark, sf_dir))


@query(HASHED + "SELECT doc_id, len(sig) AS n, sig[1] AS low, sig[-1] AS high, list_sum(sig)::BIGINT AS total FROM sig")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = neardup.sketch(documents(spark, sf_dir))
    total = F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("doc_id", F.size("sig").cast("bigint").alias("n"), F.element_at("sig", 1).alias("low"), F.element_at("sig", -1).alias("high"), total.alias("total"))


@query(HASHED + "SELECT doc_id, list_sum(list_sort(h)[1:20])::BIGINT AS total, list_sort(h)[20] AS twentieth FROM h WHERE len(h) >= 20")
def bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = neardup.bottom(documents(spark, sf_dir))
    return low.select("doc_id", F.aggregate("low", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.element_at("low", 20).alias("twentieth"))


@query(TERMS + " SELECT term, count(*) AS df FROM t GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_df(documents(spark, sf_dir))


@query(TERMS + " SELECT term, doc_id // 1048576 AS block, count(*) AS df, array_to_string(list(doc_id ORDER BY doc_id), ' ') AS docs FROM t GROUP BY 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index.postings(documents(spark, sf_dir))
    return p.withColumn("docs", F.array_join(F.transform("docs", lambda d: d.cast("string")), " "))


@query(TERMS + " SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 1048576 ORDER BY doc_id), 0) AS gap FROM t")
def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.delta_rows(documents(spark, sf_dir)).select("term", "doc_id", "gap")


@query(TERMS + """, r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term, doc_id // 1048576 ORDER BY doc_id) AS nth FROM t)
SELECT term, nth, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 1048576 ORDER BY doc_id), 0) AS gap FROM r WHERE nth % 50 = 0""")
def postings_skip50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.skips(documents(spark, sf_dir))


@query(TERMS + " SELECT term, doc_id FROM t")
def postings_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = index.undelta(index.deltas(index.postings(documents(spark, sf_dir))))
    return back.select("term", F.explode("docs").alias("doc_id"))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> index.Stored:
    """The index of a folder's documents, written to the shared folder when a session first asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        path = scratch(spark, "index")
        index.store(documents(spark, sf_dir), path)
        _STORED[at] = path
    return index.opened(spark, _STORED[at])


@query(TERMS + " SELECT doc_id FROM t WHERE term = 'the' INTERSECT SELECT doc_id FROM t WHERE term = 'of'")
def bool_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolquery.search(stored(spark, sf_dir), "the & of")


@query(TERMS + " SELECT doc_id FROM t WHERE term = 'der' UNION (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL EXCEPT SELECT doc_id FROM t WHERE term = 'en')")
def bool_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolquery.search(stored(spark, sf_dir), "der | !en")


@query(TERMS + """ (SELECT doc_id FROM t WHERE term = 'the' UNION SELECT doc_id FROM t WHERE term = 'la')
EXCEPT (SELECT doc_id FROM t WHERE term = 'of' INTERSECT SELECT doc_id FROM t WHERE term = 'is')""")
def bool_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolquery.search(stored(spark, sf_dir), "(the | la) & !(of & is)")


BATCH = ["the & of", "der | !en", "(the | la) & !(of & is)", "!the", "nosuchword", "la & !le & en"]


@query(f"""WITH d AS (SELECT doc_id, coalesce(list_distinct({LOWER}), []) AS w FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT 'the & of' AS query, doc_id FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'of')
UNION SELECT 'der | !en', doc_id FROM d WHERE list_contains(w, 'der') OR NOT list_contains(w, 'en')
UNION SELECT '(the | la) & !(of & is)', doc_id FROM d WHERE (list_contains(w, 'the') OR list_contains(w, 'la')) AND NOT (list_contains(w, 'of') AND list_contains(w, 'is'))
UNION SELECT '!the', doc_id FROM d WHERE NOT list_contains(w, 'the')
UNION SELECT 'la & !le & en', doc_id FROM d WHERE list_contains(w, 'la') AND NOT list_contains(w, 'le') AND list_contains(w, 'en'))
SELECT query, doc_id FROM q""")
def bool_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolquery.search_many(stored(spark, sf_dir), BATCH)


@query(f"""WITH d AS (SELECT coalesce(list_distinct({LOWER}), []) AS w FROM documents WHERE doc_id IS NOT NULL)
SELECT 'the & of' AS query, count(*) FILTER (list_contains(w, 'the') AND list_contains(w, 'of')) AS n FROM d
UNION ALL SELECT 'nosuchword', count(*) FILTER (list_contains(w, 'nosuchword')) FROM d""")
def bool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["the & of", "nosuchword"]
    return boolquery.report(boolquery.search_many(stored(spark, sf_dir), asked), asked)


@query(f"""WITH d AS (SELECT coalesce(list_distinct({LOWER}), []) AS w FROM documents WHERE doc_id IS NOT NULL)
SELECT query, (SELECT count(*) FROM d WHERE list_contains(w, a) AND NOT list_contains(w, b)) AS n
FROM (SELECT DISTINCT w[1] AS a, w[2] AS b, w[1] || ' & !' || w[2] AS query FROM (SELECT {LOWER} AS w FROM benchmark) WHERE len(w) > 1)""")
def search_stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of queries (the first word of each benchmark item without its second) against the stored index."""
    w = T.words(F.col("text"))
    asked = table_stream(spark, sf_dir, "benchmark").where(F.size(w) > 1).select(F.concat(w[0], F.lit(" & !"), w[1]).alias("query"))
    return search_stream(asked, stored(spark, sf_dir), scratch(spark, "answers")).distinct()


def _round_trip(df: DataFrame, encode, decode) -> DataFrame:
    coded = index.deltas(index.postings(df)).withColumn("coded", encode("gaps"))
    return coded.select("term", "block", F.length("coded").cast("bigint").alias("n_bytes"), (decode("coded") == F.col("gaps")).alias("same"))


@query(TERMS + """, g AS (SELECT term, doc_id // 1048576 AS block, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // 1048576 ORDER BY doc_id), 0) AS gap FROM t)
SELECT term, block, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END)::BIGINT AS n_bytes, true AS same FROM g GROUP BY 1, 2""")
def varbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(documents(spark, sf_dir), C.varbyte_encode, C.varbyte_decode)


@query()
def simple9_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(documents(spark, sf_dir), C.simple9_encode, C.simple9_decode)


@query(f"""WITH w AS (SELECT unnest({LOWER}) AS word FROM documents WHERE text IS NOT NULL) SELECT DISTINCT word FROM w""")
def unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()


@query(TERMS + """ SELECT q.term, (SELECT count(*) FROM t WHERE t.term = q.term) AS df, ('0x' || substr(md5(q.term), 1, 8))::BIGINT AS h
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) q""")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    found = index.term_docs(documents(spark, sf_dir)).join(asked, "term", "left_semi").groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    return asked.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), T.hash32(F.col("term")).alias("h"))


@query()
def murmur_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()
    return d.select("word", C.murmur3("word").alias("h"))


@query(TERMS + ", i AS (SELECT doc_id, term FROM t) SELECT doc_id, count(*) AS n_terms FROM i GROUP BY doc_id")
def index_saved_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is written, each file sorted by term, read back, and inverted again."""
    saved = cut(index.postings(documents(spark, sf_dir)), "postings")
    return saved.select(F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_terms"))
