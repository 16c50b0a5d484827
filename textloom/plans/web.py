"""Queries over pages and page-like features of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.functions.html import page_text
from textloom.operators import pages as P
from textloom.operators import segment, urlfeatures
from textloom.plans.registry import query
from textloom.plans.search import documents
from textloom.storage import table

PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
SEG = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
QS = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
PAIRS = f"""pr AS (SELECT page_id, unnest(regexp_split_to_array({QS}, '[&;]')) AS kv, unnest(range(0, len(regexp_split_to_array({QS}, '[&;]')))) AS k FROM pages WHERE url IS NOT NULL),
pv AS (SELECT page_id, split_part(kv, '=', 1) AS name, regexp_extract(kv, '^[^=]*=(.*)$', 1) AS value, k FROM pr WHERE regexp_matches(kv, '^[^=]*=.+'))"""
FEATURES = f"""WITH {PAIRS}, sg AS (SELECT page_id, unnest({SEG}) AS s, unnest(range(0, len({SEG}))) AS i FROM pages WHERE url IS NOT NULL),
f AS (SELECT page_id, 'segments:' || len({SEG}) AS feature FROM pages WHERE url IS NOT NULL
UNION SELECT page_id, 'param_name:' || name FROM pv
UNION SELECT page_id, 'param:' || name || '=[''' || string_agg(value, ''', ''' ORDER BY k) || ''']' FROM pv GROUP BY page_id, name
UNION SELECT page_id, 'segment_name_' || i || ':' || s FROM sg
UNION SELECT page_id, 'segment_len_' || i || ':' || strlen(s) FROM sg
UNION SELECT page_id, 'segment_[0-9]_' || i || ':1' FROM sg WHERE regexp_matches(s, '^[0-9]+$')
UNION SELECT page_id, 'segment_substr[0-9]_' || i || ':1' FROM sg WHERE regexp_matches(s, '^[^0-9]+[0-9]+[^0-9]+$')
UNION SELECT page_id, 'segment_ext_' || i || ':' || split_part(s, '.', -1) FROM sg WHERE regexp_matches(s, '^.+\\..+$')
UNION SELECT page_id, 'segment_ext_substr[0-9]_' || i || ':' || split_part(s, '.', -1) FROM sg WHERE regexp_matches(s, '^[^0-9]+[0-9]+[^0-9]+\\..+$'))"""
KEY = f"split_part(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '.', 1) || '|' || len({SEG}) || '|' || CASE WHEN {QS} <> '' THEN 'true' ELSE 'false' END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(FEATURES + " SELECT feature, count(*) AS cnt FROM f GROUP BY feature HAVING count(*) >= 0.05 * (SELECT count(*) FROM pages WHERE url IS NOT NULL)")
def url_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfeatures.feature_counts(pages(spark, sf_dir))


@query(FEATURES + " SELECT page_id, feature FROM f")
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfeatures.feature_rows(pages(spark, sf_dir))


@query(f"WITH s AS (SELECT page_id, unnest({SEG}) AS segment, unnest(range(0, len({SEG}))) AS i FROM pages WHERE url IS NOT NULL) SELECT page_id, i::BIGINT AS i, segment FROM s")
def url_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.posexplode(U.segments(U.decoded(F.col("url")))).alias("i", "segment")).withColumn("i", F.col("i").cast("bigint"))


@query(f"WITH {PAIRS} SELECT page_id, name, string_agg(value, '|' ORDER BY k) AS vals FROM pv GROUP BY page_id, name")
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.explode(U.params(U.decoded(F.col("url")))).alias("p")).select("page_id", "p.name", F.array_join("p.values", "|").alias("vals"))


@query(FEATURES + """, k AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id FROM f WHERE NOT starts_with(feature, 'segment_len') GROUP BY feature HAVING count(*) > 8)
SELECT page_id, array_to_string(list(id ORDER BY id), ' ') AS present FROM f JOIN k USING (feature) GROUP BY page_id""")
def url_binary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = urlfeatures.binary_matrix(pages(spark, sf_dir), 8)
    return m.select("page_id", F.array_join(F.transform("present", lambda x: x.cast("string")), " ").alias("present"))


@query("SELECT page_id, url FROM pages ORDER BY md5('s-' || page_id), page_id LIMIT 100")
def url_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfeatures.sample(pages(spark, sf_dir), 100).select("page_id", "url")


@query(FEATURES + """, h AS (SELECT feature, count(*) FILTER (page_id % 2 = 0) AS a, count(*) FILTER (page_id % 2 = 1) AS b FROM f GROUP BY feature),
n AS (SELECT count(*) FILTER (page_id % 2 = 0) AS na, count(*) FILTER (page_id % 2 = 1) AS nb FROM pages WHERE url IS NOT NULL),
c AS (SELECT count(*) FILTER (a >= 0.05 * na) AS n_golden, count(*) FILTER (b >= 0.05 * nb) AS n_found, count(*) FILTER (a >= 0.05 * na AND b >= 0.05 * nb) AS n_hit FROM h, n)
SELECT n_golden, n_found, n_hit, round(n_hit / n_golden, 6) AS share, round(n_found / n_golden, 6) AS ratio FROM c""")
def golden_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of one half of the pages against those of the other."""
    p = pages(spark, sf_dir)
    return urlfeatures.overlap(urlfeatures.feature_counts(p.where("page_id % 2 = 1")), urlfeatures.feature_counts(p.where("page_id % 2 = 0")))


def _tag(tag: str) -> str:
    return f"regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"


def _words_in(tag: str) -> str:
    return f"coalesce(list_sum(list_transform({_tag(tag)}, lambda s: len(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')))), 0)::BIGINT"


@query(f"""SELECT page_id, len({_tag('a')}) AS n_links, len({_tag('title')}) AS n_titles, len({_tag('p')}) AS n_paragraphs,
{_words_in('a')} AS link_words, {_words_in('title')} AS title_words FROM pages WHERE html IS NOT NULL""")
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tag_counts(pages(spark, sf_dir))


@query()
def html_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zone_counts(pages(spark, sf_dir))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", page_text("html").alias("text"))


@query("""SELECT page_id, length(url) AS n_chars, length(regexp_replace(url, '[^0-9]', '', 'g')) AS n_digits,
length(regexp_replace(url, '[^./_-]', '', 'g')) AS n_separators FROM pages WHERE url IS NOT NULL""")
def page_url_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.url_stats(pages(spark, sf_dir))


@query("""SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS n_0,
((length(lower(text)) - length(replace(lower(text), 'en', ''))) // 2)::BIGINT AS n_1, ((length(lower(text)) - length(replace(lower(text), '. ', ''))) // 2)::BIGINT AS n_2 FROM documents WHERE text IS NOT NULL""")
def substr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.substring_counts(documents(spark, sf_dir), ["the", "en", ". "])


@query("SELECT doc_id, floor(list_sum(list_transform(string_split(text, ' '), lambda x: length(x))) / len(string_split(text, ' ')))::BIGINT AS avg_len FROM documents WHERE text IS NOT NULL")
def avg_word_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.average_word_length(documents(spark, sf_dir))


@query()
def compress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compress_ratio(documents(spark, sf_dir))


@query("""SELECT page_id, regexp_replace(url, '[!-/:-@\\[-`{-~]', '', 'g') AS bare, trim(regexp_replace(html, '[ \\t\\r\\n]+', ' ', 'g')) = html AS tidy,
decode(from_base64(base64(encode(url)))) = url AS b64 FROM pages""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    b64 = F.decode(F.unbase64(F.base64(F.encode("url", "UTF-8"))), "UTF-8") == F.col("url")
    return p.select("page_id", T.strip_punctuation(F.col("url")).alias("bare"), (F.trim(T.collapse(F.col("html"))) == F.col("html")).alias("tidy"), b64.alias("b64"))


@query("""SELECT term AS word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_words(documents(spark, sf_dir)).withColumnRenamed("term", "word")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a crawl stream: cluster by the URL alone, arrival by page_id, wanted by a hash."""
    key = segment.segment_key(F.col("url"))
    wanted = F.substring(F.md5(F.col("page_id").cast("string")), 1, 1) < "8"
    return pages(spark, sf_dir).where("url is not null").select("page_id", key.alias("cluster"), F.col("page_id").alias("arrival"), wanted.alias("wanted"))


QUOTA = f"""WITH k AS (SELECT page_id, {KEY} AS cluster, substr(md5(page_id::VARCHAR), 1, 1) < '8' AS wanted FROM pages WHERE url IS NOT NULL),
c AS (SELECT cluster, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS quota FROM k WHERE wanted GROUP BY cluster)"""
ADMIT = QUOTA + """, r AS (SELECT k.*, coalesce(row_number() OVER (PARTITION BY k.cluster ORDER BY page_id) <= ceil(quota), false) AS within FROM k LEFT JOIN c USING (cluster)),
a AS (SELECT *, within AND sum(within::INT) OVER (ORDER BY page_id) <= 80 AS accepted FROM r)"""


@query(QUOTA + " SELECT cluster, n, round(quota, 6) AS quota FROM c")
def cluster_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.cluster_quota(_keyed(spark, sf_dir).where("wanted"), 100).withColumn("quota", F.round("quota", 6))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _keyed(spark, sf_dir)
    return segment.admit(stream, segment.cluster_quota(stream.where("wanted"), 100), cap=80)


@query(ADMIT + " SELECT page_id, cluster, accepted FROM a")
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir).select("page_id", "cluster", "accepted")


@query(ADMIT + """, n AS (SELECT count(*) FILTER (accepted) AS fetched, count(*) FILTER (wanted) AS wanted, count(*) FILTER (accepted AND wanted) AS hit FROM a)
SELECT fetched, wanted, hit, round(hit / fetched, 6) AS precision, round(hit / wanted, 6) AS recall, round(2 * (hit / fetched) * (hit / wanted) / (hit / fetched + hit / wanted), 6) AS f1 FROM n""")
def crawl_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.crawl_f1(_admitted(spark, sf_dir))


@query()
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.url_clusters(pages(spark, sf_dir).select("page_id", "url"))
    return c.select("page_id", F.col("cluster").cast("bigint").alias("cluster"))


def _labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as pages: the first line is title and link, the rest the body; a bad document is spam."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality in (0, 1)"), "doc_id").where("text is not null")
    first, clean = F.substring_index("text", "\n", 1), lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>"), clean(first), F.lit("</title></head><body><a href='/'>"), clean(first), F.lit("</a><p>"), clean(F.col("text")), F.lit("</p></body></html>"))
    return d.select(F.col("doc_id").alias("key"), html.alias("html"), F.concat_ws("/", F.lit("http:/"), "source", "lang", F.col("doc_id").cast("string")).alias("url"), (1 - F.col("quality")).cast("double").alias("label"))


def _spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary is the 100 words that most documents have, in place of a given list."""
    words = [r.word for r in top_words(spark, sf_dir).orderBy(F.desc("df"), "word").limit(100).collect()]
    return P.spam_scores(_labelled_pages(spark, sf_dir), words, folds=3)


@query()
def gbt_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spam(spark, sf_dir)


@query()
def spam_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.f1_by_fold(_spam(spark, sf_dir))
