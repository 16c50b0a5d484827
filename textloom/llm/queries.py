"""Queries opN_<name> of the llm subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, exact, lines, media, mixing, near, pii, quality, suffix, toxicity
from textloom.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selected(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "pages"), "page_id", "html")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_mix_sources": op8_mix_sources,
    "op9_media_columns": op9_media_columns,
    "op10_bpe": op10_bpe,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])
  WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.5 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents WHERE doc_id IS NOT NULL UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, min(c) AS class_id, coalesce(max(n_links), 0)::BIGINT AS n_links
FROM r LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) ON a = doc_id GROUP BY doc_id""",
    "op5_exact_dedup": """
SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents
WHERE text IS NOT NULL AND doc_id IS NOT NULL) WHERE doc_id <> keep_id""",
    "op2_suffix_dedup": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n\f\v]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM t WHERE len(w) >= 50),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i+1:i+50], ' ') ORDER BY doc_id, i) AS n FROM p),
s AS (SELECT doc_id, i, CASE WHEN i > 50 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r WHERE n > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s)
SELECT doc_id, min(i) AS start, max(i) + 50 AS stop, max(i) + 50 - min(i) AS n_words FROM g GROUP BY doc_id, island""",
    "op3_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[ \t\r\n\f\v]*[^ \t\r\n\f\v]+') AS raw FROM documents),
w AS (SELECT doc_id, unnest(raw) AS raw, unnest(range(0, len(raw))) AS i FROM t),
p AS (SELECT doc_id, i, raw, regexp_replace(raw, '^[ \t\r\n\f\v]+', '') AS word, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM w),
b AS (SELECT *, (contains(raw, chr(10)) OR coalesce(regexp_matches(lag(word) OVER (PARTITION BY doc_id ORDER BY i), '[.!?,;:]$'), true))::INT AS begins FROM p),
n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM b),
u AS (SELECT doc_id, u - min(u) OVER (PARTITION BY doc_id) AS unit, min(i) AS a, max(i) + 1 AS b, arg_min(stop - length(word), i) AS start, max(stop) AS stop FROM n GROUP BY doc_id, u),
d AS (SELECT doc_id, list(lower(word) ORDER BY i) AS words FROM p GROUP BY doc_id),
k AS (SELECT x.doc_id, x.unit, y.unit AS last, x.a, y.b, x.start, y.stop FROM u x ASOF JOIN u y ON x.doc_id = y.doc_id AND x.a + 30 <= y.b),
f AS (SELECT k.*, array_to_string(words[a + 1 : b], ' ') AS norm FROM k JOIN d USING (doc_id)),
r AS (SELECT doc_id, unit, last, a, b, start, stop, first_value(doc_id) OVER w AS keep_doc_id, first_value(unit) OVER w AS keep_unit FROM f WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit)),
s AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r WHERE doc_id <> keep_doc_id OR unit <> keep_unit),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM s)
SELECT doc_id, min(unit)::BIGINT AS unit, max(last)::BIGINT AS last_unit, min(start) AS start, max(stop) AS stop,
  arg_min(keep_doc_id, a) AS keep_doc_id, arg_min(keep_unit, a)::BIGINT AS keep_unit FROM g GROUP BY doc_id, island""",
    "op8_mix_sources": r"""
WITH d AS (SELECT d.doc_id, source, len(string_split(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')), ' ')) AS n_tokens,
  CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE END AS known, coalesce(known, avg(known) OVER (PARTITION BY source), 1.0::DOUBLE) AS w FROM documents d LEFT JOIN labels l USING (doc_id) WHERE trim(text) <> ''),
k AS (SELECT *, -ln((('0x' || md5('17-' || doc_id)[1:13])::BIGINT::DOUBLE + 1) / 4503599627370498.0) / w AS key FROM d),
s AS (SELECT source, sum(n_tokens) AS total, CASE source WHEN 'src0' THEN 0.15::DOUBLE WHEN 'src1' THEN 0.15::DOUBLE WHEN 'src2' THEN 0.1::DOUBLE WHEN 'src3' THEN 0.05::DOUBLE END AS share FROM d GROUP BY source),
b AS (SELECT source, total, floor(0.6::DOUBLE * sum(total) OVER () * coalesce(share, (1 - sum(share) OVER ()) * total / sum(CASE WHEN share IS NULL THEN total END) OVER ()))::BIGINT AS budget FROM s),
r AS (SELECT k.*, budget // total AS epochs, budget % total AS rest,
  sum(n_tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN b USING (source))
SELECT doc_id, source, n_tokens, round(key, 9) AS key, (epochs + (upto <= rest)::INT)::BIGINT AS copies FROM r WHERE epochs + (upto <= rest)::INT > 0""",
}
