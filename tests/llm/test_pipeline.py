"""The pipeline against a version that goes stage by stage with other means; and the llm queries against their SQL."""

import itertools

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.support import SMALL, duck, sparked
from textloom.llm import bpe, quality
from textloom.llm.common import cut, table
from textloom.llm.queries import ORACLE, QUERIES


def brute_force(spark, docs, labels):
    """(doc_id, tokens) of the pipeline's rows by other means: plain scores, texts in a set, all pairs, the mixing query's SQL, another encoder."""
    model = quality.train(docs, labels)
    rows = docs.toPandas()
    rows = rows[[brute.quality(t, model)[3] for t in rows.text]].sort_values("doc_id").drop_duplicates("text")
    sets = {r.doc_id: brute.grams(r.text) for r in rows.itertuples()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    root = brute.roots(sets, links)
    documents = rows[rows.doc_id.map(lambda i: root[i] == i)]
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels.toPandas())
    taken = con.execute(ORACLE["op8_mix_sources"]).df()
    copies = dict(zip(taken.doc_id, taken.copies, strict=True))
    other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder(bpe.VOCABULARY).ranks, special_tokens={})
    return sorted((r.doc_id, other.encode(r.text, disallowed_special=())) for r in documents.itertuples() for _ in range(int(copies.get(r.doc_id, 0))))


def test_pipeline_equals_brute_force(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    want = brute_force(spark, docs, labels)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in got)
    assert sorted((r.doc_id, r.tokens) for r in got) == want and len(want) > 20


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns with the operators' own names go through all stages."""
    names = ["copies", "mix_id", "mix_row", "sid", "class_id", "keeper", "salt", "hi", "weight", "q", "key", "bucket"]
    clash = [F.lit(k).alias(n) for k, n in enumerate(names)]
    known = table(spark, SMALL, "documents").join(table(spark, SMALL, "labels").where("quality = 1"), "doc_id").where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(8).collect()
    good = "\n".join(r.text.split("\n")[0] for r in known) + "\n"
    odd = [(None, good + "One."), (70001, None), (70002, ""), (70003, " \n "), (70004, good + "Two."), (70004, good + "Two."), (70005, good + "Two."), (70006, (good + "And more.\n") * 400), (70007, None)]
    extra = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in odd], table(spark, SMALL, "documents").schema)
    docs = table(spark, SMALL, "documents").unionByName(extra).select("*", *clash)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), f"odd-{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "bpe" or set(names) <= set(docs.columns)
    assert not {70001, 70002, 70003, 70007} & set(kept["quality"]) and {None, 70004, 70005, 70006} <= set(kept["quality"])
    # a row without doc_id is never a copy; of the repeated document both rows stay, its copy goes
    assert kept["exact_dedup"].count(70004) == 2 and 70005 not in kept["exact_dedup"] and None in kept["exact_dedup"]
    assert kept["near_dedup"].count(70004) == 2 and None in kept["near_dedup"] and None not in kept["mix"]
    assert all(r.round_trip for r in docs.collect())


def test_stages_return_documents(spark):
    docs = table(spark, SMALL, "documents").limit(50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert dict(out.dtypes) == dict(docs.dtypes), name


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, name):
    assert sparked(QUERIES[name](spark, SMALL)) == duck(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_every_row_has_a_result(spark, name):
    n = table(spark, SMALL, "pages" if "media" in name else "documents").count()
    assert QUERIES[name](spark, SMALL).count() == n


def test_approximate_routing_recall():
    """What the band keys miss at the threshold and above."""
    from textloom.llm.near import BANDS

    assert all((1 - s * s) ** BANDS < 0.001 for s in np.arange(0.5, 1, 0.05))
