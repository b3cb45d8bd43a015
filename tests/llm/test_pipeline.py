import re

import corpus_pipeline
import numpy as np
from test_decontam import find
from test_pii import pii
from test_simhash import brute_groups

from graphloom.llm import bpe, quality_model

TEXTS = [
    "The committee met on Tuesday to discuss the proposals for the new harbour and its many small boats.",
    "The committee met on Tuesday to discuss the proposals for the new harbour and its many small boats.",
    "A quite different story tells of rivers that run north and of people who follow them each spring.",
    "Please write to jane.doe@example.com about the bread and the flour that we ordered last week from you.",
    "In the old town the clock strikes twelve and every child knows that the baker opens his door at noon.",
    "### $$$ %%% &&& *** ||| <<< >>> ### $$$ %%% &&& *** ||| <<< >>> ###",
    None,
]
ITEM = "the clock strikes twelve and every child knows that the baker opens his door"


def tables(spark, path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def plain(docs, kept, items):
    """The stages after the classifier, one document at a time."""
    rows = [(d, t) for d, t in docs if d in kept]
    kept_rows = set(brute_groups(rows))
    rows = [row for i, row in enumerate(rows) if i in kept_rows]
    windows = set()
    for item in items:
        own = find(item)
        size = min(10, len(own))
        windows |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1 if own else 0)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = find(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    rows = [(d, t) for d, t in rows if clean(t)]
    encoder = bpe.Encoder(bpe.vocabulary())
    return {d: encoder.encode(pii.replace(t or "", {}, pii.KEY, True, True)[0]).tolist() for d, t in rows}


def hold(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = {r.doc_id for r in quality_model.classify(docs, labels).where("kept").collect()}
    items = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = plain([(r.doc_id, r.text) for r in docs.collect()], kept, items)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, path).collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[d], want[d]) for d in got)
    return got


def test_small_tables_against_plain_version(spark, tmp_path):
    tables(spark, tmp_path)
    got = hold(spark, str(tmp_path))
    assert 1 not in got and 4 not in got and {0, 2, 3} <= got.keys()


def test_documents_against_plain_version(spark):
    assert len(hold(spark, "/root/testdata/sf0.001")) > 20


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as score", "2 as kept", "3 as fp")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    for r in docs.collect():
        assert r.n_chars == len(r.text)
    assert not [r for r in docs.collect() if re.search(r"\.\d\d@mail\d\.example\.com", r.text)]


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
