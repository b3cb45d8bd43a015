import re
from pathlib import Path

import numpy as np
from cases import documents

from graphloom.llm import quality_model
from graphloom.llm.common import shared_dir, texts


def chunk(*found):
    import pyarrow as pa

    t = texts(pa.array(found, pa.string()))
    return quality_model.Chunk(t, 0, len(t))


def test_rates_against_plain_python():
    found = ["The THE the cat!! ### é", "", "a b c a b c a b", "x" * 50 + " 12 | |", None]
    c = chunk(*found)
    for i, text in enumerate(found):
        words = (text or "").split()
        n = max(1, len(words))
        low = [w.lower() for w in words]
        assert c.n[i] == len(words)
        assert np.isclose(c.rates["variety"][i], 1 - len(set(low)) / n)
        assert np.isclose(c.rates["stutter"][i], sum(a == b for a, b in zip(low, low[1:], strict=False)) / n)
        windows = list(zip(low, low[1:], low[2:], strict=False))
        assert np.isclose(c.rates["windows"][i], (len(windows) - len(set(windows))) / n)
        assert np.isclose(c.rates["symbols"][i], sum(map((text or "").count, "#*$%&|<>")) / n)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learned = labels.where("doc_id % 3 <> 0")
    rows = quality_model.classify(docs, learned).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "good"), "doc_id").collect()
    clean = [r for r in rows if r.good and not r.toxic]
    junk = [r for r in rows if not r.good]
    toxic = [r for r in rows if r.toxic]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)
    assert sum(r.kept for r in toxic) <= 0.15 * len(toxic)


def test_cases(spark):
    docs = documents(spark).selectExpr("*", "1 as votes", "2 as insults", "3 as toxic", "4 as kept", "5 as quality")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_model.classify(docs, labels)
    assert out.count() == docs.count()
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert quality_model.classify(docs, None).count() == docs.count()


def test_scorer_gives_weight_to_what_tells_classes_apart():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.3).astype(float)
    features = [np.array([9, 100 + i, *([5] if label else [])], np.uint32) for i, label in enumerate(y)]
    weight, bias = quality_model.fit(features, y)
    assert weight[5] > 1 and weight[9] == 0 and not weight[100:700].any() and bias < 0


def test_one_class_gives_a_constant():
    weight, bias = quality_model.fit([np.arange(3, dtype=np.uint32)], np.ones(1))
    assert not weight.any() and bias > 0


def test_clean_documents_stay_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    insulted = docs.selectExpr("doc_id + 1000000 as doc_id", "concat('you idiot moron scum ', text) as text").where("doc_id % 20 = 0")
    plain = docs.where("not text rlike '(?i)clown|disgusting|idiot|loser|moron|pathetic|scum|stupid|trash|worthless'")
    for given in (labels, None):
        rows = quality_model.classify(plain, given).collect()
        assert all(r.toxicity < 0.5 for r in rows) and sum(r.kept for r in rows) > len(rows) / 2
    rows = quality_model.classify(plain.union(insulted), labels).collect()
    clean = [r for r in rows if r.doc_id < 1000000]
    assert sum(r.toxicity < 0.5 for r in clean) >= 0.9 * len(clean)
    rude = [r for r in rows if r.doc_id >= 1000000]
    assert sum(r.toxicity > 0.5 for r in rude) >= 0.5 * len(rude)


def test_training_writes_no_table(spark):
    shared_dir(spark)  # the first call sets the folder
    folder = Path(re.sub("^file:/+", "/", shared_dir(spark))) / "tables"
    before = set(folder.glob("*"))
    (weight, bias), _ = quality_model.train(documents(spark), None)
    assert np.isfinite(weight).all() and np.isfinite(bias)
    assert set(folder.glob("*")) == before
