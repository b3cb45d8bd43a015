import hashlib
import random
import re

from cases import documents

from graphloom.llm import decontam


def find(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, items):
    words = find(text)
    hit, names = set(), set()
    for name, item in items:
        own = find(item)
        size = min(10, len(own))
        for p in range(len(own) - size + 1 if own else 0):
            window = own[p : p + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == window:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
    listed = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def run(spark, tmp_path, docs, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = decontam.query(spark, str(tmp_path)).collect()
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]
    named = [x for x in items if x[0] is not None]
    want = [(str(r.doc_id), *brute(r.text, named)) for r in docs.collect()]
    assert sorted(got) == sorted(want)
    return rows


def test_cases_against_brute_force(spark, tmp_path):
    items = [
        (1, "the quick brown fox jumps over the lazy dog the quick brown fox"),
        (10, "Lazy dog! The quick brown fox, jumps over the LAZY dog. The quick"),
        (2, "small words"),
        (3, "émigré ñandú"),
        (4, None),
        (5, ""),
        (6, "no such thing is to be found in any of these documents at all really"),
        (7, "a b c a b c a b c a b c a b c"),
        (7, "Licensed under the Apache License"),
        (8, "one"),
    ]
    rows = run(spark, tmp_path, documents(spark, (80, "xx the quick-brown fox jumps over the lazy dog the quickly")), items)
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_random_spans_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(4, 16)))) for i in range(25)]
    items += [(90 + i, " ".join(docs[i][1].split()[3 : 3 + rng.randrange(5, 14)])) for i in range(20)]
    run(spark, tmp_path, documents(spark, *docs), items)


def test_keep_clean(spark):
    docs = documents(spark).selectExpr("*", "1 as row", "2 as items", "3 as `group`")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog the quick")], "item_id long, text string")
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None not in ids and 7 not in ids and 8 not in ids and ids.count(3) == 2 and len(ids) == docs.count() - 3


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = documents(spark)
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).where("n_hit > 0 or n_items > 0").count() == 0
    assert decontam.keep_clean(docs, items.limit(0)).count() == docs.count()


def test_rows_are_judged_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog the quick"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(5, item), (5, "quite another text"), (None, item), (None, "one more")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.keep_clean(docs, items).collect()) == ["one more", "quite another text"]


def test_words_decide_where_hashes_agree(spark, monkeypatch):
    from graphloom.llm import common

    # a hash that tells words apart by length alone
    monkeypatch.setattr(common.Words, "hashed", staticmethod(lambda raw, start, end: (end - start).astype("uint64")))
    items = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zz " * 30), (2, "x aa bb cc dd ee ff gg hh ii jj")], "doc_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontam.contamination(docs, items).collect()}
    assert found[1] == 0
