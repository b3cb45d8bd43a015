import re
from collections import Counter

from cases import documents

from graphloom.llm import quality_rules

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_cases_against_brute_force(spark):
    docs = documents(spark)
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    rows = quality_rules.judge(docs).collect()
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS), r.base_failed) for r in rows)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS), r.base_failed) for r in quality_rules.judge(docs).collect())
    assert got == want


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed")
    rows = judged.join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_estimate_tells_reliable_rules_from_noise():
    # two good rules that agree, one that says bad at random
    patterns = [((1, 1, 1), 450), ((1, 1, -1), 450), ((-1, -1, 1), 50), ((-1, -1, -1), 50)]
    prior, ratio = quality_rules.estimate(patterns)
    assert prior > 1 and ratio[0][-1] < -2 and ratio[0][1] > 1 and abs(ratio[2][-1]) < 0.3


def test_empty_table(spark):
    assert quality_rules.judge(documents(spark).limit(0)).count() == 0


def test_other_columns_do_not_clash(spark):
    docs = documents(spark).selectExpr("*", "1 as n_words", "2 as words", "3 as h", "4 as again", "5 as kept")
    assert quality_rules.judge(docs).count() == docs.count()
