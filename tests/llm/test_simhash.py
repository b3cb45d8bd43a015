import random
import re

import numpy as np
import xxhash
from cases import documents

from graphloom.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: [(doc_id, fp)] -> smallest id that each can reach."""
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [ids.get(find(i)) for i in range(len(fps))]


def test_cases_against_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
    docs = documents(spark, (90, base), (91, base + "x"), (92, base.upper()))
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = brute_components(want)
    got = [
        (r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()
    ]
    expect = [(d, fp, c) for (d, fp), c in zip(want, roots, strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expect, key=key)


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(list(enumerate(fps)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for x, w in zip(fps, want, strict=True):
        groups.setdefault(roots.get(x, x), set()).add(w)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want))


def test_large_bucket_equals_all_pairs():
    rng = np.random.default_rng(3)
    free = 0x3FFFFF
    fps = np.unique(rng.integers(0, free, 3000, dtype=np.uint64) | np.uint64(5 << 40))
    labels = simhash.local_labels(fps, free)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    reach = np.arange(len(fps))
    while True:
        new = np.array([reach[row].min() for row in apart])
        if (new == reach).all():
            break
        reach = new
    assert (labels == reach).all()


def test_masks_hold_every_pair_within_two_bits():
    fixed = simhash.masks()
    assert all(bin(m).count("1") >= 42 for m in fixed)
    for a in range(64):
        for b in range(64):
            flip = (1 << a) | (1 << b)
            assert any(not flip & m for m in fixed)


def test_keep_one_and_empty_table(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 7 in ids and 8 not in ids and ids.count(0) == 1 and 1 not in ids
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_other_columns_do_not_clash(spark):
    docs = documents(spark)
    more = docs.selectExpr("*", "1 as fp", "2 as component_id", "3 as root", "'x' as __n", "4 as node")
    assert simhash.near_duplicates(more).count() == docs.count()
    assert simhash.keep_one(more).columns == more.columns


def test_query_format(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.fingerprint) for r in simhash.query(spark, str(tmp_path)).collect())
    assert got == sorted((str(r.doc_id), f"{brute_fingerprint(r.text):016x}") for r in docs.collect())


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """rows: [(doc_id, text)] -> place of the row that each row's group keeps; all pairs by exact similarity."""
    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(size):
        for j in size[x + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        best[r] = min(best.get(r, (True, 0, 0)), (d is None, d or 0, i))
    return [best[find(i)][2] for i in range(len(rows))]


def check_groups(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {(rows[i][0], rows[i][1]) for i in brute_groups(rows)}
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    return got, kept


def test_stage_against_brute_force(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(12)]
    more = []
    for i in range(120):
        words = list(base[i % 12])
        for _ in range(rng.randrange(12)):
            words[rng.randrange(300)] = f"x{rng.randrange(9)}"
        more.append((200 + i, " ".join(words)))
    got, kept = check_groups(spark, documents(spark, *more))
    assert len(got) == len(set(got)) and set(got) == kept


def test_stage_on_documents(spark):
    got, kept = check_groups(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert set(got) == kept


def test_bucket_of_unlike_texts_is_searched_to_the_end(spark, monkeypatch):
    # one band that puts everything into one bucket: only the rarest shingles can find the links
    monkeypatch.setattr(simhash, "_band_keys", lambda low: np.zeros(1, np.uint64))
    rng = random.Random(2)
    base = [" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(9)]
    rows = [(i, base[i % 9] + f" z{i}") for i in range(27)]
    got, kept = check_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got) == 9 and set(got) == kept


def test_rows_that_repeat_an_id(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (None, "c d"), (5, b)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert len(got) == 3 and set(got) == {(3, a), (5, b), (None, "c d")}
