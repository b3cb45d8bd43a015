import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents

from graphloom.llm import lm
from graphloom.llm.common import texts


def split(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def check_base(docs, rows):
    found = [(r.doc_id, split(r.text)) for r in docs.collect()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in found]
    count = Counter(w for (_, words), h in zip(found, held, strict=True) if not h for w in words)
    total, distinct = sum(count.values()), len(count)
    want = []
    for (d, words), h in zip(found, held, strict=True):
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want.append((str(d), h, len(words), sum(count[w] > 0 for w in words), total, base))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)


def test_cases_against_brute_force(spark, tmp_path):
    docs = documents(spark).selectExpr("*", "1 as word", "2 as n", "3 as score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm.query(spark, str(tmp_path)).collect()
    check_base(docs, rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = lm.query(spark, d).collect()
    check_base(spark.read.parquet(f"{d}/documents.parquet"), rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_nothing_to_learn_from(spark, tmp_path):
    docs = documents(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert lm.query(spark, f"{tmp_path}/a").count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = spark.createDataFrame([(held, "some words", "en", "s", 10)], docs.schema)
    one.write.parquet(f"{tmp_path}/b/documents.parquet")
    row = lm.query(spark, f"{tmp_path}/b").collect()[0]
    assert row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.base_score == pytest.approx(0)


def tiny(found):
    import pyarrow as pa

    t = texts(pa.array(found))
    tokens = lm.Tokens(t, 0, len(t))
    h, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
    order = np.argsort(-n, kind="stable")[:80]
    tails = {k: (0, 0) for k in range(lm.TAIL)}
    for i in np.argsort(-n, kind="stable")[80:]:
        k = int(tokens.tail[first[i]])
        tails[k] = (tails[k][0] + 1, tails[k][1] + int(n[i]))
    v = lm.Vocabulary([(int(h[i]), int(n[i])) for i in order], int(n.sum()), len(h), tails)
    return v, v.encode(tokens), tokens.first


def sentences():
    rng = np.random.default_rng(1)
    return [" ".join(f"w{(a * 7 + i * 3) % 100}" for i in range(rng.integers(1, 70))) for a in range(40)]


def test_probabilities_sum_to_one():
    v, ids, _ = tiny(sentences())
    p = lm.start(v, 3)
    state = np.random.default_rng(0).standard_normal((5, lm.HIDDEN)).astype(np.float32)
    every = np.arange(v.ids)
    for s in state:
        assert np.exp(lm.log_likelihood(p, v, every, np.repeat(s[None], len(every), 0))).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows(monkeypatch):
    v, ids, first = tiny(sentences())
    p = lm.train(lm.start(v, 3), v, ids, first)
    found = []
    for window, lanes in ((5, 3), (1000, 512)):
        monkeypatch.setattr(lm, "WINDOW", window)
        monkeypatch.setattr(lm, "SCORING_LANES", lanes)
        found.append(lm.score_rows(p, v, ids, first))
    assert np.allclose(found[0], found[1], atol=1e-2)
    one_by_one = []
    for a, b in zip(first, first[1:], strict=False):
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), p["first"][None], 0.0
        for i in ids[a:b]:
            h, _ = lm._step(p, x, h)
            total += lm.log_likelihood(p, v, np.array([i]), h)[0]
            x = p["input"][[i]]
        one_by_one.append(total)
    assert np.allclose(found[0], one_by_one, atol=1e-2)


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(lm, "_FLOAT", np.float64)
    v, ids, _ = tiny(sentences())
    p = {k: x.astype(np.float64) for k, x in lm.start(v, 3).items()}
    rng = np.random.default_rng(2)
    s, y = rng.standard_normal((9, lm.HIDDEN)), ids[:9]
    grad, ds = lm._output_gradients(p, v, s, y)
    loss = lambda: -lm.log_likelihood(p, v, y, s).sum()
    for array, d in ((p["class"], dict(grad["dense"])["class"]), (s, ds), (p["word"][grad["words"][0][0]], grad["words"][0][1])):
        for _ in range(5):
            at = tuple(rng.integers(n) for n in array.shape)
            kept = array[at]
            array[at] = kept + 1e-5
            up = loss()
            array[at] = kept - 1e-5
            down = loss()
            array[at] = kept
            assert (up - down) / 2e-5 == pytest.approx(d[at], abs=1e-4)


def test_tokens_do_not_depend_on_the_ranges(monkeypatch):
    t = lm.texts(pa.array(["a b  c", "", None, "long words here, and more of them", "é x"]))
    whole = lm.Tokens(t, 0, 5)
    assert whole.first.tolist() == [0, 4, 5, 6, 14, 17] and len(lm.Tokens(t, 2, 2).hash) == 0
    monkeypatch.setattr(lm, "_RANGE", 4)
    parts = lm.Tokens(t, 0, 5)
    assert all((x == y).all() for x, y in zip(vars(whole).values(), vars(parts).values(), strict=True))


def test_log_of_a_softmax_at_any_size():
    rng = np.random.default_rng(1)
    for scale, shift in ((1, 0), (30, 0), (300, 0), (1, -500), (1, 500)):
        s, w = rng.standard_normal((7, lm.HIDDEN)), rng.standard_normal((lm.HIDDEN, 11)) * scale
        bias, at = rng.standard_normal(11) + shift, rng.integers(0, 11, 7)
        x = s @ w + bias
        top = x.max(axis=1, keepdims=True)
        want = (x - top)[np.arange(7), at] - np.log(np.exp(x - top).sum(axis=1))
        assert np.allclose(lm._log_of(s, w, bias, at), want)


def test_a_window_updates_all_classes_at_once(monkeypatch):
    """Each update of a class on its own cost more than its arithmetic."""
    v, ids, first = tiny(sentences())
    seen, update = [], lm._update
    monkeypatch.setattr(lm, "_update", lambda x, *more: (seen.append(x.shape), update(x, *more)))
    p = lm.start(v, 3)
    lm.train(p, v, ids, first)
    assert seen.count(p["word"].shape) <= seen.count(p["gates"].shape)


def test_training_lowers_the_loss():
    v, ids, first = tiny(sentences())
    p = lm.start(v, 3)
    before = lm.score_rows(p, v, ids, first).sum()
    for _ in range(6):
        p = lm.train(p, v, ids, first)
    after = lm.score_rows(p, v, ids, first).sum()
    assert after > 0.7 * before


def test_back_propagation_against_differences(monkeypatch):
    monkeypatch.setattr(lm, "_FLOAT", np.float64)
    found = ["a b c d e f a b", "b c d", "c a b e"] * 3
    v, ids, first = tiny([*found, *sentences()])
    n = len(found)
    ids, first = ids[: first[n]], first[: n + 1]
    p = {k: x.astype(np.float64) for k, x in lm.start(v, 3).items()}
    seen = []
    monkeypatch.setattr(lm, "_update", lambda x, scale, where, d, rate: seen.append((x.shape, where, d.copy())))
    lm.train(p, v, ids, first)  # one window: nothing is cut off, nothing is changed
    scale = n

    def slope(name, at):
        kept = p[name][at]
        p[name][at] = kept + 1e-5
        up = lm.score_rows(p, v, ids, first).sum()
        p[name][at] = kept - 1e-5
        down = lm.score_rows(p, v, ids, first).sum()
        p[name][at] = kept
        return -(up - down) / 2e-5

    dense = {shape: d for shape, where, d in seen if where is None}
    rng = np.random.default_rng(5)
    for name in ("gates", "gate_bias", "class", "class_bias"):
        for _ in range(6):
            at = tuple(rng.integers(k) for k in p[name].shape)
            assert slope(name, at) == pytest.approx(scale * dense[p[name].shape][at], abs=1e-4)
    shape, where, d = next(x for x in seen if x[0] == (v.ids + 1, 3 * lm.HIDDEN))
    for row in range(len(where)):
        at = int(rng.integers(3 * lm.HIDDEN))
        real = slope("first", (at,)) if where[row] == v.ids else slope("input", (int(where[row]), at))
        assert real == pytest.approx(scale * d[row, at], abs=1e-4)


def test_every_training_document_gives_gradients(spark, monkeypatch):
    monkeypatch.setattr(lm, "START_TOKENS", 100)
    rows = [(i, " ".join([f"own{i}"] * 5)) for i in range(300)]
    rows.append((next(i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 10), "longtext " * 9000))  # over 64 KB
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, v, p = lm.model(docs)
    moved = np.abs(p["input"] - lm.start(v)["input"]).max(axis=1)[: v.end] > 0
    assert v.end == 1 + sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(300))
    assert moved.all()


def test_end_is_known_where_many_words_are_more_frequent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    rows = [(i, " ".join([f"w{k}" for k in range(8)] * 3)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check_base(docs, lm.query(spark, str(tmp_path)).collect())
