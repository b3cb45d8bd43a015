import hashlib
import random

import numpy as np
import pytest
from cases import documents

from graphloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.vocabulary())


def same(own, oracle, text):
    want = oracle.encode(text, add_special_tokens=False).ids
    got = own.encode(text).tolist()
    assert got == want, text[:200]
    assert own.decode(got) == oracle.decode(want, skip_special_tokens=False)


def test_cases(own, oracle):
    for t in (
        "", " ", "a", "Hello World's isn't 123 !!! don't're", "<|endoftext|> a<|startoftext|>b <|endoftext", "ΣΑΣ ΟΔΟΣ İstanbul",
        "é Å ﬁ ½ Ⅷ ² 東京 한국어 😀👍🏽 ‍ x y\x1cz", "</w>x</w>", "aaaaaaaaaaaaaaaaaaaa" * 500, "'s't'll 's'", "_" * 50,
    ):
        same(own, oracle, t)


def test_every_character(own, oracle):
    chars = [chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 64):
        block = chars[at : at + 64]
        same(own, oracle, " ".join(f"a{c}b" for c in block))


def test_random_words(own, oracle):
    rng = random.Random(11)
    pieces = ["th", "er", "ing", "tion", "an", "re", "ou", "ed", "x", "qu", "é", "ß", "ñ", "!!", "$$$", "0", "7"]
    for _ in range(400):
        same(own, oracle, " ".join("".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(30)))


def test_backtracking_is_exact_where_longest_match_is_not(own):
    greedy = 0
    for word in ("thanandering", "reerthouing", "inenanthere", "ndoushealy", "erlyandtiones", "unbelievableness"):
        spelled = [own.plain[b] for b in word.encode()]
        tokens = own.word(word)
        assert "".join(own.spelling[k] for k in tokens)[:-1] == "".join(spelled)[:-1]
        at, first = 0, []
        text = "".join(spelled[:-1]) + chr(ord(spelled[-1]) + 0x10000)
        while at < len(text):
            k = max((k for k in range(len(own.spelling)) if text.startswith(own.spelling[k], at)), key=own.size.__getitem__)
            first.append(k)
            at += own.size[k]
        greedy += first != tokens
    assert greedy


def test_table(spark, own, oracle):
    docs = documents(spark).selectExpr("*", "1 as ids", "2 as n_tokens")
    want = []
    for r in docs.collect():
        ids = oracle.encode(r.text or "", add_special_tokens=False).ids
        text = oracle.decode(ids, skip_special_tokens=False)
        want.append(
            (str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        )
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.digests(docs.limit(0)).count() == 0
    tokens = bpe.encode(docs)
    rows = {str(r.doc_id): r.ids for r in tokens.collect()}
    assert sum(map(len, rows.values())) > 0 and rows["1"] == []
    texts = {str(r.doc_id): r.text for r in bpe.decode(tokens).collect()}
    assert texts["4"] == oracle.decode(rows["4"], skip_special_tokens=False)


def test_documents(spark, own, oracle):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        same(own, oracle, r.text)
