import random
import re

from cases import documents

from graphloom.llm import license_scan
from graphloom.llm.license_scan import PHRASES, Automaton, Scanner


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [
        (i, label)
        for phrase, label in PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return (
        len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})),
    )


def rows_of(df):
    return sorted(
        ((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=repr
    )


def test_base_against_brute_force(spark):
    docs = documents(
        spark,
        (60, "GNU General Public License, cc-by cc by CC BY mit license apache license apache-license gnu general public"),
        (61, "gnu general public"),
        (62, "license mit"),
        (63, "é mit license é"),
    )
    docs = docs.selectExpr("*", "1 as labels", "2 as spans", "3 as score")
    assert rows_of(license_scan.scan(docs)) == sorted(((str(r.doc_id), *brute(r.text)) for r in docs.collect()), key=repr)
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(license_scan.scan(whole)) == sorted(((str(r.doc_id), *brute(r.text)) for r in whole.collect()), key=repr)


def test_automaton_gives_matching_statistics():
    rng = random.Random(2)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
    automaton = Automaton(sequences)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(60):
        run = [rng.randrange(4) for _ in range(rng.randrange(40))]
        longest = [max((n for n in range(e + 2) if tuple(run[e + 1 - n : e + 1]) in parts), default=0) for e in range(len(run))]
        want = {(e + 1, n) for e, n in enumerate(longest) if n and (e + 1 == len(run) or longest[e + 1] <= n)}
        got = list(automaton.matches(run, 1))
        assert {(e, n) for e, n, _ in got} == {x for x in want if x[1] >= 1}
        for e, n, state in got:
            assert automaton.ends[state] == {
                (k, j) for k, s in enumerate(sequences) for j in range(n - 1, len(s)) if s[j - n + 1 : j + 1] == run[e - n : e]
            }


def test_spans(spark):
    text = dict(license_scan.TEMPLATES)["mit-text"]
    edited = text.replace("obtaining", "getting hold of").replace("merge", "fuse")
    docs = documents(spark, (70, f"x y z {edited} tail"), (71, " ".join(text.split()[:20])), (72, "permission is denied to the software"))
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert rows[70].labels == "mit-text" and rows[70].base_labels == "" and rows[70].score > 0.75
    assert rows[70].spans[0].first == 3
    assert rows[71].labels == "" and rows[72].labels == "" and rows[72].score == 0
    assert rows[11].labels == "apache,apache-2.0-notice,mit,mit-notice"
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_every_template_finds_itself():
    scanner = Scanner()
    for (label, _), sequence in zip(license_scan.TEMPLATES, scanner.sequences, strict=True):
        assert (label, 1.0) in [x[:2] for x in scanner.cover([(0, sequence)])]


def brute_cover(words, template, least, gap):
    """Best chain of runs of at least ``least`` words that both share, over all pairs of places."""
    n, m = len(words), len(template)
    blocks = []
    for i in range(n):
        for j in range(m):
            if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                k = 0
                while i + k < n and j + k < m and words[i + k] == template[j + k]:
                    k += 1
                if k >= least:
                    blocks.append((i, j, k))
    blocks.sort(key=lambda b: (b[0] + b[2], b[0], b[1]))
    covered = []
    for x, (i, j, k) in enumerate(blocks):
        value = k
        for y, (a, b, c) in enumerate(blocks[:x]):
            both = max(0, a + c - i, b + c - j)
            if both < k and i + both - a - c <= gap and j + both - b - c <= gap:
                value = max(value, covered[y] + k - both)
        covered.append(value)
    return max(covered, default=0) / m


def test_chains_against_brute_force():
    rng = random.Random(9)
    template = [f"t{i}" for i in range(60)]  # no word twice: the longest run at a place is the only one
    scanner = Scanner([("t", " ".join(template))], (), min_match=3, max_gap=4, min_cover=0.5)
    for _ in range(200):
        words = list(template)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = rng.choices([*template, "x", "y"], k=rng.randrange(4))
        ids = [scanner.hashes.tolist().index(license_scan.hash_bytes(w.encode())) if w in template else -1 for w in words]
        numbers = [int(scanner.number[i]) if i >= 0 else -1 for i in ids]
        runs, run, start = [], [], 0
        for i, x in enumerate([*numbers, -1]):
            if x < 0:
                runs += [(start, run)] if len(run) >= 3 else []
                run, start = [], i + 1
            else:
                run.append(x)
        got = max((x[1] for x in scanner.cover(runs)), default=0)
        assert abs(got - brute_cover(words, template, 3, 4)) < 1e-9


def test_words_inserted_from_the_template_keep_its_label():
    text = dict(license_scan.TEMPLATES)["gpl-header"]
    own = text.replace("you can redistribute it", "any later version you can redistribute it")
    scanner = Scanner()
    number = {w: k for k, w in enumerate(sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.tokens(t)}))}
    found = dict(x[:2] for x in scanner.cover([(0, [number[w] for w in license_scan.tokens(own)])]))
    assert found["gpl-header"] == 1.0


def test_whole_licence_texts(spark):
    rows = [(i, "Copyright of somebody.\n" + text) for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    rows.append((99, ("prose of its own " * 400) + dict(license_scan.TEMPLATES)["gpl-3"] * 3 + " more prose" * 9000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in license_scan.scan(docs).collect()}
    assert all(label in found[i] for i, (label, _) in enumerate(license_scan.TEMPLATES)) and "gpl-3" in found[99]
