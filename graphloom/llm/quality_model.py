"""Quality classifier: weak labels by expectation-maximisation train a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every whole text.
Their vote patterns, counted over all documents (at most 3**labellers rows),
give each labeller's accuracy and each pattern's posterior.  The posteriors
label a bounded sample, on which a logistic scorer over hashed features (words,
their openings, openings that come again, word shapes and their shares,
repetition) is
trained; the scorer then judges all documents.  Toxicity is a second head of
the same make, whose labellers are a word list and the table of labels where it
has the document; the list alone tells what is clean if no label does, and
nothing is toxic where one of the two classes is missing.  A document is kept if it is good and not toxic.

The sample has SAMPLE documents in expectation, of at most LONGEST bytes, drawn
by a hash of the text; votes, counts and scores cover everything.

Edge cases: a null text is an empty one; a text without words gets no votes and
is kept only if the prior says so (the scorer has its bias alone).  Rows that
repeat a doc_id are judged each; a null doc_id is returned and never has a
label; of a doc_id's repeated labels the largest counts.  An empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NOT_SPACE, Texts, Words, documents, hash_bytes, id_text, lean, mix, spread, text_key, texts, without, words
from graphloom.llm.quality_rules import estimate

DIMENSIONS = 1 << 20
SAMPLE = 12_000
LONGEST = 1 << 15
STEPS = 300
CONFIDENT = 6.0  # standard errors by which a feature must tell the classes apart to get a weight
LIST_VOTE = 2

#: Insults that the word-list labeller knows.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

LABELLERS = ("symbols", "capitals", "marks", "plain", "variety", "stutter", "windows", "spread")
#: rate below or above which each labeller votes; (bad when over, good when under)
_LIMITS = {
    "symbols": (0.25, 0.02), "capitals": (0.5, 0.2), "marks": (0.5, 0.25), "plain": (0.4, 0.15),
    "variety": (0.8, 0.6), "stutter": (0.2, 0.02), "windows": (0.4, 0.1), "spread": (0.2, 0.05),
}
_MIN_WORDS = 8  # rates of shorter texts say nothing

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 1
_SHAPE[97:123] = 2
_SHAPE[128:] = 2
_SHAPE[48:58] = 3
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) < 123)) | (np.arange(256) >= 128)
_MARK = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's range."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]


def _per_word(flags: np.ndarray, w: Words) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[w.end] - c[w.start]


def _first_of_kind(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its value in its row."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = True
    return out


class Chunk:
    """Words and rates of a range of rows; case is kept."""

    def __init__(self, t: Texts, a: int, b: int):
        w = self.w = words(t, a, b, NOT_SPACE, lower=False)
        self.low = words(t, a, b, NOT_SPACE)
        self.rows = w.row_of()
        self.n = np.diff(w.first)
        raw = w.bytes
        upper, letter = _per_word(_UPPER[raw], w), _per_word(_LETTER[raw], w)
        size = w.end - w.start
        closed = _CLOSING[raw[w.end - 1]] if len(w) else np.zeros(0, bool)
        plain = (letter > 0) & (letter + closed == size)
        h = self.low.hash
        same_row = self.rows[1:] == self.rows[:-1]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & same_row
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.maximum(self.n, 1)
            letters = np.maximum(_sums(letter, w.first), 1)
            self.rates = {
                "symbols": _sums(_per_word(_SYMBOL[raw], w), w.first) / n,
                "capitals": _sums(upper, w.first) / letters,
                "marks": _sums(_per_word(_MARK[raw], w), w.first) / n,
                "plain": 1 - _sums(plain, w.first) / n,
                "variety": 1 - _sums(_first_of_kind(h, self.rows), w.first) / n,
                "stutter": _sums(again, w.first) / n,
                "windows": self._windows(h) / n,
                "spread": _sums((size > 40) | (letter == 0), w.first) / n,
            }

    def _windows(self, h: np.ndarray) -> np.ndarray:
        """Per row, the 3-word windows that were there before."""
        if len(h) < 3:
            return np.zeros(len(self.n))
        g = h[:-2] * np.uint64(31) + mix(h[1:-1]) * np.uint64(17) + mix(mix(h[2:]))
        inside = np.flatnonzero(self.rows[:-2] == self.rows[2:])
        seen = np.zeros(len(h), np.int64)
        seen[inside] = ~_first_of_kind(g[inside], self.rows[inside])
        return _sums(seen, self.w.first)

    def votes(self) -> np.ndarray:
        """rows x labellers of 1, 0, -1."""
        out = np.zeros((len(self.n), len(LABELLERS)), np.int8)
        enough = self.n >= _MIN_WORDS
        for k, name in enumerate(LABELLERS):
            bad, good = _LIMITS[name]
            out[:, k] = np.where(self.rates[name] > bad, -1, self.rates[name] < good) * enough
        return out

    def insults(self) -> np.ndarray:
        """Per row, the number of words on the list, punctuation aside."""
        known = np.sort(np.array([hash_bytes(x.encode()) for x in INSULTS], np.uint64))
        h = self._openings(None)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return _sums(known[at] == h, self.w.first)

    def _openings(self, size: int | None) -> np.ndarray:
        """Hashes of the words without what closes them, or of their first ``size`` bytes."""
        low = self.low
        if not len(low):
            return np.zeros(0, np.uint64)
        end = low.end - (_CLOSING[low.bytes[low.end - 1]] & (low.end - low.start > 1))
        if size is not None:
            end = np.minimum(end, low.start + size)
        return low.part(low.start, end)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and features (below DIMENSIONS); a feature may be there more than once in a row."""
        w, rows = self.w, self.rows
        whole, opening = self._openings(None), self._openings(5)
        # openings that come again: one such word may be chance
        _, first, counts = np.unique(opening ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        again = first[counts > 1]
        # word shapes: runs of a kind count once
        kinds = _SHAPE[w.bytes]
        new = np.ones(len(kinds), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[w.start] = True
        at = np.concatenate([[0], np.cumsum(new)])
        shapes = Words.hashed(kinds[new], at[w.start], at[w.end])
        # share of each shape in its row, by powers of two
        key = shapes ^ mix(rows.astype(np.uint64) + np.uint64(1))
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        share = np.log2(np.maximum(self.n[rows[first]], 1) / counts).astype(np.uint64)
        shape_rows, shape = rows[first], mix(shapes[first] + np.uint64(977)) + share
        every = np.arange(len(self.n))
        rates = [
            (every, mix(np.full(len(every), 7919 + k, np.uint64)) + np.floor(np.sqrt(self.rates[name]) * 8).astype(np.uint64))
            for k, name in enumerate(LABELLERS)
        ]
        all_rows = [rows, rows, rows[again], shape_rows, *(r for r, _ in rates)]
        hashes = [mix(whole + np.uint64(1)), mix(opening + np.uint64(2)), mix(opening[again] + np.uint64(3)), mix(shape)]
        hashes += [mix(h) for _, h in rates]
        return np.concatenate(all_rows), (np.concatenate(hashes) % np.uint64(DIMENSIONS)).astype(np.int64)


_VOTES = "array<byte>"


def vote(docs: DataFrame) -> DataFrame:
    """doc_id, votes, insults, small (may be in the sample), draw: one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(1))
            votes, insults = [], []
            for a, b in t.chunks():
                c = Chunk(t, a, b)
                votes.append(c.votes())
                insults.append(c.insults())
            flat = np.concatenate(votes).ravel() if votes else np.zeros(0, np.int8)
            at = np.arange(len(t) + 1, dtype=np.int32) * len(LABELLERS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.array(np.concatenate(insults) if insults else np.zeros(0, np.int64)),
                ],
                ["doc_id", "votes", "insults"],
            )

    return spread(id_text(docs)).mapInArrow(lean(run), f"doc_id long, votes {_VOTES}, insults long")


def _posterior(prior: float, ratio: list[dict[int, float]], votes: list[int]) -> float:
    return 1 / (1 + np.exp(-np.clip(prior + sum(r[v] for r, v in zip(ratio, votes, strict=True)), -50, 50)))


def fit(features: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over DIMENSIONS and bias of a logistic scorer: the distinct features of each document, and soft labels y.

    Only features whose rates in the two classes differ by CONFIDENT standard
    errors get a weight, so that words of a single document cannot.  Documents
    are counted one after another; only the chosen features are held together.
    """
    n, weight = len(y), np.zeros(DIMENSIONS, np.float32)
    good = float(y.sum())
    if not n or good < 1 or n - good < 1:
        return weight, float(np.clip(np.log((good + 0.5) / (n - good + 0.5)), -8, 8))
    have, on_good = np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32)
    for own, label in zip(features, y, strict=True):
        have[own] += 1
        on_good[own] += label
    p = have / n
    apart = np.abs(on_good / good - (have - on_good) / (n - good))
    chosen = np.flatnonzero((have >= 5) & (apart >= CONFIDENT * np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / good + 1 / (n - good)))))
    number = np.full(DIMENSIONS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    kept = [number[own] for own in features]
    kept = [own[own >= 0] for own in kept]
    x_rows = np.repeat(np.arange(n), [len(own) for own in kept])
    x = np.concatenate(kept)
    w, b = np.zeros(len(chosen)), float(np.log(good / (n - good)))
    scale, scale_b = np.full(len(chosen), 1e-8), 1e-8
    class_weight = np.where(y > 0.5, 0.5 * n / good, 0.5 * n / (n - good))  # both classes count alike
    for _ in range(STEPS):
        s = b + np.bincount(x_rows, w[x], n)
        error = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y) * class_weight / n
        gradient = np.bincount(x, error[x_rows], len(chosen)) + 1e-4 * w
        scale += gradient**2
        scale_b += error.sum() ** 2
        w -= 0.2 * gradient / np.sqrt(scale)
        b -= 0.2 * error.sum() / np.sqrt(scale_b)
    weight[chosen] = w
    return weight, b


def train(docs: DataFrame, labels: DataFrame | None) -> list[tuple[np.ndarray, float]]:
    """The two heads, good and toxic: weights and bias."""
    # counted as they come: files would be written once, read once and start a process each on local disks
    patterns = sorted((tuple(r["votes"]), r["count"]) for r in vote(docs).groupBy("votes").count().collect())
    prior, ratio = estimate(patterns)
    total = sum(c for _, c in patterns)
    part = min(1.0, SAMPLE / max(1, total))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    gold = None
    if labels is not None:
        gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        gold = gold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = id_text(docs).where((draw < part) & (F.octet_length("text") <= LONGEST))
    if gold is not None:
        sample = sample.join(gold, "doc_id", "left").select("doc_id", "text", "toxic")
    else:
        sample = sample.select("doc_id", "text", F.lit(None).cast("int").alias("toxic"))
    # copies have the same draw: one of each text is enough
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(0))
            for a, b in t.chunks():
                c = Chunk(t, a, b)
                rows, x = c.features()
                pair = np.unique(rows * DIMENSIONS + x)
                rows, x = pair // DIMENSIONS, (pair % DIMENSIONS).astype(np.uint32)
                at = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(b - a + 1, dtype=np.int32) * len(LABELLERS)), pa.array(c.votes().ravel())
                        ),
                        pa.array(c.insults()),
                        batch.column(1).slice(a, b - a),
                    ],
                    ["x", "votes", "insults", "toxic"],
                )

    found = sample.mapInArrow(lean(run), f"x binary, votes {_VOTES}, insults long, toxic int").collect()
    features = [np.frombuffer(r["x"], np.uint32) for r in found]
    good = np.array([_posterior(prior, ratio, r["votes"]) for r in found], float)
    # toxicity: the list and the labels vote on being clean; where both abstain a document says nothing
    cast: dict[tuple[int, ...], int] = {}
    ballots = []
    for r in found:
        listed = -1 if r["insults"] >= LIST_VOTE else 0 if r["insults"] else 1
        known = 0 if r["toxic"] is None else (-1 if r["toxic"] else 1)
        ballots.append((listed, known))
        cast[ballots[-1]] = cast.get(ballots[-1], 0) + 1
    clean_prior, clean_ratio = estimate(sorted(cast.items())) if cast else (0.0, [])
    # the labels are given, not guessed: they decide where they speak
    toxic = np.array([(v[1] < 0) if v[1] else 1 - _posterior(clean_prior, clean_ratio, v) for v in ballots], float)
    spoken = np.array([bool(v[1]) or v[0] < 0 for v in ballots], bool)
    if not any(v[1] > 0 for v in ballots):  # no label says what is clean: the list's clean votes do
        spoken |= np.array([v[0] > 0 for v in ballots], bool)
        toxic = np.array([float(v[1] < 0 or (not v[1] and v[0] < 0)) for v in ballots])
    if len(set(toxic[spoken] > 0.5)) < 2:  # nothing tells toxic from clean: not toxic
        return [fit(features, good), (np.zeros(DIMENSIONS, np.float32), -8.0)]
    return [fit(features, good), fit([f for f, s in zip(features, spoken, strict=True) if s], toxic[spoken])]


def score(docs: DataFrame, heads: list[tuple[np.ndarray, float]]) -> DataFrame:
    """doc_id, quality, toxicity, kept of every whole text."""
    given = [(np.flatnonzero(weight), weight[weight != 0], bias) for weight, bias in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = []
        for at, weight, bias in given:
            dense.append((np.zeros(DIMENSIONS, np.float32), bias))
            dense[-1][0][at] = weight
        for batch in batches:
            t = texts(batch.column(1))
            out = np.zeros((len(dense), len(t)))
            for a, b in t.chunks():
                rows, x = Chunk(t, a, b).features()
                for k, (weight, bias) in enumerate(dense):
                    hit = np.flatnonzero(weight[x])
                    pair = np.unique(rows[hit] * DIMENSIONS + x[hit])  # each feature counts once in a row
                    s = np.bincount(pair // DIMENSIONS, weight[pair % DIMENSIONS], b - a) + bias
                    out[k, a:b] = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0]), pa.array(out[1]), pa.array((out[0] >= 0.5) & (out[1] < 0.5))],
                ["doc_id", "quality", "toxicity", "kept"],
            )

    return spread(id_text(docs)).mapInArrow(lean(run), "doc_id long, quality double, toxicity double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, quality, toxicity, kept: one row per row of docs."""
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps.  Each row is judged by its own text, whatever rows share its doc_id."""
    keyed = docs.select(text_key().alias("doc_id"), "text")
    return without(docs, score(keyed, train(docs, labels)).where("not kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
