"""A gated recurrent language model that scores whole documents.

Words are predicted in two steps: the class, by a softmax over the state of a
gated recurrent unit, then the word in its class.  The FREQUENT most frequent
words have learned in-class softmaxes; all others fall into TAIL classes by
their look (length, script, closing mark), where a word's probability comes
from its count in the corpus, so the vocabulary has no bound.  The network is
trained in numpy by back-propagation through windows of WINDOW steps, and the
state is carried across windows, in training and in scoring: a document's score
is the log-likelihood of all of it, its end included.

Counts come from all training documents (crc32(doc_id as text) mod 10 is not
0) and are joined to the documents by word.  Gradients come from all training
documents: one worker starts the network on a bounded sample, then workers train
on from there on their parts of all documents, and their networks are averaged
in a tree.

Words are known by a 64-bit hash.  Edge cases: a null or empty text is its end
alone, one token.  Rows that repeat a doc_id are scored each; a null doc_id is
returned, and learned from.  With nothing to learn from, every token has the
base probability 0.1 / 0.1 = 1 and the score is the base.  An empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import (
    NOT_SPACE,
    Texts,
    crc_mod,
    cut,
    documents,
    hash_bytes,
    id_text,
    signed,
    spread,
    table,
    texts,
    words,
)

FOLDS = 10
ADD = 0.1
FREQUENT = 2048
HIDDEN = 24
CLASS_SIZE = 64
TAIL = 16
WINDOW = 32
LANES = 256  # lanes of documents side by side in training, at most
SCORING_LANES = 512
START_TOKENS = 400_000
PART_TOKENS = 3_000_000  # a part that is trained in one go, about
KNOWN = 1 << 17  # words at most whose counts go along with the scan
RATE = 0.2
LATER_RATE = 0.05  # once the network is started
END = hash_bytes(b" ")  # no word has a space

_FLOAT = np.float32
_RANGE = 1 << 18  # bytes of text that are cut into words together
_GROUP = 16 << 20  # bytes of text that are scored together


# --- words -----------------------------------------------------------------


def tail_class(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The tail class of a word by its look: length, whether it is ASCII, how it ends."""
    size = end - start
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    other = high[end] > high[start]
    last = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    mark = ~(((last >= 97) & (last < 123)) | (last >= 128))
    length = np.digitize(size, [5, 8, 12])
    return (length + 4 * other + 8 * mark).astype(np.int64)


class Tokens:
    """Hashes and tail classes of the words of a range of rows; each row ends with END."""

    def __init__(self, t: Texts, a: int, b: int):
        parts = [self._some(t, x, y) for x, y in t.chunks(_RANGE, a, b)]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *(h for h, _, _ in parts)])
        self.tail = np.concatenate([np.zeros(0, np.int64), *(tail for _, tail, _ in parts)])
        self.first = np.cumsum(np.concatenate([[0], *(n for _, _, n in parts)]).astype(np.int64))

    @staticmethod
    def _some(t: Texts, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, tail classes, and the tokens of each row, of a range that is small enough for a processor's cache."""
        w = words(t, a, b, NOT_SPACE)
        n = len(w) + b - a
        ends = w.first[1:] + np.arange(b - a)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        h = np.full(n, END, np.uint64)
        h[is_word] = w.hash
        tail = np.zeros(n, np.int64)
        tail[is_word] = tail_class(w.bytes, w.start, w.end)
        return h, tail, np.diff(ends, prepend=-1)


def training(docs: DataFrame) -> DataFrame:
    return id_text(docs).where(F.coalesce(crc_mod("doc_id", FOLDS) != 0, F.lit(True)))


def counts(docs: DataFrame, most: int = 1 << 19) -> DataFrame:
    """word (hash), tail, n: how often each word stands in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, back = np.unique(h, return_index=True, return_inverse=True)
            return found, tail[first], np.bincount(back, n).astype(np.int64)

        def out(h, tail, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(tail.astype(np.int32)), pa.array(n)], ["word", "tail", "n"]
            )

        for batch in batches:
            t = texts(batch.column(1))
            for a, b in t.chunks():
                tokens = Tokens(t, a, b)
                h, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
                held.append((h, tokens.tail[first], n))
                size += len(h)
                if size > 2 * most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > most:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    found = spread(training(docs)).mapInArrow(run, "word long, tail int, n long")
    return found.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


# --- the network -----------------------------------------------------------


class Vocabulary:
    """Frequent words with their class and place in it, and what the tail classes weigh."""

    def __init__(self, frequent: list[tuple[int, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        """frequent: (hash, count) in order; tails: words and tokens of each tail class, frequent words aside."""
        self.total, self.distinct = total, distinct
        ranked = [(h, n) for h, n in frequent if h != END]
        self.end_count = next((n for h, n in frequent if h == END), 0)
        hashes = np.array([h for h, _ in ranked], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.rank = order.astype(np.int64)
        self.count = np.array([n for _, n in ranked], np.int64)
        self.classes = -(-len(ranked) // CLASS_SIZE)
        # ids: frequent words by rank, then the end, then the tail classes
        self.end = len(ranked)
        self.ids = self.end + 1 + TAIL
        rank = np.arange(len(ranked))
        self.class_of = np.concatenate([rank // CLASS_SIZE, [self.classes], self.classes + 1 + np.arange(TAIL)])
        self.outputs = self.classes + 1 + TAIL
        # probability mass in a tail class: its counts, and one unseen word
        self.tail_mass = np.array([tails.get(k, (0, 0))[1] + ADD * (tails.get(k, (0, 0))[0] + 1) for k in range(TAIL)])
        self.log_total = math.log10(total + ADD * (distinct + 1))

    def encode(self, tokens: Tokens) -> np.ndarray:
        """Ids of the tokens."""
        out = self.end + 1 + tokens.tail
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, tokens.hash), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == tokens.hash, self.rank[at], out)
        return np.where(tokens.hash == np.uint64(END), self.end, out)


def start(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN

    def small(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(_FLOAT)

    weight = np.maximum(np.bincount(v.class_of[: v.end], v.count, v.outputs) if v.end else np.zeros(v.outputs), 0.0)
    weight[v.classes] = v.end_count
    weight[v.classes + 1 :] = v.tail_mass
    inner = np.full((max(1, v.classes), CLASS_SIZE), -30.0)
    inner.ravel()[: v.end] = np.log(v.count + ADD)
    outer = np.log(weight + ADD)
    return {
        "input": small(v.ids, 3 * h),  # what each id adds to the gates
        "gates": small(h, 3 * h),
        "gate_bias": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(_FLOAT),
        "class": small(h, v.outputs),
        "class_bias": (outer - outer.max()).astype(_FLOAT),
        "word": small(max(1, v.classes), h, CLASS_SIZE),
        "word_bias": (inner - inner.max(axis=1, keepdims=True)).astype(_FLOAT),
        "first": np.zeros(3 * h, _FLOAT),  # the input before the first word
    }


def _halved(x: np.ndarray) -> np.ndarray:
    """What goes into the gates, halved: a sigmoid is half the hyperbolic tangent of the half, and a half."""
    x = np.ascontiguousarray(x)
    x[..., : 2 * HIDDEN] *= 0.5
    return x


def _advance(x, h, both, last, gate, reset, c) -> None:
    """One step of the unit (update, reset, candidate) into c, the state after it, and gate; x and both are halved for the gates."""
    k = HIDDEN
    np.matmul(h, both, out=gate)
    gate += x[:, : 2 * k]
    np.tanh(gate, out=gate)
    gate *= 0.5
    gate += 0.5
    np.matmul(np.multiply(gate[:, k:], h, out=reset), last, out=c)
    c += x[:, 2 * k :]
    np.tanh(c, out=c)
    c -= h
    c *= gate[:, :k]
    c += h


def _halved_gates(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gates = _halved(p["gates"].copy())
    return np.ascontiguousarray(gates[:, : 2 * HIDDEN]), np.ascontiguousarray(gates[:, 2 * HIDDEN :])


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step: the state after it, and the gates."""
    gate, reset, c = np.empty((len(h), 2 * HIDDEN), h.dtype), np.empty_like(h), np.empty_like(h)
    _advance(_halved(x + p["gate_bias"]), h, *_halved_gates(p), gate, reset, c)
    return c, gate


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, by a product."""
    return x @ np.ones(x.shape[1], x.dtype)


def _log_of(state: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax over state @ weight + bias at one place of each row."""
    logits = state @ weight
    logits += bias
    own = logits[np.arange(len(at)), at]
    if logits.max(initial=0) <= 60:
        total = _sums(np.exp(logits, out=logits))
        if total.min(initial=1) > 1e-20:
            return own - np.log(total)
        logits = state @ weight + bias
    top = logits.max(axis=1)
    return own - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))


def _by_class(target: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Order by class of what has a class of words, and the bounds of the classes in it."""
    order = np.argsort(target.astype(np.int16 if v.outputs < 32_000 else np.int64), kind="stable")
    bounds = np.searchsorted(target[order], np.arange(v.classes + 1))
    return order[: bounds[-1]], bounds


def log_likelihood(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each id after its state; of a tail word, that of its class."""
    target = v.class_of[ids]
    out = _log_of(state, p["class"], p["class_bias"], target)
    order, bounds = _by_class(target, v)
    ranked, place, more = state[order], ids[order], np.empty(len(order), out.dtype)
    for c in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[c], bounds[c + 1])
        more[own] = _log_of(ranked[own], p["word"][c], p["word_bias"][c], place[own] - c * CLASS_SIZE)
    out[order] += more
    return out


class Lanes:
    """Sequences side by side, longest first, walked in windows with the state carried on."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, chosen: np.ndarray):
        size = first[chosen + 1] - first[chosen]
        self.order = chosen[np.argsort(-size, kind="stable")]
        self.size = first[self.order + 1] - first[self.order]
        self.begin = first[self.order]
        self.ids = ids

    def windows(self, window: int) -> Iterator[tuple[int, np.ndarray]]:
        """(lanes that are left at the start, ids of steps x lanes, -1 past an end)."""
        for at in range(0, int(self.size[0]) if len(self.size) else 0, window):
            left = int(np.searchsorted(-self.size, -at, side="left"))
            steps = at + np.arange(min(window, int(self.size[0]) - at))
            inside = steps[:, None] < self.size[None, :left]
            place = np.minimum(self.begin[None, :left] + steps[:, None], len(self.ids) - 1)
            yield left, np.where(inside, self.ids[place], -1)


def score_rows(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole row, tail words as their classes."""
    rows = len(first) - 1
    out = np.zeros(rows)
    by_size = np.argsort(-(first[1:] - first[:-1]), kind="stable")
    k = HIDDEN
    inputs = _halved(np.concatenate([p["input"], p["first"][None]]) + p["gate_bias"])
    both, last = _halved_gates(p)
    x, zr = np.empty((SCORING_LANES, 3 * k), _FLOAT), np.empty((SCORING_LANES, 2 * k), _FLOAT)
    reset = np.empty((SCORING_LANES, k), _FLOAT)
    for g in range(0, rows, SCORING_LANES):
        lanes = Lanes(ids, first, by_size[g : g + SCORING_LANES])
        h = np.zeros((len(lanes.order), k), _FLOAT)
        before = np.full(len(lanes.order), v.ids)
        for left, block in lanes.windows(WINDOW):
            inside = block >= 0
            bounds = np.concatenate([[0], np.cumsum(inside.sum(axis=1))])
            states = np.empty((bounds[-1], k), _FLOAT)
            for t, row in enumerate(block):
                n = int(bounds[t + 1] - bounds[t])  # longest first: lanes that go on are a prefix
                h = h[:n]
                own, c = np.take(inputs, before[:n], axis=0, out=x[:n], mode="clip"), states[bounds[t] : bounds[t + 1]]
                _advance(own, h, both, last, zr[:n], reset[:n], c)
                h, before = c, row
            found = log_likelihood(p, v, block[inside], states)
            out[lanes.order[:left]] += np.bincount(np.nonzero(inside)[1], found, left)
    return out


def deal(first: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Places of the tokens, steps x lanes, -1 past a lane's end.

    Documents follow one another in lanes of about equal length, so that all
    lanes are busy to the end; the longest document bounds how many there are.
    """
    size = np.diff(first)
    lanes = max(1, min(lanes, len(size), int(size.sum()) // max(1, int(size.max(initial=1)))))
    load = [(0, k) for k in range(lanes)]
    own: list[list[int]] = [[] for _ in range(lanes)]
    for row in np.argsort(-size, kind="stable").tolist():
        held, k = load[0]
        own[k].append(row)
        heapq.heapreplace(load, (held + int(size[row]), k))
    rng = np.random.default_rng(7)
    places = []
    for rows in own:
        at = [np.arange(first[r], first[r + 1]) for r in rng.permutation(rows)]
        places.append(np.concatenate(at) if at else np.zeros(0, np.int64))
    places.sort(key=len, reverse=True)
    out = np.full((len(places[0]), lanes), -1, np.int64)
    for k, at in enumerate(places):
        out[: len(at), k] = at
    return out


def train(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, first: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """Truncated back-propagation through time over all rows, with Adagrad; the state is carried across windows."""
    p = {name: x.copy() for name, x in p.items()}
    p["input"] = np.concatenate([p["input"], p.pop("first")[None]])
    scale = {name: np.full(x.shape, 1e-3, _FLOAT) for name, x in p.items()}
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = v.ids
    goes_on = np.ones(len(ids), _FLOAT)  # 0 where a document begins and the state is new
    goes_on[first[:-1]] = 0
    if len(first) > 1:
        places = deal(first)
        h = np.zeros((places.shape[1], HIDDEN), _FLOAT)
        for at in range(0, len(places), WINDOW):
            block = places[at : at + WINDOW]
            h = _window(p, scale, v, ids, before, goes_on, block[:, block[0] >= 0], h, rate)
    p["first"] = p["input"][-1].copy()
    p["input"] = p["input"][:-1].copy()
    return p


def _window(p, scale, v: Vocabulary, ids, before, goes_on, block: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
    """One update from a window of steps x lanes, whose lanes are the first of h; the state after it."""
    k, (steps, lanes) = HIDDEN, block.shape
    inside = block >= 0
    at = np.maximum(block, 0)
    x_ids = before[at]
    x = np.take(_halved(p["input"] + p["gate_bias"]), x_ids, axis=0)
    on = goes_on[at][:, :, None]
    old, zr = np.empty((steps, lanes, k), _FLOAT), np.empty((steps, lanes, 2 * k), _FLOAT)
    reset, c, state = (np.empty((steps, lanes, k), _FLOAT) for _ in range(3))
    both, last = p["gates"][:, : 2 * k], np.ascontiguousarray(p["gates"][:, 2 * k :])
    half = _halved_gates(p)[0]
    h = h[:lanes]
    for t in range(steps):
        np.multiply(h, on[t], out=old[t])
        g = zr[t]
        np.matmul(old[t], half, out=g)
        g += x[t, :, : 2 * k]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.multiply(g[:, k:], old[t], out=reset[t])
        np.matmul(reset[t], last, out=c[t])
        c[t] += x[t, :, 2 * k :]
        np.tanh(c[t], out=c[t])
        h = state[t]
        np.subtract(c[t], old[t], out=h)
        h *= g[:, :k]
        h += old[t]
    every = bool(inside.all())
    s, y = state.reshape(-1, k), ids[at].ravel()
    if every:
        grad, ds = _output_gradients(p, v, s, y)
    else:
        own = np.flatnonzero(inside)
        grad, found = _output_gradients(p, v, s[own], y[own])
        ds = np.zeros_like(s)
        ds[own] = found
    ds = ds.reshape(steps, lanes, k)
    z, r = zr[:, :, :k], zr[:, :, k:]
    of_c, of_z, of_r = z * (1 - c * c), (c - old) * z * (1 - z), old * r * (1 - r)
    keep = 1 - z
    dx = np.empty((steps, lanes, 3 * k), _FLOAT)
    dh = np.zeros((lanes, k), _FLOAT)
    both_t, last_t = np.ascontiguousarray(both.T), np.ascontiguousarray(last.T)
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        np.multiply(dh, of_c[t], out=dx[t, :, 2 * k :])
        np.multiply(dh, of_z[t], out=dx[t, :, :k])
        back = dx[t, :, 2 * k :] @ last_t
        np.multiply(back, of_r[t], out=dx[t, :, k : 2 * k])
        dh *= keep[t]
        back *= r[t]
        dh += back
        dh += dx[t, :, : 2 * k] @ both_t
        dh *= on[t]
    dx = dx.reshape(-1, 3 * k)
    dgates = np.concatenate([old.reshape(-1, k).T @ dx[:, : 2 * k], reset.reshape(-1, k).T @ dx[:, 2 * k :]], axis=1)
    norm = 1.0 / (lanes + int(((on[1:, :, 0] == 0) & inside[1:]).sum()))  # documents in the window
    for name, d in (("gates", dgates), ("gate_bias", dx.sum(axis=0)), *grad["dense"]):
        _update(p[name], scale[name], None, np.clip(d * norm, -1, 1), rate)
    order = np.argsort(x_ids.ravel().astype(np.int16 if v.ids < 32_000 else np.int64), kind="stable")
    ranked = x_ids.ravel()[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    d = np.add.reduceat(dx[order], begin, axis=0)
    _update(p["input"], scale["input"], ranked[begin], np.clip(d * norm, -1, 1), rate)
    if grad["words"]:
        number, dw, db = (np.stack(x) for x in zip(*grad["words"], strict=True))  # one update for all
        _update(p["word"], scale["word"], number, np.clip(dw * norm, -1, 1), rate)
        _update(p["word_bias"], scale["word_bias"], number, np.clip(db * norm, -1, 1), rate)
    return h


def _update(x: np.ndarray, scale: np.ndarray, where, d: np.ndarray, rate: float) -> None:
    if where is None:
        scale += d * d
        x -= rate * d / np.sqrt(scale)
    else:
        scale[where] += d * d
        x[where] -= rate * d / np.sqrt(scale[where])


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place.  Biases start at zero and below and states are at most one, so the cut at 60 is for safety."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x *= (1 / (_sums(x) + _FLOAT(1e-30)))[:, None]
    return x


def _output_gradients(p: dict[str, np.ndarray], v: Vocabulary, s: np.ndarray, y: np.ndarray):
    """Gradients of the loss in the output weights and in the states."""
    target = v.class_of[y]
    d = _softmax(s @ p["class"] + p["class_bias"])
    d[np.arange(len(y)), target] -= 1
    ds = d @ p["class"].T
    dense = [("class", s.T @ d), ("class_bias", d.sum(axis=0))]
    inner = []
    order, bounds = _by_class(target, v)
    ranked, place, more = s[order], y[order], np.empty((len(order), HIDDEN), _FLOAT)
    for c in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[c], bounds[c + 1])
        e = _softmax(ranked[own] @ p["word"][c] + p["word_bias"][c])
        e[np.arange(len(e)), place[own] - c * CLASS_SIZE] -= 1
        np.matmul(e, p["word"][c].T, out=more[own])
        inner.append((c, ranked[own].T @ e, e.sum(axis=0)))
    ds[order] += more
    return {"dense": dense, "words": inner}, ds


def pack(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


# --- over the corpus -------------------------------------------------------


def _parts(batches: Iterator[pa.RecordBatch], v: Vocabulary, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and row bounds of all rows, in parts of ``most`` tokens or little more."""
    ids, sizes, held = [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        t = texts(batch.column(1))
        for a, b in t.chunks():
            tokens = Tokens(t, a, b)
            ids.append(v.encode(tokens))
            sizes.append(np.diff(tokens.first))
            held += len(ids[-1])
            if held >= most:
                yield np.concatenate(ids), np.cumsum(np.concatenate(sizes))
                ids, sizes, held = [], [np.zeros(1, np.int64)], 0
    if held:
        yield np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def _average(found: Iterator[tuple[int, dict[str, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """One network for all that are found, weighed by their tokens."""
    total, weight = None, 0
    for n, p in found:
        if total is None:
            total = {k: x.astype(np.float64) * n for k, x in p.items()}
        else:
            for k in total:
                total[k] += p[k] * float(n)
        weight += n
    if total is not None:
        p = {k: (x / weight).astype(_FLOAT) for k, x in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([pack(p)], pa.binary())], ["n", "p"])


def learn(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """The network: started by one worker on a bounded sample, then trained on all training documents.

    Each worker trains on from the start on every part of its documents and
    averages; the averages go up a tree of groups of 16, so no task and no
    driver ever holds more than 16 networks.
    """
    own = training(docs)
    # by id and text: copies of a text are drawn one by one, so a large group of them is not drawn as a whole
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    begin = min(1.0, START_TOKENS / max(1, v.total))
    size = "n long, p binary"

    def run_from(raw: bytes | None, rate: float, most: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = unpack(raw) if raw else start(v)
            yield from _average((len(ids), train(p, v, ids, first, rate)) for ids, first in _parts(batches, v, most))

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _average(
            (n, unpack(raw.as_py()))
            for batch in batches
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
        )

    # the start is one worker's, so it takes no long text; the pass over all documents takes them too
    small = F.octet_length("text") <= 1 << 16
    seed = own.where((draw < begin) & small).repartition(1).mapInArrow(run_from(None, RATE, math.inf), size).collect()
    p = unpack(seed[0]["p"]) if seed else start(v)
    nets = cut(spread(own).mapInArrow(run_from(pack(p), LATER_RATE, PART_TOKENS), size))
    parts = nets.count()
    while parts > 16:
        parts = -(-parts // 16)
        nets = cut(nets.repartition(parts).mapInArrow(average, size))
    found = list(nets.coalesce(1).mapInArrow(average, size).collect())
    return unpack(found[0]["p"]) if found else p


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From the counts: totals, the end, the FREQUENT most frequent words, and the weight of each tail class."""
    total = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    is_end = F.col("word") == int(signed(np.array([END], np.uint64))[0])
    # the end is looked up on its own: among long documents it is not frequent
    top = counted.where(is_end).collect() + counted.where(~is_end).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = [(r["word"] % (1 << 64), r["n"]) for r in top]
    tails = {r["tail"]: [r["v"], r["n"]] for r in counted.groupBy("tail").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    for r in top:
        tails[r["tail"]][0] -= 1
        tails[r["tail"]][1] -= r["n"]
    return Vocabulary(frequent, total["n"] or 0, total["v"], {k: tuple(x) for k, x in tails.items()})


def known_words(counted: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words, at most ``most``.

    The least count that is taken is an edge of a histogram of eight steps a
    doubling, so nothing is sorted and the driver gets no more than ``most`` rows.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, None
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():
        if r["v"] > left:
            break
        left, least = left - r["v"], r["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counted.where(step >= least).select("word", "n").toArrow()
    h = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy()[order]


def score(docs: DataFrame, counted: DataFrame, v: Vocabulary, p: dict[str, np.ndarray], most: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score.

    Words of the vocabulary and up to ``most`` others have their counts where the
    text is read.  The rest leave as (row, word, times) and meet their counts in
    a join; with 2**17 words gone, the hottest key left is less than a millionth
    of the tokens where words are spread as in natural text.
    """
    own_hash, own_count = known_words(counted, most)
    own_log = np.log10(own_count + ADD)
    tail_log = np.log10(v.tail_mass)
    frequent_log = np.concatenate([np.log10(v.count + ADD), [math.log10(v.end_count + ADD)]]) if v.end else np.array([math.log10(v.end_count + ADD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(1))
            for a, b in t.chunks(_GROUP):
                every = [Tokens(t, x, y) for x, y in t.chunks(begin=a, end=b)]
                ids = np.concatenate([v.encode(x) for x in every])
                hashes = np.concatenate([x.hash for x in every])
                first = np.cumsum(np.concatenate([[0], *(np.diff(x.first) for x in every)]))
                del every
                n = np.diff(first)
                rows = np.repeat(np.arange(b - a), n)
                is_tail = ids > v.end
                known = np.bincount(rows, ~is_tail, b - a) if v.end_count else np.zeros(b - a)
                base = np.bincount(rows[~is_tail], frequent_log[ids[~is_tail]], b - a) - n * v.log_total
                own = score_rows(p, v, ids, first) / math.log(10)
                own -= np.bincount(rows[is_tail], tail_log[ids[is_tail] - v.end - 1], b - a)
                at = np.flatnonzero(is_tail)
                if len(own_hash):
                    place = np.minimum(np.searchsorted(own_hash, hashes[at]), len(own_hash) - 1)
                    have = own_hash[place] == hashes[at]
                    held = rows[at[have]]
                    gain = np.bincount(held, own_log[place[have]], b - a)
                    base, own, known = base + gain, own + gain, known + np.bincount(held, minlength=b - a)
                    at = at[~have]
                pair = np.lexsort((hashes[at], rows[at]))
                r, h = rows[at][pair], hashes[at][pair]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(r)))
                offsets = np.searchsorted(r[begin], np.arange(b - a + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays(
                    [pa.array(signed(h[begin])), pa.array(times.astype(np.int32))], names=["word", "times"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                        pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), struct),
                    ],
                    ["doc_id", "n", "known", "base", "own", "rest"],
                )

    schema = "doc_id long, n long, known long, base double, own double, rest array<struct<word:long,times:int>>"
    scanned = table(spread(id_text(docs)).mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*"))
    rest = scanned.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.times")
    unseen = math.log10(ADD)
    matched = (
        rest.join(counted.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.col("times") * F.coalesce(F.log10(F.col("c") + ADD), F.lit(unseen))).alias("gain"),
        )
    )
    zero = F.lit(0.0)
    return scanned.drop("rest").join(matched, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("gain", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("gain", zero)).alias("score"),
    )


def model(docs: DataFrame) -> tuple[DataFrame, Vocabulary, dict[str, np.ndarray]]:
    counted = table(counts(docs))
    v = vocabulary(counted)
    return counted, v, learn(docs, v)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counted, v, p = model(docs)
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return score(docs, counted, v, p).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(v.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
