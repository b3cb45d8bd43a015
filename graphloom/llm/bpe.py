"""Exact BPE by backtracking over longest matches.

For each pre-token an Aho-Corasick automaton over the vocabulary gives the
longest token at every place.  The encoder takes the longest token that may
stand after the one before it, falls back to shorter ones, and steps back from
places that proved dead; each place dies once, so the time is linear.  Which
tokens may stand side by side comes from a pair-compatibility table: two tokens
are compatible when no merge across their border would have come first.
Decoding gathers token texts from one byte string through an offset table.

The vocabulary file is read by the driver and travels with the tasks.

Edge cases: a null text is an empty one, without tokens.  Rows that repeat a
doc_id are encoded each; a null doc_id is returned.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import documents, id_text, lean, spread, texts

VOCABULARY = "word_bpe_49k.json"
WORD_CACHE = 200_000
PAIR_CACHE = 1_000_000
_BLOCK = 1 << 16
_END = 0x10000  # added to the last symbol of a pre-token
_FOREVER = 1 << 60

# Fixed values.  The tokenizer's classes are those of Unicode 16, its lower case
# that of Unicode 17; the modules here are newer in the one and older in the other.
#: Not yet letters, numbers or spaces in Unicode 16: first and last character.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals since Unicode 16: first, last, and how far off their small letters are.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 0x1), (0xA7CE, 0xA7CE, 0x1), (0xA7D2, 0xA7D2, 0x1),
    (0xA7D4, 0xA7D4, 0x1), (0xA7DA, 0xA7DA, 0x1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
#: Capital sigma has one small letter here, wherever it stands.
SIGMA = {0x3A3: 0x3C3}


def vocabulary(name: str = VOCABULARY) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, where none is odd."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Encoder:
    """Tokens are numbered by rank: symbols first, then merges in their order."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.plain = {b: s for b, s in enumerate(symbols)}
        spelled = {s: s for s in symbols} | {s + suffix: chr(ord(s) + _END) for s in symbols}
        rank: dict[str, int] = {}
        self.ids: list[int] = []
        self.spelling: list[str] = []
        self.parts: list[tuple[int, int] | None] = []

        def add(name: str, spelling: str, parts: tuple[int, int] | None) -> None:
            rank[name] = len(self.ids)
            self.ids.append(vocab[name])
            self.spelling.append(spelling)
            self.parts.append(parts)

        for name, spelling in spelled.items():
            add(name, spelling, None)
        self.merge: dict[int, int] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = rank[left], rank[right]
            if left + right in rank:
                raise ValueError(f"two merges make {left + right!r}")
            add(left + right, self.spelling[a] + self.spelling[b], (a, b))
            self.merge[a << 20 | b] = rank[left + right]
        self.size = [len(s) for s in self.spelling]
        by_spelling = {s: k for k, s in enumerate(self.spelling)}
        self.shorter = [
            next((by_spelling[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_spelling), -1) for s in self.spelling
        ]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for k, s in enumerate(self.spelling):
            self.automaton.add_word(s, (k, len(s)))
        self.automaton.make_automaton()
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        # special tokens stand in the raw text; decoding joins token texts with spaces
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        # the same classes among ASCII characters, for the faster of the two regex modules
        narrow = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\x0B\f\r")
        self.find_ascii = re.compile(narrow).findall
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}][{later}]]")
        exact = exact.replace(r"[\p{L}]", rf"[\p{{L}}--[{later}]]").replace(r"|[\p{N}]", rf"|[\p{{N}}--[{later}]]")
        self.find_exact = regex.compile(exact, regex.V1).findall
        self.small = SIGMA | {c: c + step for a, b, step in CAPITALS for c in range(a, b + 1)}
        self.odd = regex.compile(f"[{later}{''.join(map(chr, self.small))}]").search
        named = {i: name for name, i in vocab.items()} | {i: name for name, i in self.special.items()}
        pieces = [(named.get(i, "") + " ").encode() for i in range(max(named) + 1)]
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token along its border, the whole first: (part, rank that consumes it)."""
        out = self.edges.get((token, side))
        if out is None:
            out, part, consumed = [], token, _FOREVER
            while True:
                out.append((part, consumed))
                if self.parts[part] is None:
                    break
                consumed, part = part, self.parts[part][side]
            self.edges[token, side] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a followed by b as they are; looked up in the table, or worked out for it.

        A merge across the border happens if both of its sides stand there at
        its turn: made before it and not yet consumed.  At the same turn the
        leftmost place goes first.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            merge, right = self.merge.get, self._edge(b, 0)
            known = True
            for x, x_gone in self._edge(a, 1):
                x <<= 20
                for y, y_gone in right:
                    m = merge(x | y)
                    if m is not None and m < x_gone and m <= y_gone:
                        known = False
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def word(self, piece: str) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        if piece.isascii() and piece.isprintable():  # such characters stand for themselves
            spelled = piece[:-1] + chr(ord(piece[-1]) + _END)
        else:
            raw, plain = piece.encode(), self.plain
            spelled = "".join([plain[b] for b in raw[:-1]]) + chr(ord(plain[raw[-1]]) + _END)
        n, size, shorter, pairs = len(spelled), self.size, self.shorter, self.pairs.get
        longest = [0] * n
        for end, (token, length) in self.automaton.iter(spelled):
            longest[end - length + 1] = token  # later ends are longer
        out: list[int] = []
        at, token, last, dead = 0, longest[0], -1, None
        while True:
            while token >= 0:
                end = at + size[token]
                if dead is None or end not in dead:
                    if last < 0:
                        break
                    fits = pairs(last << 20 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at == n:
                    return out
                token = longest[at]
            else:
                dead = dead or set()
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]

    def _word(self, piece: str) -> bytes:
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        packed = self.packed
        found = b"".join([packed[k] for k in self.word(piece)])
        if len(piece) <= 64:
            self.words[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        find = self.find_ascii
        if not text.isascii():
            find = self.find
            text = unicodedata.normalize("NFC", text)
            if not _is_latin(text) and self.odd(text):
                text, find = text.translate(self.small), self.find_exact
        get, make = self.words.get, self._word
        return b"".join([get(p) or make(p) for p in find(text.lower())])

    def encode(self, text: str) -> np.ndarray:
        """Ids of the tokens of a text, as little-endian unsigned 32-bit integers."""
        if self.split_special is None or "<|" not in text:
            return np.frombuffer(self._plain(text), "<u4")
        parts = [
            self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p)
            for k, p in enumerate(self.split_special.split(text))
        ]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text, in UTF-8, in blocks."""
        for at in range(0, len(ids), _BLOCK):
            block = ids[at : at + _BLOCK]
            length = self.length[block]
            ends = np.cumsum(length)
            places = np.arange(ends[-1]) + np.repeat(self.offset[block] - (ends - length), length)
            found = self.text[places].tobytes()
            yield found[:-1] if at + _BLOCK >= len(ids) else found

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decode_blocks(np.asarray(ids, "<u4"))).decode()


_loaded: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded[key] = Encoder(raw)
    return _loaded[key]


def _strings(column: pa.Array) -> Iterator[str]:
    t = texts(column)
    for i in range(len(t)):
        yield t.row(i).decode()


def encode(docs: DataFrame, raw: bytes | None = None) -> DataFrame:
    """doc_id, ids array<long> of every whole text."""
    raw = raw or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw)
        for batch in batches:
            found, first, total = [], 0, 0
            for i, text in enumerate(_strings(batch.column(1))):
                found.append(e.encode(text))
                total += len(found[-1])
                if total >= 1 << 20 or i + 1 == batch.num_rows:
                    sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    flat = pa.array(np.concatenate(found).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(found)), pa.ListArray.from_arrays(pa.array(sizes), flat)],
                        ["doc_id", "ids"],
                    )
                    found, first, total = [], i + 1, 0

    return spread(id_text(docs)).mapInArrow(lean(run), "doc_id long, ids array<long>")


def decode(tokens: DataFrame, raw: bytes | None = None) -> DataFrame:
    """doc_id, text of every list of ids."""
    raw = raw or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.array(batch.column(1)[i].as_py() or [], "<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([e.decode(ids)], pa.string())], ["doc_id", "text"]
                )

    return tokens.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame, raw: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass."""
    raw = raw or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw)
        for batch in batches:
            n, encoded, decoded = [], [], []
            for text in _strings(batch.column(1)):
                ids = e.encode(text)
                n.append(len(ids))
                encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                h = hashlib.sha256()
                for block in e.decode_blocks(ids):
                    h.update(block)
                decoded.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(id_text(docs)).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
