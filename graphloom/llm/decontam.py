"""Benchmark decontamination by winnowing.

Every run of WINDOW words has WINDOW - K + 1 hashes of K words; the least of
them is its fingerprint.  A document and an item that share WINDOW consecutive
words therefore share a fingerprint, always.  Documents are scanned once
against a bitmap of the items' fingerprints, whose size is fixed; places that
pass are joined with the items on the fingerprint and extended to the whole
window, whose words are compared as they are spelled.  Items shorter than WINDOW words are one window of their own length.

Which items occur is worked out once for each distinct combination of windows,
not for each document, so a passage that many documents share with many items
does not multiply.

Edge cases: a null or empty text has no words, is never hit and, as an item,
never occurs.  Rows that repeat a doc_id are judged each; a null doc_id is
returned; items that share an item_id are one item, and a null item_id counts
for hits but is not listed.  An empty table of items hits nothing.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LETTERS, Texts, Words, documents, grams, id_text, lean, signed, spread, table, text_key, texts, without, words

WINDOW = 10
K = 6
BITMAP_BITS = 24

_CANDIDATE = pa.struct([("size", pa.int32()), ("mark", pa.int64()), ("whole", pa.int64()), ("at", pa.int32()), ("words", pa.string())])
_CANDIDATE_SQL = "struct<size:int,mark:long,whole:long,at:int,words:string>"


def _places(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``size`` words start that stay within a row, and the rows."""
    rows = w.row_of()
    at = np.arange(len(w))
    fits = at + size <= w.first[1:][rows]
    return at[fits], rows[fits]


def _marks(w: Words, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """The least hash of k words within the window from each place."""
    g = grams(w.hash, k)
    least = g[at]
    for j in range(1, window - k + 1):
        least = np.minimum(least, g[at + j])
    return least


def _windows(w: Words, size: int, window: int, k: int):
    """Place, row, fingerprint and whole hash of the windows of one size."""
    at, rows = _places(w, size)
    if not len(at):
        none = np.empty(0, np.uint64)
        return at, rows, none, none
    whole = grams(w.hash, size)[at]
    return at, rows, _marks(w, at, window, k) if size == window else whole, whole


def _emit(keys: pa.Array, counts: list[np.ndarray], found: list[tuple]) -> pa.RecordBatch:
    """found: (row, size, mark, whole, at, words) arrays."""
    empty = np.empty(0, np.int64)
    row, size, mark, whole, at, spelled = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [empty] * 6
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(len(keys) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays(
        [
            pa.array(size[order].astype(np.int32)),
            pa.array(signed(mark[order].astype(np.uint64))),
            pa.array(signed(whole[order].astype(np.uint64))),
            pa.array(at[order].astype(np.int32)),
            pa.array([x.decode() for x in spelled[order].tolist()], pa.string()),
        ],
        fields=list(_CANDIDATE),
    )
    n = np.concatenate(counts) if counts else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), struct)], ["key", "n_words", "found"]
    )


def _scan(t: Texts, keys: pa.Array, sizes: dict[int, str] | None, passes, window: int, k: int) -> pa.RecordBatch:
    """Windows of each row that pass; sizes None: all windows of an item, by its own length."""
    counts, found = [], []
    for a, b in t.chunks():
        w = words(t, a, b, LETTERS)
        n = np.diff(w.first)
        counts.append(n)
        for size in sizes if sizes is not None else sorted({min(window, int(x)) for x in n if x}):
            at, rows, mark, whole = _windows(w, size, window, k)
            if sizes is None:
                keep = n[rows] == size if size < window else np.ones(len(at), bool)
            else:
                keep = passes(mark)
            at, rows, mark, whole = at[keep], rows[keep], mark[keep], whole[keep]
            spelled = np.empty(len(at), object)
            spelled[:] = [b" ".join(w.bytes[w.start[i] : w.end[i]].tobytes() for i in range(p, p + size)) for p in at.tolist()]
            found.append((rows + a, np.full(len(at), size), mark, whole, at - w.first[rows], spelled))
    return _emit(keys, counts, found)


def item_windows(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """size, mark, whole, words, item: the windows of every item; item is the id as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scan(texts(batch.column(1)), batch.column(0), None, None, window, k)

    rows = items.select(F.col("item_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    scanned = rows.mapInArrow(lean(run), f"key string, n_words long, found array<{_CANDIDATE_SQL}>")
    return (
        scanned.select(F.col("key").alias("item"), F.explode("found").alias("w"))
        .select("w.size", "w.mark", "w.whole", "w.words", "item")
        .distinct()
    )


def bitmap(marks: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each value of the top bits of the marks: 2**bits bits, whatever the number of marks."""
    cells = (
        marks.select(F.shiftrightunsigned("mark", 64 - bits).alias("slot"))
        .select(F.expr("cast(slot >> 6 as int)").alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()  # at most 2**(bits - 6) rows
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    for cell in cells:
        out[cell["cell"]] = cell["bits"] % (1 << 64)
    return out


def scan(docs: DataFrame, marks: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITMAP_BITS) -> DataFrame:
    """row, doc_id, n_words, found: each row's windows whose fingerprint may be an item's.  Written once."""
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect())  # at most WINDOW values
    held = bitmap(marks, bits)

    def passes(mark: np.ndarray) -> np.ndarray:
        slot = mark >> np.uint64(64 - bits)
        return (held[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scan(texts(batch.column(1)), batch.column(0), sizes, passes, window, k)

    scanned = spread(id_text(docs)).mapInArrow(lean(run), f"key long, n_words long, found array<{_CANDIDATE_SQL}>")
    return table(
        scanned.select(F.monotonically_increasing_id().alias("row"), F.col("key").alias("doc_id"), "n_words", "found")
    )


def _covered(spans):
    """Words that sorted (at, size) spans cover."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["at"] + x["size"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n"),
        ),
        lambda s: s["n"].cast("long"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as text), spans of the hits (at, size)."""
    own = table(item_windows(items, window, k))
    scanned = scan(docs, own, window, k)
    # windows with the same items are one group: their list is kept once
    grouped = own.groupBy("size", "mark", "whole", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    grouped = table(grouped.withColumn("group", F.sha2(F.to_json("items"), 256)))
    lists = grouped.groupBy("group").agg(F.any_value("items").alias("items"))
    places = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.*")
    # hashes find the windows, their words decide
    hits = places.join(grouped.select("size", "mark", "whole", "words", "group"), ["size", "mark", "whole", "words"])
    by_row = table(
        hits.groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"), F.array_sort(F.collect_set("group")).alias("groups"))
        .select("row", _covered(F.col("spans")).alias("n_hit"), "spans", "groups", F.sha2(F.to_json("groups"), 256).alias("mix"))
    )
    mixes = by_row.groupBy("mix").agg(F.any_value("groups").alias("groups"))
    named = (
        mixes.select("mix", F.explode("groups").alias("group"))
        .join(lists, "group")
        .select("mix", F.explode_outer("items").alias("item"))
        .groupBy("mix")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = by_row.join(named, "mix").select("row", "n_hit", "spans", "items")
    none = F.array().cast("array<string>")
    return scanned.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,size:int>>")).alias("spans"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a hit.  Each row is judged by its own text, whatever rows share its doc_id."""
    keyed = docs.select(text_key().alias("doc_id"), "text")
    return without(docs, contamination(keyed, items).where("n_hit > 0"))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
