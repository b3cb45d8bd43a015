"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components.

Fingerprints of 64 bits are cut into six blocks.  Two that differ in at most
two bits agree on some four of the six, so they meet under one of 15 masks; one
mask fixes at least 42 bits, which proves that a bucket of *distinct*
fingerprints has at most 2**22 members, however many documents carry them.
Copies collapse before the blocks, and a bucket reports a spanning forest of
its links, so nothing grows with the square of a group.

Two bits are a narrow reach: texts of similarity 0.8 differ in up to 18.  The
stage that keeps one document of each group therefore takes its candidates
from the blocks and from bands of least hashes besides, and checks the exact
similarity of each; see :func:`similar`.

Edge cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other.  Rows that repeat a doc_id are fingerprinted and
returned each.  A null doc_id is returned, and never names a component that has
another id.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NOT_SPACE, cut, grams, id_text, lean, mix, side, signed, spread, table, text_key, texts, words
from graphloom.session import ship

WIDTHS = (11, 11, 11, 11, 10, 10)
DISTANCE = 2
SEED = 42
SHINGLE = 3
_ROWS = 1 << 16
#: The stage's own: shingles of five words, similarity of 0.8 or more; 20 bands of 6 miss one link in 400 at 0.8.
FIVE = 5
SIMILARITY = 0.8
BANDS = 20
BAND_ROWS = 6
_TURNS, _SHIFTS = (
    mix(np.arange(BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(k)) | np.uint64(1 - k) for k in range(2)
)


def masks() -> list[int]:
    """The bits that each choice of four blocks holds fixed."""
    at, blocks = 0, []
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(chosen) for chosen in combinations(blocks, len(WIDTHS) - DISTANCE)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        parts = iter([b" ".join(found)])
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    digest = partial(xxhash.xxh64_digest, seed=SEED)
    n = max(1, len(found) - shingle + 1)
    ones = np.zeros(64, np.int64)
    h = np.frombuffer(b"".join(map(digest, parts)), np.uint8).reshape(n, 8)
    for at in range(0, n, _ROWS):
        ones += np.unpackbits(h[at : at + _ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: one row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(1))
            fp = np.fromiter((fingerprint(t.row(i), shingle) for i in range(len(t))), np.uint64, len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return spread(id_text(docs)).mapInArrow(lean(run), "doc_id long, fp long")


def local_labels(fps: np.ndarray, free: int, distance: int = DISTANCE) -> np.ndarray:
    """For each of these distinct fingerprints, which differ in the bits of ``free`` only,
    the place of the smallest one that links within the bucket reach.

    Small buckets compare all; larger ones look up each flip of up to two free
    bits (at most 254) in the sorted bucket: linear in its size.
    """
    labels = np.arange(len(fps))

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal labels
        while True:
            a, b = labels[i], labels[j]
            if not (apart := a != b).any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while (labels != (up := labels[labels])).any():
                labels = up

    if len(fps) <= 256:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
        unite(i, j)
        return labels
    bits = [np.uint64(1 << k) for k in range(64) if free >> k & 1]
    order = np.argsort(fps)
    ranked = fps[order]
    for size in range(1, distance + 1):
        for flip in combinations(bits, size):
            other = fps ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
            at = np.minimum(np.searchsorted(ranked, other), len(fps) - 1)
            here = np.flatnonzero(ranked[at] == other)
            unite(here, order[at[here]])
    return labels


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that span every group of distinct fingerprints in ``fp`` within the distance."""
    fixed = masks()
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for k, m in enumerate(fixed)])
        ).alias("b"),
    )
    buckets = (
        keyed.groupBy("b.m", "b.k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("m", "fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for k, m in enumerate(batch.column(0).to_pylist()):
                own = np.sort(flat[at[k] : at[k + 1]])
                labels = local_labels(own, ~fixed[m] & (1 << 64) - 1)
                if (moved := np.flatnonzero(labels != np.arange(len(own)))).size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[moved].view(np.int64)), pa.array(own[labels[moved]].view(np.int64))], ["a", "b"]
                    )

    return buckets.mapInArrow(lean(run), "a long, b long")


def _long(x: int):
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node with a link reaches.

    Alternates large-star and small-star until nothing changes; the rounds grow
    with the logarithm of the longest chain, and each is checkpointed.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = (
            large.join(low, "u")
            .where("v <> w")
            .select(F.col("v").alias("u"), F.col("w").alias("v"))
            .unionByName(low.withColumnRenamed("w", "v"))
        )
        e = cut(small.distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id that a document's links reach."""
    fps = table(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    rooted = cut(rooted)
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- the stage: one document of each group of similar ones ------------------


def _minima(h: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each of the BANDS * BAND_ROWS multiplications."""
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(low, (h[None, at : at + 1024] * _TURNS[:, None] + _SHIFTS[:, None]).min(axis=1), out=low)
    return low


def _band_keys(low: np.ndarray) -> np.ndarray:
    rows, out = low.reshape(BANDS, BAND_ROWS), np.zeros(BANDS, np.uint64)
    for k in range(BAND_ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) ^ rows[:, k])
    return out


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Hashes, in order, of the distinct runs of FIVE words; a shorter text is one run, one without words has none."""
    return np.unique(grams(h, min(FIVE, len(h))) if len(h) else h)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tk (key of the text), cls (digest of the set), n, fp, keys: one row per row of docs."""
    kinds = [
        ("doc_id", pa.int64()), ("tk", pa.int64()), ("cls", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()),
        ("keys", pa.list_(pa.int64())),
    ]

    def row(h: np.ndarray) -> tuple[bytes, int, int, np.ndarray]:
        h = shingle_set(h)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), _ROWS):
            ones += np.unpackbits(h[at : at + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        fp = int.from_bytes(np.packbits(ones * 2 > max(1, len(h))).tobytes(), "big", signed=True)
        return xxhash.xxh128_digest(h.tobytes()), len(h), fp, signed(_band_keys(_minima(h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(2))
            for a, b in t.chunks():
                w = words(t, a, b, NOT_SPACE)
                found = [row(w.hash[i:j]) for i, j in zip(w.first, w.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(a, b - a) for k in (0, 1)]
                    + [pa.array(list(x), kind) for x, (_, kind) in zip(zip(*found, strict=True), kinds[2:], strict=True)],
                    [name for name, _ in kinds],
                )

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    return spread(given).mapInArrow(lean(run), "doc_id long, tk long, cls binary, n int, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, shingles of the wanted rows (cls, doc_id, tk): the low halves of the hashes, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch.column(1))
            for a, b in t.chunks():
                w = words(t, a, b, NOT_SPACE)
                found = [np.unique(shingle_set(w.hash[i:j]).astype(np.uint32)).view(np.int32) for i, j in zip(w.first, w.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int32()))], ["cls", "shingles"])

    own = side(wanted.select("cls", F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__tk"))
    given = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, same).select("cls", "text")
    return given.mapInArrow(lean(run), "cls binary, shingles array<int>").groupBy("cls").agg(F.any_value("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have at least this Jaccard similarity, counted over all shingles."""
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.toDF("a", "x"), "a")
        .join(sets.toDF("b", "y"), "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all"))
        .where(F.col("both") >= similarity * F.col("all"))
        .select("a", "b")
    )


def rare_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of ``left`` (cls, root) of two roots that may be alike, by the shingles that are rarest among them.

    Two sets of at least this similarity share a shingle among the rarest of
    each, and behind their first common one enough must be left to reach the
    overlap.  So the test loses no pair, and texts that are alike only in what
    many share do not meet.  In each bucket of a shingle the members of the root that
    most of them have are not held against each other.
    """
    own = left.join(sets, "cls").select("cls", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    own = cut(own)
    common = own.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ranked = (
        own.join(common, "t", "left")
        .groupBy("cls", "root", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "t"))).alias("order"))
    )
    # the least overlap of a set of n with any other is similarity * n
    opening = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity - 1e-6).cast("int") + 1)
    entries = ranked.select("cls", "root", "n", F.posexplode(opening).alias("at", "x")).where("x.c > 1")
    entries = cut(entries.select("cls", "root", "n", "at", F.col("x.t").alias("t")))
    counted = entries.groupBy("t", "root").agg(F.count("*").alias("c"))
    main = counted.groupBy("t").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("main"))
    x = entries.join(main.where("roots > 1").select("t", F.col("main.root").alias("main")), "t").where("root <> main").alias("x")
    enough = F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) >= (similarity / (1 + similarity)) * F.expr("x.n + y.n") - 1e-6
    met = F.expr("x.t = y.t and x.root <> y.root") & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6) & enough
    ends = F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")
    return x.join(entries.alias("y"), met).select(*ends).distinct()


def similar(classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, root: the components of verified links between classes that two searches propose.

    SimHash blocks propose fingerprints within two bits.  Bands of least hashes
    propose what lies between there and ``similarity``: all of a bucket is held
    against the member that has most company over all bands, so that a group has
    few of these.  The members of buckets that this leaves with more than one component
    are then searched by :func:`rare_pairs`, which misses none of their links.  So no
    bucket is capped, and a group of any size costs one comparison a member
    and the few that their rarest shingles leave possible.
    """
    hubs = classes.groupBy("fp").agg(F.min("cls").alias("hub"))
    near = links(classes.select("fp").distinct())
    pairs = classes.join(hubs, "fp").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.unionByName(
        near.join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    keyed = classes.where("n > 0").select("cls", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(keyed.join(shared, ["band", "key"]))
    company = members.groupBy("cls").agg((-F.sum("size")).alias("w"))
    order = F.struct("w", F.xxhash64("cls").alias("o"), "cls", "n")
    first = members.join(company, "cls").groupBy("band", "key").agg(F.min(order).alias("h"))
    close = F.least("n", "h.n") >= similarity * F.greatest("n", "h.n")
    held = members.join(first, ["band", "key"]).where(close)
    held = held.select(F.greatest("cls", "h.cls").alias("a"), F.least("cls", "h.cls").alias("b"))
    tried = cut(pairs.unionByName(held).where("a <> b").distinct())
    suspects = members.select("cls").unionByName(tried.selectExpr("a as cls")).unionByName(tried.selectExpr("b as cls")).distinct()
    sets = table(shingle_sets(docs, classes.join(suspects, "cls").select("cls", "low.doc_id", "low.tk")))
    found = cut(verified(tried, sets, similarity))
    roots = components(found)
    own = members.join(roots, members.cls == roots.node, "left").select("band", "key", "cls", F.coalesce("root", "cls").alias("root"))
    own = cut(own)
    mixed = own.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = cut(own.join(mixed, ["band", "key"], "left_semi").select("cls", "root").distinct())
    more = rare_pairs(left, sets, similarity).join(tried, ["a", "b"], "left_anti")
    return components(found.unionByName(verified(cut(more), sets, similarity)))


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tk, keep_id, keep_tk: for each row, the id and the text's key of the row that its group keeps.

    That is the smallest doc_id, then the smallest key; rows without a doc_id come last.
    """
    rows = table(sketches(docs))
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    classes = table(
        rows.groupBy("cls").agg(
            F.min(low).alias("low"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")
        )
    )
    roots = similar(classes, docs, similarity)
    rooted = classes.join(roots, classes.cls == roots.node, "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    rooted = cut(rooted)
    kept = rooted.groupBy("root").agg(F.min("low").alias("keep"))
    named = rooted.join(kept, "root").select("cls", "keep")
    return rows.select("doc_id", "tk", "cls").join(named, "cls").select(
        "doc_id", "tk", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tk").alias("keep_tk")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of rows whose texts are alike: five-word shingles, Jaccard similarity of 0.8 or more, and chains of such.

    Rows are told apart by doc_id and text, so rows that repeat an id with
    another text are judged each; of rows with the same id and text any one stays.
    """
    found = table(groups(docs, similarity))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tk") == F.col("keep_tk"))
    names = [F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")]
    gone = found.where(~own).select(*names).distinct()
    again = cut(found.where(own).groupBy("doc_id", "tk").agg(F.count("*").alias("__n")).where("__n > 1").select(*names))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__tk"))
    kept = docs.join(side(table(gone.unionByName(again))), same, "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, same, "left_semi").withColumn("__tk", text_key())
    return kept.unionByName(repeated.dropDuplicates(["doc_id", "__tk"]).select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import documents

    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
