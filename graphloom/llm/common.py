"""What the training-data operators share: cutting lineage, and vectorised words.

Texts reach Python as Arrow buffers.  They are handled in chunks of whole texts
of about ``CHUNK`` bytes, so memory follows the chunk or the longest single
text, never the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

CHUNK = 1 << 20


# --- lineage ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, a folder of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lost executors do not lose it, and plans stay short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plans of these nodes alone read files and know their partitions without running anything.
_PLAIN = {"Project", "Filter", "LogicalRelation"}


def _nodes(plan) -> Iterator[str]:
    """Class names of a logical plan's nodes."""
    yield plan.getClass().getSimpleName()
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out anew if it is read in fewer partitions than there are cores, else as it is.

    For the passes in Python, which cost far more than moving their input.
    Plans with more than a scan, a filter and a projection are left alone.
    """
    if not set(_nodes(df._jdf.queryExecution().optimizedPlan())) <= _PLAIN:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def give_back() -> None:
    """Freed memory that the allocators of this process hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The pass, which gives memory back when its task ends.

    A worker lives on to the end of the application, and what one stage has
    freed in it would count as its executor's in all later ones.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """The small side of a join: broadcast if it has at most ``most`` rows, which are counted, else merged."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def text_key(column="text"):
    """What names a text: rows with the same text have the same verdict, whatever their ids."""
    return F.xxhash64(F.col(column).cast("string"))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose text's key is not in ``bad`` (column doc_id, keys of texts)."""
    keys = bad.select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(side(table(keys)), text_key() == F.col("__bad"), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only what the operators read, so that other columns cannot clash."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more
    )


# --- Arrow -----------------------------------------------------------------


@dataclass
class Texts:
    """One Arrow text column: bytes of all rows, where each row starts, and which are null."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.valid)

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def chunks(self, size: int = CHUNK, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """Ranges of rows of about ``size`` bytes; a longer text is a range of its own."""
        first, n = begin, len(self) if end is None else end
        while first < n:
            last = int(np.searchsorted(self.offsets, self.offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield first, last
            first = last


def texts(column: pa.Array) -> Texts:
    """Null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return Texts(data, offsets, valid)


# --- words -----------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all that is not ASCII
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_BASE = 0x9E3779B97F4A7C15
_LONG = 64  # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def hash_bytes(word: bytes) -> int:
    """The hash that :func:`words` gives this word."""
    raw = np.frombuffer(word, np.uint8)
    return int(Words.hashed(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


@dataclass
class Words:
    """Words of a range of rows.  ``first[i]:first[i+1]`` are those of its i-th row."""

    bytes: np.ndarray  # lower-cased
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of the bytes, such as openings of words."""
        return self.hashed(self.bytes, start, end)

    @staticmethod
    def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch: its bytes in lanes of eight, mixed one after another.

        Stretches of more than _LONG bytes take XXH64, so that the lanes of all together stay few.
        """
        size = end - start
        out = size.astype(np.uint64) * np.uint64(_BASE)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
        own = np.flatnonzero(size <= _LONG)
        for j in range(0, _LONG, 8):
            own = own[size[own] > j]
            if not len(own):
                break
            lane = lanes[start[own] + j] & _MASKS[np.minimum(size[own] - j, 8)]
            out[own] = mix(out[own] ^ (lane * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)))
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), _LONG)
        return mix(out)


def words(t: Texts, a: int, b: int, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of ``kind`` in rows a to b, A-Z lower-cased, with 64-bit hashes."""
    base = t.offsets[a]
    raw = t.data[base : t.offsets[b]]
    if lower:
        raw = LOWER[raw]
    bounds = t.offsets[a : b + 1] - base
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[raw]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, start, end, Words.hashed(raw, start, end), np.searchsorted(start, bounds))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each place (over row bounds too)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(out)]
    return mix(out + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
