"""Fingerprints as a stream: each micro-batch of file contents updates the stored fingerprints.

State lives in versioned Parquet folders.  A batch is written under its own
number and becomes current by a pointer that is added to those before it, so a batch
that is played again after a failure writes the same folder and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import cdc
from graphloom.operators.validate import latest

FILES = "file_path string, content string, version long"
_PRINTS = "file_path string, content_hash string, structure_hash string"


def fingerprint(files: DataFrame) -> DataFrame:
    """The latest version of each file, hashed; without a parser the first line stands for the structure."""
    last = latest(files, ["file_path"], "version")
    first = F.substring_index("content", "\n", 1)
    return last.select("file_path", F.sha2("content", 256).alias("content_hash"), F.sha2(first, 256).alias("structure_hash"))


class FingerprintStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batch(self) -> int:
        """The batch that is current; -1 before the first."""
        try:
            row = self.spark.read.schema("batch long").json(f"{self.root}/_current").agg(F.max("batch").alias("batch")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1
        return -1 if row["batch"] is None else row["batch"]

    def current(self, batch: int | None = None) -> DataFrame:
        batch = self.batch() if batch is None else batch
        if batch < 0:
            return self.spark.createDataFrame([], _PRINTS)
        return self.spark.read.schema(_PRINTS).parquet(f"{self.root}/fingerprints/{batch}")

    def changes(self, batch: int) -> DataFrame:
        return self.spark.read.schema("file_path string, change string").parquet(f"{self.root}/changes/{batch}")

    def apply(self, files: DataFrame, batch: int) -> None:
        now = self.batch()
        if now >= batch:
            return  # played again
        fresh = fingerprint(files)
        old = self.current(now)
        touched = old.join(fresh.select("file_path"), "file_path", "left_semi")
        cdc.changes(touched, fresh).write.mode("overwrite").parquet(f"{self.root}/changes/{batch}")
        cdc.upsert(old, fresh, ["file_path"]).write.mode("overwrite").parquet(f"{self.root}/fingerprints/{batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").json(f"{self.root}/_current")


def follow(files: DataFrame, store: FingerprintStore, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run over all that a stream of FILES has now; ``then`` gets the changes of each batch."""

    def each(frame: DataFrame, batch: int) -> None:
        store.apply(frame, batch)
        if then is not None:
            then(store.changes(batch), batch)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
