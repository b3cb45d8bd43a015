"""Reachability over edges (source, target).

The distributed form is semi-naive: each round joins only what the round before
found.  Graphs of up to KERNEL edges, counted first, go to one Arrow task
instead, which returns the same rows without a job for each level.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, ship

KERNEL = 20_000


def small(edges: DataFrame, kernel: int) -> bool:
    """Whether there are at most ``kernel`` edges; reads no more than that many and one."""
    return edges.limit(kernel + 1).count() <= kernel


def reachable(edges: DataFrame, starts: DataFrame | None = None, kernel: int = KERNEL) -> DataFrame:
    """start, node: all that each start reaches, itself left out even on a cycle.

    starts is a frame of one column; without it every source is a start.
    """
    edges = edges.select("source", "target").distinct()
    if small(edges, kernel):
        return _kernel(edges, starts)
    edges = cut(edges)
    frontier = edges.withColumnsRenamed({"source": "start", "target": "node"})
    if starts is not None:
        frontier = frontier.join(starts.toDF("start").distinct(), "start", "left_semi")
    frontier = found = cut(frontier)
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "source").join(edges, "source")
        step = step.select("start", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(found, ["start", "node"], "left_anti"))
        found = found.unionByName(frontier)  # each round is written once
    return found.where("start <> node")


def _kernel(edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    ship(edges.sparkSession)
    rows = edges.select("source", "target")
    if starts is not None:
        mark = F.lit(None).cast("string")
        rows = rows.unionByName(starts.toDF("s").distinct().select(F.col("s").cast("string").alias("source"), mark.alias("target")))
    every = starts is None
    kind = edges.schema["source"].dataType.simpleString()
    rows = rows.select(F.col("source").cast("string"), F.col("target").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow: dict[str, list[str]] = defaultdict(list)
        begin: dict[str, None] = {}
        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None:
                    begin[s] = None
                else:
                    follow[s].append(t)
        for s in list(follow) if every else begin:
            seen, queue = set(), deque(follow.get(s, ()))
            while queue:
                x = queue.popleft()
                if x not in seen:
                    seen.add(x)
                    queue.extend(follow.get(x, ()))
            seen.discard(s)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(seen)), pa.array(list(seen))], ["start", "node"])

    out = rows.coalesce(1).mapInArrow(run, "start string, node string")
    return out.select(F.col("start").cast(kind), F.col("node").cast(kind))


def dependencies(edges: DataFrame, starts: DataFrame, kernel: int = KERNEL) -> DataFrame:
    return reachable(edges, starts, kernel)


def dependents(edges: DataFrame, starts: DataFrame, kernel: int = KERNEL) -> DataFrame:
    return reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), starts, kernel)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, fuse: int | None = 50) -> tuple[DataFrame, bool]:
    """node, depth of all that depend on the seeds over at most ``depth`` steps, and whether the fuse blew.

    If more than ``fuse`` nodes are found, only the direct dependents are returned.
    """
    edges = edges.select(F.col("source").alias("user"), F.col("target").alias("used")).distinct()
    found = seeds.toDF("node").distinct().withColumn("depth", F.lit(0))
    last = found
    for k in range(1, depth + 1):
        last = last.join(edges, F.col("node") == F.col("used")).select(F.col("user").alias("node")).distinct()
        last = last.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        found = found.unionByName(last)
    out = found.where("depth > 0")
    if fuse is None:
        return out, False
    out = cut(out)
    blown = out.limit(fuse + 1).count() > fuse
    return (out.where("depth = 1") if blown else out), blown


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the weakly connected components of all nodes with an edge."""
    e = cut(
        edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    )
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
        if now["n"] == 0 or now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("w"))
        moved = e.join(low, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        e = cut(moved.unionByName(low.withColumnRenamed("w", "v")).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    joined = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = edges.where("source = target").select(F.col("source").alias("node")).distinct()
    return joined.unionByName(alone.join(joined, "node", "left_anti").withColumn("component", F.col("node")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """step, node of the first shortest path from start to goal; empty if there is none."""
    spark = edges.sparkSession
    e = cut(edges.select("source", "target").distinct())
    kind = e.schema["source"].dataType
    found = spark.createDataFrame([(start,)], "node string").select(F.col("node").cast(kind), F.lit(None).cast(kind).alias("via"), F.lit(0).alias("step"))
    last, k = found, 0
    while True:
        k += 1
        if not found.where(F.col("node") == F.lit(goal)).isEmpty():
            break
        step = last.select(F.col("node").alias("source")).join(e, "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("via"))
        last = cut(step.join(found, "node", "left_anti").withColumn("step", F.lit(k)))
        if last.isEmpty():
            return found.select("step", "node").limit(0)
        found = cut(found.unionByName(last))
    path = found.where(F.col("node") == F.lit(goal))
    row = path.first()
    rows = []
    while row is not None:
        rows.append((row["step"], row["node"]))
        row = found.where(F.col("node") == F.lit(row["via"])).first() if row["via"] is not None else None
    return spark.createDataFrame(sorted(rows), found.select("step", "node").schema) if rows else found.select("step", "node").limit(0)
