"""Communities of files by their imports, and how far the folders deviate from them.

Local moves are sequential within a connected component, and of the others only
the total weight counts.  So components go to tasks, one after another in each;
memory follows the largest of them.  Up to KERNEL pairs, counted first, all go
to one task as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import closure, partitions
from graphloom.session import cut, ship

WARN_ABOVE = 0.5
KERNEL = 200_000


def undirected_imports(imports: DataFrame) -> DataFrame:
    """a, b, weight: imports between two files, in either direction, without self-imports."""
    return (
        imports.where("source <> target")
        .groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .agg(F.count("*").cast("double").alias("weight"))
    )


def louvain_level(nodes: list[str], weights: list[tuple[str, str, float]], total: float | None = None) -> dict[str, str]:
    """One level of local moves in the order of the names; a community is named by its smallest member.

    A node goes to the neighbouring community with the largest gain above that
    of staying; of equal gains, to the one whose name was first.  total is the
    weight of the whole graph, if this is a part of it.
    """
    order = sorted(nodes)
    number = {x: i for i, x in enumerate(order)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in order]
    for a, b, w in weights:
        i, j = number[a], number[b]
        near[i][j] += w
        near[j][i] += w
    if total is None:
        total = sum(w for _, _, w in weights)
    own = list(range(len(order)))
    if total:
        degree = [sum(x.values()) for x in near]
        mass, m2 = list(degree), 2 * total
        moved = True
        while moved:
            moved = False
            for i, k in enumerate(degree):
                links: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    links[own[j]] += w
                home = own[i]
                mass[home] -= k

                def gain(c: int, links=links, k=k) -> float:
                    return 2 * links.get(c, 0.0) / m2 - 2 * mass[c] * k / (m2 * m2)

                best, most = home, 0.0
                for c in sorted(links):
                    if gain(c) > most:
                        best, most = c, gain(c)
                if gain(home) >= most:
                    best = home
                mass[best] += k
                moved |= best != home
                own[i] = best
    groups: dict[int, list[str]] = defaultdict(list)
    for i, c in enumerate(own):
        groups[c].append(order[i])
    return {x: min(members) for members in groups.values() for x in members}


def communities(files: DataFrame, imports: DataFrame, kernel: int = KERNEL) -> DataFrame:
    """id, community of every file."""
    weights = cut(undirected_imports(imports))
    found = weights.agg(F.count("*").alias("n"), F.sum("weight").alias("total")).first()
    total = found["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: dict[str, str] = {}
        for _, own in groupby(rows, key=lambda r: r[0]):
            pairs = [r[1:] for r in own]
            held |= louvain_level(list({x for a, b, _ in pairs for x in (a, b)}), pairs, total)
            if len(held) > 10_000:
                yield _named(held)
                held = {}
        if held:
            yield _named(held)

    ship(files.sparkSession)
    if found["n"] <= kernel:
        parts = weights.select(F.lit("").alias("component"), "a", "b", "weight").repartition(1)
    else:
        of = closure.connected(weights.select(F.col("a").alias("source"), F.col("b").alias("target")))
        parts = weights.join(of.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "weight")
        parts = parts.repartition(F.col("component")).sortWithinPartitions("component")
    named = parts.mapInArrow(run, "id string, community string")
    return files.toDF("id").distinct().join(named, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _named(found: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.string())], ["id", "community"])


def deviation(files: DataFrame, imports: DataFrame) -> dict:
    """How far the folders are from the communities: 1 less the normalised mutual information."""
    found = communities(files, imports).withColumn("dir", scalar.parent_dir(scalar.node_path(F.col("id"))))
    if found.limit(2).count() < 2:
        return {"nmi": 1.0, "ari": 1.0, "deviation": 0.0, "warn": False, "details": None}
    table = partitions.contingency(found, "community", "dir")
    nmi, ari = partitions.nmi(table).first()["nmi"], partitions.ari(table).first()["ari"]
    return {
        "nmi": nmi, "ari": ari, "deviation": 1 - nmi, "warn": 1 - nmi > WARN_ABOVE,
        "details": partitions.purity(found, "community", "dir"),
    }
