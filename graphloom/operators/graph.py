"""The source graph: two DataFrames, and the queries that need no recursion.

Node ids are ``kind:path`` or ``kind:path:name``.  Parallel edges are kept in
``raw_edges``; ``edges`` has each (source, target, edge_type) once.  Edges whose
ends are missing belong to no graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar

EDGE_KEY = ["source", "target", "edge_type"]


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    columns = lead + [c for c in rest if c not in lead]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in columns])).alias("__first"))
    return picked.select(*keys, *[F.col("__first")[c].alias(c) for c in columns]).select(*df.columns)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    raw_edges: DataFrame
    warnings: list[str] = field(default_factory=list)

    @property
    def edges(self) -> DataFrame:
        return self.raw_edges.dropDuplicates(EDGE_KEY)

    def with_integrity(self) -> Graph:
        """Each node id once, and no edge without both its ends."""
        nodes = self.nodes.dropDuplicates(["id"])
        ids = nodes.select("id")
        kept = self.raw_edges.join(ids, F.col("source") == ids.id, "left_semi")
        kept = kept.join(ids, F.col("target") == ids.id, "left_semi")
        return replace(self, nodes=nodes, raw_edges=kept)

    def dangling(self) -> DataFrame:
        """Edges with an end that no node has."""
        ids = self.nodes.select(F.col("id"))
        source, target = ids.withColumnRenamed("id", "__s"), ids.withColumnRenamed("id", "__t")
        joined = self.raw_edges.join(source, F.col("source") == F.col("__s"), "left").join(
            target, F.col("target") == F.col("__t"), "left"
        )
        return joined.where("__s is null or __t is null").drop("__s", "__t")

    # --- lookups

    def by_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def files(self) -> DataFrame:
        return self.by_type("file")

    def symbols_in(self, path: str) -> DataFrame:
        return self.nodes.where((F.col("file_path") == path) & (F.col("node_type") != "file"))

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def resolve_file(self, module: str) -> DataFrame:
        """The file node that a name means: its id, then file:name, then file:src/name, then the only
        path that ends in /name.  Empty if there is none or the ending is not unique."""
        files = self.files()
        rank = (
            F.when(F.col("id") == module, 0)
            .when(F.col("id") == f"file:{module}", 1)
            .when(F.col("id") == f"file:src/{module}", 2)
            .when(F.col("file_path").endswith(f"/{module}"), 3)
        )
        found = files.select("id", rank.alias("rank")).where("rank is not null")
        best = found.groupBy("rank").agg(F.min("id").alias("id"), F.count("*").alias("n")).orderBy("rank").limit(1)
        return best.where("rank < 3 or n = 1").select("id")

    # --- neighbours

    def outgoing(self, edge_type: str | None = None, raw: bool = True) -> DataFrame:
        """source, target, the payload of the edge, and the target's node_type; a row for each parallel edge."""
        e = self.raw_edges if raw else self.edges
        if edge_type:
            e = e.where(F.col("edge_type") == edge_type)
        ends = self.nodes.select(F.col("id").alias("target"), F.col("node_type").alias("target_type"))
        return e.join(ends, "target")

    def incoming(self, edge_type: str | None = None, raw: bool = True) -> DataFrame:
        e = self.raw_edges if raw else self.edges
        if edge_type:
            e = e.where(F.col("edge_type") == edge_type)
        ends = self.nodes.select(F.col("id").alias("source"), F.col("node_type").alias("source_type"))
        return e.join(ends, "source")

    def neighbors(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        e = self.raw_edges.where(F.col("source") == node_id)
        if edge_type:
            e = e.where(F.col("edge_type") == edge_type)
        return self.nodes.join(e.select(F.col("target").alias("id")), "id")

    # --- sub-graphs

    def import_graph(self) -> DataFrame:
        """source, target: the imports between files, each once."""
        files = self.files().select("id")
        e = self.raw_edges.where("edge_type = 'imports'").select("source", "target").distinct()
        e = e.join(files, e.source == files.id, "left_semi")
        return e.join(files, e.target == files.id, "left_semi")

    def induced(self, ids: DataFrame) -> Graph:
        """The sub-graph on the ids of a one-column frame."""
        own = ids.toDF("id").distinct()
        nodes = self.nodes.join(own, "id", "left_semi")
        kept = self.raw_edges.join(own, F.col("source") == own.id, "left_semi")
        kept = kept.join(own, F.col("target") == own.id, "left_semi")
        return replace(self, nodes=nodes, raw_edges=kept)

    def without_files(self, paths: DataFrame) -> Graph:
        """The graph without the nodes of some files and the edges at them."""
        gone = paths.toDF("file_path").distinct()
        lost = self.nodes.join(gone, "file_path", "left_semi").select("id")
        nodes = self.nodes.join(gone, "file_path", "left_anti")
        kept = self.raw_edges.join(lost, F.col("source") == lost.id, "left_anti")
        kept = kept.join(lost, F.col("target") == lost.id, "left_anti")
        return replace(self, nodes=nodes, raw_edges=kept)

    # --- counts

    def node_counts(self) -> DataFrame:
        return self.nodes.groupBy("node_type").agg(F.count("*").alias("n"))

    def edge_counts(self) -> DataFrame:
        """Per type, edges as built (parallel ones too) and as stored (each once)."""
        per_key = self.raw_edges.groupBy(*EDGE_KEY).agg(F.count("*").alias("n"))
        return per_key.groupBy("edge_type").agg(F.sum("n").alias("built"), F.count("*").alias("stored"))


def interfaces(nodes: DataFrame, used: Column | None = None) -> DataFrame:
    """Exported symbols with a token estimate of their signature or name; ``used`` NULL means all."""
    out = nodes.where("is_exported and node_type <> 'file'")
    if used is not None:
        out = out.where(used.isNull() | F.array_contains(used, F.col("name")))
    return out.withColumn("tokens", scalar.token_estimate(F.coalesce("signature", "name")))
