"""Change detection between snapshots, what a change touches, and the incremental store."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import closure
from graphloom.operators.graph import EDGE_KEY, Graph


def structure_hash(symbols: DataFrame, imports: DataFrame, exports: DataFrame, calls: DataFrame) -> DataFrame:
    """file_path, structure_hash: SHA-256 over the sorted lines of a file's symbols, imports, exports and calls.

    symbols: file_path, node_type, name, is_exported, is_async, signature;
    imports: file_path, module_path, symbols (array of name and alias), kind,
    reexport; exports: file_path, name; calls: file_path, callee, is_constructor.
    """
    text = lambda b: F.when(F.col(b), "true").otherwise("false")
    listed = F.array_join(
        F.array_sort(F.transform("symbols", lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit(" as "), s["alias"]), F.lit(""))))), ","
    )
    lines = [
        symbols.where("node_type <> 'file'").select(
            "file_path", F.lit(1).alias("part"),
            F.concat_ws(":", "node_type", "name", text("is_exported"), text("is_async"), F.coalesce("signature", F.lit(""))).alias("line"),
        ),
        imports.select(
            "file_path", F.lit(2).alias("part"),
            F.concat(F.lit("import:"), F.concat_ws(":", "module_path", listed, "kind"), F.lit(":re="), text("reexport")).alias("line"),
        ),
        exports.select("file_path", F.lit(3).alias("part"), F.concat(F.lit("export:"), "name").alias("line")),
        calls.select("file_path", F.lit(4).alias("part"), F.concat(F.lit("call:"), "callee", F.lit(":"), text("is_constructor")).alias("line")),
    ]
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("part", "line")))
    joined = F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n"))
    return every.groupBy("file_path").agg(F.sha2(joined, 256).alias("structure_hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, change (added, deleted, none, cosmetic, structural) between two fingerprint tables."""
    o = old.select("file_path", F.col("content_hash").alias("oc"), F.col("structure_hash").alias("os"))
    n = new.select("file_path", F.col("content_hash").alias("nc"), F.col("structure_hash").alias("ns"))
    level = scalar.change_level(F.col("oc"), F.col("os"), F.col("nc"), F.col("ns"))
    change = F.when(F.col("oc").isNull(), "added").when(F.col("nc").isNull(), "deleted").otherwise(level)
    return o.join(n, "file_path", "full_outer").select("file_path", change.alias("change"))


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("file_path").join(new.select("file_path"), "file_path", "left_anti").distinct()


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


@dataclass(frozen=True)
class Store:
    """The persisted tables; analyses (`lang.base.ANALYSIS`) of all files stay, so that a change parses only what is new in content."""

    graph: Graph
    fingerprints: DataFrame
    integrity: str = "full"
    analyses: DataFrame | None = None

    def without(self, paths: DataFrame) -> Store:
        """Files that are gone: their fingerprints, nodes and edges go."""
        gone = paths.toDF("file_path").distinct()
        return replace(
            self,
            graph=self.graph.without_files(gone),
            fingerprints=self.fingerprints.join(gone, "file_path", "left_anti"),
            analyses=self._analyses_without(gone),
        )

    def splice(self, fresh: Graph, fingerprints: DataFrame, changed: DataFrame, truncated: bool = False) -> Store:
        """The changed files' nodes and edges replaced; a row that is there already is kept."""
        base = self.graph.without_files(changed)
        nodes = base.nodes.unionByName(fresh.nodes, allowMissingColumns=True).dropDuplicates(["id"])
        edges = base.raw_edges.unionByName(fresh.raw_edges, allowMissingColumns=True).dropDuplicates(EDGE_KEY)
        graph = Graph(nodes, edges, [*self.graph.warnings, *fresh.warnings]).with_integrity()
        prints = upsert(self.fingerprints, fingerprints, ["file_path"])
        # an analysis that is missing is made again, one that is out of date would be believed
        return Store(graph, prints, "partial" if truncated else self.integrity, self._analyses_without(changed))

    def _analyses_without(self, paths: DataFrame) -> DataFrame | None:
        if self.analyses is None:
            return None
        return self.analyses.join(paths.toDF("path").distinct(), "path", "left_anti")


def affected(changed: DataFrame, imports: DataFrame, depth: int = 3, fuse: int = 50) -> tuple[DataFrame, bool]:
    """file ids to analyse again: what changed in structure, what is new, and what depends on them within the
    depth; only direct dependents when the fuse blows.  Whoever imports a rebuilt file is among them."""
    seeds = changed.where("change in ('added', 'deleted', 'structural')").select(F.concat(F.lit("file:"), "file_path").alias("id"))
    found, blown = closure.impact(imports, seeds, depth, fuse)
    return seeds.unionByName(found.select(F.col("node").alias("id"))).distinct(), blown


def update_stats(changed: DataFrame) -> DataFrame:
    """One row with the number of files of each kind of change."""
    kinds = ("added", "deleted", "none", "cosmetic", "structural")
    return changed.agg(F.count("*").alias("files"), *[F.count_if(F.col("change") == k).alias(k) for k in kinds])
