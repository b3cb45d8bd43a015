"""From analysed files to a graph: one Arrow pass, then joins."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lang import base
from graphloom.operators import cdc, resolve
from graphloom.operators.graph import Graph
from graphloom.session import cut


@dataclass(frozen=True)
class Build:
    graph: Graph
    fingerprints: DataFrame
    warnings: DataFrame
    analyses: DataFrame | None = None

    def store(self) -> cdc.Store:
        return cdc.Store(self.graph, self.fingerprints, analyses=self.analyses)


def _rows(analyses: DataFrame, column: str) -> DataFrame:
    return analyses.select(F.col("path").alias("file"), F.explode(column).alias("x")).select("file", "x.*")


def _resolved(imports: DataFrame, files: DataFrame, language: str, module: str) -> DataFrame:
    s = imports.select("file", "specifier").distinct()
    paths = files.select("path")
    if language == "typescript":
        return resolve.resolve_relative(s, paths)
    if language == "python":
        return resolve.resolve_python(s, paths)
    return resolve.resolve_go(s, paths, module)


def _content_hash() -> Column:
    return F.sha2(F.col("content").cast("binary"), 256)


def build(files: DataFrame, module: str = "", known: DataFrame | None = None) -> Build:
    """Graph and fingerprints of files (path, language, content); module is the Go module's path.

    Files that ``known`` has an analysis of are not parsed.  Analyses of all files are
    kept together, so a barrel is passed through whether or not it changed.
    """
    if known is None:
        analyses = cut(base.analyze(files))
    else:
        analyses = cut(known.unionByName(base.analyze(files.join(known.select("path"), "path", "left_anti"))))
    languages = sorted(r["language"] for r in files.select("language").distinct().collect())
    nodes = analyses.select(F.explode("nodes").alias("n")).select("n.*")
    local = analyses.select(F.explode("edges").alias("e")).select("e.*")
    local = resolve.fix_extends(local, nodes)
    imports, calls, bindings = (_rows(analyses, c) for c in ("imports", "calls", "bindings"))
    parts = []
    for language in languages:
        own = files.where(F.col("language") == language)
        mine = imports.join(own.select(F.col("path").alias("file")), "file", "left_semi")
        parts.append(_resolved(mine, own, language, module))
    resolved = parts[0]
    for p in parts[1:]:
        resolved = resolved.unionByName(p)
    resolved = cut(resolved)
    hit = imports.join(resolved, ["file", "specifier"])
    named = hit.where("reexport and name is not null and symbol_kind = 'named'").select(
        "file", F.coalesce("alias", "name").alias("symbol"), "target", F.col("name").alias("original")
    )
    wildcards = hit.where("reexport and name is null").select("file", "seq", "target")
    own = nodes.where("is_exported").select(F.col("file_path").alias("file"), F.col("name").alias("symbol"))
    asked = hit.where("name is not null").select(F.col("target").alias("file"), F.col("name").alias("symbol"))
    origins = cut(resolve.reexport_origins(own, named, wildcards, asked))
    ident = lambda c: F.concat(F.lit("file:"), F.col(c))
    none = F.lit(None).cast("string")
    used = resolve.import_usage(imports, resolved, origins).where("source <> target").select(
        ident("source").alias("source"), ident("target").alias("target"), F.lit("imports").alias("edge_type"), none.alias("sub_kind"), "used_symbols"
    )
    aliases = resolve.import_aliases(imports, resolved, origins)
    called = resolve.call_edges(calls, nodes, aliases, bindings).select(
        ident("file").alias("source"), "target", F.lit("calls").alias("edge_type"), "sub_kind", F.lit(None).cast("array<string>").alias("used_symbols")
    )
    edges = local.withColumn("used_symbols", F.lit(None).cast("array<string>")).unionByName(used).unionByName(called)
    edges = edges.withColumn("provenance", F.lit("tree_sitter")).withColumn("weight", F.lit(1.0))
    structure = cdc.structure_hash(
        nodes,
        imports.groupBy("file", "specifier", "kind", "reexport").agg(
            F.collect_list(F.struct(F.coalesce("name", F.lit("")).alias("name"), "alias")).alias("symbols")
        ).withColumnsRenamed({"file": "file_path", "specifier": "module_path"}),
        analyses.select(F.col("path").alias("file_path"), F.explode("exports").alias("name")),
        calls.withColumnRenamed("file", "file_path"),
    )
    content = files.select(F.col("path").alias("file_path"), _content_hash().alias("content_hash"))
    prints = content.join(structure, "file_path", "left").withColumn("structure_hash", F.coalesce("structure_hash", "content_hash"))
    warnings = analyses.where("warning is not null").select(F.col("path").alias("subject"), "warning")
    return Build(Graph(nodes, edges).with_integrity(), prints, warnings, analyses)


def classify(analyses: DataFrame) -> DataFrame:
    """file, tier, kind, danger, classified of analysed files."""
    return analyses.select(F.concat(F.lit("file:"), "path").alias("file"), "tier", F.col("file_kind").alias("kind"), "danger", "classified")


def unchanged(old: cdc.Store, files: DataFrame) -> DataFrame | None:
    """The stored analyses of files whose path, language and content are as they were; None if the store has none."""
    if old.analyses is None:
        return None
    now = files.select("path", "language", _content_hash().alias("content_hash"))
    same = now.join(old.fingerprints.withColumnRenamed("file_path", "path"), ["path", "content_hash"], "left_semi")
    return old.analyses.join(same.select("path", "language"), ["path", "language"], "left_semi").select(*old.analyses.columns)


def incremental(old: cdc.Store, files: DataFrame, module: str = "", depth: int = 3, fuse: int = 50) -> tuple[cdc.Store, DataFrame, bool]:
    """The store after a change of files, what changed, and whether the fuse blew.

    Files whose content hash is the same keep their stored analysis, so only what is new or
    differs is parsed; without stored analyses all are.  Edges are resolved
    against all files, so the result is that of a full build.
    """
    fresh = build(files, module, unchanged(old, files))
    changed = cut(cdc.changes(old.fingerprints, fresh.fingerprints))
    imports = old.graph.raw_edges.where("edge_type = 'imports'").select("source", "target")
    _, blown = cdc.affected(changed, imports, depth, fuse)
    gone = changed.where("change = 'deleted'").select("file_path")

    store = old.without(gone).splice(fresh.graph, fresh.fingerprints, changed.where("change <> 'deleted'").select("file_path"), blown)
    return replace(store, analyses=fresh.analyses), changed, blown
