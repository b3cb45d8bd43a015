"""Modules from a graph: one for each unit of work, with tier, danger and where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import decompose, quality, scc
from graphloom.operators.graph import Graph
from graphloom.session import cut


class Refused(Exception):
    """Modules are under way, or too little could be read."""


def populate(graph: Graph, files: DataFrame, modules: DataFrame | None = None, budget: int | None = decompose.BUDGET) -> DataFrame:
    """The modules table of a graph's files.

    files: file (node id), tier, kind, danger, classified, size (bytes over
    four), footprint.  With a budget None units are the cycles and single files,
    and nothing is taken as classified.  Modules that are there must all be
    pending; those that no unit has any more go, the others keep their row's
    history elsewhere.
    """
    if modules is not None and not modules.where("status <> 'pending'").isEmpty():
        raise Refused("E005: modules are under way")
    report = quality.classification_report(files).first()
    if budget is not None and report["abort"]:
        raise Refused(f"E010: {report['read_failures']:.0%} of the files could not be read")
    nodes = graph.files().select("id")
    imports = graph.import_graph()
    groups = cut(scc.groups(scc.components(nodes, imports), imports))
    if budget is None:
        size = F.size("members")
        units = groups.select("members", F.when(F.col("is_cycle") & (size > 1), "cycle").alias("composite_kind"), "sprint")
    else:
        sizes = files.select(F.col("file").alias("id"), F.col("size").alias("self_size"), "footprint")
        plan = cut(decompose.plan_rows(groups, graph.raw_edges, sizes, budget))
        units = plan.select("members", F.when(F.col("kind").isin("cycle", "batch"), F.col("kind")).alias("composite_kind"), "sprint")
    units = units.withColumn("module", F.col("members")[0])
    rolled = quality.roll_up(files, units.select("module", F.explode("members").alias("file")))
    provenance = F.col("danger_provenance") if budget is not None else F.lit("unclassified")
    none = lambda kind: F.lit(None).cast(kind)
    return units.join(rolled, "module").select(
        "module", F.lit("pending").alias("status"), none("string").alias("substatus"), F.col("sprint").cast("int").alias("sprint"),
        none("string").alias("test_pass_rate"), none("int").alias("coverage"), F.lit(0).alias("known_differences"), "tier",
        none("string").alias("phase_a_version"), none("boolean").alias("phase_a_audit_passed"), none("array<string>").alias("blocked_by"),
        none("string").alias("pre_blocked_status"), F.col("members").alias("member_files"), "composite_kind",
        none("string").alias("decomposition_snapshot"), F.lit(False).alias("decomposition_frozen"), "danger", provenance.alias("danger_provenance"),
    )


def orphans(modules: DataFrame, fresh: DataFrame) -> DataFrame:
    """Modules that the fresh table no longer has."""
    return modules.join(fresh.select("module"), "module", "left_anti").select("module")


def tier_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("tier").agg(F.count("*").alias("n"))
