"""Graphs as JSON, DOT and Mermaid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar


def _quoted(c: str):
    return F.concat(F.lit('"'), scalar.quote_dot(F.col(c)), F.lit('"'))


def dot_edges(edges: DataFrame) -> DataFrame:
    """line: a DOT statement for each edge."""
    return edges.select(
        F.concat(F.lit("  "), _quoted("source"), F.lit(" -> "), _quoted("target"), F.lit(" [label="), _quoted("edge_type"), F.lit("];")).alias("line")
    )


def dot_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat(F.lit("  "), _quoted("id"), F.lit(" [label="), _quoted("name"), F.lit("];")).alias("line"))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    ident = lambda c: scalar.mermaid_id(F.col(c))
    return edges.select(F.concat(F.lit("  "), ident("source"), F.lit(" -->|"), F.col("edge_type"), F.lit("| "), ident("target")).alias("line"))


def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    label = F.replace(F.col("name"), F.lit('"'), F.lit("#quot;"))
    return nodes.select(F.concat(F.lit("  "), scalar.mermaid_id(F.col("id")), F.lit('["'), label, F.lit('"]')).alias("line"))


def mermaid_collisions(nodes: DataFrame) -> DataFrame:
    """ids that different nodes share once they are written for Mermaid."""
    keyed = nodes.select(scalar.mermaid_id(F.col("id")).alias("mermaid_id"), "id").distinct()
    return keyed.groupBy("mermaid_id").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge) and json of each row."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", F.col("node_type").alias("type"), "name", "file_path", "is_exported")).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", F.col("edge_type").alias("type"), "weight", "sub_kind")).alias("json"))
    return n.unionByName(e)


def document(header: str, lines: list[DataFrame], footer: str = "") -> str:
    """The whole text of a graph that is to be drawn; drawings are small."""
    body = [r["line"] for df in lines for r in df.orderBy("line").collect()]
    return "\n".join([header, *body, *([footer] if footer else [])]) + "\n"


def dot(nodes: DataFrame, edges: DataFrame) -> str:
    return document("digraph source {", [dot_nodes(nodes), dot_edges(edges)], "}")


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    return document("flowchart TD", [mermaid_nodes(nodes), mermaid_edges(edges)])
