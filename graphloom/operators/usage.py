"""Which exported symbols a file uses of its dependencies, and what reading them costs.

``used_symbols`` is NULL when everything is used.  A union is therefore NULL as
soon as one part is, which an ordinary set union is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar


def absorbing_union(used: str | Column) -> Column:
    """Sorted distinct union of arrays, NULL if any of them is."""
    used = F.col(used) if isinstance(used, str) else used
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(used))))
    return F.when(F.count(F.lit(1)) == F.count(used), every)


def imported_symbols(imports: DataFrame) -> DataFrame:
    """source, target, used_symbols: one row for each pair of files."""
    return imports.groupBy("source", "target").agg(absorbing_union("used_symbols").alias("used_symbols"))


def used_interfaces(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target and the exported symbols of target that source uses, with tokens.

    target is a file node's id; its symbols are found by their file_path.
    """
    pairs = imported_symbols(imports).withColumn("file_path", scalar.node_path(F.col("target")))
    own = nodes.where("is_exported and node_type <> 'file'").select(
        "file_path", "name", "node_type", scalar.token_estimate(F.coalesce("signature", "name")).alias("tokens")
    )
    joined = pairs.join(own, "file_path")
    return joined.where(F.col("used_symbols").isNull() | F.array_contains("used_symbols", F.col("name"))).select(
        "source", "target", "name", "node_type", "tokens"
    )


def dependency_tokens(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, tokens: the signatures a file has to read of all that it imports."""
    return used_interfaces(imports, nodes).groupBy("source").agg(F.sum("tokens").alias("tokens"))


def group_interfaces(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, member, symbols, tokens: the exported interface of every member of a group of file ids."""
    own = nodes.where("is_exported and node_type <> 'file'").select(
        "file_path", scalar.token_estimate(F.coalesce("signature", "name")).alias("tokens")
    )
    sums = own.groupBy("file_path").agg(F.count("*").alias("symbols"), F.sum("tokens").alias("tokens"))
    keyed = members.withColumn("file_path", scalar.node_path(F.col("member")))
    return keyed.join(sums, "file_path", "left").select(
        "group", "member", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
