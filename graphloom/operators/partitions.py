"""Comparing two partitions of the same things, and how pure a group is.

All measures come from one contingency table, which is an aggregate; nothing
reads the members a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: how many things have each pair of labels."""
    return labelled.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def nmi(table: DataFrame) -> DataFrame:
    """nmi: twice the mutual information over the sum of the entropies, in 0 to 1; 1 if both are 0."""
    rows = table.groupBy("a").agg(F.sum("n").alias("na"))
    columns = table.groupBy("b").agg(F.sum("n").alias("nb"))
    cells = table.alias("t").join(rows.alias("r"), F.col("t.a").eqNullSafe(F.col("r.a"))).join(
        columns.alias("c"), F.col("t.b").eqNullSafe(F.col("c.b"))
    )
    # n ln(n N / (na nb)) / N, with N taken out of the logarithm's sum
    part = cells.agg(
        F.sum(F.col("n") * F.log(F.col("n").cast("double") / (F.col("na").cast("double") * F.col("nb")))).alias("s"), F.sum("n").alias("n")
    )
    ha = rows.agg(F.sum(F.col("na") * F.log(F.col("na").cast("double"))).alias("s"))
    hb = columns.agg(F.sum(F.col("nb") * F.log(F.col("nb").cast("double"))).alias("s"))
    one = (
        part.select(F.col("s").alias("sab"), "n", F.lit(1).alias("k"))
        .join(ha.select(F.col("s").alias("sa"), F.lit(1).alias("k")), "k")
        .join(hb.select(F.col("s").alias("sb"), F.lit(1).alias("k")), "k")
    )
    n = F.col("n").cast("double")
    mi = F.col("sab") / n + F.log(n)
    both = (F.log(n) - F.col("sa") / n) + (F.log(n) - F.col("sb") / n)
    found = F.least(F.greatest(2 * mi / F.nullif(both, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return one.select(F.when(F.coalesce(F.abs(both) < 1e-15, F.lit(True)), 1.0).otherwise(found).alias("nmi"))


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("double")


def ari(table: DataFrame) -> DataFrame:
    """ari: the adjusted Rand index; 1 for fewer than two things."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"), F.lit(1).alias("k"))
    rows = table.groupBy("a").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("pa"), F.lit(1).alias("k"))
    columns = table.groupBy("b").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("pb"), F.lit(1).alias("k"))
    one = cells.join(rows, "k").join(columns, "k")
    expected = F.col("pa") * F.col("pb") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    most = (F.col("pa") + F.col("pb")) / 2
    found = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, 1.0)
        .when(F.abs(most - expected) < 1e-15, F.when(F.abs(F.col("both") - expected) < 1e-15, 1.0).otherwise(0.0))
        .otherwise((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0)))
    )
    return one.select(found.alias("ari"))


def purity(labelled: DataFrame, group: str, label: str) -> DataFrame:
    """group, primary (its most frequent label, the smallest of equals), purity, n."""
    counts = labelled.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = counts.groupBy("group").agg(F.max(F.col("n")).alias("top"), F.sum("n").alias("n"))
    named = (
        counts.withColumnRenamed("n", "own")
        .join(best, "group")
        .where("own = top")
        .groupBy("group", "top", "n")
        .agg(F.min("label").alias("primary"))
    )
    return named.select("group", "primary", (F.col("top") / F.col("n")).alias("purity"), "n")
