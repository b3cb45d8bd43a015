"""Comparing a graph with what other tools found, and timings with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECALL_GATE, F1_WARNING = 0.98, 0.7
DRIFT, LEAST_MS = 0.10, 5.0


def precision_recall(predicted: DataFrame, truth: DataFrame, empty: str = "zero") -> DataFrame:
    """tp, n_predicted, n_truth, precision, recall, f1 of two frames with the same columns, as sets.

    empty: 'zero' makes a side without rows 0, both sides without rows 1;
    'one' is the same but for its f1 of 0 where only one side is empty.
    """
    keys = predicted.columns
    p = predicted.distinct().withColumn("__p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    both = p.join(t, keys, "full_outer")
    sums = both.agg(
        F.count_if(F.col("__p").isNotNull() & F.col("__t").isNotNull()).alias("tp"),
        F.count("__p").alias("n_predicted"),
        F.count("__t").alias("n_truth"),
    )
    return _scored(sums)


def _scored(sums: DataFrame) -> DataFrame:
    nothing = (F.col("n_predicted") == 0) & (F.col("n_truth") == 0)
    share = lambda n: F.when(nothing, 1.0).otherwise(F.coalesce(F.col("tp") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)))
    out = sums.withColumn("precision", share("n_predicted")).withColumn("recall", share("n_truth"))
    total = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / total, F.lit(0.0)))


def pooled(parts: DataFrame) -> DataFrame:
    """The same scores from summed tp, n_predicted and n_truth of many comparisons."""
    return _scored(parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_predicted", "n_truth")]))


def two_oracles(own: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """common, found, recall, missing, extra, passed: edges (source, target) against those both oracles have.

    extra edges are in neither oracle.  Without a common edge the gate fails.
    """
    key = ["source", "target"]
    own, first, second = (x.select(*key).distinct() for x in (own, first, second))
    all_of = (
        own.withColumn("o", F.lit(1))
        .join(first.withColumn("a", F.lit(1)), key, "full_outer")
        .join(second.withColumn("b", F.lit(1)), key, "full_outer")
    )
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    sums = all_of.agg(
        F.count_if(common).alias("common"),
        F.count_if(common & F.col("o").isNotNull()).alias("found"),
        F.count_if(common & F.col("o").isNull()).alias("missing"),
        F.count_if(F.col("o").isNotNull() & F.col("a").isNull() & F.col("b").isNull()).alias("extra"),
    )
    recall = F.coalesce(F.col("found") / F.nullif(F.col("common"), F.lit(0)), F.lit(0.0))
    return sums.withColumn("recall", recall).withColumn("passed", (F.col("common") > 0) & (recall >= RECALL_GATE))


def split_components(own: DataFrame, oracle: DataFrame) -> DataFrame:
    """Components of the oracle (node, component) whose nodes are in several of ours."""
    ours = own.select("node", F.col("component").alias("ours"))
    joined = oracle.select("node", F.col("component").alias("theirs")).join(ours, "node", "left")
    return joined.groupBy("theirs").agg(F.count_distinct("ours").alias("parts"), F.count("*").alias("n")).where("parts > 1")


def timing_summary(runs: DataFrame, group: str = "name", value: str = "ms") -> DataFrame:
    """name, n, min, median, mean, p90 (the value at the place n * 0.9, rounded down)."""
    s = F.array_sort(F.collect_list(value))
    out = runs.groupBy(group).agg(s.alias("s"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"))
    at = F.floor(F.size("s") * 0.9).cast("int")
    return out.select(
        group, F.size("s").cast("long").alias("n"), F.col("s")[0].alias("min"), "median", "mean", F.get("s", F.least(at, F.size("s") - 1)).alias("p90")
    )


def regressions(now: DataFrame, base: DataFrame) -> DataFrame:
    """name, change, failed, drifted: medians off by more than a tenth fail for hard ones of 5 ms or more;
    other node counts are a drift."""
    b = base.select("name", F.col("median").alias("was"), F.col("nodes").alias("nodes_was"), "hard")
    joined = now.select("name", "median", "nodes").join(b, "name")
    change = F.col("median") / F.nullif(F.col("was"), F.lit(0.0)) - 1
    return joined.select(
        "name",
        change.alias("change"),
        ((F.abs(change) > DRIFT) & F.col("hard") & (F.col("was") >= LEAST_MS)).alias("failed"),
        (F.col("nodes") != F.col("nodes_was")).alias("drifted"),
    )
