"""Coverage, quality and line statistics of a migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators.state import is_degraded

DONE_LEAST, FFI_LEAST = 80.0, 60.0
#: Healthy and alert limits of the ratios, and penalties per item.
LOC_RATIO, FUNCTION_RATIO, CYCLOMATIC_RATIO = (2.0, 3.0), (1.3, 2.0), (1.2, 1.5)
CLIPPY_PENALTY, UNSAFE_PENALTY = 10.0, 15.0


def coverage_stats(modules: DataFrame) -> DataFrame:
    """total, done, in_progress, pending, degraded, completion (percent; 0 if there are no modules)."""
    s = F.col("status")
    sums = modules.agg(
        F.count("*").alias("total"),
        F.count_if(s == "done").alias("done"),
        F.count_if(is_degraded(s)).alias("degraded"),
        F.count_if(s == "pending").alias("pending"),
        F.count_if(~s.isin("done", "pending") & ~is_degraded(s)).alias("in_progress"),
    )
    share = (F.col("done") + F.col("degraded")) / F.nullif(F.col("total"), F.lit(0)) * 100
    return sums.withColumn("completion", F.coalesce(share, F.lit(0.0)))


def score(modules: DataFrame) -> DataFrame:
    """Per module: compile_pass, rate, behavior_coverage, final_score (NULL with fewer than two indicators)."""
    rate = scalar.pass_rate(F.col("test_pass_rate"))
    passed = scalar.compile_pass(F.col("status"))
    extra = {c: F.col(c) if c in modules.columns else F.lit(None) for c in ("loc_ratio", "function_ratio", "cyclomatic_ratio", "clippy_warnings", "unsafe_blocks")}
    indicators = [
        scalar.normalize_pass(passed),
        scalar.normalize_share(rate),
        scalar.normalize_ratio(extra["loc_ratio"].cast("double"), *LOC_RATIO),
        scalar.normalize_ratio(extra["function_ratio"].cast("double"), *FUNCTION_RATIO),
        scalar.normalize_count(extra["clippy_warnings"].cast("double"), CLIPPY_PENALTY),
        scalar.normalize_count(extra["unsafe_blocks"].cast("double"), UNSAFE_PENALTY),
        scalar.normalize_ratio(extra["cyclomatic_ratio"].cast("double"), *CYCLOMATIC_RATIO),
    ]
    return modules.select(
        "module",
        "status",
        "known_differences",
        passed.alias("compile_pass"),
        rate.alias("rate"),
        scalar.behavior_coverage(rate, F.col("known_differences")).alias("behavior_coverage"),
        scalar.deterministic_average(*indicators).alias("final_score"),
    )


def quality_report(modules: DataFrame) -> DataFrame:
    """One row: totals, degrade_rate, avg_final_score, data_completeness and the modules below their threshold."""
    least = F.when(F.col("status") == "degrade_ffi", FFI_LEAST).otherwise(DONE_LEAST)
    low = F.filter(F.array_sort(F.collect_list(F.when(F.col("final_score") < least, F.col("module")))), lambda x: x.isNotNull())
    n = F.nullif(F.count("*"), F.lit(0))
    return score(modules).agg(
        F.count("*").alias("total_modules"),
        F.count_if(F.col("status") == "done").alias("done_modules"),
        F.count_if(is_degraded(F.col("status"))).alias("degraded_modules"),
        F.coalesce(F.count_if(is_degraded(F.col("status"))) / n, F.lit(0.0)).alias("degrade_rate"),
        F.avg("final_score").alias("avg_final_score"),
        F.coalesce(F.count("final_score") / n, F.lit(0.0)).alias("data_completeness"),
        low.alias("below_threshold"),
    )


def roll_up(files: DataFrame, members: DataFrame) -> DataFrame:
    """module, tier (the highest of its files), danger (distinct, sorted), provenance.

    files: file, tier, danger, classified; members: module, file.  One file that
    could not be classified makes the module partly classified.
    """
    rank = F.when(F.col("tier") == "full", 3).when(F.col("tier") == "standard", 2).when(F.col("tier") == "trivial", 1)
    joined = members.join(files, "file", "left")
    sums = joined.groupBy("module").agg(
        F.max_by("tier", rank).alias("tier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("danger")))).alias("danger"),
        F.bool_and(F.coalesce("classified", F.lit(False))).alias("every"),
    )
    provenance = F.when(F.col("every"), "classified").otherwise("partially_classified")
    return sums.select("module", "tier", "danger", provenance.alias("danger_provenance"))


def classification_report(files: DataFrame) -> DataFrame:
    """Files by kind, those with a danger, and the share that could not be read (half or more aborts)."""
    n = F.nullif(F.count("*"), F.lit(0))
    failed = F.coalesce(F.count_if(~F.col("classified")) / n, F.lit(0.0))
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.size("danger") > 0).alias("dangerous"),
        F.count_if(F.col("kind") != "normal").alias("mechanical"),
        failed.alias("read_failures"),
        (failed >= 0.5).alias("abort"),
    )


# --- lines -----------------------------------------------------------------


COMMENTS = {"python": r"^\s*#", "go": r"^\s*(//|/\*|\*)", "typescript": r"^\s*(//|/\*|\*)", "rust": r"^\s*(//|/\*|\*)"}


def lines_by_file(files: DataFrame, exclude_tests: bool = False) -> DataFrame:
    """path, language, code, comments, blanks of each (path, language, content)."""
    if exclude_tests:
        files = files.where(~scalar.is_test_file(F.col("path")))
    comment = F.lit("^\\s*(//|#)")
    for language, pattern in COMMENTS.items():
        comment = F.when(F.col("language") == language, pattern).otherwise(comment)
    text = F.regexp_replace("content", "\n$", "")
    base = files.select(
        "path", "language", F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")).alias("lines"), comment.alias("comment")
    )
    blank = F.size(F.filter("lines", lambda x: F.trim(x) == ""))
    noted = F.size(F.filter("lines", lambda x: (F.trim(x) != "") & F.regexp_like(x, F.col("comment"))))
    return base.select(
        "path",
        "language",
        (F.size("lines") - blank - noted).cast("long").alias("code"),
        noted.cast("long").alias("comments"),
        blank.cast("long").alias("blanks"),
    )


def loc_report(lines: DataFrame) -> DataFrame:
    """language (NULL for all of them), files, code, comments, blanks."""
    return lines.rollup("language").agg(
        F.count("*").alias("files"), F.sum("code").alias("code"), F.sum("comments").alias("comments"), F.sum("blanks").alias("blanks")
    )


def primary_language(lines: DataFrame) -> DataFrame:
    """The language with most lines, the first by name of equals."""
    total = lines.groupBy("language").agg(F.sum(F.col("code") + F.col("comments") + F.col("blanks")).alias("lines"))
    return total.orderBy(F.desc("lines"), "language").limit(1)


def project_ratio(source: DataFrame, target: DataFrame) -> DataFrame:
    """loc_ratio: code of the target over code of the source, tests left out; NULL if there is no source."""
    s = lines_by_file(source, True).agg(F.coalesce(F.sum("code"), F.lit(0)).alias("s"), F.lit(1).alias("k"))
    t = lines_by_file(target, True).agg(F.coalesce(F.sum("code"), F.lit(0)).alias("t"), F.lit(1).alias("k"))
    return s.join(t, "k").select(scalar.ratio(F.col("t"), F.col("s")).alias("loc_ratio"))


def structure_ratios(pairs: DataFrame) -> DataFrame:
    """pairs (code, functions, nesting of both sides) with the three ratios; nothing to divide by is NULL."""
    out = pairs
    for m in ("code", "functions", "nesting"):
        out = out.withColumn(f"{m}_ratio", scalar.ratio(F.col(f"target_{m}"), F.col(f"source_{m}")))
    return out


def cycle_break_point(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle, node: the member with the fewest exports, the first of equals."""
    exports = edges.where("edge_type = 'exports'").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("exports"))
    each = cycles.select(F.col("members")[0].alias("cycle"), F.posexplode("members").alias("place", "node"))
    joined = each.join(exports, "node", "left").withColumn("exports", F.coalesce("exports", F.lit(0)))
    return joined.groupBy("cycle").agg(F.min_by("node", F.struct("exports", "place")).alias("node"))
