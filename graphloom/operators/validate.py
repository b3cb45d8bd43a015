"""Checks of a state, its history, its configuration and its rule versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import state
from graphloom.operators.graph import first_by


def history_steps(history: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """history with the label before it and whether the step is legal; the first has no step."""
    w = W.partitionBy(*key).orderBy(*order)
    before = F.lag(label).over(w)
    legal = before.isNull() | state.can_transition_project(before, F.col(label))
    return history.withColumn("before", before).withColumn("legal", legal)


def history_exits(history: DataFrame, key: list[str], order: list[str], entered: str) -> DataFrame:
    """history with exited_at, the time at which the next entry begins; the last is open."""
    return history.withColumn("exited_at", F.lead(entered).over(W.partitionBy(*key).orderBy(*order)))


def history_ends(history: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """key, first, last, n of each history."""
    at = F.struct(*order)
    return history.groupBy(*key).agg(F.min_by(label, at).alias("first"), F.max_by(label, at).alias("last"), F.count("*").alias("n"))


def history_problems(history: DataFrame, current: str) -> DataFrame:
    """code of what is wrong with one state history (seq, state, entered_at, exited_at)."""
    ends = history.agg(
        F.min_by("state", "seq").alias("first"),
        F.max_by("state", "seq").alias("last"),
        F.max_by(F.col("exited_at").isNull(), "seq").alias("open_last"),
        F.count_if(F.col("exited_at").isNull()).alias("open"),
        F.count("*").alias("n"),
    )
    illegal = history_steps(history.withColumn("__k", F.lit(1)), ["__k"], ["seq"], "state").agg(F.count_if(~F.col("legal")).alias("illegal"))
    one = ends.withColumn("k", F.lit(1)).join(illegal.withColumn("k", F.lit(1)), "k")
    found = F.array(
        F.when(F.col("n") == 0, "history_empty"),
        F.when(F.col("first") != "init", "first_not_init"),
        F.when(F.col("last") != current, "last_not_current"),
        F.when(~F.col("open_last"), "last_closed"),
        F.when(F.col("open") - F.col("open_last").cast("int") > 0, "earlier_entry_open"),
        F.when(F.col("illegal") > 0, "illegal_step"),
    )
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("code"))


def approved(attempts: DataFrame) -> DataFrame:
    """Modules with an approval in their log, by a person or by a policy."""
    said = F.col("result").startswith("approved:human") | F.col("result").startswith("auto_approved_by_policy:")
    return attempts.where(said).select("module").distinct()


def done_without_approval(modules: DataFrame, attempts: DataFrame) -> DataFrame:
    return modules.where("status = 'done'").select("module").join(approved(attempts), "module", "left_anti")


def double_members(modules: DataFrame) -> DataFrame:
    """Files that more than one module lists."""
    own = modules.select("module", F.explode("member_files").alias("file")).distinct()
    return own.groupBy("file").agg(F.array_sort(F.collect_list("module")).alias("modules")).where(F.size("modules") > 1)


def validate_state(modules: DataFrame, attempts: DataFrame, history: DataFrame, current: str, version: str = "1.0.0", own: str = "1.0.0") -> DataFrame:
    """severity, code, subject of everything that is wrong."""
    spark = modules.sparkSession

    def of(df: DataFrame, severity: str, code: str | Column, subject: Column) -> DataFrame:
        code = F.lit(code) if isinstance(code, str) else code
        return df.select(F.lit(severity).alias("severity"), code.alias("code"), subject.cast("string").alias("subject"))

    refs = state.references(modules)
    blocked = state.blocked_check(modules)
    cycles = state.blocked_cycles(modules)
    same = spark.createDataFrame([(version, own)], "a string, b string").where(~scalar.same_major(F.col("a"), F.col("b")))
    parts = [
        of(history_problems(history, current), "error", F.col("code"), F.lit(current)),
        of(same, "error", "schema_version", F.col("a")),
        of(done_without_approval(modules, attempts), "warning", "done_without_approval", F.col("module")),
        of(double_members(modules), "warning", "member_of_several", F.col("file")),
        of(refs.where("resolution = 'missing'").select("module", "ref").distinct(), "warning", "ghost_reference", F.concat_ws("→", "module", "ref")),
        of(refs.where("resolution = 'ambiguous'"), "warning", "ambiguous_reference", F.concat_ws("→", "module", "ref")),
        of(blocked.where("ready"), "warning", "blocked_but_ready", F.col("module")),
        of(cycles, "error", "blocked_cycle", F.array_join("members", ",")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with duplicate: whether the key was there before, by the order."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("duplicate", F.row_number().over(w) > 1)


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; an aggregate that combines before the shuffle."""
    down = df.withColumn("__down", -F.col(version))
    return first_by(down, key, ["__down"]).drop("__down")


def rule_versions(registry: DataFrame, templates: DataFrame) -> DataFrame:
    """language, rule, issue: registry (rule, version) against templates (language, rule, version).

    missing: a template lacks a rule; mismatch: it has another version; unknown:
    it has a rule that the registry lacks.
    """
    # every language must have every rule of the registry, which is a short list
    listed = registry.agg(F.collect_set(F.struct("rule", F.col("version").alias("want"))).alias("listed"), F.lit(1).alias("k"))
    languages = templates.select("language").distinct().withColumn("k", F.lit(1))
    want = languages.join(listed, "k").select("language", F.explode("listed").alias("r")).select("language", "r.*")
    both = want.join(templates.select("language", "rule", F.col("version").alias("have")), ["language", "rule"], "full_outer")
    issue = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("have"), "mismatch")
    )
    return both.withColumn("issue", issue).where("issue is not null").select("language", "rule", "issue", "want", "have")


def front_matter_rules(templates: DataFrame) -> DataFrame:
    """language, rule, version of texts (language, content) whose front matter has rule_versions: RULE-1:2, RULE-3:1."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---", 1)
    listed = F.regexp_extract(head, r"(?m)^rule_versions?:[ \t]*\[?([^\n\]]*)\]?[ \t]*$", 1)
    item = F.explode(F.split(listed, ","))
    rows = templates.select("language", item.alias("item")).select("language", F.regexp_replace(F.trim("item"), "[\"']", "").alias("item"))
    return rows.select(
        "language",
        F.regexp_extract("item", r"^(RULE-\d+):", 1).alias("rule"),
        F.regexp_extract("item", r"^RULE-\d+:\s*([^\s]+)$", 1).alias("version"),
    ).where("rule <> '' and version <> ''")


#: What a configuration may hold: name, least, most.
LIMITS = (
    ("coverage_threshold", 0, 100),
    ("max_retries_per_step", 0, 10),
    ("stall_timeout_secs", 1, 86_400),
    ("decompose_budget", 1, 10_000_000),
)


def config_problems(config: dict) -> list[str]:
    out = [
        f"{name} is {config[name]}, not within {least} and {most}"
        for name, least, most in LIMITS
        if name in config and not least <= config[name] <= most
    ]
    return out + [f"source root {r!r} contains target root {config['target_root']!r}" for r in [config.get("source_root")] if r and roots_overlap(r, config.get("target_root"))]


def roots_overlap(a: str | None, b: str | None) -> bool:
    if not a or not b:
        return False
    a, b = a.rstrip("/") + "/", b.rstrip("/") + "/"
    return a.startswith(b) or b.startswith(a)


TIERS = ("trivial", "standard", "full")


def run_rules(rules: list[tuple[str, str, object]], tier: str) -> list[tuple[str, str, list[str]]]:
    """(name, tier, problems) of the rules of all tiers up to one; a rule is (name, tier, callable that lists problems)."""
    upto = TIERS.index(tier)
    return [(name, own, list(check())) for name, own, check in rules if TIERS.index(own) <= upto]
