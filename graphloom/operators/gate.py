"""The review gate: red lines, policies, and what a decision follows from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.schemas import CLEAN_SUBSTATUSES, STOP_GATE

COVERAGE = 80
#: What an orchestrator must attest under any policy, and what each policy adds.
MUST_CHECK = (
    "l2_l3_differential_executable", "phase_b_new_paths_have_mdr", "public_api_unchanged", "error_semantics_unchanged",
    "concurrency_model_unchanged", "numeric_boundary_unchanged", "io_side_effects_unchanged", "coverage_not_below_source",
    "bug_replica_confirmed", "todo_port_zero",
)
POLICIES = {
    "batch_mechanical": ("exports_match", "content_hash_unchanged"),
    "headless_default": ("tests_passed",),
}


def required_attestations(policy: str) -> list[str]:
    return list(dict.fromkeys((*POLICIES[policy], *MUST_CHECK)))


def red_lines(coverage: int = COVERAGE) -> Column:
    """Codes of the reasons for which only a person may approve a module, in their order.

    A coverage that was not measured is below any threshold; a mechanical batch
    has none to measure.  An audit that was not recorded is not a failed one.
    """
    codes = F.array(
        F.when(F.size(F.coalesce("danger", F.array().cast("array<string>"))) > 0, "danger_non_empty"),
        F.when(F.col("danger_provenance") != "classified", "danger_provenance_untrusted"),
        F.when(F.col("known_differences") > 0, "known_differences_present"),
        F.when(~F.col("substatus").isin(*CLEAN_SUBSTATUSES), "substatus_not_clean"),
        F.when(F.col("phase_a_audit_passed") == False, "phase_a_audit_failed"),  # noqa: E712
        F.when(
            ~F.col("composite_kind").eqNullSafe("batch") & (F.col("coverage").isNull() | (F.col("coverage") < coverage)),
            "coverage_below_threshold",
        ),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def rejections(policy: str, enabled: list[str]) -> Column:
    """Why a policy may not approve a module; an empty array if it may."""
    found = [F.lit(None if policy in enabled else "not_enabled").cast("string")]
    if policy == "batch_mechanical":
        found.append(F.when(~F.col("composite_kind").eqNullSafe("batch"), "composite_kind_not_batch"))
    else:
        rate = scalar.pass_rate(F.col("test_pass_rate"))
        found.append(
            F.when(F.col("test_pass_rate").isNull(), "test_pass_rate_missing")
            .when(rate.isNull(), "test_pass_rate_unreadable")
            .when(rate < 1, "test_pass_rate_below_one")
        )
        found.append(F.when(~F.col("phase_a_audit_passed").eqNullSafe(True), "phase_a_audit_not_passed"))
    found.append(F.when(F.col("substatus") == STOP_GATE, "awaiting_final_review"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def judge(modules: DataFrame, enabled: list[str], coverage: int = COVERAGE) -> DataFrame:
    """modules with mandatory_reasons, rejected_<policy> and decision."""
    out = modules.withColumn("mandatory_reasons", red_lines(coverage))
    for policy in POLICIES:
        out = out.withColumn(f"rejected_{policy}", rejections(policy, enabled))
    eligible = F.lit(False)
    for policy in POLICIES:
        eligible = eligible | (F.size(f"rejected_{policy}") == 0)
    return out.withColumn(
        "decision",
        F.when(F.size("mandatory_reasons") > 0, "mandatory_manual").when(eligible, "policy_eligible").otherwise("manual_required"),
    )


def unknown_policies(enabled: list[str]) -> list[str]:
    return sorted(set(enabled) - set(POLICIES))


def policy_refusal(policy: str, attested: list[str], enabled: list[str]) -> Column:
    """The code for which a policy's approval is refused on judged modules, NULL if it is not."""
    if policy not in POLICIES:
        return F.lit("unknown_policy")
    if policy not in enabled:
        return F.lit("policy_not_enabled")
    missing = [a for a in required_attestations(policy) if a not in attested]
    return (
        F.when(F.col("decision") == "mandatory_manual", "mandatory_manual")
        .when(F.size(f"rejected_{policy}") > 0, "policy_conditions_unmet")
        .when(F.lit(bool(missing)), "missing_attestations")
    )


def evidence(files: DataFrame, modules: DataFrame) -> DataFrame:
    """module, path, kind: the artefacts that carry a module's name.

    A file belongs to the module with the longest name that it starts with,
    followed by a dash; names are the display names with / as -.
    """
    named = modules.select("module", F.replace(scalar.display_name(F.col("module")), F.lit("/"), F.lit("-")).alias("stem"))
    base = files.select("path", F.element_at(F.split("path", "/"), -1).alias("base"))
    # every beginning of the name up to a dash is a key: an equi-join in place of a prefix join
    cuts = base.select("path", "base", F.explode(F.sequence(F.lit(1), F.length("base"))).alias("at"))
    cuts = cuts.where(F.substring(F.col("base"), F.col("at"), F.lit(1)) == "-")
    keyed = cuts.select("path", "base", F.substring(F.col("base"), F.lit(1), F.col("at") - 1).alias("stem"))
    found = keyed.join(named, "stem")
    longest = found.groupBy("path").agg(F.max(F.length("stem")).alias("n"))
    best = found.join(longest, "path").where(F.length("stem") == F.col("n"))
    rest = F.substring(F.col("base"), F.col("n") + 2, F.length("base"))
    return best.select("module", "path", scalar.evidence_kind(rest).alias("kind")).where("kind is not null")


def ambiguous_siblings(modules: DataFrame) -> DataFrame:
    """module, sibling: other modules whose display name ends in the same last part."""
    last = modules.select("module", F.element_at(F.split(scalar.display_name(F.col("module")), "/"), -1).alias("last"))
    other = last.select(F.col("module").alias("sibling"), "last")
    return last.join(other, "last").where("module <> sibling").select("module", "sibling")
