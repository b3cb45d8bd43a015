"""Schemas of the base tables (as DDL, which needs no session), value domains and transition tables.

The lists below are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = (
    "id string, node_type string, name string, file_path string, start_line int, end_line int, signature string, "
    "is_exported boolean, complexity string, is_async boolean, visibility string, is_abstract boolean, "
    "decorators array<string>, migration_status string, migration_priority int, rust_kind string, rust_path string, "
    "crate_name string"
)
EDGES = (
    "source string, target string, edge_type string, provenance string, weight double, sub_kind string, "
    "mapping_notes string, used_symbols array<string>"
)
FINGERPRINTS = "file_path string, content_hash string, structure_hash string, analyzed_at timestamp"
METADATA = "key string, value string"
MODULES = (
    "module string, status string, substatus string, sprint int, test_pass_rate string, coverage int, "
    "known_differences int, tier string, phase_a_version string, phase_a_audit_passed boolean, blocked_by array<string>, "
    "pre_blocked_status string, member_files array<string>, composite_kind string, decomposition_snapshot string, "
    "decomposition_frozen boolean, danger array<string>, danger_provenance string"
)
ATTEMPTS = "module string, seq int, ts timestamp, result string, retry_count int, checkpoint string"
STATE_HISTORY = "seq int, state string, entered_at timestamp, exited_at timestamp"
WARNINGS = "subject string, code string, detail string"

DOMAINS = {
    "node_type": (
        "file", "module", "package", "class", "interface", "function", "variable", "enum", "type_alias", "rust_target",
        "test_fixture", "community",
    ),
    "edge_type": ("imports", "exports", "calls", "extends", "uses_type", "maps_to", "tested_by", "contains"),
    "provenance": ("tree_sitter", "tool_assisted", "llm", "manual"),
    "sub_kind": ("implements", "constructor"),
    "visibility": ("public", "crate", "private"),
    "rust_kind": ("struct", "enum", "trait", "function", "module", "crate"),
    "complexity": ("simple", "moderate", "complex"),
    "project_state": ("init", "profile", "plan", "scaffold", "sprint_loop", "graduate"),
    "module_status": (
        "pending", "translating", "compile_fixing", "testing", "reviewing", "done", "paused", "blocked", "degrade_ffi",
        "degrade_manual", "degrade_skip",
    ),
    "tier": ("trivial", "standard", "full"),
    "composite_kind": ("cycle", "batch", "coupled_batch"),
    "danger": (
        "concurrency", "numeric_precision", "dynamic_reflection", "io_side_effect", "ffi", "shared_mutable_global",
    ),
    "danger_provenance": ("unclassified", "classified", "partially_classified"),
}

#: code, name, whether a retry may help
ERRORS = (
    ("E001", "graph_build_failed", False), ("E002", "cyclic_dependency", False), ("E003", "module_not_found", False),
    ("E004", "invalid_transition", False), ("E005", "precondition_failed", False), ("E006", "module_blocked", False),
    ("E007", "lock_conflict", False), ("E008", "schema_validation", False), ("E009", "file_not_found", False),
    ("E010", "parse_failed", False), ("E011", "database_error", True), ("E012", "config_error", False),
    ("E013", "timeout", True), ("E014", "io_error", True), ("E015", "not_implemented", False),
)

PROJECT_TRANSITIONS = tuple(zip(DOMAINS["project_state"], DOMAINS["project_state"][1:], strict=False))

BLOCKABLE = ("pending", "translating", "compile_fixing", "testing", "reviewing", "paused")
DEGRADED = ("degrade_ffi", "degrade_manual", "degrade_skip")
TERMINAL = ("done", *DEGRADED)
RUNNING = ("translating", "compile_fixing", "testing", "reviewing")
AGENT_DONE = "agent_done"
STOP_GATE = "awaiting_final_review"
CLEAN_SUBSTATUSES = (AGENT_DONE, STOP_GATE)

_STEPS = (
    ("pending", ("translating",)),
    ("translating", ("compile_fixing", "testing")),
    ("compile_fixing", ("testing", "paused")),
    ("testing", ("reviewing", "paused")),
    ("reviewing", ("done", "translating", "compile_fixing")),
    ("paused", ("translating", *DEGRADED)),
    ("degrade_ffi", ("translating",)),
    ("degrade_manual", ("translating",)),
    ("degrade_skip", ("translating",)),
)
MODULE_TRANSITIONS = tuple(
    [(a, b) for a, targets in _STEPS for b in targets]
    + [(s, "blocked") for s in BLOCKABLE]
    + [("blocked", s) for s in BLOCKABLE]
)


def module_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODULE_TRANSITIONS), "from_status string, to_status string")


def project_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROJECT_TRANSITIONS), "from_state string, to_state string")


def in_pairs(a, b, pairs) -> object:
    """Whether (a, b) is one of the pairs, as an expression: the tables above are small and fixed."""
    from pyspark.sql import functions as F

    return F.coalesce(F.concat_ws(">", a, b).isin([f"{x}>{y}" for x, y in pairs]) & a.isNotNull() & b.isNotNull(), F.lit(False))
