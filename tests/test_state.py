import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import gate, quality, state, validate
from graphloom.schemas import DOMAINS, MODULE_TRANSITIONS, MODULES

STATUSES = DOMAINS["module_status"]
#: from -> targets, written out
MATRIX = {
    "pending": {"translating", "blocked"},
    "translating": {"compile_fixing", "testing", "blocked"},
    "compile_fixing": {"testing", "paused", "blocked"},
    "testing": {"reviewing", "paused", "blocked"},
    "reviewing": {"done", "blocked", "translating", "compile_fixing"},
    "paused": {"translating", "degrade_ffi", "degrade_manual", "degrade_skip", "blocked"},
    "degrade_ffi": {"translating"},
    "degrade_manual": {"translating"},
    "degrade_skip": {"translating"},
    "done": set(),
    "blocked": {"pending", "translating", "compile_fixing", "testing", "reviewing", "paused"},
}


def module(name, **given):
    base = {
        "module": name, "status": "pending", "known_differences": 0, "decomposition_frozen": False, "danger": [],
        "danger_provenance": "classified",
    }
    return base | given


def frame(spark, *modules):
    columns = [c.split()[0] for c in MODULES.split(", ")]
    return spark.createDataFrame([tuple(m.get(c) for c in columns) for m in modules], MODULES)


def commands(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


MOVE = "name string, to_status string, substatus string, reason string, force boolean"


def test_matrix():
    assert {(a, b) for a, bs in MATRIX.items() for b in bs} == set(MODULE_TRANSITIONS)


def test_every_transition(spark):
    pairs = list(itertools.product(STATUSES, STATUSES))
    m = frame(spark, *[module(f"{a}>{b}", status=a, test_pass_rate="90%", coverage=5, substatus="x") for a, b in pairs])
    change = state.transition(m, commands(spark, MOVE, *[(f"{a}>{b}", b, None, "why", False) for a, b in pairs]))
    codes = {r.module: r.code for r in change.outcomes.collect()}
    after = {r.module: r for r in change.modules.collect()}
    audits = {r.module for r in change.audit.collect()}
    for a, b in pairs:
        key, legal = f"{a}>{b}", b in MATRIX[a]
        want = "invalid_transition" if not legal else "approval_required" if b == "done" else "force_required" if a.startswith("degrade") else "ok"
        assert codes[key] == want
        assert after[key].status == (b if want == "ok" else a) and (key in audits) == (want == "ok")
    assert after["testing>blocked"].pre_blocked_status == "testing"
    back = after["reviewing>translating"]
    assert (back.substatus, back.test_pass_rate, back.coverage) == (None, None, None)
    assert after["testing>reviewing"].coverage == 5


def test_blocks_go_back_where_they_came_from(spark):
    m = frame(spark, module("a", status="blocked", pre_blocked_status="testing", blocked_by=["b"]), module("b"))
    change = state.transition(m, commands(spark, MOVE, ("a", "translating", None, None, False)))
    assert change.outcomes.first().code == "invalid_transition"
    change = state.transition(m, commands(spark, MOVE, ("a", "testing", None, None, False)))
    row = change.modules.where("module = 'a'").first()
    assert (row.status, row.blocked_by, row.pre_blocked_status) == ("testing", None, None)


def test_degraded_needs_force_and_stop_gate_leaves_a_trace(spark):
    m = frame(spark, module("a", status="degrade_ffi", substatus="x"), module("b", status="reviewing", substatus="awaiting_final_review"))
    change = state.transition(m, commands(spark, MOVE, ("a", "translating", None, None, True), ("b", None, "agent_done", None, False)))
    assert {r.code for r in change.outcomes.collect()} == {"ok"}
    assert change.modules.where("module = 'a'").first().substatus is None
    assert change.modules.where("module = 'b'").first().substatus == "agent_done"
    assert [r.result[:24] for r in change.audit.collect()] == ["stop-gate-marker-cleared"]
    assert [r.module for r in state.restarted(m, commands(spark, MOVE, ("a", "translating", None, None, True))).collect()] == ["a"]


def test_names_and_duplicates(spark):
    m = frame(spark, module("g", member_files=["x", "y"]), module("h", member_files=["y", "z"]))
    names = spark.createDataFrame([("g",), ("x",), ("y",), ("q",)], "name string")
    assert {r.name: (r.code, r.module) for r in state.canonical(m, names).collect()} == {
        "g": ("ok", "g"), "x": ("ok", "g"), "y": ("ambiguous", None), "q": ("not_found", None),
    }
    moves = commands(spark, MOVE + ", position int", ("x", "translating", None, None, False, 1), ("g", "blocked", None, None, False, 2), ("q", "blocked", None, None, False, 3))
    change = state.transition(m, moves)
    assert {(r.name, r.code) for r in change.outcomes.collect()} == {("x", "ok"), ("g", "duplicate"), ("q", "not_found")}
    assert [r.file for r in validate.double_members(m).collect()] == ["y"]


def test_metrics(spark):
    m = frame(spark, module("a", status="testing", coverage=4), module("b"), module("c", status="reviewing"))
    schema = "name string, test_pass_rate string, known_differences int, coverage int, phase_a_audit_passed boolean"
    change = state.record_metrics(m, commands(spark, schema, ("a", "85/100", None, None, True), ("b", "1", 0, 1, True), ("c", "150%", 0, 1, True)))
    assert {r.module: r.code for r in change.outcomes.collect()} == {"a": "ok", "b": "not_running", "c": "invalid_rate"}
    row = change.modules.where("module = 'a'").first()
    assert (row.test_pass_rate, row.known_differences, row.coverage, row.phase_a_audit_passed) == ("85/100", 0, 4, True)
    assert change.audit.first().result == "metrics:test_pass_rate=85/100 known_differences=0 coverage=4 phase_a_audit_passed=true"
    graduated = state.record_metrics(m, commands(spark, schema, ("a", "1", None, None, None)), "graduate")
    assert graduated.outcomes.first().code == "graduated"


def test_reset_twice_is_reset_once(spark):
    m = frame(spark, *[module(s, status=s, coverage=1, substatus="x") for s in STATUSES])
    force = commands(spark, "name string, force boolean", *[(s, True) for s in STATUSES])
    once = state.reset(m, force)
    twice = state.reset(once.modules, force)
    assert {r.code for r in twice.outcomes.collect()} == {"noop"} and twice.audit.count() == 0
    assert sorted(map(str, once.modules.collect())) == sorted(map(str, twice.modules.collect()))
    assert {r.status for r in once.modules.collect()} == {"pending", "translating"}
    plain = state.reset(m, commands(spark, "name string, force boolean", *[(s, False) for s in STATUSES]))
    assert {r.module for r in plain.outcomes.where("code = 'force_required'").collect()} == {"done", "blocked", "paused", "degrade_ffi", "degrade_manual", "degrade_skip"}


def test_recover(spark):
    m = frame(spark, *[module(s, status=s, coverage=1) for s in STATUSES])
    for policy, want in (("skip", "paused"), ("retry", "translating")):
        change = state.recover(m, commands(spark, "name string, policy string, reason string", *[(s, policy, None) for s in STATUSES]))
        codes = {r.module: r.code for r in change.outcomes.collect()}
        assert {k for k, v in codes.items() if v == "not_stalled"} == {"pending", "done", "blocked", "degrade_ffi", "degrade_manual", "degrade_skip"}
        assert change.modules.where("module = 'testing'").first().status == want
        assert codes["paused"] == ("noop" if policy == "skip" else "ok")


def gate_module(name, **given):
    return module(name, **({"status": "reviewing", "coverage": 90, "test_pass_rate": "100%", "phase_a_audit_passed": True, "substatus": "agent_done"} | given))


def test_red_lines_and_decision(spark):
    m = frame(
        spark,
        gate_module("ok"),
        gate_module("danger", danger=["ffi"], danger_provenance="unclassified", known_differences=2, substatus="odd", phase_a_audit_passed=False, coverage=79),
        gate_module("unmeasured", coverage=None),
        gate_module("batch", coverage=None, composite_kind="batch"),
        gate_module("edge", coverage=80, phase_a_audit_passed=None),
        gate_module("waits", substatus="awaiting_final_review"),
    )
    got = {r.module: (r.mandatory_reasons, r.decision) for r in gate.judge(m, ["batch_mechanical", "headless_default"]).collect()}
    assert got["ok"] == ([], "policy_eligible") and got["batch"] == ([], "policy_eligible")
    assert got["danger"][0] == [
        "danger_non_empty", "danger_provenance_untrusted", "known_differences_present", "substatus_not_clean", "phase_a_audit_failed",
        "coverage_below_threshold",
    ]
    assert got["unmeasured"] == (["coverage_below_threshold"], "mandatory_manual")
    assert got["edge"] == ([], "manual_required") and got["waits"] == ([], "manual_required")
    assert gate.unknown_policies(["x", "batch_mechanical"]) == ["x"]
    assert len(gate.required_attestations("headless_default")) == 11


def test_approvals(spark):
    m = frame(
        spark, gate_module("ok"), gate_module("waits", substatus="awaiting_final_review"),
        gate_module("red", substatus="awaiting_final_review", known_differences=1), module("early"), gate_module("low", coverage=1),
    )
    names = ("ok", "waits", "red", "early", "low")

    def codes(reason, policy=None, attested=None, enabled=("headless_default",)):
        c = commands(spark, "name string, reason string", *[(n, reason) for n in names])
        change = state.approve(m, c, list(enabled), policy, attested)
        return {r.module: r.code for r in change.outcomes.collect()}, change

    human, _ = codes(None)
    assert human == {"ok": "not_awaiting_final_review", "waits": "ok", "red": "mandatory_override_requires_reason", "early": "not_reviewing", "low": "not_awaiting_final_review"}
    human, change = codes("seen")
    assert human["red"] == "ok"
    assert {r.result for r in change.audit.collect()} == {"approved:human reason=seen", "approved:human reason=seen overridden=known_differences_present"}
    every = gate.required_attestations("headless_default")
    auto, change = codes(None, "headless_default", every)
    assert auto == {"ok": "ok", "waits": "awaiting_requires_human", "red": "awaiting_requires_human", "early": "not_reviewing", "low": "mandatory_manual"}
    assert change.modules.where("status = 'done'").count() == 1
    assert codes(None, "headless_default", every[1:])[0]["ok"] == "missing_attestations"
    assert codes(None, "headless_default", every, ())[0]["ok"] == "policy_not_enabled"
    assert codes(None, "nonsense", every)[0]["ok"] == "unknown_policy"
    assert codes(None, "batch_mechanical", every, ("batch_mechanical",))[0]["ok"] == "policy_conditions_unmet"
    batch = state.batch_done(m, commands(spark, "name string", *[(n,) for n in names]), ["headless_default"], "headless_default", every)
    assert {r.module: r.code for r in batch.outcomes.collect()} == {
        "ok": "ok", "waits": "awaiting_final_review", "red": "awaiting_final_review", "early": "not_agent_done", "low": "mandatory_manual",
    }
    assert {r.code for r in state.batch_done(m, commands(spark, "name string", ("ok",)), [], None).outcomes.collect()} == {"approval_required"}


def test_references(spark):
    m = frame(
        spark,
        module("a", status="blocked", blocked_by=["b", "ghost", "ghost", "c"], pre_blocked_status="testing"),
        module("b", status="done"),
        module("c", status="translating"),
        module("d", status="blocked", blocked_by=[]),
        module("e", status="blocked", blocked_by=["ghost"]),
    )
    got = {r.module: (r.resolved, r.unresolved, r.ready) for r in state.blocked_check(m).collect()}
    assert got == {"a": (["b"], ["c", "ghost"], False), "d": ([], [], True), "e": ([], ["ghost"], False)}
    fixed = state.repair_ghosts(m)
    after = {r.module: r.blocked_by for r in fixed.modules.collect()}
    assert after["a"] == ["b", "c"] and after["e"] is None and after["d"] == []
    assert {r.module: r.removed for r in fixed.outcomes.collect()} == {"a": 2, "e": 1}
    free = state.auto_unblock(m)
    assert {r.module: r.status for r in free.modules.collect()}["d"] == "pending" and free.audit.count() == 1
    ring = frame(spark, module("a", status="blocked", blocked_by=["b"]), module("b", status="blocked", blocked_by=["a"]), module("d", status="blocked"))
    assert [r.members for r in state.blocked_cycles(ring).collect()] == [["a", "b"]]
    assert state.auto_unblock(ring).audit.count() == 0
    assert state.cycle_path([("a", "b"), ("b", "a"), ("b", "c")], ["a", "b"]) == ["a", "b", "a"]


def test_dependencies_of_a_module(spark):
    m = frame(spark, module("g", member_files=["f1", "f2"]), module("h", member_files=["f3"], status="done"), module("k", member_files=["f4"]))
    imports = spark.createDataFrame([("f1", "f3"), ("f3", "f4"), ("f2", "f9"), ("f2", "f1")], "source string, target string")
    got = {(r.dependency, r.status, r.blocking) for r in state.dependencies(m, imports, spark.createDataFrame([("g",)], "name string")).collect()}
    assert got == {("h", "done", False), ("k", "pending", True), ("f9", "absent", False)}


def test_sprints_and_reports(spark):
    m = frame(spark, module("a", sprint=1, status="done"), module("b", sprint=1, status="degrade_skip"), module("c", sprint=2))
    one = lambda df: df.first().asDict()
    assert one(state.advance_sprint(m, 1))["outcome"] == "advanced" and one(state.advance_sprint(m, 1))["targets"] == ["c"]
    assert one(state.advance_sprint(m, 2))["outcome"] == "not_ready" and one(state.advance_sprint(m, 7))["outcome"] == "all_completed"
    assert one(state.graduate_report(m)) == {"ready": False, "total": 3, "done": 1, "degraded": 1, "open": ["c"]}
    assert {r.bucket: r.modules for r in state.resume_plan(m).collect()} == {"done": ["a"], "degraded": ["b"], "next": ["c"]}
    assert one(quality.coverage_stats(m))["completion"] == pytest.approx(200 / 3)
    assert one(quality.coverage_stats(m.limit(0)))["completion"] == 0.0
    assert one(quality.quality_report(m.limit(0)))["avg_final_score"] is None
    assert state.retain(m, spark.createDataFrame([("a",)], "x string")).count() == 1
    with pytest.raises(ValueError, match="E007"):
        state.compare_and_set(3, 2)


def test_history(spark):
    h = "seq int, state string, entered_at string, exited_at string"
    problems = lambda rows, now: {r.code for r in validate.history_problems(spark.createDataFrame(rows, h), now).collect()}
    assert problems([(0, "init", "1", "2"), (1, "profile", "2", None)], "profile") == set()
    assert problems([(0, "profile", "1", None), (1, "scaffold", "2", "3")], "plan") == {
        "first_not_init", "last_not_current", "last_closed", "earlier_entry_open", "illegal_step",
    }
    assert problems([], "init") == {"history_empty"}


def test_validate_state(spark):
    m = frame(spark, module("a", status="done"), module("b", status="done"), module("c", status="blocked", blocked_by=["ghost"]))
    attempts = spark.createDataFrame([("a", "approved:human reason=x")], "module string, result string")
    history = spark.createDataFrame([(0, "init", "1", None)], "seq int, state string, entered_at string, exited_at string")
    found = {(r.severity, r.code, r.subject) for r in validate.validate_state(m, attempts, history, "init", "2.0.0", "1.4.0").collect()}
    assert found == {("warning", "done_without_approval", "b"), ("warning", "ghost_reference", "c→ghost"), ("error", "schema_version", "2.0.0")}


def test_rate_boundaries(spark):
    from graphloom.functions import scalar

    cases = {
        None: None, "": None, "85%": 0.85, "0.85": 0.85, "85": 0.85, "85/100": 0.85, "1": 1.0, "1/0": None, "NaN": None, "150%": None,
        " 50 % ": 0.5, "inf": None, "-1": None, "0": 0.0, "100": 1.0, "3/4/5": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalar.pass_rate(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == pytest.approx(cases)


def test_scalars(spark):
    from graphloom.functions import scalar as s

    def value(expression, *given):
        df = spark.createDataFrame([tuple(given)], ", ".join(f"c{i} string" for i in range(len(given))))
        return df.select(expression(*[F.col(f"c{i}") for i in range(len(given))]).alias("v")).first().v

    assert value(s.normalize_path, "a/./b/../c") == "a/c" and value(s.normalize_path, "a/../../b") is None
    assert value(s.display_name, "file:src/a/b.test.ts") == "a/b.test" and value(s.display_name, "file:src/.gitignore") == ".gitignore"
    assert value(s.display_name, "file:src\\x\\y.ts") == "x/y" or value(s.display_name, "src\\x\\y.ts") == "x/y"
    assert value(s.canonical_file, "./src/a/index.ts") == "src/a" and value(s.canonical_file, "a.d.ts") == "a"
    assert value(s.symbol_without_base, "ns.f", "ns") == "f" and value(s.symbol_without_base, "f", "ns") == "f"
    assert value(s.version_satisfies, "v1.10.2", "1.9") and not value(s.version_satisfies, "1.8.9", "1.9")
    assert value(s.timestamp_valid, "2024-01-01T00:00:00Z") and not value(s.timestamp_valid, "2024-01-01 00:00")
    assert value(s.node_symbol, "function:a.py:x:y") == "x:y" and value(s.node_symbol, "file:a.py") is None
    assert value(lambda c: s.failure_kind(F.array(c)), "cannot borrow x") == "compilation_error"
    assert value(lambda c: s.failure_kind(F.array(c)), "hm") == "semantic_gap"
    assert value(s.evidence_kind, "phase-a-1.md") == "phase_a_attempt" and value(s.evidence_kind, "b-intent.md") is None
    assert value(s.parent_dir, "a/b/c") == "a/b" and value(s.parent_dir, "c") == ""
    assert value(s.is_test_file, "a/test_x.py") and not value(s.is_test_file, "a/x.py")


def test_evidence_goes_to_the_longest_name(spark):
    m = spark.createDataFrame([("file:src/a.ts",), ("file:src/a-b.ts",)], "module string")
    f = spark.createDataFrame([("d/a-intent.md",), ("d/a-b-intent.md",), ("d/a-b-c.md",), ("d/zz.md",)], "path string")
    assert {(r.module, r.path, r.kind) for r in gate.evidence(f, m).collect()} == {
        ("file:src/a.ts", "d/a-intent.md", "intent"), ("file:src/a-b.ts", "d/a-b-intent.md", "intent"),
    }


def test_small_reports(spark):
    from graphloom.functions import scalar

    m = spark.createDataFrame([("file:src/a/x.ts",), ("file:lib/x.py",), ("file:src/y.ts",)], "module string")
    assert {(r.module, r.sibling) for r in gate.ambiguous_siblings(m).collect()} == {("file:src/a/x.ts", "file:lib/x.py"), ("file:lib/x.py", "file:src/a/x.ts")}
    cycles = spark.createDataFrame([(["a", "b", "c"],)], "members array<string>")
    edges = spark.createDataFrame([("a", "s", "exports"), ("b", "t", "exports"), ("b", "u", "exports"), ("c", "a", "imports")], "source string, target string, edge_type string")
    assert quality.cycle_break_point(cycles, edges).first().node == "c"
    assert validate.config_problems({"coverage_threshold": 101, "max_retries_per_step": 2}) and not validate.config_problems({"coverage_threshold": 80})
    assert validate.roots_overlap("/a/b", "/a/b/c") and not validate.roots_overlap("/a/b", "/a/bc")
    n = spark.createDataFrame([(0,), (3,), (4,), (11,)], "n int").select("n", scalar.ffi_effort(F.col("n")).alias("f"), scalar.skip_effort(F.col("n")).alias("s"))
    assert {r.n: (r.f, r.s) for r in n.collect()} == {0: ("low", "low"), 3: ("low", "medium"), 4: ("medium", "high"), 11: ("high", "high")}
    pairs = spark.createDataFrame([("m", 10, 0, 2, 20, 3, 4)], "module string, source_code int, source_functions int, source_nesting int, target_code int, target_functions int, target_nesting int")
    row = quality.structure_ratios(pairs).first()
    assert (row.code_ratio, row.functions_ratio, row.nesting_ratio) == (2.0, None, 2.0)
