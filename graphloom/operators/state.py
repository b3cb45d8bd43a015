"""Migration state: every change is (modules, commands) -> (modules, audit, outcomes).

Commands name modules by key or by a member file.  A batch carries at most one
command for a module; of several, the first by position counts and the others
come back as duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import gate
from graphloom.operators.graph import first_by
from graphloom.schemas import (
    AGENT_DONE,
    BLOCKABLE,
    DEGRADED,
    MODULE_TRANSITIONS,
    PROJECT_TRANSITIONS,
    RUNNING,
    STOP_GATE,
    TERMINAL,
    in_pairs,
)


@dataclass(frozen=True)
class Change:
    modules: DataFrame
    audit: DataFrame  # module, result
    outcomes: DataFrame


def can_transition(a: Column, b: Column) -> Column:
    return in_pairs(a, b, MODULE_TRANSITIONS)


def can_transition_project(a: Column, b: Column) -> Column:
    return in_pairs(a, b, PROJECT_TRANSITIONS)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_degraded(status: Column) -> Column:
    return status.isin(*DEGRADED)


def is_blockable(status: Column) -> Column:
    return status.isin(*BLOCKABLE)


def needs_force(status: Column) -> Column:
    return status.isin("done", "blocked", "paused", *DEGRADED)


def is_agent_done(substatus: Column) -> Column:
    return F.coalesce(substatus == AGENT_DONE, F.lit(False))


# --- names -----------------------------------------------------------------


def members(modules: DataFrame) -> DataFrame:
    """file, module: the files of each module; without a list, the module is its own file."""
    own = F.coalesce("member_files", F.array("module"))
    return modules.select(F.explode(own).alias("file"), "module").distinct()


def canonical(modules: DataFrame, names: DataFrame) -> DataFrame:
    """names (a column name) with module and code: ok, not_found or ambiguous.

    A key is itself; else the only module that lists the file.
    """
    hosts = members(modules).groupBy("file").agg(F.min("module").alias("host"), F.count("*").alias("hosts"))
    keys = modules.select(F.col("module").alias("key")).distinct()
    joined = names.join(keys, F.col("name") == F.col("key"), "left").join(hosts, F.col("name") == F.col("file"), "left")
    code = F.when(F.col("key").isNotNull(), "ok").when(F.col("hosts") == 1, "ok").when(F.col("hosts") > 1, "ambiguous").otherwise("not_found")
    return joined.withColumn("code", code).withColumn(
        "module", F.when(F.col("code") == "ok", F.coalesce("key", "host"))
    ).drop("key", "file", "host", "hosts")


def _addressed(modules: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands by module, first of each; outcomes of those that reach no module or come again)."""
    position = commands if "position" in commands.columns else commands.withColumn("position", F.monotonically_increasing_id())
    found = canonical(modules, position)
    good = found.where("code = 'ok'")
    first = first_by(good, ["module"], ["position"])
    again = good.join(first.select("module", F.col("position").alias("__p")), "module").where("position > __p")
    lost = found.where("code <> 'ok'").select("name", F.lit(None).cast("string").alias("module"), "code")
    lost = lost.unionByName(again.select("name", "module", F.lit("duplicate").alias("code")))
    return first.drop("code"), lost


def _apply(modules: DataFrame, commands: DataFrame, code: Column, changes: dict[str, Column], audit: list[Column]) -> Change:
    """Join commands to modules, keep the changes where the code is NULL, and gather audit lines."""
    own, lost = _addressed(modules, commands)
    mine = own.select("module", F.struct(*[c for c in own.columns if c != "module"]).alias("cmd"))
    joined = modules.join(mine, "module", "left")
    joined = joined.withColumn("__code", F.when(F.col("cmd").isNotNull(), F.coalesce(code, F.lit("ok"))))
    done = F.coalesce(F.col("__code") == "ok", F.lit(False))
    new = joined.select(
        *[F.when(done, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in modules.columns]
    )
    lines = joined.where(done).select("module", F.explode(F.filter(F.array(*audit), lambda x: x.isNotNull())).alias("result"))
    outcomes = joined.where("cmd is not null").select(F.col("cmd.name").alias("name"), "module", F.col("__code").alias("code"))
    return Change(new, lines, outcomes.unionByName(lost))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


# --- commands --------------------------------------------------------------


def transition(modules: DataFrame, commands: DataFrame) -> Change:
    """commands: name, to_status, substatus, reason, force.

    Done out of reviewing needs an approval, which is another command; leaving
    degrade_* needs force; a block remembers where it came from and goes back
    there only; going back from reviewing voids what was measured.
    """
    to, start = F.col("cmd.to_status"), F.col("status")
    back = (start == "reviewing") & to.isin("translating", "compile_fixing")
    restart = is_degraded(start) & (to == "translating")
    code = (
        F.when(to.isNull(), None)
        .when(~can_transition(start, to), "invalid_transition")
        .when((start == "reviewing") & (to == "done"), "approval_required")
        .when(restart & ~F.coalesce("cmd.force", F.lit(False)), "force_required")
        .when((start == "blocked") & F.col("pre_blocked_status").isNotNull() & (to != F.col("pre_blocked_status")), "invalid_transition")
    )
    moved = to.isNotNull()
    kept = F.when(moved & (restart | back | (to == "done")), F.lit(None)).otherwise(F.col("substatus"))
    given = F.col("cmd.substatus")
    new_status = F.coalesce(to, start)
    void = lambda c: F.when(moved & back, F.lit(None)).otherwise(F.col(c))
    changes = {
        "status": new_status,
        "substatus": F.coalesce(given, kept),
        "pre_blocked_status": F.when(to == "blocked", start).when(moved & (start == "blocked"), F.lit(None)).otherwise(F.col("pre_blocked_status")),
        "blocked_by": F.when(moved & (start == "blocked"), F.lit(None)).otherwise(F.col("blocked_by")),
        "test_pass_rate": void("test_pass_rate"),
        "coverage": void("coverage"),
        "phase_a_audit_passed": void("phase_a_audit_passed"),
        "known_differences": F.when(moved & back, 0).otherwise(F.col("known_differences")),
    }
    audit = [
        F.when((kept == STOP_GATE) & (given != STOP_GATE), F.concat(F.lit(f"stop-gate-marker-cleared: {STOP_GATE} → "), given)),
        F.when(
            F.col("cmd.reason").isNotNull(),
            F.concat(F.lit("transition:"), start, F.lit("→"), new_status, F.lit(" reason="), F.col("cmd.reason")),
        ),
    ]
    return _apply(modules, commands, code, changes, audit)


def restarted(modules: DataFrame, commands: DataFrame) -> DataFrame:
    """Modules whose attempts a transition out of degrade_* clears."""
    change = transition(modules, commands)
    before = modules.where(is_degraded(F.col("status"))).select("module")
    return change.modules.where("status = 'translating'").join(before, "module", "left_semi").select("module")


def record_metrics(modules: DataFrame, commands: DataFrame, project_state: str = "sprint_loop") -> Change:
    """commands: name, test_pass_rate, known_differences, coverage, phase_a_audit_passed; NULL leaves a value."""
    measured = ("test_pass_rate", "known_differences", "coverage", "phase_a_audit_passed")
    code = (
        F.when(F.col("cmd.test_pass_rate").isNotNull() & scalar.pass_rate(F.col("cmd.test_pass_rate")).isNull(), "invalid_rate")
        .when(F.lit(project_state == "graduate"), "graduated")
        .when(~F.col("status").isin(*RUNNING), "not_running")
    )
    changes = {c: F.coalesce(F.col(f"cmd.{c}"), F.col(c)) for c in measured}
    line = F.concat(F.lit("metrics:"), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), _text(changes[c])) for c in measured]))
    return _apply(modules, commands, code, changes, [line])


_MEASURED = ("substatus", "phase_a_version", "phase_a_audit_passed", "test_pass_rate", "coverage", "blocked_by", "pre_blocked_status")


def _clean() -> Column:
    out = F.col("status").isin("translating", "pending") & (F.col("known_differences") == 0)
    for c in _MEASURED:
        out = out & F.col(c).isNull()
    return out


def reset(modules: DataFrame, commands: DataFrame, project_state: str = "sprint_loop") -> Change:
    """commands: name, force.  A module that is clean already is left alone, without audit."""
    code = (
        F.when(F.lit(project_state == "graduate"), "graduated")
        .when(needs_force(F.col("status")) & ~F.coalesce("cmd.force", F.lit(False)), "force_required")
        .when(_clean(), "noop")
    )
    to = F.when(F.col("status") == "pending", "pending").otherwise("translating")
    changes = {c: F.lit(None) for c in _MEASURED} | {"status": to, "known_differences": F.lit(0)}
    return _apply(modules, commands, code, changes, [F.concat(F.lit("reset:"), F.col("status"), F.lit("→"), to)])


def recover(modules: DataFrame, commands: DataFrame, project_state: str = "sprint_loop") -> Change:
    """commands: name, policy (retry or skip), reason.  Retry resets; skip pauses, past the matrix."""
    skip = F.col("cmd.policy") == "skip"
    code = (
        F.when(F.lit(project_state == "graduate"), "graduated")
        .when(~F.col("status").isin(*RUNNING, "paused"), "not_stalled")
        .when(skip & (F.col("status") == "paused"), "noop")
        .when(~skip & _clean(), "noop")
    )
    to = F.when(skip, "paused").otherwise("translating")
    changes = {c: F.when(skip, F.col(c)).otherwise(F.lit(None)) for c in _MEASURED}
    changes |= {"substatus": F.lit(None), "status": to, "known_differences": F.when(skip, F.col("known_differences")).otherwise(0)}
    audit = [
        F.when(~skip, F.concat(F.lit("reset:"), F.col("status"), F.lit("→"), to)),
        F.concat(F.lit("recover:"), F.col("cmd.policy"), F.coalesce(F.concat(F.lit(" reason="), F.col("cmd.reason")), F.lit(""))),
    ]
    return _apply(modules, commands, code, changes, audit)


def approve(
    modules: DataFrame, commands: DataFrame, enabled: list[str], policy: str | None = None, attested: list[str] | None = None,
    coverage: int = gate.COVERAGE,
) -> Change:
    """commands: name, reason.  Without a policy a person approves: only at the stop gate, and over red
    lines only with a reason.  A policy never approves at the stop gate nor over a red line."""
    judged = gate.judge(modules, enabled, coverage)
    waiting = F.coalesce(F.col("substatus") == STOP_GATE, F.lit(False))
    code = F.when(F.col("status") != "reviewing", "not_reviewing")
    if policy is None:
        over = F.size("mandatory_reasons") > 0
        code = code.when(~waiting, "not_awaiting_final_review").when(
            over & F.col("cmd.reason").isNull(), "mandatory_override_requires_reason"
        )
        head = F.lit("approved:human")
    else:
        code = code.when(waiting, "awaiting_requires_human").otherwise(gate.policy_refusal(policy, attested or [], enabled))
        head = F.lit(f"auto_approved_by_policy:{policy}")
    overridden = F.when(F.size("mandatory_reasons") > 0, F.concat(F.lit(" overridden="), F.array_join("mandatory_reasons", ",")))
    line = F.concat(
        head, F.coalesce(F.concat(F.lit(" reason="), F.col("cmd.reason")), F.lit("")), F.coalesce(overridden, F.lit(""))
    )
    out = _apply(judged, commands, code, {"status": F.lit("done"), "substatus": F.lit(None)}, [line])
    return Change(out.modules.select(*modules.columns), out.audit, out.outcomes)


def batch_done(
    modules: DataFrame, commands: DataFrame, enabled: list[str], policy: str | None, attested: list[str] | None = None,
    coverage: int = gate.COVERAGE,
) -> Change:
    """commands: name.  Each module on its own: skipped with a code, or approved by the policy."""
    commands = commands.withColumn("reason", F.lit(None).cast("string"))
    judged = gate.judge(modules, enabled, coverage)
    code = F.when(F.lit(policy is None), "approval_required")
    code = code.when(F.col("substatus") == STOP_GATE, "awaiting_final_review").when(~is_agent_done(F.col("substatus")), "not_agent_done")
    code = code.when(F.col("status") != "reviewing", "not_reviewing")
    if policy is not None:
        code = code.otherwise(gate.policy_refusal(policy, attested or [], enabled))
    out = _apply(judged, commands, code, {"status": F.lit("done"), "substatus": F.lit(None)}, [F.lit(f"auto_approved_by_policy:{policy}")])
    skipped = out.outcomes.where("module is not null and code not in ('ok', 'duplicate')").select(
        "module", F.concat(F.lit("batch-done-skipped:"), F.col("code")).alias("result")
    )
    return Change(out.modules.select(*modules.columns), out.audit.unionByName(skipped), out.outcomes)


# --- references between modules --------------------------------------------


def references(modules: DataFrame) -> DataFrame:
    """module, ref, place, resolution (resolved, ambiguous, missing), target, target_status of every blocked_by entry."""
    refs = modules.select("module", F.posexplode("blocked_by").alias("place", "name"))
    found = canonical(modules, refs.select("name").distinct()).select(
        "name", F.col("module").alias("target"), F.when(F.col("code") == "ok", "resolved").when(F.col("code") == "ambiguous", "ambiguous").otherwise("missing").alias("resolution")
    )
    status = modules.select(F.col("module").alias("target"), F.col("status").alias("target_status"))
    return refs.join(found, "name").join(status, "target", "left").select(
        "module", F.col("name").alias("ref"), "place", "resolution", "target", "target_status"
    )


def blocked_check(modules: DataFrame) -> DataFrame:
    """module, resolved, unresolved, ready of every blocked module; nothing to wait for is ready."""
    r = references(modules)
    state = F.coalesce(F.col("target_status").isin(*TERMINAL), F.lit(False))
    sums = r.groupBy("module").agg(
        F.array_sort(F.collect_set(F.when(state, F.col("ref")))).alias("resolved"),
        F.array_sort(F.collect_set(F.when(~state, F.col("ref")))).alias("unresolved"),
    )
    none = F.array().cast("array<string>")
    return modules.where("status = 'blocked'").select("module").join(sums, "module", "left").select(
        "module",
        F.coalesce("resolved", none).alias("resolved"),
        F.coalesce("unresolved", none).alias("unresolved"),
        (F.size(F.coalesce("unresolved", none)) == 0).alias("ready"),
    )


def ghosts(modules: DataFrame) -> DataFrame:
    """module, ref of the entries that name nothing."""
    return references(modules).where("resolution = 'missing'").select("module", "ref").distinct()


def repair_ghosts(modules: DataFrame) -> Change:
    """Entries that name nothing go, other duplicates stay; an emptied list is NULL."""
    gone = ghosts(modules).groupBy("module").agg(F.collect_set("ref").alias("__gone"))
    joined = modules.join(gone, "module", "left")
    left = F.filter("blocked_by", lambda x: ~F.array_contains("__gone", x))
    new = F.when(F.col("__gone").isNull(), F.col("blocked_by")).when(F.size(left) > 0, left)
    fixed = joined.withColumn("__n", F.size("blocked_by") - F.size(left)).withColumn("__new", new)
    audit = fixed.where("__gone is not null").select(
        "module", F.concat(F.lit("repair:removed "), F.col("__n").cast("string"), F.lit(" ghost references")).alias("result")
    )
    outcomes = fixed.where("__gone is not null").select(F.col("module").alias("name"), "module", F.col("__n").alias("removed"))
    return Change(fixed.withColumn("blocked_by", F.col("__new")).select(*modules.columns), audit, outcomes)


def blocked_cycles(modules: DataFrame) -> DataFrame:
    """members of each cycle of blocked modules that wait for each other."""
    from graphloom.operators import scc

    blocked = modules.where("status = 'blocked'").select("module")
    r = references(modules).where("resolution = 'resolved'")
    edges = r.join(blocked, "module", "left_semi").join(blocked.toDF("target"), "target", "left_semi")
    edges = edges.select(F.col("module").alias("source"), "target").distinct()
    return scc.cycles(scc.components(blocked, edges), edges)


def cycle_path(edges: list[tuple[str, str]], members_: list[str]) -> list[str]:
    """One closed path through the smallest member of a cycle, shortest and first by name."""
    inside = set(members_)
    follow = {m: sorted(b for a, b in edges if a == m and b in inside) for m in members_}
    start = min(members_)
    paths, seen = [[start]], set()
    while paths:
        nxt = []
        for path in paths:
            for y in follow[path[-1]]:
                if y == start:
                    return [*path, start]
                if y not in seen:
                    seen.add(y)
                    nxt.append([*path, y])
        paths = nxt
    return []


def auto_unblock(modules: DataFrame) -> Change:
    """Ready blocked modules go back where they came from; none does while there is a cycle."""
    if not blocked_cycles(modules).isEmpty():
        none = modules.select("module").limit(0)
        return Change(modules, none.withColumn("result", F.lit("")), none.withColumn("code", F.lit("")))
    ready = blocked_check(modules).where("ready").select("module", F.lit(True).alias("__ready"))
    joined = modules.join(ready, "module", "left")
    to = F.coalesce("pre_blocked_status", F.lit("pending"))
    go = F.coalesce("__ready", F.lit(False))
    new = joined.select(
        *[
            F.when(go, to).otherwise(F.col("status")).alias(c) if c == "status"
            else F.when(~go, F.col(c)).alias(c) if c in ("blocked_by", "pre_blocked_status")
            else F.col(c)
            for c in modules.columns
        ]
    )
    audit = joined.where(go).select("module", F.concat(F.lit("unblocked→"), to).alias("result"))
    return Change(new, audit, joined.where(go).select("module", F.lit("ok").alias("code")))


def dependencies(modules: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """name, dependency, status, blocking: the modules that the files of a module import, at any distance.

    Files that no module has are listed as absent and do not block.
    """
    from graphloom.operators import closure

    own = canonical(modules, names).where("code = 'ok'").select("name", "module")
    of = members(modules)
    starts = own.join(of, "module").select("name", "module", F.col("file").alias("start"))
    reach = closure.reachable(imports, starts.select("start").distinct())
    hit = starts.join(reach, "start").select("name", "module", F.col("node").alias("file")).distinct()
    host = of.groupBy("file").agg(F.min("module").alias("host"))
    grouped = hit.join(host, "file", "left").withColumn("dependency", F.coalesce("host", "file"))
    grouped = grouped.where(F.col("dependency") != F.col("module")).select("name", "dependency", "host").distinct()
    status = modules.select(F.col("module").alias("host"), "status")
    return grouped.join(status, "host", "left").select(
        "name",
        "dependency",
        F.coalesce("status", F.lit("absent")).alias("status"),
        (F.col("status").isNotNull() & ~is_terminal(F.col("status"))).alias("blocking"),
    )


# --- reports ---------------------------------------------------------------


def resume_bucket() -> Column:
    return (
        F.when((F.col("status") == "reviewing") & (F.col("substatus") == STOP_GATE), "awaiting_approval")
        .when(F.col("status").isin(*RUNNING), "interrupted")
        .when(F.col("status") == "paused", "awaiting_decision")
        .when(F.col("status") == "pending", "next")
        .when(F.col("status") == "blocked", "blocked")
        .when(F.col("status") == "done", "done")
        .otherwise("degraded")
    )


def resume_plan(modules: DataFrame) -> DataFrame:
    """bucket, n, modules: what to go on with."""
    return modules.withColumn("bucket", resume_bucket()).groupBy("bucket").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("module")).alias("modules")
    )


def advance_sprint(modules: DataFrame, current: int) -> DataFrame:
    """outcome (not_ready, all_completed, advanced), sprint, completed, targets.

    A sprint closes when all its modules are terminal, also when there are none;
    without modules in the next, it closes but does not advance.
    """
    sums = modules.agg(
        F.count_if(F.col("sprint") == current).alias("own"),
        F.count_if((F.col("sprint") == current) & is_terminal(F.col("status"))).alias("closed"),
        F.count_if(F.col("sprint") == current + 1).alias("following"),
        F.array_sort(F.collect_list(F.when((F.col("sprint") == current) & is_terminal(F.col("status")), F.col("module")))).alias("completed"),
        F.array_sort(F.collect_list(F.when(F.col("sprint") == current + 1, F.col("module")))).alias("targets"),
    )
    return sums.select(
        F.when(F.col("closed") < F.col("own"), "not_ready").when(F.col("following") == 0, "all_completed").otherwise("advanced").alias("outcome"),
        F.when((F.col("closed") == F.col("own")) & (F.col("following") > 0), current + 1).otherwise(current).alias("sprint"),
        F.when(F.col("closed") == F.col("own"), F.col("completed")).alias("completed"),
        F.when((F.col("closed") == F.col("own")) & (F.col("following") > 0), F.col("targets")).alias("targets"),
    )


def graduate_report(modules: DataFrame, sample: int = 5) -> DataFrame:
    """ready, total, done, degraded, open (the first few that are not terminal)."""
    left = F.filter(F.array_sort(F.collect_list(F.when(~is_terminal(F.col("status")), F.col("module")))), lambda x: x.isNotNull())
    return modules.agg(
        (F.count_if(~is_terminal(F.col("status"))) == 0).alias("ready"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(is_degraded(F.col("status"))).alias("degraded"),
        F.slice(left, 1, sample).alias("open"),
    )


def retain(modules: DataFrame, live: DataFrame) -> DataFrame:
    """The modules whose key is among the live ones (one column)."""
    return modules.join(live.toDF("module").distinct(), "module", "left_semi")


def compare_and_set(version: int, expected: int) -> int:
    """The next version; a stale one is refused."""
    if version != expected:
        raise ValueError(f"E007: state is at version {version}, not {expected}")
    return version + 1
