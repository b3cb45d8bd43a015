"""The migration state as one JSON document, and configuration.

The document is small and belongs to one project; it is read and written by the
driver, and becomes frames from there.
"""

from __future__ import annotations

import json
import os
import time
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.schemas import ATTEMPTS, MODULES

KEEP_SECONDS = 7 * 24 * 3600
VERSION = "1.0.0"
_COLUMNS = tuple(part.split()[0] for part in MODULES.split(", "))

DEFAULTS = {
    "coverage_threshold": 80, "max_retries_per_step": 2, "retry_backoff_secs": [5, 15], "stall_timeout_secs": 600, "decompose_budget": 12_000,
    "auto_approve_policies": [],
}


@dataclass
class Result:
    """What a command answers: data, warnings, and the status that follows."""

    data: object
    warnings: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def status(self) -> str:
        return "error" if self.error else "warning" if self.warnings else "ok"

    def to_json(self) -> str:
        body = {"status": self.status, "data": self.data}
        if self.error:
            body = {"status": "error", "error": self.error}
        if self.warnings:
            body["warnings"] = self.warnings
        return json.dumps(body, ensure_ascii=False)

    @property
    def exit_code(self) -> int:
        if self.error and "E002" in self.error:
            return 2
        return 1 if self.error else 0


def new_state(now: str) -> dict:
    return {
        "schema_version": VERSION, "state": "init", "state_history": [{"state": "init", "entered_at": now, "exited_at": None}],
        "modules": {}, "metadata": {"version": 0},
    }


def _backup(path: Path) -> Path:
    return path.with_name(f".{path.name}.backup")


def load(path: str) -> tuple[dict, list[str]]:
    """The document; a broken one is read from its backup, with a warning.  A missing file is an error."""
    p = Path(path)
    text = p.read_text(encoding="utf-8")
    try:
        return json.loads(text), []
    except json.JSONDecodeError as e:
        try:
            return json.loads(_backup(p).read_text(encoding="utf-8")), [f"{path} is broken ({e}); its backup was read"]
        except (OSError, json.JSONDecodeError):
            raise ValueError(f"E010: {path}: {e}") from e


def save(path: str, state: dict, recovered: bool = False) -> None:
    """Backup, write aside, flush, rename; what was recovered from a backup does not overwrite it."""
    p = Path(path)
    if p.exists() and not recovered:
        _replace(_backup(p), p.read_bytes())
    _replace(p, json.dumps(state, ensure_ascii=False, indent=2).encode())


def _replace(path: Path, raw: bytes) -> None:
    aside = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    with aside.open("wb") as f:
        f.write(raw)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def drop_old_backups(folder: str, keep_seconds: float = KEEP_SECONDS, now: float | None = None) -> list[str]:
    """Names of the backups that were too old and are gone."""
    limit = (time.time() if now is None else now) - keep_seconds
    gone = []
    for p in sorted(Path(folder).glob(".*.backup*")):
        if p.stat().st_mtime < limit:
            p.unlink()
            gone.append(p.name)
    return gone


def modules(spark: SparkSession, state: dict) -> DataFrame:
    """The modules of a document as a frame."""
    empty = {"known_differences": 0, "decomposition_frozen": False, "danger_provenance": "unclassified"}
    rows = []
    for key, m in sorted(state.get("modules", {}).items()):
        row = {c: m.get(c, empty.get(c)) for c in _COLUMNS} | {"module": key, "danger": m.get("danger") or []}
        rows.append(tuple(row[c] for c in _COLUMNS))
    return spark.createDataFrame(rows, MODULES)


def attempts(spark: SparkSession, state: dict) -> DataFrame:
    """The log of all modules, numbered in its order."""
    rows = [
        (key, i, a["timestamp"], a["result"], a.get("retry_count", 0), a.get("checkpoint"))
        for key, m in sorted(state.get("modules", {}).items())
        for i, a in enumerate(m.get("attempts", []))
    ]
    text = ATTEMPTS.replace("ts timestamp", "ts string")
    return spark.createDataFrame(rows, text).selectExpr("module", "seq", "to_timestamp(ts) AS ts", "result", "retry_count", "checkpoint")


def history(spark: SparkSession, state: dict) -> DataFrame:
    rows = [(i, h["state"], h["entered_at"], h.get("exited_at")) for i, h in enumerate(state.get("state_history", []))]
    df = spark.createDataFrame(rows, "seq int, state string, entered_at string, exited_at string")
    return df.selectExpr("seq", "state", "to_timestamp(entered_at) AS entered_at", "to_timestamp(exited_at) AS exited_at")


def store(state: dict, changed: DataFrame, audit: DataFrame, now: str) -> dict:
    """The document with the rows of a change, and its audit at the end of the logs."""
    out = json.loads(json.dumps(state))
    logs = {key: m.get("attempts", []) for key, m in out.get("modules", {}).items()}
    out["modules"] = {}
    for row in changed.collect():
        m = {k: v for k, v in row.asDict(recursive=True).items() if k != "module" and (v is not None)}
        out["modules"][row["module"]] = m | {"attempts": logs.get(row["module"], [])}
    for row in audit.collect():
        out["modules"][row["module"]]["attempts"].append({"timestamp": now, "result": row["result"], "retry_count": 0})
    out.setdefault("metadata", {})["version"] = out.get("metadata", {}).get("version", 0) + 1
    return out


def move_project(state: dict, to: str, now: str) -> dict:
    """The document in its next project state: the open entry closed, a new one begun."""
    from graphloom.schemas import PROJECT_TRANSITIONS

    if (state["state"], to) not in PROJECT_TRANSITIONS:
        raise ValueError(f"E004: {state['state']} → {to}")
    out = json.loads(json.dumps(state))
    if out["state_history"]:
        out["state_history"][-1]["exited_at"] = now
    out["state_history"].append({"state": to, "entered_at": now, "exited_at": None})
    out["state"] = to
    return out


def push_call(state: dict, agent: str, status: str, now: str) -> dict:
    if status not in ("started", "ok", "error", "timeout"):
        raise ValueError(f"E012: status {status!r}")
    return state | {"subagent_calls": [*state.get("subagent_calls", []), {"agent": agent, "status": status, "timestamp": now}]}


def config(path: str | None, strict: bool = False) -> tuple[dict, list[str]]:
    """Settings over the defaults; a file that is missing or broken is an error for a gate, else a warning."""
    if path is None or not Path(path).exists():
        if strict:
            raise ValueError(f"E012: no configuration at {path}")
        return dict(DEFAULTS), [] if path is None else [f"no configuration at {path}; defaults are used"]
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        if strict:
            raise ValueError(f"E012: {path}: {e}") from e
        return dict(DEFAULTS), [f"{path}: {e}; defaults are used"]
    flat = {k: v for k, v in found.items() if not isinstance(v, dict)} | {k: v for part in found.values() if isinstance(part, dict) for k, v in part.items()}
    return DEFAULTS | flat, []
