import pytest

from graphloom.lang.base import adapter
from graphloom.operators import build, scc
from graphloom.sources import tables

TS = {
    "src/types.ts": "export interface User { id: string }\nexport interface Saves { save(): string }\nexport enum Role { Admin = 'a', Guest = 'g' }\n",
    "src/db.ts": "import type { User } from './types';\nexport async function find(id: string): Promise<User | null> {\n  return null;\n}\nexport function makeId(): string { return Math.random().toString(36).slice(2); }\n",
    "src/auth.ts": "import type { User, Saves } from './types';\nimport { find, makeId as fresh } from './db';\n\nexport class Auth implements Saves {\n  private m: Map<string, User> = new Map();\n  async login(t: string): Promise<User | null> {\n    const u = await find(t);\n    this.save();\n    fresh();\n    return u;\n  }\n  save(): string { return 'x'; }\n}\n",
    "src/barrel.ts": "export { User, Role } from './types';\nexport * from './db';\nexport { Auth as Gate } from './auth';\n",
    "src/index.ts": "import { find, Gate } from './barrel';\nimport './side';\n\nexport async function main(t: string) {\n  const service = new Gate();\n  await service.login(t);\n  return find(t);\n}\n",
    "src/side.ts": "console.log('started');\n",
}
PY = {
    "src/utils.py": '"""Leaf."""\nfrom typing import List\n\n__all__ = ["clamp", "fetch", "Range"]\nLEAST = 0\n\ndef clamp(v: int, lo: int, hi: int) -> int:\n    return max(lo, min(v, hi))\n\nasync def fetch(url: str) -> List[int]:\n    return [1]\n\nclass Range:\n    def __init__(self, lo: int, hi: int):\n        self.lo = lo\n',
    "src/service.py": "from .utils import clamp, fetch, Range\n\nclass Service:\n    def __init__(self, r: Range):\n        self.r = r\n\n    def normal(self, v: int) -> int:\n        return clamp(v, 0, 1)\n\n    async def load(self, url):\n        return [self.normal(v) for v in await fetch(url)]\n",
    "src/index.py": "from .service import Service\nfrom .utils import Range\n\ndef main():\n    s = Service(Range(0, 10))\n    print(s.normal(5))\n",
}
GO = {
    "main.go": 'package main\n\nimport "example.com/linear/service"\n\nfunc main() {\n\t_ = service.Run(10)\n}\n',
    "service/service.go": 'package service\n\nimport "example.com/linear/utils"\n\n// Scaler scales.\ntype Scaler struct {\n\tFactor int\n}\n\nfunc (s Scaler) Scale(v int) int {\n\treturn utils.Clamp(v*s.Factor, 0, utils.Most)\n}\n\nfunc Run(v int) int {\n\ts := Scaler{Factor: 2}\n\treturn s.Scale(v)\n}\n',
    "utils/utils.go": "package utils\n\nconst Most = 100\n\nvar low = 0\n\nfunc Clamp(v, lo, hi int) int {\n\tif v < lo {\n\t\treturn lo\n\t}\n\treturn v\n}\n\nfunc Both(a, b int) (int, int) {\n\treturn b, a\n}\n",
    "geom/geom.go": "package geom\n\ntype Shape interface {\n\tArea() float64\n}\n\ntype Base struct{ Name string }\n\ntype Circle struct {\n\tBase\n\tR float64\n}\n\nfunc (c *Circle) Area() float64 { return c.R }\n",
    "geom/other.go": "//go:build windows\n\npackage geom\n\nfunc Hidden() {}\n",
}


def files(spark, sources, language):
    return spark.createDataFrame([(p, language, c) for p, c in sources.items()], "path string, language string, content string")


def rows(b):
    edges = {(r.source, r.target, r.edge_type, r.sub_kind) for r in b.graph.edges.collect()}
    nodes = {r.id: r for r in b.graph.nodes.collect()}
    return nodes, edges


def of(edges, kind):
    return {(s, t) for s, t, k, _ in edges if k == kind}


def test_typescript(spark):
    b = build.build(files(spark, TS, "typescript"))
    nodes, edges = rows(b)
    assert set(nodes) == {
        *(f"file:{p}" for p in TS), "interface:src/types.ts:User", "interface:src/types.ts:Saves", "enum:src/types.ts:Role",
        "function:src/db.ts:find", "function:src/db.ts:makeId", "class:src/auth.ts:Auth", "function:src/auth.ts:Auth.login",
        "function:src/auth.ts:Auth.save", "function:src/index.ts:main",
    }
    assert nodes["function:src/db.ts:find"].is_async and nodes["function:src/db.ts:find"].is_exported
    f = lambda p: f"file:src/{p}.ts"
    assert of(edges, "imports") == {
        (f("db"), f("types")), (f("auth"), f("types")), (f("auth"), f("db")), (f("barrel"), f("types")), (f("barrel"), f("db")),
        (f("barrel"), f("auth")), (f("index"), f("db")), (f("index"), f("auth")), (f("index"), f("side")),
    }
    assert ("class:src/auth.ts:Auth", "interface:src/types.ts:Saves", "extends", "implements") in edges
    assert of(edges, "calls") >= {
        (f("auth"), "function:src/db.ts:find"), (f("auth"), "function:src/db.ts:makeId"), (f("auth"), "function:src/auth.ts:Auth.save"),
        (f("index"), "class:src/auth.ts:Auth"), (f("index"), "function:src/auth.ts:Auth.login"), (f("index"), "function:src/db.ts:find"),
    }
    used = {(r.source, r.target): r.used_symbols for r in b.graph.raw_edges.where("edge_type = 'imports'").collect()}
    assert used[f("auth"), f("db")] == ["find", "makeId"] and used[f("index"), f("db")] is None and used[f("index"), f("side")] is None
    imports = b.graph.import_graph()
    found = scc.components(b.graph.files().select("id"), imports)
    order = [r.node for r in scc.topological_order(found, imports).collect()]
    assert order.index(f("types")) < order.index(f("db")) < order.index(f("auth")) < order.index(f("barrel"))


def test_python(spark):
    nodes, edges = rows(build.build(files(spark, PY, "python")))
    f = lambda p: f"file:src/{p}.py"
    assert {n for n in nodes if not n.startswith("file:")} == {
        "function:src/utils.py:clamp", "function:src/utils.py:fetch", "class:src/utils.py:Range", "function:src/utils.py:Range.__init__",
        "class:src/service.py:Service", "function:src/service.py:Service.__init__", "function:src/service.py:Service.normal",
        "function:src/service.py:Service.load", "function:src/index.py:main",
    }
    assert of(edges, "imports") == {(f("service"), f("utils")), (f("index"), f("service")), (f("index"), f("utils"))}
    assert of(edges, "calls") == {
        (f("service"), "function:src/utils.py:clamp"), (f("service"), "function:src/utils.py:fetch"),
        (f("service"), "function:src/service.py:Service.normal"), (f("index"), "class:src/service.py:Service"),
        (f("index"), "class:src/utils.py:Range"),
    }
    assert of(edges, "exports") == {
        (f("utils"), "function:src/utils.py:clamp"), (f("utils"), "function:src/utils.py:fetch"), (f("utils"), "class:src/utils.py:Range"),
    }
    assert nodes["function:src/utils.py:fetch"].is_async and not nodes["class:src/service.py:Service"].is_exported


def test_go(spark):
    sources = files(spark, GO, "go")
    nodes, edges = rows(build.build(sources, "example.com/linear"))
    assert {n for n in nodes if not n.startswith("file:")} == {
        "function:main.go:main", "class:service/service.go:Scaler", "function:service/service.go:Scaler.Scale",
        "function:service/service.go:Run", "variable:utils/utils.go:Most", "variable:utils/utils.go:low", "function:utils/utils.go:Clamp",
        "function:utils/utils.go:Both", "interface:geom/geom.go:Shape", "class:geom/geom.go:Base", "class:geom/geom.go:Circle",
        "function:geom/geom.go:Circle.Area",
    }
    assert "file:geom/other.go" in nodes
    assert of(edges, "imports") == {("file:main.go", "file:service/service.go"), ("file:service/service.go", "file:utils/utils.go")}
    assert of(edges, "calls") == {
        ("file:main.go", "function:service/service.go:Run"), ("file:service/service.go", "function:utils/utils.go:Clamp"),
        ("file:service/service.go", "function:service/service.go:Scaler.Scale"), ("file:service/service.go", "class:service/service.go:Scaler"),
    }
    assert ("class:geom/geom.go:Circle", "class:geom/geom.go:Base", "extends", None) in edges
    assert ("class:geom/geom.go:Circle", "function:geom/geom.go:Circle.Area", "contains", None) in edges


def test_incremental_equals_full(spark):
    first = build.build(files(spark, PY, "python"))
    store = first.store()
    edited = {k: v for k, v in PY.items() if k != "src/index.py"}
    edited["src/utils.py"] = PY["src/utils.py"].replace("clamp", "bound")
    edited["src/service.py"] = PY["src/service.py"] + "\n# a remark\n"
    edited["src/new.py"] = "from .utils import fetch\n"
    after, changed, blown = build.incremental(store, files(spark, edited, "python"))
    assert {r.file_path: r.change for r in changed.collect()} == {
        "src/utils.py": "structural", "src/service.py": "cosmetic", "src/index.py": "deleted", "src/new.py": "added",
    }
    full = rows(build.build(files(spark, edited, "python")))
    got = rows(build.Build(after.graph, after.fingerprints, None))
    assert set(got[0]) == set(full[0]) and got[1] == full[1] and not blown
    again, changed, _ = build.incremental(after, files(spark, edited, "python"))
    assert {r.change for r in changed.collect()} == {"none"}
    assert sorted(r.path for r in again.analyses.collect()) == sorted(edited)


def test_incremental_parses_only_new_content(spark, monkeypatch, tmp_path):
    parsed = []
    analyze = build.base.analyze

    def counted(frame):
        parsed.append(sorted(r.path for r in frame.select("path").collect()))
        return analyze(frame)

    monkeypatch.setattr(build.base, "analyze", counted)
    first = build.build(files(spark, PY, "python"))
    tables.save(spark, str(tmp_path / "graph"), first.store())
    store = tables.load(spark, str(tmp_path / "graph"))
    edited = PY | {"src/utils.py": PY["src/utils.py"].replace("clamp", "bound"), "src/new.py": "from .utils import fetch\n"}
    after, _, _ = build.incremental(store, files(spark, edited, "python"))
    assert parsed == [sorted(PY), ["src/new.py", "src/utils.py"]]
    got, full = rows(build.Build(after.graph, after.fingerprints, None)), rows(build.build(files(spark, edited, "python")))
    assert set(got[0]) == set(full[0]) and got[1] == full[1]
    # what a splice replaced is parsed again
    torn = store.splice(after.graph, after.fingerprints, spark.createDataFrame([("src/utils.py",)], "file_path string"))
    assert sorted(r.path for r in build.unchanged(torn, files(spark, edited, "python")).collect()) == ["src/index.py", "src/service.py"]


def test_broken_file_keeps_its_node(spark):
    b = build.build(files(spark, {"a.py": "def (:\n", "b.py": "import a\n"}, "python"))
    nodes, edges = rows(b)
    assert "file:a.py" in nodes and ("file:b.py", "file:a.py") in of(edges, "imports")
    assert [r.subject for r in b.warnings.collect()] == ["a.py"]


@pytest.mark.parametrize(
    ("language", "text", "tier", "kind", "danger"),
    [
        ("python", "X = 1\n", "trivial", "pure_constant", []),
        ("python", "from typing import TypeVar\nT = TypeVar('T')\n", "trivial", "pure_type", []),
        ("python", "from .a import b\n__all__ = ['b']\n", "trivial", "barrel", []),
        ("python", "def f():\n    return 1\n", "standard", "normal", []),
        ("python", "import os\ntry:\n    pass\nfinally:\n    pass\n", "full", "normal", ["io_side_effect"]),
        ("python", "async def f():\n    await g()\n", "full", "normal", ["concurrency"]),
        ("python", "CACHE = {}\n", "trivial", "normal", ["shared_mutable_global"]),
        ("typescript", "export * from './a';\n", "trivial", "barrel", []),
        ("typescript", "export type A = string;\n", "trivial", "pure_type", []),
        ("typescript", "export const A = 1;\n", "trivial", "pure_constant", []),
        ("typescript", "let n = 0;\n", "full", "normal", ["shared_mutable_global"]),
        ("typescript", "export function f(x: number) { return x + 1; }\n", "standard", "normal", []),
        ("typescript", "import fs from 'fs';\nexport function f() { return fs; }\n", "full", "normal", ["io_side_effect"]),
        ("go", "package a\n\nfunc F() { go G() }\n", "full", "normal", ["concurrency"]),
        ("go", 'package a\n\nimport "unsafe"\n', "full", "normal", ["ffi"]),
    ],
)
def test_classification(language, text, tier, kind, danger):
    found = adapter(language).analyze(text, "x")
    assert (found.tier, found.file_kind, found.danger) == (tier, kind, danger)


def test_which_files():
    ts, go, py = adapter("typescript"), adapter("go"), adapter("python")
    assert ts.can_handle("a/b.tsx") and not any(map(ts.can_handle, ("a.d.ts", "a.test.ts", "a.spec.tsx", "a.js")))
    assert go.can_handle("a_linux.go") and go.can_handle("windows.go") and not any(map(go.can_handle, ("a_test.go", "a_windows.go", "a_linux_arm64.go")))
    assert py.can_handle("a.py") and not py.can_handle("a.pyi")
    with pytest.raises(NotImplementedError):
        adapter("c")
