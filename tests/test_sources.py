import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators.cdc import Store
from graphloom.operators.graph import Graph
from graphloom.sources import export, files, oracles, state_file, tables, tools
from graphloom.streaming import cdc as stream


def test_collect(spark, tmp_path):
    for p in ("src/a.ts", "src/a.test.ts", "src/b/c.tsx", "src/types.d.ts", "node_modules/x/y.ts", "src/p.py", "lib/z_windows.go", "lib/z.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("é\n")
    got = {(r.path, r.language) for r in files.collect(spark, str(tmp_path), ["typescript", "go"]).collect()}
    assert got == {("src/a.ts", "typescript"), ("src/b/c.tsx", "typescript"), ("lib/z.go", "go")}
    found = files.collect(spark, str(tmp_path), ["typescript"])
    assert found.first().content == "é\n" and files.source_root(found, "typescript") == "src"
    assert files.go_module("module example.com/a\n\ngo 1.21\n") == "example.com/a"


def test_go_names_in_expressions_and_in_python(spark):
    from graphloom.lang.go import Go

    names = ["a.go", "a_test.go", "a_linux.go", "a_windows.go", "a_linux_arm64.go", "a_windows_amd64.go", "windows.go", "_windows.go", "a_b.go", "x/a_arm.go"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", files.handles_go(F.col("p")).alias("h"))
    assert {r.p: r.h for r in df.collect()} == {n: Go().can_handle(n) for n in names}


def test_store_round_trip_and_domains(spark, tmp_path):
    nodes = spark.createDataFrame([("file:a", "file", "a", "a"), ("file:b", "file", "b", "b")], "id string, node_type string, name string, file_path string")
    edges = spark.createDataFrame([("file:a", "file:b", "imports"), ("file:a", "file:b", "imports"), ("file:a", "file:z", "calls")], "source string, target string, edge_type string")
    prints = spark.createDataFrame([("a", "1", "2")], "file_path string, content_hash string, structure_hash string")
    root = str(tmp_path / "g")
    tables.save(spark, root, Store(Graph(nodes, edges), prints, "partial"))
    back = tables.load(spark, root)
    assert back.graph.nodes.count() == 2 and back.graph.raw_edges.count() == 1 and back.integrity == "partial"
    tables.save(spark, root, Store(Graph(nodes.withColumn("node_type", F.lit("strange")), edges), prints))
    with pytest.raises(tables.UnknownValue):
        tables.load(spark, root)
    assert tables.integrity(spark.createDataFrame([], "key string, value string")) == "full"


def test_lenient_values_and_extra(spark):
    rows = [("a", "simple", '{"is_async": true, "visibility": "public", "rust_kind": "nonsense"}'), ("b", "odd", "{broken"), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, complexity string, extra string")
    clean, warnings = tables.lenient(df, "complexity", "complexity")
    assert [r.subject for r in warnings.collect()] == ["b"]
    out, warnings = tables.parse_extra(clean)
    got = {r.id: r for r in out.collect()}
    assert got["a"].is_async and got["a"].visibility == "public" and got["a"].rust_kind is None
    assert not got["b"].is_async and got["c"].decorators == [] and [r.subject for r in warnings.collect()] == ["b"]


def test_state_file(spark, tmp_path):
    path = str(tmp_path / "migration-state.json")
    state = state_file.new_state("2024-01-01T00:00:00Z")
    state["modules"]["m"] = {"status": "pending", "attempts": [{"timestamp": "2024-01-01T00:00:00Z", "result": "x"}]}
    state_file.save(path, state)
    state = state_file.move_project(state, "profile", "2024-01-02T00:00:00Z")
    state_file.save(path, state)
    assert state_file.load(path) == (state, [])
    with open(path, "w") as f:
        f.write("{broken")
    old, warnings = state_file.load(path)
    assert old["state"] == "init" and len(warnings) == 1
    with pytest.raises(FileNotFoundError):
        state_file.load(path + ".no")
    os.remove(tmp_path / ".migration-state.json.backup")
    with pytest.raises(ValueError, match="E010"):
        state_file.load(path)
    with pytest.raises(ValueError, match="E004"):
        state_file.move_project(state, "graduate", "2024-01-03T00:00:00Z")
    m, a, h = (f(spark, state) for f in (state_file.modules, state_file.attempts, state_file.history))
    assert m.first().danger == [] and a.count() == 1 and h.count() == 2
    audit = spark.createDataFrame([("m", "reset:pending→pending")], "module string, result string")
    new = state_file.store(state, m.withColumn("status", F.lit("translating")), audit, "2024-01-04T00:00:00Z")
    assert new["modules"]["m"]["status"] == "translating" and len(new["modules"]["m"]["attempts"]) == 2 and new["metadata"]["version"] == 1
    assert state_file.push_call(state, "a", "ok", "t")["subagent_calls"][0]["agent"] == "a"


def test_configuration(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[testing]\ncoverage_threshold = 70\n")
    assert state_file.config(str(p))[0]["coverage_threshold"] == 70
    p.write_text("[broken")
    assert state_file.config(str(p))[1] and state_file.config(None)[0]["coverage_threshold"] == 80
    with pytest.raises(ValueError, match="E012"):
        state_file.config(str(p), strict=True)
    r = state_file.Result({"a": 1}, ["w"])
    assert json.loads(r.to_json()) == {"status": "warning", "data": {"a": 1}, "warnings": ["w"]} and r.exit_code == 0
    assert state_file.Result(None, error="E002: cycle").exit_code == 2


def test_other_tools(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.json", "b.json", "c.json"))
    json.dump({"modules": [{"source": "./src/a.ts", "dependencies": [{"resolved": "src/b/index.ts"}]}]}, open(a, "w"))
    json.dump({"tree": {"src/a.ts": [{"issuer": "src/a.ts", "id": "src/b/index.ts"}]}}, open(b, "w"))
    json.dump({"edges": [{"source": "x", "target": "y", "type": "calls"}]}, open(c, "w"))
    want = [("src/a", "src/b")]
    assert [tuple(r) for r in oracles.module_list(spark, a).collect()] == want == [tuple(r) for r in oracles.tree(spark, b).collect()]
    assert oracles.pairs(spark, c).count() == 1
    json.dump({"tools": [{"name": "t", "min_version": "1.10.0", "required": True}, {"name": "u", "required": True}]}, open(a, "w"))
    probed = tools.manifest(spark, a).withColumn("output", F.when(F.col("name") == "t", "tool 1.9.3 (x)"))
    got = {r.name: (r.available, r.satisfies_min, r.is_missing) for r in tools.status(probed).collect()}
    assert got == {"t": (True, False, False), "u": (False, None, True)}
    (tmp_path / "adapters" / "go").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        tools.templates(spark, str(tmp_path / "adapters"))
    (tmp_path / "adapters" / "go" / "porting-template.md").write_text("---\nrule_versions: RULE-1:2, RULE-3:1\n---\nbody RULE-9:9\n")
    from graphloom.operators import validate

    t = validate.front_matter_rules(tools.templates(spark, str(tmp_path / "adapters")))
    assert {tuple(r) for r in t.collect()} == {("go", "RULE-1", "2"), ("go", "RULE-3", "1")}


def test_exports(spark):
    nodes = spark.createDataFrame([('file:a"b', "file", 'a"b', "a", False), ("file:a_b", "file", "a_b", "b", False)], "id string, node_type string, name string, file_path string, is_exported boolean")
    edges = spark.createDataFrame([('file:a"b', "file:a_b", "imports", 1.0, None)], "source string, target string, edge_type string, weight double, sub_kind string")
    text = export.dot(nodes, edges)
    assert text.startswith("digraph source {\n") and '"file:a\\"b" -> "file:a_b" [label="imports"];' in text
    assert "file_a_b -->|imports| file_a_b" in export.mermaid(nodes, edges)
    assert export.mermaid_collisions(nodes).first().ids == ['file:a"b', "file:a_b"]
    assert {json.loads(r.json).get("type") for r in export.json_rows(nodes, edges).collect()} == {"file", "imports"}


def test_stream_of_fingerprints(spark, tmp_path):
    source, store = str(tmp_path / "in"), stream.FingerprintStore(spark, str(tmp_path / "store"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), stream.FILES).coalesce(1).write.mode("append").json(source)
        seen = []
        q = stream.follow(spark.readStream.schema(stream.FILES).json(source), store, str(tmp_path / "cp"), lambda c, b: seen.extend(c.collect()))
        q.awaitTermination()
        return {r.file_path: r.change for r in seen}

    assert arrive(("a", "x\n1", 1), ("b", "y", 1)) == {"a": "added", "b": "added"}
    assert arrive(("a", "x\n2", 2), ("b", "z", 2), ("c", "w", 1), ("a", "x\n3", 3)) == {"a": "cosmetic", "b": "structural", "c": "added"}
    assert arrive(("c", "w", 2)) == {"c": "none"}
    assert store.current().count() == 3 and store.batch() == 2
    store.apply(spark.createDataFrame([("a", "late", 9)], stream.FILES), 1)
    assert store.batch() == 2
