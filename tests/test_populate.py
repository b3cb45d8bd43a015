import pytest

from graphloom.lang import rust
from graphloom.operators import populate, structure, validate
from graphloom.operators.graph import Graph

RUST = """
// fn not_me() {}
/* fn nor_me() { /* nested */ } */
fn one<'a>(x: &'a str) -> char { if x.is_empty() { 'y' } else { let s = "fn two() { if }"; 'z' } }
pub async fn two() { for i in 0..3 { while true { match i { _ => loop { break } } } } }
"""


def test_rust_measures():
    assert rust.functions(RUST) == 2 and rust.depth(RUST) == 4 and rust.functions("") == 0
    assert rust.functions('let s = r#"fn a() {}"#; fn b() {}') == 1


def test_compare_structure(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, language string, content string")
    source = files(("a.py", "python", "def f():\n    if 1:\n        for x in y:\n            pass\n"), ("b.go", "go", "package b\nfunc F() {}\n"), ("c.py", "python", "def ("))
    target = files(("a.rs", "rust", "fn f() {\n if x { for y in z {} }\n}\nfn g() {}\n"))
    pairs = spark.createDataFrame([("m", "a.py", "a.rs"), ("n", "b.go", "b.rs"), ("o", "c.py", None)], "module string, source_path string, target_path string")
    got = {r.module: r for r in structure.compare(pairs, source, target).collect()}
    assert (got["m"].source_code, got["m"].target_code, got["m"].code_ratio) == (4, 4, 1.0)
    assert (got["m"].functions_ratio, got["m"].nesting_ratio) == (2.0, 1.0)
    assert got["n"].source_functions == 1 and got["n"].source_nesting is None and got["n"].code_ratio is None
    assert got["o"].source_functions is None


def small(spark):
    names = ["file:d/a", "file:d/b", "file:e/c", "file:e/x", "file:e/y"]
    nodes = spark.createDataFrame([(n, "file", n[5:], n[5:]) for n in names], "id string, node_type string, name string, file_path string")
    edges = [("file:e/c", "file:d/a", "imports"), ("file:e/x", "file:e/y", "imports"), ("file:e/y", "file:e/x", "imports")]
    graph = Graph(nodes, spark.createDataFrame(edges, "source string, target string, edge_type string"))
    rows = [(n, "full" if n.endswith("b") else "trivial", "normal", ["ffi"] if n.endswith("b") else [], not n.endswith("c"), 10, 1) for n in names]
    files = spark.createDataFrame(rows, "file string, tier string, kind string, danger array<string>, classified boolean, size int, footprint int")
    return graph, files


def test_populate(spark):
    graph, files = small(spark)
    got = {r.module: r for r in populate.populate(graph, files, budget=20).collect()}
    assert set(got) == {"file:d/a", "file:e/c", "file:e/x"}
    batch, cycle, single = got["file:d/a"], got["file:e/x"], got["file:e/c"]
    assert (batch.composite_kind, batch.tier, batch.danger, batch.member_files) == ("batch", "full", ["ffi"], ["file:d/a", "file:d/b"])
    assert cycle.composite_kind == "cycle" and single.composite_kind is None and single.danger_provenance == "partially_classified"
    plain = populate.populate(graph, files, budget=None)
    assert plain.count() == 4 and {r.danger_provenance for r in plain.collect()} == {"unclassified"}
    fresh = populate.populate(graph, files, plain, 20)
    assert [r.module for r in populate.orphans(plain, fresh).collect()] == ["file:d/b"]
    with pytest.raises(populate.Refused):
        populate.populate(graph, files, plain.withColumn("status", plain.status.substr(1, 3)), 20)
    with pytest.raises(populate.Refused):
        populate.populate(graph, files.selectExpr("file", "tier", "kind", "danger", "false as classified", "size", "footprint"))
    assert {r.tier: r.n for r in populate.tier_histogram(files).collect()} == {"full": 1, "trivial": 4}


def test_rules_up_to_a_tier():
    rules = [("a", "trivial", list), ("b", "full", lambda: ["bad"])]
    assert validate.run_rules(rules, "standard") == [("a", "trivial", [])]
    assert validate.run_rules(rules, "full")[1] == ("b", "full", ["bad"])
