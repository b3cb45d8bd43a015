from collections import defaultdict

import pytest
from hypothesis import HealthCheck, Phase, example, given, settings
from hypothesis import strategies as st

from graphloom.operators import closure, scc, usage
from graphloom.operators.graph import Graph, interfaces

CIRCULAR = [
    ("event-bus", "shared"), ("event-bus", "handler"), ("handler", "shared"), ("handler", "emitter"), ("emitter", "shared"),
    ("emitter", "event-bus"),
]


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def nodes_df(spark, names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def plain_reach(pairs):
    follow = defaultdict(set)
    for a, b in pairs:
        follow[a].add(b)
    out = set()
    for s in list(follow):
        seen, stack = set(), list(follow[s])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += follow[x]
        out |= {(s, x) for x in seen if x != s}
    return out


graphs = st.integers(2, 9).flatmap(
    lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=18).map(
        lambda e: (n, [(f"n{a}", f"n{b}") for a, b in e])
    )
)
few = settings(
    max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.generate]
)


@few
@given(graphs)
@example((7, [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n3"), ("n3", "n4"), ("n4", "n3"), ("n5", "n5"), ("n5", "n0")]))
@example((2, []))
def test_kernel_and_rounds_give_the_same(spark, g):
    n, pairs = g
    edges, nodes = edges_df(spark, pairs), nodes_df(spark, [f"n{i}" for i in range(n)])
    want = plain_reach(pairs)
    for kernel in (1000, -1):
        assert {(r.start, r.node) for r in closure.reachable(edges, kernel=kernel).collect()} == want
    both = [{(r.node, r.component, r.level) for r in scc.components(nodes, edges, kernel).collect()} for kernel in (1000, -1)]
    assert both[0] == both[1]
    name = {x: c for x, c, _ in both[0]}
    level = {x: v for x, _, v in both[0]}
    assert len(name) == n
    for a in name:
        for b in name:
            together = a == b or ((a, b) in want and (b, a) in want)
            assert (name[a] == name[b]) == together
    for a, b in pairs:
        if name[a] != name[b]:
            assert level[a] > level[b]
    for a in name:
        below = [level[y] for x, y in pairs if name[x] == name[a] and name[y] != name[a]]
        assert level[a] == max([-1, *below]) + 1


def test_circular_fixture(spark):
    edges = edges_df(spark, CIRCULAR)
    found = scc.components(nodes_df(spark, ["event-bus", "handler", "emitter", "shared", "alone"]), edges)
    got = [(r.sprint, r.members, r.is_cycle) for r in scc.migration_sequence(found, edges)["groups"].collect()]
    assert got == [(1, ["alone"], False), (1, ["shared"], False), (2, ["emitter", "event-bus", "handler"], True)]
    with pytest.raises(scc.CyclicDependency):
        scc.topological_order(found, edges)
    layers = {r.sprint: (r.n_groups, r.n_files, r.n_cycles) for r in scc.parallel_groups(found, edges).collect()}
    assert layers == {1: (2, 2, 0), 2: (1, 3, 1)}


def test_self_loop_is_a_cycle_and_start_is_left_out(spark):
    edges = edges_df(spark, [("a", "a"), ("a", "b")])
    found = scc.components(nodes_df(spark, ["a", "b"]), edges)
    assert [r.members for r in scc.cycles(found, edges).collect()] == [["a"]]
    starts = spark.createDataFrame([("a",)], "x string")
    assert [(r.start, r.node) for r in closure.dependencies(edges, starts).collect()] == [("a", "b")]
    assert [(r.start, r.node) for r in closure.dependents(edges, spark.createDataFrame([("b",)], "x string")).collect()] == [("b", "a")]


def test_topological_order(spark):
    edges = edges_df(spark, [("index", "service"), ("service", "utils"), ("index", "utils")])
    found = scc.components(nodes_df(spark, ["index", "service", "utils"]), edges)
    assert [r.node for r in scc.topological_order(found, edges).collect()] == ["utils", "service", "index"]
    assert [r.node for r in scc.topological_order(found, edges, reverse=True).collect()] == ["index", "service", "utils"]


def test_deep_chain_in_the_kernel():
    n = 50_000
    follow = {str(i): [str(i + 1)] for i in range(n)}
    names = [str(i) for i in range(n + 1)]
    name = scc.tarjan(follow, names)
    assert len(set(name.values())) == n + 1
    assert scc.levels_of({k: set(v) for k, v in follow.items()}, names)["0"] == n


def test_impact_depth_and_fuse(spark):
    chain = edges_df(spark, [(f"n{i + 1}", f"n{i}") for i in range(6)])
    seeds = spark.createDataFrame([("n0",)], "x string")
    found, blown = closure.impact(chain, seeds)
    assert {(r.node, r.depth) for r in found.collect()} == {("n1", 1), ("n2", 2), ("n3", 3)} and not blown
    for extra, want in ((49, False), (50, True)):
        star = edges_df(spark, [("a", "n0"), *((f"b{i}", "a") for i in range(extra))])
        found, blown = closure.impact(star, seeds)
        assert blown == want and found.count() == (1 if want else 50)


def test_connected_degrees_and_paths(spark):
    edges = edges_df(spark, [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), ("b", "g"), ("a", "g")])
    assert {(r.node, r.component) for r in closure.connected(edges).collect()} == {
        ("a", "a"), ("b", "a"), ("c", "a"), ("g", "a"), ("d", "d"), ("e", "d"), ("f", "f"),
    }
    assert {r.node: (r.out_degree, r.in_degree) for r in closure.degrees(edges).collect()}["b"] == (1, 2)
    assert [r.node for r in closure.shortest_path(edges, "a", "g").collect()] == ["a", "g"]
    assert [r.node for r in closure.shortest_path(edges, "c", "g").collect()] == ["c", "b", "g"]
    assert closure.shortest_path(edges, "g", "a").count() == 0


NODE = "id string, node_type string, name string, file_path string, signature string, is_exported boolean"
EDGE = "source string, target string, edge_type string, used_symbols array<string>"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        ("file:src/a.ts", "file", "a.ts", "src/a.ts", None, False),
        ("file:src/b.ts", "file", "b.ts", "src/b.ts", None, False),
        ("file:lib/b.ts", "file", "b.ts", "lib/b.ts", None, False),
        ("function:src/b.ts:x:y", "function", "x:y", "src/b.ts", "x(): é", True),
        ("function:src/b.ts:z", "function", "z", "src/b.ts", None, True),
        ("function:src/b.ts:hid", "function", "hid", "src/b.ts", None, False),
        ("file:src/a.ts", "file", "twice", "src/a.ts", None, False),
    ]
    edges = [
        ("file:src/a.ts", "file:src/b.ts", "imports", ["z"]),
        ("file:src/a.ts", "file:src/b.ts", "imports", ["x:y", "z"]),
        ("file:src/a.ts", "file:lib/b.ts", "imports", None),
        ("file:src/a.ts", "file:lib/b.ts", "imports", ["q"]),
        ("file:src/b.ts", "file:nowhere.ts", "imports", None),
        ("file:src/b.ts", "function:src/b.ts:z", "contains", None),
    ]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def test_integrity_and_counts(graph):
    g = graph.with_integrity()
    assert g.nodes.count() == 6 and g.raw_edges.count() == 5 and graph.dangling().count() == 1
    assert {r.edge_type: (r.built, r.stored) for r in g.edge_counts().collect()} == {"imports": (4, 2), "contains": (1, 1)}
    assert {r.node_type: r.n for r in g.node_counts().collect()} == {"file": 3, "function": 3}


def test_lookups(graph):
    g = graph.with_integrity()
    ids = lambda m: [r.id for r in g.resolve_file(m).collect()]
    assert ids("file:src/a.ts") == ids("src/a.ts") == ids("a.ts") == ["file:src/a.ts"]
    assert ids("b.ts") == ["file:src/b.ts"] and ids("nope") == []
    assert g.symbols_in("src/b.ts").count() == 3 and g.node("function:src/b.ts:z").count() == 1
    assert g.neighbors("file:src/a.ts").count() == 4 and g.neighbors("missing").count() == 0
    assert g.outgoing("imports").count() == 4 and g.incoming("contains").count() == 1
    assert g.import_graph().count() == 2


def test_subgraphs(spark, graph):
    g = graph.with_integrity()
    some = spark.createDataFrame([("file:src/a.ts",), ("file:src/b.ts",)], "x string")
    assert (g.induced(some).nodes.count(), g.induced(some).raw_edges.count()) == (2, 2)
    gone = g.without_files(spark.createDataFrame([("src/b.ts",)], "x string"))
    assert (gone.nodes.count(), gone.raw_edges.count()) == (2, 2)


def test_usage(graph):
    g = graph.with_integrity()
    imports = g.raw_edges.where("edge_type = 'imports'")
    got = {r.target: r.used_symbols for r in usage.imported_symbols(imports).collect()}
    assert got == {"file:src/b.ts": ["x:y", "z"], "file:lib/b.ts": None}
    assert {(r.name, r.tokens) for r in usage.used_interfaces(imports, g.nodes).collect()} == {("x:y", 2), ("z", 1)}
    assert [(r.source, r.tokens) for r in usage.dependency_tokens(imports, g.nodes).collect()] == [("file:src/a.ts", 3)]
    assert {r.name for r in interfaces(g.nodes).collect()} == {"x:y", "z"}
