import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, compare, decompose, partitions, quality, resolve, scc


def plain_plan(groups, follows, weight, budget):
    """Greedy merging with everything computed anew each time."""
    units = [
        {"m": sorted(g["members"]), "z": g["is_cycle"], "s": g["self_size"], "f": g["footprint"], "p": g["sprint"], "g": {i}}
        for i, g in enumerate(groups)
    ]

    def where(u):
        return decompose.directory(u["m"])

    for u in units:
        u["d"] = where(u)
    for same in (True, False):
        while True:
            of = {g: k for k, u in enumerate(units) for g in u["g"]}
            down = {k: set() for k in range(len(units))}
            for a, bs in follows.items():
                down[of[a]] |= {of[b] for b in bs} - {of[a]}
            reach = {}
            for k in down:
                seen, stack = set(), list(down[k])
                while stack:
                    x = stack.pop()
                    if x not in seen:
                        seen.add(x)
                        stack += down[x]
                reach[k] = seen
            w = {}
            for (a, b), n in weight.items():
                if of[a] != of[b]:
                    key = tuple(sorted((of[a], of[b])))
                    w[key] = w.get(key, 0) + n
            pairs = []
            for a in range(len(units)):
                for b in range(a + 1, len(units)):
                    if units[a]["z"] or units[b]["z"]:
                        continue
                    if same and (units[a]["d"] is None or units[a]["d"] != units[b]["d"]) or not same and (a, b) not in w:
                        continue
                    keys = sorted(("\n".join(units[a]["m"]), "\n".join(units[b]["m"])))
                    pairs.append((-w.get((a, b), 0), *keys, a, b))
            for _, _, _, a, b in sorted(pairs):
                if units[a]["s"] + units[b]["s"] > budget:
                    continue
                s = {a, b}
                if any(x not in s and x in reach[a] | reach[b] and reach[x] & s for x in range(len(units))):
                    continue
                u, v = units[a], units[b]
                units[a] = {
                    "m": sorted(u["m"] + v["m"]), "z": False, "s": u["s"] + v["s"], "f": u["f"] + v["f"], "p": min(u["p"], v["p"]),
                    "g": u["g"] | v["g"], "d": u["d"] if u["d"] == v["d"] else None,
                }
                del units[b]
                break
            else:
                break
    return sorted(tuple(u["m"]) for u in units)


def random_case(seed):
    rng = random.Random(seed)
    n = rng.randrange(4, 16)
    level = [rng.randrange(4) for _ in range(n)]
    groups = [
        {"members": [f"file:d{rng.randrange(3)}/f{i:02}"], "is_cycle": rng.random() < 0.15, "self_size": rng.randrange(1, 8), "footprint": i, "sprint": level[i] + 1}
        for i in range(n)
    ]
    follows, weight = {}, {}
    for _ in range(rng.randrange(30)):
        a, b = rng.randrange(n), rng.randrange(n)
        if level[a] > level[b]:
            follows.setdefault(a, set()).add(b)
            key = (min(a, b), max(a, b))
            weight[key] = weight.get(key, 0) + 1
    return groups, follows, weight


def test_merging_equals_a_full_search_each_time():
    for seed in range(150):
        groups, follows, weight = random_case(seed)
        for budget in (6, 14, 1000):
            got = sorted(tuple(u.members) for u in decompose._Merger(groups, follows, weight, budget).run())
            assert got == plain_plan(groups, follows, weight, budget), seed


def test_plan_of_many_groups(spark):
    """More groups than a search over all pairs of a folder can take: uncoupled files go together in the order of their names."""
    files = spark.range(20_100).selectExpr("concat('file:d', id % 3, '/p', id) AS id")
    groups = files.select(F.array("id").alias("members"), F.lit(1).alias("sprint"), F.lit(False).alias("is_cycle"))
    none = spark.createDataFrame([], "source string, target string, edge_type string")
    units = decompose.plan(groups, none, files.select("id", F.lit(5).alias("self_size"), F.lit(1).alias("footprint")), 64)
    want = []
    for d in range(3):
        own = sorted(f"file:d{d}/p{i}" for i in range(d, 20_100, 3))
        want += [own[i : i + 12] for i in range(0, len(own), 12)]
    assert [u.members for u in units] == want


def test_merging_of_names_that_sort_before_a_line_break():
    for seed in range(40):
        groups, follows, weight = random_case(seed)
        for i, g in enumerate(groups):
            g["members"] = [m.replace("/f", "/f\t" if i % 3 else "/f\x01") for m in g["members"]]
        got = sorted(tuple(u.members) for u in decompose._Merger(groups, follows, weight, 14).run())
        assert got == plain_plan(groups, follows, weight, 14), seed


def test_merging_where_labels_run_out(monkeypatch):
    monkeypatch.setattr(decompose, "GAP", 2)
    test_merging_equals_a_full_search_each_time()


def fixture(spark):
    names = [f"file:d{i % 3}/f{i}" for i in range(12)]
    rng = random.Random(4)
    pairs = [(names[a], names[b], "imports") for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(20)) if a > b]
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    edges = spark.createDataFrame(pairs, "source string, target string, edge_type string")
    sizes = nodes.select("id", F.lit(10).alias("self_size"), F.lit(3).alias("footprint"))
    groups = scc.groups(scc.components(nodes, edges), edges)
    return nodes, edges, sizes, groups


def test_plan_over_frames(spark):
    nodes, edges, sizes, groups = fixture(spark)
    units = decompose.plan(groups, edges, sizes, 40)
    found = decompose.invariants(units, edges, 12)
    assert found["partition_ok"] and found["dag_acyclic"] and found["over_budget_count"] == 0
    again = decompose.plan(groups.repartition(7), edges.repartition(3), sizes, 40)
    assert decompose.canonical_hash(units) == decompose.canonical_hash(again) == found["plan_hash"]
    assert decompose.canonical_hash_frame(decompose.plan_frame(spark, units)).first().plan_hash == found["plan_hash"]
    assert {u.kind for u in decompose.plan(groups, edges, sizes, 5)} == {"manual_over_budget"}
    metrics = decompose.target_metrics(units, 12, 12)
    assert metrics["units"] == len(units) and 0 < metrics["reduction_rate"] < 1
    c = decompose.cohesion(units, edges, samples=5)
    assert 0 <= c["actual"] <= 1 and c["batched_files"] == sum(len(u.members) for u in units if u.kind == "batch")
    assert decompose.cohesion([], edges)["ratio"] == 1.0 and decompose.cohesion_passes(decompose.cohesion([], edges))


def test_draws_are_fixed_and_keep_sizes():
    a = decompose.shuffles(["a", "b", "c", "d"], [3, 1], 7, 4)
    assert a == decompose.shuffles(["a", "b", "c", "d"], [3, 1], 7, 4) and len(a) == 4
    assert all(sorted(f for f, _ in x) == ["a", "b", "c", "d"] and sorted(b for _, b in x) == [0, 0, 0, 1] for x in a)


def test_draws_go_on_from_one_another():
    x, mask = 7, (1 << 64) - 1
    for k in range(5):
        order = list(range(30))
        for i in range(29, 0, -1):
            x ^= x << 13 & mask
            x ^= x >> 7
            x ^= x << 17 & mask
            j = (x * 0x2545F4914F6CDD1D & mask) % (i + 1)
            order[i], order[j] = order[j], order[i]
        assert decompose.drawn(30, k, 7) == order


def plain_mq(batch, edges):
    inner = sum(batch.get(a) is not None and batch.get(a) == batch.get(b) for a, b in edges)
    ends = sum(1 if batch.get(a) is not None and batch.get(a) == batch.get(b) else (a in batch) + (b in batch) for a, b in edges)
    return inner / ends, ends


def test_cohesion_query_of_many_files(spark, tmp_path):
    from graphloom.plans import catalogue

    spark.range(20_100).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(4_000).selectExpr("id DIV 2 AS l_orderkey", "id % 2 + 1 AS l_linenumber", "id * 31 % 20100 AS l_partkey", "0.1D AS l_discount", "'A' AS l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    row = catalogue.QUERIES["cohesion"](spark, str(tmp_path)).first()
    name = lambda i: f"file:b{i % 20}/p{i}"
    edges = {(name(2 * k * 31 % 20_100), name((2 * k + 1) * 31 % 20_100)) for k in range(2_000)}
    plan = catalogue.QUERIES["decompose_plan"](spark, str(tmp_path)).orderBy("unit").collect()
    batches = [r.members for r in plan if r.kind == "batch"]
    assert row.batched_files == sum(map(len, batches)) > 20_000
    actual, ends = plain_mq({m: i for i, own in enumerate(batches) for m in own}, edges)
    assert (row.actual, row.coupling_edges) == (pytest.approx(actual), ends)
    drawn = decompose.shuffles(sorted(m for own in batches for m in own), [len(own) for own in batches], samples=20)
    assert row.baseline == pytest.approx(sum(plain_mq(dict(x), edges)[0] for x in drawn) / 20)


def test_cohesion_query_takes_all_draws(spark, tmp_path):
    from graphloom.plans import catalogue

    spark.range(300).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(600).selectExpr("id DIV 2 AS l_orderkey", "id % 2 + 1 AS l_linenumber", "id * 31 % 300 AS l_partkey", "0.1D AS l_discount", "'A' AS l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    row = catalogue.QUERIES["cohesion"](spark, str(tmp_path)).first()
    name = lambda i: f"file:b{i % 20}/p{i}"
    edges = {(name(2 * k * 31 % 300), name((2 * k + 1) * 31 % 300)) for k in range(300)}
    plan = catalogue.QUERIES["decompose_plan"](spark, str(tmp_path)).orderBy("unit").collect()
    batches = [r.members for r in plan if r.kind == "batch"]
    files = sorted(m for own in batches for m in own)
    each = [plain_mq(dict(x), edges)[0] for x in decompose.shuffles(files, [len(own) for own in batches], samples=100)]
    assert row.batched_files == len(files) and row.baseline == pytest.approx(sum(each) / 100) != pytest.approx(sum(each[:20]) / 20)
    assert row.ratio == pytest.approx(row.actual / row.baseline)


def test_cohesion_of_edges_that_leave_the_batches(spark):
    rng = random.Random(8)
    units = [decompose.Unit([f"u{k}/f{i}" for i in range(k % 4 + 1)], ("single", "batch", "batch", "cycle")[k % 4], 1, 0) for k in range(20)]
    every = [m for u in units for m in u.members] + ["x", "y"]
    pairs = [(rng.choice(every), rng.choice(every)) for _ in range(200)] + [("u1/f0", "u1/f1")] * 9 + [("u2/f0", "u2/f0"), ("x", "y")]
    edges = spark.createDataFrame([(*p, "imports") for p in pairs] + [("u1/f0", "u1/f1", "calls")], "source string, target string, edge_type string")
    batches = [u.members for u in units if u.kind == "batch"]
    actual, ends = plain_mq({m: i for i, own in enumerate(batches) for m in own}, pairs)
    drawn = decompose.shuffles(sorted(m for own in batches for m in own), [len(own) for own in batches], 5, 7)
    found = decompose.cohesion(units, edges.repartition(3), 5, 7)
    assert (found["actual"], found["coupling_edges"]) == (pytest.approx(actual), ends)
    assert found["baseline"] == pytest.approx(sum(plain_mq(dict(x), pairs)[0] for x in drawn) / 7)
    for none in (edges.limit(0), edges.where("source = 'x' AND target = 'y'"), edges.where("edge_type = 'calls'")):
        found = decompose.cohesion(units, none)
        assert (found["actual"], found["baseline"], found["ratio"], found["coupling_edges"]) == (0.0, 0.0, 1.0, 0)
        assert found["batched_files"] == sum(map(len, batches)) and decompose.cohesion_passes(found)


def test_weighted_cohesion(spark):
    imports = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("c", "x", 2), ("x", "y", 3)], "source string, target string, edge long")
    assigned = spark.createDataFrame([(0, "a", 0), (0, "b", 0), (0, "c", 1)], "sample int, file string, batch long")
    row = decompose.weighted_cohesion(imports, assigned).first()
    assert (row.mq, row.edges) == (pytest.approx(1 / 4), 4)


def test_communities(spark):
    two = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 1.0)]
    found = community.louvain_level([f"{g}{i}" for g in "ab" for i in range(4)], two)
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and found["a1"] != found["b1"]
    assert community.louvain_level(["x", "y"], []) == {"x": "x", "y": "y"}
    files = spark.createDataFrame([(f"file:{g}/{g}{i}",) for g in "ab" for i in range(4)], "id string")
    imports = spark.createDataFrame([(f"file:{a[0]}/{a}", f"file:{b[0]}/{b}") for a, b, _ in two], "source string, target string")
    out = community.deviation(files, imports)
    assert out["nmi"] == pytest.approx(1) and out["ari"] == pytest.approx(1) and not out["warn"]
    assert community.deviation(files.limit(1), imports)["deviation"] == 0.0


def test_communities_by_component(spark):
    rng = random.Random(5)
    pairs = [(f"{g}{rng.randrange(12):02}", f"{g}{rng.randrange(12):02}") for g in "abcdefgh" for _ in range(rng.randrange(1, 30))]
    pairs += [("a01", "b01"), ("c02", "d03")]
    files = spark.createDataFrame([(f"{g}{i:02}",) for g in "abcdefghi" for i in range(12)], "id string")
    imports = spark.createDataFrame(pairs, "source string, target string")
    one, many = (dict(map(tuple, community.communities(files, imports, kernel).collect())) for kernel in (1000, 3))
    assert one == many and len(one) == 108 and len(set(one.values())) < 80


def test_communities_of_more_pairs_than_one_task_takes(spark):
    k = 520_000
    imports = spark.range(k).selectExpr("concat('a', id) AS source", "concat('b', id) AS target")
    files = imports.selectExpr("source AS id").unionByName(imports.selectExpr("target AS id"))
    found = community.communities(files, imports)
    assert found.count() == 2 * k and found.select("community").distinct().count() == k


def test_partition_measures(spark):
    def measures(rows):
        t = partitions.contingency(spark.createDataFrame(rows, "a string, b string"), "a", "b")
        return partitions.nmi(t).first().nmi, partitions.ari(t).first().ari

    assert measures([("x", "p"), ("x", "p"), ("y", "q"), ("y", "q")]) == (pytest.approx(1), pytest.approx(1))
    assert measures([("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")]) == (pytest.approx(0, abs=1e-9), pytest.approx(-0.5))
    assert measures([("x", "p")]) == (1.0, 1.0) and measures([("x", "p"), ("x", "p")]) == (1.0, 1.0)
    p = {r.group: (r.primary, r.purity) for r in partitions.purity(spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "c")], "g string, l string"), "g", "l").collect()}
    assert p == {"g": ("a", 0.5), "h": ("c", 1.0)}


def test_scores_of_empty_sets(spark):
    some, none = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([], "k string")
    score = lambda a, b: tuple(compare.precision_recall(a, b).select("precision", "recall", "f1").first())
    assert score(none, none) == (1.0, 1.0, 1.0) and score(some, none) == (0.0, 0.0, 0.0) and score(some, some) == (1.0, 1.0, 1.0)
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    assert not compare.two_oracles(e, e.limit(0), e).first().passed and compare.two_oracles(e, e, e).first().passed


def test_reexports(spark):
    own = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "file string, symbol string")
    named = spark.createDataFrame([("barrel", "z", "a", "x"), ("barrel", "lost", "a", "nowhere")], "file string, symbol string, target string, original string")
    stars = spark.createDataFrame([("barrel", 0, "loop"), ("loop", 0, "barrel"), ("barrel", 1, "a"), ("barrel", 2, "b")], "file string, seq int, target string")
    asked = spark.createDataFrame([("barrel", s) for s in ("x", "y", "z", "lost", "none")] + [("a", "x")], "file string, symbol string")
    got = {(r.file, r.symbol): (r.origin, r.original) for r in resolve.reexport_origins(own, named, stars, asked).collect()}
    assert got == {
        ("barrel", "x"): ("a", "x"), ("barrel", "y"): ("b", "y"), ("barrel", "z"): ("a", "x"), ("barrel", "lost"): ("a", "nowhere"), ("a", "x"): ("a", "x"),
    }


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a/index.ts", "src/b.tsx", "pkg/__init__.py", "pkg/m.py", "u/b.go", "u/a.go", "u/a_test.go")], "path string")
    s = lambda *rows: spark.createDataFrame(list(rows), "file string, specifier string")
    got = {r.specifier: r.target for r in resolve.resolve_relative(s(("src/x.ts", "./a"), ("src/x.ts", "./b.js"), ("src/x.ts", "../../a"), ("src/x.ts", "lib")), files).collect()}
    assert got == {"./a": "src/a.ts", "./b.js": "src/b.tsx"}
    got = {r.specifier: r.target for r in resolve.resolve_python(s(("pkg/x.py", ".m"), ("pkg/x.py", "pkg"), ("pkg/x.py", "."), ("pkg/x.py", "...m"), ("pkg/x.py", "pkg.m")), files).collect()}
    assert got == {".m": "pkg/m.py", "pkg": "pkg/__init__.py", ".": "pkg/__init__.py", "pkg.m": "pkg/m.py"}
    got = {r.specifier: r.target for r in resolve.resolve_go(s(("m.go", "ex.com/p/u"), ("m.go", "ex.com/pp/u")), files, "ex.com/p").collect()}
    assert got == {"ex.com/p/u": "u/a.go"}


def test_lines_and_roll_up(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\n# note\n\ny = 2\n"), ("a.go", "go", "// c\nfunc f() {}"), ("test_a.py", "python", "z\n"), ("e.py", "python", "")], "path string, language string, content string")
    lines = {r.path: (r.code, r.comments, r.blanks) for r in quality.lines_by_file(files).collect()}
    assert lines == {"a.py": (2, 1, 1), "a.go": (1, 1, 0), "test_a.py": (1, 0, 0), "e.py": (0, 0, 0)}
    assert quality.lines_by_file(files, True).count() == 3
    report = {r.language: (r.files, r.code) for r in quality.loc_report(quality.lines_by_file(files)).collect()}
    assert report == {"python": (3, 3), "go": (1, 1), None: (4, 4)}
    assert quality.primary_language(quality.lines_by_file(files)).first().language == "python"
    assert quality.project_ratio(files, files.limit(0)).first().loc_ratio == 0.0 and quality.project_ratio(files.limit(0), files).first().loc_ratio is None
    kinds = spark.createDataFrame([("f1", "full", ["b"], True), ("f2", "trivial", ["a", "b"], True), ("f3", "standard", [], False)], "file string, tier string, danger array<string>, classified boolean")
    members = spark.createDataFrame([("m", "f1"), ("m", "f2"), ("n", "f3"), ("n", "f9")], "module string, file string")
    got = {r.module: (r.tier, r.danger, r.danger_provenance) for r in quality.roll_up(kinds, members).collect()}
    assert got == {"m": ("full", ["a", "b"], "classified"), "n": ("standard", [], "partially_classified")}


def test_modules_of_every_supplier(spark, tmp_path):
    from graphloom.plans import catalogue

    spark.range(1500).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalogue.QUERIES["coverage_stats"](spark, str(tmp_path)).first()["total"] == 1500
