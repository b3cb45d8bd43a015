"""Strongly connected components, levels, orders and layers.

Nodes are all file ids; an isolated one is a component of its own.  A component
is named by its smallest member, whichever way it was found.  Up to KERNEL
nodes and edges, counted first, one Arrow task runs Tarjan's algorithm and the
levels; larger graphs are trimmed and coloured round by round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import small
from graphloom.session import cut, ship

KERNEL = 200_000


class CyclicDependency(Exception):
    """The graph has a cycle where an order was asked for; ``cycles`` has them."""

    def __init__(self, cycles: DataFrame):
        super().__init__("the graph has a cycle")
        self.cycles = cycles


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, and a row without a target for each node, in the type of the nodes, whose order names components."""
    kind = edges.schema["source"].dataType
    n = nodes.toDF("source").select(F.col("source").cast(kind).alias("source"), F.lit(None).cast(kind).alias("target"))
    return n.unionByName(edges.select("source", F.col("target").cast(kind).alias("target")))


def tarjan(follow: dict[str, list[str]], nodes: list[str]) -> dict[str, str]:
    """The smallest member of each node's component; no recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    name: dict[str, str] = {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(follow.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            x, rest = work[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    on.add(y)
                    work.append((y, iter(follow.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    up = work[-1][0]
                    low[up] = min(low[up], low[x])
                if low[x] == index[x]:
                    members = []
                    while True:
                        y = stack.pop()
                        on.discard(y)
                        members.append(y)
                        if y == x:
                            break
                    least = min(members)
                    for y in members:
                        name[y] = least
    return name


def levels_of(follow: dict[str, set[str]], nodes: list[str]) -> dict[str, int]:
    """0 for what follows nothing, else one more than the highest that it follows."""
    waiting = {x: len(follow.get(x, ())) for x in nodes}
    users: dict[str, list[str]] = defaultdict(list)
    for x, ys in follow.items():
        for y in ys:
            users[y].append(x)
    level = {x: 0 for x in nodes}
    ready = [x for x in nodes if not waiting[x]]
    while ready:
        x = ready.pop()
        for y in users[x]:
            level[y] = max(level[y], level[x] + 1)
            waiting[y] -= 1
            if not waiting[y]:
                ready.append(y)
    return level


def _kernel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ship(nodes.sparkSession)
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow: dict[str, list[str]] = defaultdict(list)
        every: dict[str, None] = {}
        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every[s] = None
                if t is not None:
                    every[t] = None
                    follow[s].append(t)
        found = sorted(every)
        name = tarjan(follow, found)
        above: dict[str, set[str]] = defaultdict(set)
        for s, ts in follow.items():
            above[name[s]] |= {name[t] for t in ts if name[t] != name[s]}
        level = levels_of(above, sorted(set(name.values())))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type_), pa.array([name[x] for x in found], type_), pa.array([level[name[x]] for x in found], pa.int32())],
                ["node", "component", "level"],
            )

    return _rows(nodes, edges).coalesce(1).mapInArrow(run, f"node {kind}, component {kind}, level int")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: trim what cannot be on a cycle, then colour forwards and collect backwards."""
    left = cut(edges.where("source <> target").select("source", "target").distinct())
    done = None
    while True:
        while True:  # what nothing enters or leaves is alone
            n = left.count()
            entered = left.select(F.col("target").alias("source")).distinct()
            leaving = left.select(F.col("source").alias("target")).distinct()
            left = cut(left.join(entered, "source", "left_semi").join(leaving, "target", "left_semi").select("source", "target"))
            if left.count() == n:
                break
        if left.isEmpty():
            break
        color = cut(left.select(F.col("source").alias("node")).unionByName(left.select(F.col("target").alias("node"))).distinct().withColumn("color", F.col("node")))
        while True:  # the least node that reaches each node
            step = left.join(color.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "color")
            new = cut(color.unionByName(step).groupBy("node").agg(F.min("color").alias("color")))
            if new.join(color, ["node", "color"], "left_anti").isEmpty():
                break
            color = new
        c = color
        same = left.join(c.select(F.col("node").alias("source"), F.col("color").alias("a")), "source").join(
            c.select(F.col("node").alias("target"), F.col("color").alias("b")), "target"
        )
        same = cut(same.where("a = b").select("source", "target", F.col("a").alias("color")))
        found = frontier = cut(color.where("node = color"))
        while not frontier.isEmpty():  # what reaches the least node inside its colour
            step = same.join(frontier.select(F.col("node").alias("target"), "color"), ["target", "color"])
            frontier = cut(step.select(F.col("source").alias("node"), "color").distinct().join(found, ["node", "color"], "left_anti"))
            found = cut(found.unionByName(frontier))
        done = found if done is None else cut(done.unionByName(found))
        gone = found.select(F.col("node").alias("source"))
        left = left.join(gone, "source", "left_anti").join(gone.toDF("target"), "target", "left_anti")
        left = cut(left.select("source", "target"))
    every = nodes.toDF("node").distinct()
    if done is None:
        return every.withColumn("component", F.col("node"))
    joined = every.join(done, "node", "left")
    return joined.select("node", F.coalesce("color", "node").alias("component"))


def _levels(components: DataFrame, edges: DataFrame) -> DataFrame:
    """component, level, peeled from the sinks: a round for each level."""
    a = components.select(F.col("node").alias("source"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("target"), F.col("component").alias("b"))
    above = cut(edges.join(a, "source").join(b, "target").where("a <> b").select("a", "b").distinct())
    left = cut(components.select("component").distinct())
    done, level = None, 0
    while not left.isEmpty():
        busy = above.select(F.col("a").alias("component")).distinct()
        now = cut(left.join(busy, "component", "left_anti").withColumn("level", F.lit(level)))
        done = now if done is None else cut(done.unionByName(now))
        gone = now.select("component")
        left = cut(left.join(gone, "component", "left_anti"))
        above = cut(above.join(gone.toDF("b"), "b", "left_anti").select("a", "b"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def components(nodes: DataFrame, edges: DataFrame, kernel: int = KERNEL) -> DataFrame:
    """node, component, level of every node; nodes is a frame of one column, edges has source and target."""
    edges = edges.select("source", "target").distinct()
    if small(edges, kernel) and nodes.limit(kernel + 1).count() <= kernel:
        return _kernel(nodes, edges)
    found = cut(_components(nodes, edges))
    return found.join(_levels(found, edges), "component").select("node", "component", "level")


def groups(found: DataFrame, edges: DataFrame) -> DataFrame:
    """sprint, members (sorted), is_cycle of each component; a single node is a cycle if it imports itself."""
    loops = edges.where("source = target").select(F.col("source").alias("component")).distinct().withColumn("loop", F.lit(True))
    grouped = found.groupBy("component").agg(
        F.array_sort(F.collect_list("node")).alias("members"), (F.first("level") + 1).alias("sprint")
    )
    return grouped.join(loops, "component", "left").select(
        "component", "sprint", "members", ((F.size("members") > 1) | F.coalesce("loop", F.lit(False))).alias("is_cycle")
    )


def cycles(found: DataFrame, edges: DataFrame) -> DataFrame:
    return groups(found, edges).where("is_cycle").select("members")


def topological_order(found: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """node, position: dependencies first.  Raises CyclicDependency if there is a cycle."""
    bad = cycles(found, edges)
    if not bad.isEmpty():
        raise CyclicDependency(bad)
    ordered = found.select("node", "level").orderBy(F.desc("level") if reverse else "level", F.desc("node") if reverse else "node")
    return ordered.select("node", "level")


def migration_sequence(found: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """groups in order of sprint and first member, the cycles, and the order of all nodes, in which a
    cycle's members stand together."""
    g = groups(found, edges).withColumn("first", F.col("members")[0])
    order = g.select("sprint", "first", F.posexplode("members").alias("place", "node"))
    return {
        "groups": g.orderBy("sprint", "first").select("sprint", "members", "is_cycle"),
        "cycles": g.where("is_cycle").orderBy("first").select("members"),
        "order": order.orderBy("sprint", "first", "place").select("node", "sprint"),
    }


def parallel_groups(found: DataFrame, edges: DataFrame) -> DataFrame:
    """sprint, groups, files, n_groups, n_files: what can be worked on at the same time."""
    g = groups(found, edges)
    return g.groupBy("sprint").agg(
        F.array_sort(F.collect_list("members")).alias("groups"),
        F.count("*").alias("n_groups"),
        F.sum(F.size("members")).cast("long").alias("n_files"),
        F.count_if("is_cycle").alias("n_cycles"),
    )
