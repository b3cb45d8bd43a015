"""Budgeted convex clustering of files into units of work, and how cohesive the units are.

Greedy merging is sequential: each merge changes what may merge next.  The
input is the condensed graph, which the frames below reduce first; the merging
runs in one Arrow task, whose memory follows the groups and their edges.  A
list of the units in topological order bounds the search for what lies between
two, and each merge moves only what its search has found.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.session import cut, ship

BUDGET = 12_000
GAP = 1 << 60  # between the labels of neighbours in the merger's list
SEED, SAMPLES, ONLY_ACTUAL = 0x00FFEE15, 100, 999.0
RATIO, FLOOR, NOTHING = 1.5, 0.5, 1e-9
COUPLING = ("imports", "calls", "extends", "uses_type")


@dataclass
class Unit:
    members: list[str]
    kind: str
    footprint: int
    sprint: int


def directory(members: Iterable[str]) -> str | None:
    """The direct parent folder that all members share, if they do."""
    found = {m.split(":", 1)[-1].rpartition("/")[0] for m in members}
    return found.pop() if len(found) == 1 else None


class _Merger:
    """Units by number; a merged unit keeps the number of the part whose key is first."""

    def __init__(self, groups: list[dict], follows: dict[int, set[int]], coupling: dict[tuple[int, int], int], budget: int):
        n = len(groups)
        self.budget = budget
        self.members = [sorted(g["members"]) for g in groups]
        self.frozen = [g["is_cycle"] for g in groups]
        self.size = [g["self_size"] for g in groups]
        self.footprint = [g["footprint"] for g in groups]
        self.sprint = [g["sprint"] for g in groups]
        self.dir = [directory(m) for m in self.members]
        # members that sort before a line break would make a key's place change when it grows
        self.plain = not any(min(m) <= "\n" for own in self.members for m in own if m)
        self.down: dict[int, set[int]] = {x: set(ys) for x, ys in follows.items() if ys}
        self.up: dict[int, set[int]] = {}
        for x, ys in self.down.items():
            for y in ys:
                self.up.setdefault(y, set()).add(x)
        self.weight: dict[int, dict[int, int]] = {}
        for (a, b), w in coupling.items():
            for x, y in ((a, b), (b, a)):
                own = self.weight.setdefault(x, {})
                own[y] = own.get(y, 0) + w
        self.alive = [True] * n
        self.merges = [0] * n  # how often a unit grew: pairs of its earlier states are stale
        if self.plain:  # keys keep the order of their first members
            self.key: list = [0] * n
            for place, x in enumerate(sorted(range(n), key=lambda i: self.members[i][0])):
                self.key[x] = place
        else:
            self.key = ["\n".join(m) for m in self.members]
        self._order()

    def _order(self) -> None:
        """A linked list in which units stand behind all that they follow, with labels that tell the order of any two."""
        n = len(self.alive)
        waiting = [len(self.down.get(x, ())) for x in range(n)]
        order = [x for x in range(n) if not waiting[x]]
        for x in order:
            for y in self.up.get(x, ()):
                waiting[y] -= 1
                if not waiting[y]:
                    order.append(y)
        self.label = [0] * (n + 2)
        self.before, self.after = [0] * (n + 2), [0] * (n + 2)  # n is the head, n + 1 the end
        line = [n, *order, n + 1]
        for x, y in itertools.pairwise(line):
            self.after[x], self.before[y] = y, x
        for i, x in enumerate(line):
            self.label[x] = i * GAP

    def _put(self, moved: list[int], low: int) -> None:
        """Take these units out of the list and put them behind ``low``, in their order."""
        before, after, label = self.before, self.after, self.label
        for x in moved:
            after[before[x]], before[after[x]] = after[x], before[x]
        high = after[low]
        space = (label[high] - label[low]) // (len(moved) + 1)
        at = low
        for i, x in enumerate(moved, 1):
            after[at], before[x], label[x] = x, at, label[low] + i * space
            at = x
        after[at], before[high] = high, at
        if not space:  # no room between the two
            x, i = len(self.alive), 0
            while True:
                label[x] = i * GAP
                if x == len(self.alive) + 1:
                    break
                x, i = after[x], i + 1

    def between(self, a: int, b: int) -> tuple[int, int, list[int]] | None:
        """None if anything lies between the two, else how the order allows their merging.

        A path can only lead down from the later one in the list, over units that
        stand between the two.  Both ends are searched, the smaller front first.
        Once one of them is done, the units that it has found move past the other
        end, and there the merged unit stands: (lower end, upper end, units that move to the end named last).
        """
        label = self.label
        low, high = (a, b) if label[a] < label[b] else (b, a)
        least, most = label[low], label[high]
        edges = self.down, self.up
        fronts = [
            [y for y in self.down.get(high, ()) if label[y] > least],
            [y for y in self.up.get(low, ()) if label[y] < most],
        ]
        seen = [set(fronts[0]), set(fronts[1])]
        if not seen[0].isdisjoint(seen[1]):
            return None
        while fronts[0] and fronts[1]:
            k = len(fronts[0]) > len(fronts[1])
            mine, other, step = seen[k], seen[1 - k], edges[k]
            new = []
            for x in fronts[k]:
                for y in step.get(x, ()):
                    if y not in mine and least < label[y] < most:
                        if y in other:
                            return None
                        mine.add(y)
                        new.append(y)
            fronts[k] = new
        k = bool(fronts[0])
        return (low, high, sorted(seen[k], key=label.__getitem__)) if k else (high, low, sorted(seen[k], key=label.__getitem__))

    def pair(self, a: int, b: int) -> tuple:
        """Most coupled first, then by the smaller and the larger key."""
        if self.key[b] < self.key[a]:
            a, b = b, a
        return -self.weight.get(a, {}).get(b, 0), self.key[a], self.key[b], a, b, self.merges[a], self.merges[b]

    def fresh(self, pair: tuple) -> bool:
        _, _, _, a, b, at_a, at_b = pair
        return self.alive[a] and self.alive[b] and self.merges[a] == at_a and self.merges[b] == at_b

    def coupled(self, x: int, same_dir: bool) -> list[int]:
        """What x may merge with, of the units that it is coupled to."""
        if self.frozen[x] or same_dir and self.dir[x] is None:
            return []
        room = self.budget - self.size[x]
        return [
            y for y in self.weight.get(x, ()) if not self.frozen[y] and self.size[y] <= room and not (same_dir and self.dir[y] != self.dir[x])
        ]

    def merge(self, a: int, b: int, room: tuple[int, int, list[int]]) -> int:
        """Merge two units that nothing lies between, as ``between`` says how; the number of both."""
        leaves, stays, moved = room
        self._put(moved, stays if self.label[leaves] < self.label[stays] else self.before[stays])
        if self.key[b] < self.key[a]:
            a, b = b, a
        before, after = self.before, self.after
        after[before[leaves]], before[after[leaves]] = after[leaves], before[leaves]
        if stays != a:
            before[a], after[a], self.label[a] = before[stays], after[stays], self.label[stays]
            after[before[a]] = before[after[a]] = a
        for edges, back in ((self.down, self.up), (self.up, self.down)):
            own = edges.setdefault(a, set())
            for y in edges.pop(b, ()):
                back[y].discard(b)
                if y != a:
                    own.add(y)
                    back[y].add(a)
        mine = self.weight.setdefault(a, {})
        for c, w in self.weight.pop(b, {}).items():
            other = self.weight[c]
            del other[b]
            if c != a:
                mine[c] = other[a] = mine.get(c, 0) + w
        self.members[a] += self.members[b]
        self.members[b] = []
        if not self.plain:
            self.key[a] = "\n".join(sorted(self.members[a]))
        self.size[a] += self.size[b]
        self.footprint[a] += self.footprint[b]
        self.sprint[a] = min(self.sprint[a], self.sprint[b])
        self.dir[a] = self.dir[a] if self.dir[a] == self.dir[b] else None
        self.alive[b] = False
        self.merges[a] += 1
        return a

    def by_coupling(self, heap: list[tuple], same_dir: bool) -> None:
        """Merge the first pair that fits, again and again.

        A pair that something lies between, or that is over budget, stays so until
        one of the two merges, as merging elsewhere only adds ways.  So a heap in
        which merged units are stale gives the order of a full search each time.
        """
        heapq.heapify(heap)
        while heap:
            pair = heapq.heappop(heap)
            if self.fresh(pair) and (room := self.between(pair[3], pair[4])):
                a = self.merge(pair[3], pair[4], room)
                for y in self.coupled(a, same_dir):
                    heapq.heappush(heap, self.pair(a, y))

    def by_folder(self) -> None:
        """The uncoupled pairs of folders, once no coupled pair fits: by the first key, then the second.

        A unit that fits with none in its folder fits with no union of two of them
        either: the union is larger, and of the two only one can lie between the
        unit and the other.  So the units are taken once, in the order of their
        keys.  While uncoupled units join one, what did not fit still does not;
        only pairs of the grown unit can become coupled pairs that fit, and they
        come first.
        """
        inside = [x for x in range(len(self.alive)) if self.alive[x] and not self.frozen[x] and self.dir[x] is not None]
        inside.sort(key=self.key.__getitem__)
        places: dict[str, list[int]] = {}
        at = {}
        for x in inside:
            own = places.setdefault(self.dir[x], [])
            at[x] = len(own)
            own.append(x)
        gone = np.iinfo(np.int64).max
        sizes = {d: np.array([self.size[x] for x in own], np.int64) for d, own in places.items()}
        for a in inside:
            if not self.alive[a]:
                continue
            own, size = places[self.dir[a]], sizes[self.dir[a]]
            begin = at[a] + 1
            while found := self._next(a, own, size, begin):
                b, room = found
                joined = b not in self.down.get(a, ()) and b not in self.up.get(a, ())
                self.merge(a, b, room)
                size[at[b]] = gone
                heap = self._later(a)
                while heap:
                    y = heapq.heappop(heap)[4]
                    if room := self.between(a, y):
                        self.merge(a, y, room)
                        size[at[y]] = gone
                        joined = False
                        heap = self._later(a)
                begin = (at[b] if joined else at[a]) + 1
            size[at[a]] = gone

    def _later(self, a: int) -> list[tuple]:
        """A heap of a's coupled pairs in its folder, with units of later keys: earlier ones fit with nothing."""
        heap = [self.pair(a, y) for y in self.coupled(a, True) if self.key[a] < self.key[y]]
        heapq.heapify(heap)
        return heap

    def _next(self, a: int, own: list[int], size: np.ndarray, begin: int) -> tuple[int, tuple[int, int, list[int]]] | None:
        """The first unit from a place on that is small enough and has nothing between it and a, and how they merge."""
        most, step = self.budget - self.size[a], 256
        while begin < len(own):
            for i in np.flatnonzero(size[begin : begin + step] <= most).tolist():
                if room := self.between(a, own[begin + i]):
                    return own[begin + i], room
            begin += step
            step = min(step * 4, 1 << 16)
        return None

    def run(self) -> list[Unit]:
        """Folders first, then any coupled pairs."""
        n = range(len(self.alive))
        self.by_coupling([self.pair(x, y) for x in n for y in self.coupled(x, True) if x < y], True)
        if self.plain:
            self.by_folder()
        else:
            self._folder_pairs()
        self.by_coupling([self.pair(x, y) for x in n if self.alive[x] for y in self.coupled(x, False) if x < y], False)
        out = []
        for x in n:
            if not self.alive[x]:
                continue
            members = sorted(self.members[x])
            if self.frozen[x]:
                kind = "cycle"
            elif len(members) > 1:
                kind = "batch"
            else:
                kind = "manual_over_budget" if self.size[x] > self.budget else "single"
            out.append(Unit(members, kind, self.footprint[x], self.sprint[x]))
        return sorted(out, key=lambda u: u.members[0])

    def _folder_pairs(self) -> None:
        """by_folder for names whose keys change their order as they grow: all pairs of folders in one heap."""
        places: dict[str, set[int]] = defaultdict(set)
        for x in range(len(self.alive)):
            if self.alive[x] and not self.frozen[x] and self.dir[x] is not None:
                places[self.dir[x]].add(x)
        fits = lambda x, y: self.size[x] + self.size[y] <= self.budget
        heap = [self.pair(x, y) for own in places.values() for x in own for y in own if x < y and fits(x, y)]
        heapq.heapify(heap)
        while heap:
            pair = heapq.heappop(heap)
            a, b = pair[3], pair[4]
            if self.fresh(pair) and (room := self.between(a, b)):
                place = places[self.dir[a]]
                place -= {a, b}
                a = self.merge(a, b, room)
                for y in place:
                    if fits(a, y):
                        heapq.heappush(heap, self.pair(a, y))
                place.add(a)


PLAN = "unit int, members array<string>, kind string, footprint long, sprint int"


def plan_rows(groups: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """unit, members, kind, footprint, sprint of the units over the components of a graph, merged in one Arrow task.

    groups: members, sprint, is_cycle; edges: source, target, edge_type of any
    nodes; sizes: id, self_size, footprint of files.
    """
    flat = groups.select(F.col("members")[0].alias("g"), "sprint", "is_cycle", "members", F.explode("members").alias("id"))
    summed = (
        flat.join(sizes, "id", "left")
        .groupBy("g")
        .agg(
            F.first("sprint").cast("int").alias("sprint"),
            F.first("is_cycle").alias("is_cycle"),
            F.first("members").alias("members"),
            F.coalesce(F.sum("self_size"), F.lit(0)).cast("long").alias("self_size"),
            F.coalesce(F.sum("footprint"), F.lit(0)).cast("long").alias("footprint"),
        )
    )
    of_path = flat.select(scalar.node_path(F.col("id")).alias("path"), "g")
    ends = edges.where(F.col("edge_type").isin(*COUPLING)).select(
        scalar.node_path(F.col("source")).alias("sp"), scalar.node_path(F.col("target")).alias("tp"), "edge_type"
    )
    coupled = (
        ends.join(of_path.toDF("sp", "g"), "sp")
        .join(of_path.toDF("tp", "to"), "tp")
        .where("g <> to")
        .groupBy("g", "to")
        .agg(F.count("*").alias("w"), F.count_if(F.col("edge_type") == "imports").alias("imports"))
    )
    names = ("sprint", "is_cycle", "members", "self_size", "footprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pairs = [], []
        for batch in batches:
            is_pair = batch.column("to").is_valid()
            for r in batch.filter(is_pair).select(["g", "to", "w", "imports"]).to_pylist():
                pairs.append(tuple(r.values()))
            found += batch.filter(pc.invert(is_pair)).select(["g", *names]).to_pylist()
        found.sort(key=lambda r: r["g"])
        number = {r["g"]: i for i, r in enumerate(found)}
        follows: dict[int, set[int]] = defaultdict(set)
        weight: dict[tuple[int, int], int] = defaultdict(int)
        for g, to, w, imports in pairs:
            x, y = number[g], number[to]
            weight[min(x, y), max(x, y)] += w
            if imports:
                follows[x].add(y)
        merger = _Merger(found, follows, weight, budget)
        del found, pairs, number, follows, weight
        units = merger.run()
        for at in range(0, len(units), 10_000):
            own = units[at : at + 10_000]
            columns = [
                pa.array(range(at, at + len(own)), pa.int32()), pa.array([u.members for u in own], pa.list_(pa.string())),
                pa.array([u.kind for u in own]), pa.array([u.footprint for u in own], pa.int64()), pa.array([u.sprint for u in own], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "members", "kind", "footprint", "sprint"])

    ship(groups.sparkSession)
    rows = summed.unionByName(coupled, allowMissingColumns=True)
    return rows.repartition(1).mapInArrow(run, PLAN)


def plan(groups: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int = BUDGET) -> list[Unit]:
    """The rows of ``plan_rows``, here."""
    found = plan_rows(groups, edges, sizes, budget).collect()
    return [Unit(r["members"], r["kind"], r["footprint"], r["sprint"]) for r in sorted(found, key=lambda r: r["unit"])]


def plan_frame(spark, units: list[Unit]) -> DataFrame:
    rows = [(i, u.members, u.kind, u.footprint, u.sprint) for i, u in enumerate(units)]
    return spark.createDataFrame(rows, PLAN)


def canonical_hash(units: list[Unit]) -> str:
    """SHA-256 of the plan: a line for each unit of its kind, footprint, sprint, number of members and members,
    each written as its length in bytes, a colon, itself and a semicolon."""
    lines = []
    for u in units:
        fields = (u.kind, str(u.footprint), str(u.sprint), str(len(u.members)), *u.members)
        lines.append("".join(f"{len(x.encode())}:{x};" for x in fields) + "\n")
    return hashlib.sha256("".join(lines).encode()).hexdigest()


def canonical_hash_frame(plan_rows: DataFrame) -> DataFrame:
    """plan_hash of a plan as a frame, in expressions."""
    field = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x, F.lit(";"))
    head = [F.col("kind"), F.col("footprint").cast("string"), F.col("sprint").cast("string"), F.size("members").cast("string")]
    line = F.concat(*[field(x) for x in head], F.array_join(F.transform("members", field), ""), F.lit("\n"))
    rows = plan_rows.select(F.struct(F.col("members")[0].alias("first"), line.alias("line")).alias("u"))
    ordered = F.transform(F.array_sort(F.collect_list("u")), lambda u: u["line"])
    return rows.agg(F.sha2(F.array_join(ordered, ""), 256).alias("plan_hash"))


def weighted_cohesion(imports: DataFrame, assigned: DataFrame) -> DataFrame:
    """sample, mq, edges: inner edges over inner and outer ones, an edge between batches counting at both.

    assigned: sample, file, batch.  All samples in one pass: the import edges
    meet the assignment at either end.
    """
    a = assigned.select("sample", F.col("file").alias("source"), F.col("batch").alias("a"))
    b = assigned.select("sample", F.col("file").alias("target"), F.col("batch").alias("b"))
    samples = assigned.select("sample").distinct()
    out_ends = imports.join(a, "source").select("sample", "edge", F.col("a"), F.lit(None).cast("long").alias("b"))
    in_ends = imports.join(b, "target").select("sample", "edge", F.lit(None).cast("long").alias("a"), F.col("b"))
    each = out_ends.unionByName(in_ends).groupBy("sample", "edge").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    inner = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") == F.col("b"))
    ends = F.when(inner, 1).otherwise(F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int"))
    sums = each.groupBy("sample").agg(F.sum(F.when(inner, 1).otherwise(0)).alias("i"), F.sum(ends).alias("edges"))
    return samples.join(sums, "sample", "left").select(
        "sample",
        F.coalesce(F.col("i") / F.nullif(F.col("edges"), F.lit(0)), F.lit(0.0)).alias("mq"),
        F.coalesce("edges", F.lit(0)).cast("long").alias("edges"),
    )


def numbered_imports(edges: DataFrame) -> DataFrame:
    """source, target and a number for each import edge, parallel ones too."""
    return cut(
        edges.where("edge_type = 'imports'").select("source", "target", F.monotonically_increasing_id().alias("edge"))
    )


MASK = (1 << 64) - 1


def _xorshift(x: int) -> int:
    x ^= x << 13 & MASK
    x ^= x >> 7
    return x ^ (x << 17 & MASK)


def _ahead(x: int, steps: int) -> int:
    """The state after so many steps.  A step is linear in the bits, so it is squared as a matrix of 64 columns."""

    def apply(columns: list[int], v: int) -> int:
        out = 0
        while v:
            out ^= columns[(v & -v).bit_length() - 1]
            v &= v - 1
        return out

    power = [_xorshift(1 << i) for i in range(64)]
    while steps:
        if steps & 1:
            x = apply(power, x)
        power = [apply(power, c) for c in power]
        steps >>= 1
    return x


def drawn(n: int, sample: int, seed: int = SEED) -> list[int]:
    """The sample-th order (from 0) of n places: xorshift64* and Fisher-Yates, one sample going on from the one before."""
    x = _ahead(seed or 0x9E3779B97F4A7C15, sample * max(0, n - 1))
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        j = (x * 0x2545F4914F6CDD1D & MASK) % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def shuffles(files: list[str], sizes: list[int], seed: int = SEED, samples: int = SAMPLES) -> list[list[tuple[str, int]]]:
    """Fixed draws that keep the batch sizes."""
    batch = [b for b, n in enumerate(sizes) for _ in range(n)]
    return [
        [(files[i], b) for i, b in zip(drawn(len(files), k, seed), batch, strict=True)] for k in range(max(1, samples))
    ]


def _numbered(files: DataFrame, column: str) -> DataFrame:
    """files with ``place``, from 0 in the order of the column."""
    at = F.monotonically_increasing_id()
    ranked = cut(files.orderBy(column).withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    before, begin = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before.append((part, begin))
        begin += n
    offset = files.sparkSession.createDataFrame(before, "part long, begin long")
    return ranked.join(F.broadcast(offset), "part").select(*files.columns, (F.col("at") + F.col("begin")).alias("place"))


def cohesion_rows(plan: DataFrame, edges: DataFrame, seed: int = SEED, samples: int = SAMPLES) -> dict:
    """Actual cohesion of the batches of a plan against the mean of random batches of the same sizes.

    Each random draw is made by one worker, over places of the files in the order of
    their names.  The import edges with an end in a batch go to every draw.
    """
    batches = plan.where("kind = 'batch'").select("unit", "members")
    size = batches.orderBy("unit").select(F.size("members").alias("n")).toArrow()["n"].to_numpy().astype(np.int64)
    if not len(size):
        return {"actual": 0.0, "baseline": 0.0, "ratio": 1.0, "batched_files": 0, "coupling_edges": 0}
    files, samples = int(size.sum()), max(1, samples)

    def run(key: tuple[pa.Scalar, ...], imports: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = np.full(files + 1, -1, np.int32)  # the last is the place of files in no batch
        batch[drawn(files, key[0].as_py(), seed)] = np.repeat(np.arange(len(size), dtype=np.int32), size)
        inner = ends = 0
        for edges in imports:
            a, b = batch[edges.column("source").to_numpy()], batch[edges.column("target").to_numpy()]
            same = int((a == b).sum())
            inner += same
            ends += int((a >= 0).sum() + (b >= 0).sum()) - same
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([inner / ends])], ["sample", "mq"])

    ship(edges.sparkSession)
    members = _numbered(batches.select("unit", F.explode("members").alias("name")), "name")
    # a unit is told by its number here, a drawn batch by its place: only equality within a sample counts
    own = cut(members.select(F.lit(0).alias("sample"), F.col("place").alias("file"), F.col("unit").cast("long").alias("batch"), "name"))
    place = own.select("name", "file")
    imports = cut(
        numbered_imports(edges)
        .join(place.toDF("source", "s"), "source", "left")
        .join(place.toDF("target", "t"), "target", "left")
        .where("s IS NOT NULL OR t IS NOT NULL")
        .select(F.col("s").alias("source"), F.col("t").alias("target"), "edge")
    )
    found = weighted_cohesion(imports, own.drop("name")).first()
    actual, coupling = found["mq"], found["edges"]
    of_file = lambda c: F.coalesce(c, F.lit(files)).alias(c)
    every = imports.select(of_file("source"), of_file("target"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    random = every.repartition(samples, "sample").groupBy("sample").applyInArrow(run, "sample int, mq double")
    # a draw without edges has no row, and no cohesion
    baseline = sum(r["mq"] for r in random.orderBy("sample").collect()) / samples
    ratio = actual / baseline if baseline > 0 else ONLY_ACTUAL if actual > 0 else 1.0
    return {"actual": actual, "baseline": baseline, "ratio": ratio, "batched_files": files, "coupling_edges": coupling}


def cohesion(units: list[Unit], edges: DataFrame, seed: int = SEED, samples: int = SAMPLES) -> dict:
    """cohesion_rows of a plan that is here."""
    return cohesion_rows(plan_frame(edges.sparkSession, units), edges, seed, samples)


def cohesion_passes(found: dict) -> bool:
    return (
        found["batched_files"] == 0
        or found["coupling_edges"] == 0
        or (found["baseline"] < NOTHING and found["actual"] >= FLOOR)
        or found["ratio"] >= RATIO
    )


def target_metrics(units: list[Unit], files: int, groups: int) -> dict:
    """How much the plan reduces the number of pieces, and what stays single."""
    batched = sum(len(u.members) for u in units if u.kind == "batch")
    return {
        "units": len(units),
        "reduction_rate": 1 - len(units) / files if files else 0.0,
        "batched_ratio": batched / files if files else 0.0,
        "residual_single": sum(u.kind == "single" for u in units),
        "groups": groups,
    }


def invariants(units: list[Unit], edges: DataFrame, files: int) -> dict:
    """Partition, acyclicity of the units, units over budget, and the plan's hash."""
    from graphloom.operators import scc

    members = [m for u in units for m in u.members]
    spark = edges.sparkSession
    of = spark.createDataFrame([(m, u.members[0]) for u in units for m in u.members], "m string, u string")
    quotient = (
        edges.where("edge_type = 'imports'")
        .join(of.toDF("source", "a"), "source")
        .join(of.toDF("target", "b"), "target")
        .where("a <> b")
        .select(F.col("a").alias("source"), F.col("b").alias("target"))
        .distinct()
    )
    found = scc.components(of.select("u").distinct(), quotient)
    return {
        "partition_ok": len(members) == len(set(members)) == files,
        "dag_acyclic": scc.cycles(found, quotient).isEmpty(),
        "over_budget_count": sum(u.kind == "manual_over_budget" for u in units),
        "plan_hash": canonical_hash(units),
    }
