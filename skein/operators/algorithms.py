"""Graph algorithms over a projection.

What is a join or an aggregate is one: components, paths, PageRank, triangles.
What depends on the order of updates (label propagation, Louvain) or on a
depth-first search reads its own weak component alone, so tasks run it over
whole components; their memory grows with a task's nodes, as arcs lie in files.
Strong components and levels do so only in components
that a task holds with ease; larger ones are searched by rounds of joins, and
so is betweenness in graphs that are too large to broadcast.
"""

from __future__ import annotations

import math
import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.parser import GqlError
from skein.sources.durable import written
from skein.sources.graph import PropertyGraph, label_fits

from .components import components

#: Most edges that betweenness broadcasts; more are joined.
MOST_BROADCAST_EDGES = 2_000_000
#: Most nodes and edges of a component that one task searches; larger ones are joined.
MOST_IN_TASK = 1_000_000
#: Nodes and arcs that make up a task of whole components, if no component is larger.
TASK_ROWS = 250_000
#: Arcs whose columns a task holds in memory; more lie in its temporary files.
HELD_ARCS = 1 << 21


@dataclass(frozen=True)
class Projection:
    """vertices: id. edges: src, dst, weight, eid, directed; each logical edge once."""

    name: str
    vertices: DataFrame
    edges: DataFrame

    def arcs(self, orientation: str = "natural") -> DataFrame:
        """src, dst, weight, eid: undirected edges both ways, a loop once."""
        e = self.edges
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "eid", "directed")
        if orientation == "undirected":
            return e.union(back.filter("src <> dst")).drop("directed")
        if orientation == "reverse":
            e, back = back, e
        return e.union(back.filter("not directed and src <> dst")).drop("directed")


def project(graph: PropertyGraph, name: str, node_labels: list | None, edge_labels: list | None, weight: str | None) -> Projection:
    """Nodes with one of the labels (all if null), edges with one of the labels between them; a missing or non-numeric weight is 1."""
    any_of = lambda labels: _or(labels) if labels else None
    vertices = graph.scan_nodes(any_of(node_labels), set()).select("id")

    def scan(tables: list) -> DataFrame:
        edges = graph.with_tables(edges=tables).scan_edges(None, {weight} if weight else set())
        w = F.coalesce(F.expr(f"try_cast(`{weight}` as double)"), F.lit(1.0)) if weight and weight in edges.columns else F.lit(1.0)
        return edges.select(F.col("#src").alias("src"), F.col("#dst").alias("dst"), w.alias("weight"), F.col("id").alias("eid"), F.col("#directed").alias("directed"))

    tables = graph.edge_tables(any_of(edge_labels))
    if not node_labels:
        return Projection(name, vertices, scan(tables))
    # edges that are known to lie between the nodes stay where they are, with those of their table
    within = [t for t in tables if t.sure and all(label_fits(any_of(node_labels), x.labels) for end in t.ends for x in graph.nodes if end <= x.labels)]
    parts = [scan(within).filter("src is not null and dst is not null")] if within else []
    if rest := [t for t in tables if t not in within] if parts else tables:
        ids = vertices.select(F.col("id").alias("v")).hint("merge")
        parts.append(scan(rest).join(ids, F.col("src") == F.col("v"), "left_semi").join(ids, F.col("dst") == F.col("v"), "left_semi"))
    return Projection(name, vertices, reduce(lambda a, b: a.union(b), parts) if parts else scan(tables))


def _or(labels: list) -> Any:
    out: Any = ("label", labels[0])
    for x in labels[1:]:
        out = ("or", out, ("label", x))
    return out


def ranked(df: DataFrame, score: str) -> DataFrame:
    return df.orderBy(F.desc(score), "node_id")


def wcc(p: Projection) -> DataFrame:
    """Component of each node: its smallest id."""
    roots = components(p.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "wcc")
    return p.vertices.join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select(F.col("id").alias("node_id"), F.coalesce("root", "id").alias("component_id"))


def large_part(p: Projection, part: DataFrame) -> tuple[Projection, DataFrame, DataFrame | None]:
    """The projection and ``part``, its nodes as (component_id, node_id), without large components; and the nodes of these (id), if there are any."""
    size = part.groupBy("component_id").agg(F.count("*").alias("n"))
    arcs = p.edges.join(part.hint("merge"), F.col("src") == F.col("node_id")).groupBy("component_id").agg(F.count("*").alias("m"))
    large = written(size.join(arcs.hint("merge"), "component_id", "left").filter(F.col("n") + F.coalesce("m", F.lit(0)) > MOST_IN_TASK).select("component_id"), "large-components")
    if large.isEmpty():
        return p, part, None
    nodes = written(part.join(large, "component_id").select(F.col("node_id").alias("id")), "large-nodes")
    ends = nodes.select(F.col("id").alias("v")).hint("merge")
    rest = Projection(p.name, p.vertices.join(nodes.hint("merge"), "id", "left_anti"), p.edges.join(ends, F.col("src") == F.col("v"), "left_anti"))
    return rest, part.join(large, "component_id", "left_anti"), nodes


class Spool:
    """A column of numbers that grows; beyond HELD_ARCS it lies in a temporary file."""

    def __init__(self, dtype: Any):
        self.dtype, self.parts, self.held, self.file = dtype, [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.parts.append(x.astype(self.dtype, copy=False))
        self.held += len(x)
        if self.held >= HELD_ARCS:
            self.file = self.file or tempfile.TemporaryFile()
            self.spill()

    def spill(self) -> None:
        for x in self.parts:
            self.file.write(x.tobytes())
        self.parts, self.held = [], 0

    def done(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        self.spill()
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.dtype, "r+"))


@dataclass
class Adjacency:
    """Nodes by place in ``ids``, which ascend; the arcs from i lead to ``to[begin[i]:begin[i + 1]]``, in the order of edge ids."""

    ids: np.ndarray
    begin: list
    to: np.ndarray
    weight: np.ndarray

    def near(self, i: int) -> list:
        return self.to[self.begin[i] : self.begin[i + 1]].tolist()

    def weights(self, i: int) -> list:
        return self.weight[self.begin[i] : self.begin[i + 1]].tolist()


def adjacency(batches: Iterator[pa.RecordBatch]) -> Adjacency | None:
    """Of a task's rows (src, dst, weight), sorted by src; a row without dst is the node itself and comes first."""
    ids, froms, counts, to, weight = [], [], [], Spool(np.int64), Spool(np.float64)
    for batch in batches:
        src, dst = batch.column(0).to_numpy(), batch.column(1)
        node = np.asarray(dst.is_null())
        ids.append(src[node])
        arc = ~node
        one, n = np.unique(src[arc], return_counts=True)
        froms.append(one)
        counts.append(n)
        to.add(dst.drop_null().to_numpy())
        weight.add(batch.column(2).to_numpy()[arc])
    if not ids or not sum(map(len, ids)):
        return None
    ids, to = np.concatenate(ids), to.done()
    size = np.zeros(len(ids), dtype=np.int64)
    np.add.at(size, np.searchsorted(ids, np.concatenate(froms)), np.concatenate(counts))
    for lo in range(0, len(to), HELD_ARCS):
        some = to[lo : lo + HELD_ARCS]
        at = np.searchsorted(ids, some)
        if (ids[np.minimum(at, len(ids) - 1)] != some).any():
            raise ValueError("an edge leads to a node that the projection does not have")
        some[:] = at
    return Adjacency(ids, np.concatenate([[0], np.cumsum(size)]).tolist(), to, weight.done())


def by_component(p: Projection, run, schema: str, orientation: str = "natural", part: DataFrame | None = None) -> DataFrame:
    """``run(adjacency)``, columns of rows, for tasks of whole weak components. A run over several components is one over each."""
    part = written(wcc(p), "components") if part is None else part
    part = part.filter("node_id is not null").select(F.col("component_id").alias("c"), F.col("node_id").alias("n"))
    nodes = part.select("c", F.col("n").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), F.lit(None).cast("long").alias("eid"))
    arcs = p.arcs(orientation).join(part.hint("merge"), F.col("src") == F.col("n")).select("c", "src", "dst", "weight", "eid")
    rows = written(nodes.union(arcs), "component-rows")
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (near := adjacency(batches)) is not None:
            columns = run(near)
            for lo in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)], pa.int32() if f"{n} int" in schema.split(", ") else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)

    tasks = min(rows.count() // TASK_ROWS + 1, 4000)
    return rows.repartition(tasks, "c").sortWithinPartitions("src", "eid", "dst").select("src", "dst", "weight").mapInArrow(task, schema)


def scc(p: Projection) -> DataFrame:
    """Strong component of each node: its smallest id."""

    def run(g: Adjacency) -> tuple:
        ids, out = g.ids, g.near
        n = len(ids)
        order, low, on, stack, comp = [-1] * n, [0] * n, [False] * n, [], [-1] * n
        clock = 0
        for root in range(n):
            if order[root] >= 0:
                continue
            work = [(root, iter(out(root)))]
            order[root] = low[root] = clock
            clock += 1
            stack.append(root)
            on[root] = True
            while work:
                v, rest = work[-1]
                for w in rest:
                    if order[w] < 0:
                        order[w] = low[w] = clock
                        clock += 1
                        stack.append(w)
                        on[w] = True
                        work.append((w, iter(out(w))))
                        break
                    if on[w]:
                        low[v] = min(low[v], order[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == order[v]:
                        group = []
                        while True:
                            w = stack.pop()
                            on[w] = False
                            group.append(w)
                            if w == v:
                                break
                        first = min(group)
                        for w in group:
                            comp[w] = first
        return ids, ids[comp]

    rest, part, large = large_part(p, written(wcc(p), "components"))
    out = by_component(rest, run, "node_id long, component_id long", part=part)
    return out if large is None else out.union(scc_by_joins(large, p.arcs().select("src", "dst")))


def scc_by_joins(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, component_id) by rounds: each node takes the smallest node that reaches it as colour; those of a colour that reach the
    colour's node in turn are its component, and the rest goes on without them. A colour is the smallest node of its component."""
    arcs = written(arcs.filter("src <> dst").distinct().join(nodes.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi"), "scc-arcs")
    out = None
    while True:
        # a node without an arc in or without an arc out is a component of its own
        ends = [arcs.select(F.col(c).alias("id")) for c in ("src", "dst")]
        inner = nodes.join(ends[0].hint("merge"), "id", "left_semi").join(ends[1].hint("merge"), "id", "left_semi")
        single = written(nodes.join(inner.hint("merge"), "id", "left_anti").select(F.col("id").alias("node_id"), F.col("id").alias("component_id")), "scc-single")
        if single.isEmpty():
            colour = written(nodes.select("id", F.col("id").alias("colour")), "scc-colours")
            fresh = colour
            while not fresh.isEmpty():
                sent = fresh.join(arcs.hint("merge"), F.col("id") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("sent"))
                after = colour.join(sent.hint("merge"), F.col("id") == F.col("dst"), "left")
                after = written(after.select("id", F.least("colour", "sent").alias("colour"), F.coalesce(F.col("sent") < F.col("colour"), F.lit(False)).alias("new")), "scc-colours")
                colour, fresh = after.select("id", "colour"), after.filter("new").select("id", "colour")
            inside = arcs.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")).hint("merge"), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")).hint("merge"), "dst").filter("a = b")
            inside = written(inside.select("src", "dst"), "scc-inside")
            found = fresh = written(colour.filter("id = colour"), "scc-found")
            while not fresh.isEmpty():
                near = fresh.join(inside.hint("merge"), F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "colour").distinct()
                fresh = written(near.join(found.hint("merge"), "id", "left_anti"), "scc-found")
                found = found.union(fresh)
            done = found.select(F.col("id").alias("node_id"), F.col("colour").alias("component_id"))
        else:
            done = single
        done = written(done, "scc-done")
        out = done if out is None else out.union(done)
        gone = done.select("node_id")
        nodes = written(nodes.join(gone.hint("merge"), F.col("id") == F.col("node_id"), "left_anti"), "scc-nodes")
        if nodes.isEmpty():
            return out
        arcs = written(arcs.join(gone.hint("merge"), F.col("src") == F.col("node_id"), "left_anti").join(gone.hint("merge"), F.col("dst") == F.col("node_id"), "left_anti"), "scc-arcs")


def topological_sort(p: Projection) -> DataFrame:
    """Position by (peel level, id); a cycle is an error."""

    def run(g: Adjacency) -> tuple:
        ids = g.ids
        into = np.bincount(g.to, minlength=len(ids)).tolist()
        level, now, done, level_of = 0, [i for i, k in enumerate(into) if not k], 0, [0] * len(ids)
        while now:
            after = []
            for v in now:
                level_of[v] = level
                done += 1
                for w in g.near(v):
                    into[w] -= 1
                    if not into[w]:
                        after.append(w)
            now, level = after, level + 1
        if done < len(ids):
            raise ValueError(f"22G20: a cycle runs through node {int(ids[next(i for i, k in enumerate(into) if k)])}")
        return ids, level_of

    rest, part, large = large_part(p, written(wcc(p), "components"))
    levels = by_component(rest, run, "node_id long, level int", part=part)
    if large is not None:
        levels = levels.union(levels_by_joins(large, p.arcs().select("src", "dst")))
    levels = written(levels, "levels")
    # places are sums over runs of neighbouring ids, and then inside a run, so that no task holds a whole level
    run_of = F.floor(F.col("node_id") / RUN)
    runs = levels.groupBy("level", run_of.alias("run")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("level", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("level").alias("l"), F.col("run").alias("r"), before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("level", run_of).orderBy("node_id"))
    placed = levels.withColumn("i", inside).withColumn("run", run_of).join(runs, (F.col("level") == F.col("l")) & (F.col("run") == F.col("r")))
    return placed.select("node_id", (F.col("base") + F.col("i") - 1).cast("long").alias("topo_position")).orderBy("topo_position")


#: Ids in a run of neighbours.
RUN = 1 << 16


def levels_by_joins(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, level) by peeling off the nodes that no arc leads to any more."""
    arcs = written(arcs.join(nodes.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").distinct(), "level-arcs")
    out, level = None, 0
    while not nodes.isEmpty():
        free = written(nodes.join(arcs.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti"), "level-free")
        if free.isEmpty():
            raise GqlError(f"a cycle runs through node {nodes.agg(F.min('id')).first()[0]}", "22G20")
        now = free.select(F.col("id").alias("node_id"), F.lit(level).alias("level"))
        out, level = now if out is None else out.union(now), level + 1
        nodes = written(nodes.join(free.hint("merge"), "id", "left_anti"), "level-nodes")
        arcs = written(arcs.join(free.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti"), "level-arcs")
    return out


def _biconnected(g: Adjacency) -> tuple[set, set]:
    """Cut points and bridges of the undirected view; parallel edges make no bridge."""
    n = len(g.ids)
    order, low, cuts, bridges, clock = [-1] * n, [0] * n, set(), set(), 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        work, children = [[root, -1, iter(g.near(root))]], 0
        while work:
            v, came, rest = frame = work[-1]
            for w in rest:
                if w == v:
                    continue
                if w == came:  # the edge that led here, once; others to that node are parallel ones
                    came = frame[1] = -1
                    continue
                if order[w] >= 0:
                    low[v] = min(low[v], order[w])
                    continue
                order[w] = low[w] = clock
                clock += 1
                work.append([w, v, iter(g.near(w))])
                break
            else:
                work.pop()
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > order[u]:
                        bridges.add((min(u, v), max(u, v)))
                    if u == root:
                        children += 1
                    elif low[v] >= order[u]:
                        cuts.add(u)
        if children > 1:
            cuts.add(root)
    return cuts, bridges


def articulation_points(p: Projection) -> DataFrame:
    run = lambda g: (g.ids[sorted(_biconnected(g)[0])],)
    return by_component(p, run, "node_id long", "undirected").orderBy("node_id")


def bridges(p: Projection) -> DataFrame:
    def run(g: Adjacency) -> tuple:
        ends = np.array(sorted(_biconnected(g)[1]), dtype=np.int64).reshape(-1, 2)
        return g.ids[ends[:, 0]], g.ids[ends[:, 1]]

    return by_component(p, run, "from_node long, to_node long", "undirected").orderBy("from_node", "to_node")


def checked_weights(arcs: DataFrame) -> DataFrame:
    bad = (F.col("weight") < 0) | F.isnan("weight")
    return arcs.withColumn("weight", F.when(bad, F.raise_error(F.lit("22G21: a weight is negative or not a number")).cast("double")).otherwise(F.col("weight")))


def distances(p: Projection, sources: DataFrame) -> DataFrame:
    """(source, node, cost, pred): least costs by rounds of relaxation from what got better; of equal costs the smallest predecessor."""
    arcs = written(checked_weights(p.arcs()).groupBy("src", "dst").agg(F.min("weight").alias("weight")), "arcs")
    best = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("pred"))
    best, fresh = best.withColumn("new", F.lit(True)), True
    while fresh:
        moved = best.filter("new").join(arcs, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("pred"))
        both = best.select("source", "node", "cost", "pred", F.lit(0).alias("late")).union(moved.withColumn("late", F.lit(1)))
        after = both.groupBy("source", "node").agg(F.min(F.struct("cost", "pred")).alias("m"), F.min(F.when(F.col("late") == 0, F.struct("cost", "pred"))).alias("old"))
        after = after.select("source", "node", "m.cost", "m.pred", (F.col("old").isNull() | (F.col("m.cost") < F.col("old.cost")) | (F.col("m.pred") < F.col("old.pred"))).alias("new"))
        best = written(after, "distances")
        fresh = not best.filter("new").isEmpty()
    return best.drop("new")


def sssp(p: Projection, source: int) -> DataFrame:
    start = p.vertices.filter(F.col("id") == source)
    return distances(p, start).select(F.col("node").alias("target_node"), "cost").orderBy("target_node")


def apsp(p: Projection, max_nodes: int, parallelism: int | None = None) -> DataFrame:
    parallel(parallelism)
    n = p.vertices.count()
    if n > max_nodes:
        raise GqlError(f"{n} nodes are more than {max_nodes}", "22G22")
    return distances(p, p.vertices).filter("source <> node").select(F.col("source").alias("source_node"), F.col("node").alias("target_node"), "cost").orderBy("source_node", "target_node")


def dijkstra(p: Projection, source: int, target: int) -> DataFrame:
    """One row (cost, path, length), or none."""
    best = distances(p, p.vertices.filter(F.col("id") == source))
    path, at = [], target
    found = best.filter(F.col("node") == target).first()
    kind = "cost double, path array<long>, length long"
    if found is None:
        return best.sparkSession.createDataFrame([], kind)
    while True:  # the path alone comes to the driver, one predecessor at a time
        path.append(at)
        if at == source:
            break
        at = best.filter(F.col("node") == at).first()["pred"]
    return best.sparkSession.createDataFrame([(found["cost"], path[::-1], len(path) - 1)], kind)


def parallel(n: int | None) -> None:
    """Accepted for the contract's sake; Spark decides."""
    if n is not None and not 0 <= n <= 1024:
        raise GqlError("parallelism lies between 0 and 1024", "22023")


def pagerank(p: Projection, damping: float | None = None, max_iterations: int | None = None, tolerance: float | None = None, parallelism: int | None = None, orientation: str | None = None, personalization: list | None = None) -> DataFrame:
    """Power iteration; dangling mass goes where restarts go."""
    parallel(parallelism)
    damping, rounds, tolerance = 0.85 if damping is None else float(damping), 100 if max_iterations is None else int(max_iterations), 1e-6 if tolerance is None else float(tolerance)
    if not (math.isfinite(damping) and 0 <= damping < 1):
        raise GqlError("damping lies in [0, 1)", "22023")
    orientation = (orientation or "natural").lower()
    if orientation not in ("natural", "reverse", "undirected"):
        raise GqlError(f"unknown orientation {orientation}", "22023")
    arcs = p.arcs(orientation).groupBy("src", "dst").agg(F.count("*").alias("times"))
    degree = arcs.groupBy("src").agg(F.sum("times").alias("degree"))
    arcs = written(arcs.join(degree, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share")), "pagerank-arcs")
    sinks = p.vertices.join(degree, F.col("id") == F.col("src"), "left").select("id", F.col("degree").isNull().alias("sink"))
    if personalization:
        seeds = defaultdict(float)
        for r in personalization:
            seeds[int(r["node"])] += float(r["weight"])
        total = sum(seeds.values())
        start = p.vertices.sparkSession.createDataFrame([(k, v / total) for k, v in seeds.items()], "seed long, restart double")
        nodes = sinks.join(F.broadcast(start), F.col("id") == F.col("seed"), "left").select("id", "sink", F.coalesce("restart", F.lit(0.0)).alias("restart"))
    else:
        n = p.vertices.count()
        nodes = sinks.withColumn("restart", F.lit(1.0 / max(n, 1)))
    nodes = written(nodes, "pagerank-nodes")
    score = nodes.select("id", F.col("restart").alias("score"))
    for k in range(rounds):
        lost = nodes.filter("sink").join(score, "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        given = arcs.join(score, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("given"))
        new = nodes.join(given, F.col("id") == F.col("dst"), "left").crossJoin(F.broadcast(lost))
        new = new.select("id", ((1 - damping) * F.col("restart") + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") * F.col("restart"))).alias("score"))
        if tolerance <= 0 and k % 3 != 2 and k < rounds - 1:
            score = new
            continue
        new = written(new, "pagerank")
        if tolerance > 0:
            moved = new.join(score.withColumnRenamed("score", "old"), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
            if moved is None or moved < tolerance:
                score = new
                break
        score = new
    return ranked(score.select(F.col("id").alias("node_id"), "score"), "score")


def betweenness(p: Projection, sample_size: int | None = None, parallelism: int | None = None) -> DataFrame:
    """Brandes from each source (or from an even sample, scaled up), over an adjacency that is broadcast within a checked size, and by joins beyond."""
    parallel(parallelism)
    spark = p.vertices.sparkSession
    arcs = p.arcs().select("src", "dst")
    n = p.vertices.count()
    if sample_size is not None and sample_size < n:
        k = sample_size
        if k <= 0:
            return ranked(p.vertices.select(F.col("id").alias("node_id"), F.lit(0.0).alias("score")), "score")
        places = sorted({i * (n - 1) // (k - 1) if k > 1 else 0 for i in range(k)})
        numbered = p.vertices.withColumn("at", F.row_number().over(Window.orderBy("id")) - 1)
        sources, scale = numbered.filter(F.col("at").isin(places)).select("id"), n / k
    else:
        sources, scale = p.vertices, 1.0
    if arcs.count() > MOST_BROADCAST_EDGES:
        parts = dependencies(sources, arcs).groupBy("id").agg((F.sum("part") * scale).alias("score"))
        return ranked(p.vertices.join(parts, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score")), "score")
    table = arcs.toArrow()
    pairs = np.stack([table[c].to_numpy() for c in ("src", "dst")], axis=1)
    names, inverse = np.unique(pairs, return_inverse=True)
    inverse = inverse.reshape(-1, 2)
    order = np.argsort(inverse[:, 0], kind="stable")
    begin = np.searchsorted(inverse[order, 0], np.arange(len(names) + 1))
    shared = spark.sparkContext.broadcast((names, begin, inverse[order, 1]))

    def run(batches):
        ids, start, to = shared.value
        total = np.zeros(len(ids))
        for pdf in batches:
            for source in pdf["id"].tolist():
                s = int(np.searchsorted(ids, source))
                if s == len(ids) or ids[s] != source:
                    continue
                depth, paths, order_, preds = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
                todo = deque([s])
                while todo:
                    v = todo.popleft()
                    order_.append(v)
                    for w in to[start[v] : start[v + 1]].tolist():
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            todo.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            preds[w].append(v)
                credit: dict = defaultdict(float)
                for w in reversed(order_):
                    for v in preds[w]:
                        credit[v] += paths[v] / paths[w] * (1 + credit[w])
                    if w != s:
                        total[w] += credit[w]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids[at], "part": total[at]})

    parts = sources.repartition(max(1, min(n // 50 + 1, 200))).mapInPandas(run, "id long, part double").groupBy("id").agg((F.sum("part") * scale).alias("score"))
    return ranked(p.vertices.join(parts, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score")), "score")


def dependencies(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, part): what each source adds to a node's betweenness. Breadth first from all sources at once, level by level, and back."""
    arcs = written(arcs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("times")), "between-arcs")
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths"))
    levels = [written(start, "between-level")]
    while True:
        grown = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("paths") * F.col("times")).alias("paths"))
        for seen in levels:
            grown = grown.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        grown = written(grown, "between-level")
        if grown.isEmpty():
            break
        levels.append(grown)
    credit, out = levels[-1].withColumn("credit", F.lit(0.0)), []
    for above in levels[-2::-1]:
        out.append(credit.select(F.col("node").alias("id"), F.col("credit").alias("part")))
        below = credit.select("source", F.col("node").alias("dst"), ((1 + F.col("credit")) / F.col("paths")).alias("share"))
        given = below.join(arcs, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("share") * F.col("times")).alias("share"))
        credit = above.join(given, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("credit"))
        credit = written(credit, "between-credit")
    out.append(credit.limit(0).select(F.col("node").alias("id"), F.col("credit").alias("part")))  # a source takes no part in its own paths
    return reduce(lambda a, b: a.union(b), out)


def label_propagation(p: Projection, max_iter: int | None = None) -> DataFrame:
    """Nodes in ascending order take the commonest label among their neighbours, the smallest of equals, until none changes."""
    rounds = 50 if max_iter is None else max_iter

    def run(g: Adjacency) -> tuple:
        label = list(range(len(g.ids)))
        for _ in range(rounds):
            changed = False
            for v in range(len(label)):
                around = g.near(v)
                if not around:
                    continue
                votes: dict = defaultdict(int)
                for w in around:
                    votes[label[w]] += 1
                best = min(votes, key=lambda x: (-votes[x], x))  # noqa: B023
                changed |= best != label[v]
                label[v] = best
            if not changed:
                break
        return g.ids, g.ids[label]

    return by_component(p, run, "node_id long, community long", "undirected").orderBy("node_id")


def louvain(p: Projection, max_iter: int | None = None) -> DataFrame:
    """One level: nodes in ascending order move to the community of strictly largest gain; it is named by the node it grew from."""
    rounds = 50 if max_iter is None else max_iter
    half = F.when(F.col("src") == F.col("dst"), F.col("weight") / 2).otherwise(F.col("weight"))
    total = p.edges.agg(F.sum(half)).first()[0] or 1.0

    def run(g: Adjacency) -> tuple:
        home = list(range(len(g.ids)))
        degree = [sum(g.weights(v)) for v in home]
        weight = list(degree)
        for _ in range(rounds):
            moved = False
            for v in range(len(home)):
                links: dict = defaultdict(float)
                for w, x in zip(g.near(v), g.weights(v), strict=True):
                    links[home[w]] += x
                here, k = home[v], degree[v]
                gain = lambda inside, others: inside / total - k * others / (2 * total * total)  # noqa: B023, E731
                stay = gain(links.get(here, 0.0), weight[here] - k)
                best, most = here, 0.0
                for there in sorted(links):
                    if there != here and (more := gain(links[there], weight[there]) - stay) > most:
                        best, most = there, more
                if best != here:
                    weight[here] -= k
                    weight[best] += k
                    home[v], moved = best, True
            if not moved:
                break
        return g.ids, g.ids[home], np.zeros(len(home), dtype=np.int32)

    return by_component(p, run, "node_id long, community long, level int", "undirected").orderBy("node_id")


def triangle_count(p: Projection, parallelism: int | None = None) -> DataFrame:
    """Triangles of the simple undirected graph at each node, by joins of edges that point from fewer neighbours to more. Only edges that can begin a triangle ship lists."""
    parallel(parallelism)
    pairs = p.edges.filter("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    degree = pairs.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    d = lambda c: degree.select(F.col("v").alias(c), F.col("d").alias(f"d{c}"))
    up = pairs.join(d("x").hint("merge"), "x").join(d("y").hint("merge"), "y")
    first = F.struct("dx", "x") < F.struct("dy", "y")
    up = up.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.greatest("dx", "dy").alias("d"))
    up = written(up, "oriented")
    # a triangle's first edge leads to a node from which others lead on
    middle = up.join(up.select(F.col("a").alias("m")).distinct().hint("merge"), F.col("b") == F.col("m"), "left_semi")
    middle = written(middle.select("a", "b", "d"), "middle")
    if middle.isEmpty():
        return ranked(p.vertices.select(F.col("id").alias("node_id"), F.lit(0).cast("long").alias("triangle_count")), "triangle_count")
    ways = up.join(middle.select(F.col("a").alias("m")).distinct().hint("merge"), F.col("a") == F.col("m"), "left_semi")
    lists = ways.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", "b"))).alias("up"))
    # each middle node gets what comes after it in the list that it stands in, and meets its own list; a list has at most sqrt(2 edges) nodes
    rest = middle.hint("merge").join(lists, "a").select("a", "b", F.transform(F.filter("up", lambda x: x > F.struct("d", "b")), lambda x: x["b"]).alias("rest")).filter(F.size("rest") > 0)
    outs = up.join(middle.select(F.col("b").alias("m")).distinct().hint("merge"), F.col("a") == F.col("m"), "left_semi").groupBy(F.col("a").alias("b")).agg(F.collect_list("b").alias("outs"))
    common = rest.join(outs.hint("merge"), "b").select("a", "b", F.explode(F.array_intersect("rest", "outs")).alias("c"))
    corners = common.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangle_count"))
    return ranked(p.vertices.join(corners, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("triangle_count", F.lit(0)).alias("triangle_count")), "triangle_count")
