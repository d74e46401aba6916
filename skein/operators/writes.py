"""Changes to a graph: each gives a new graph, and leaves the old one as it is.

What a change binds is written out first with a number for each row, so ids of
new elements and the order of updates stay the same however often a plan runs.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.compiler import Bound, Compiler, Table, col
from skein.plans.parser import GqlError
from skein.plans.syntax import Change, NodePattern
from skein.sources.durable import written
from skein.sources.graph import EdgeTable, NodeTable, PropertyGraph, label_fits


def numbered(c: Compiler, t: Table) -> Table:
    t = c.unit(t)
    if "#row" in t.df.columns:
        return t
    return Table(written(t.df.withColumn("#row", F.monotonically_increasing_id()), "change"), t.scope, t.carry)


def apply(c: Compiler, change: Change, t: Table) -> Table:
    if change.kind == "finish":
        return t
    t = numbered(c, t)
    return {"insert": insert, "set": set_items, "remove": remove_items, "delete": delete}[change.kind](c, change, t)


def labels_of(expr: Any) -> frozenset:
    if expr is None:
        return frozenset()
    op, *rest = expr
    if op == "label":
        return frozenset(rest)
    if op == "and":
        return labels_of(rest[0]) | labels_of(rest[1])
    raise GqlError("a new element's labels are joined by &")


def top_id(g: PropertyGraph) -> int:
    top = 0
    for t in (*g.nodes, *g.edges):
        top = max(top, t.df.agg(F.max("id")).first()[0] or 0)
    return top


def replaced(c: Compiler, **tables: Any) -> None:
    c.graph = c.graph.with_tables(**tables)
    c.ctx.graph = c.graph


def add_node_rows(c: Compiler, labels: frozenset, df: DataFrame) -> None:
    nodes = list(c.graph.nodes)
    for i, t in enumerate(nodes):
        if t.labels == labels:
            nodes[i] = NodeTable(labels, t.df.unionByName(df, allowMissingColumns=True))
            break
    else:
        nodes.append(NodeTable(labels, df))
    replaced(c, nodes=nodes)


def add_edge_rows(c: Compiler, label: str, df: DataFrame, directed: bool) -> None:
    edges = list(c.graph.edges)
    for i, t in enumerate(edges):
        if t.label == label and t.directed == directed and not any(t.ends):
            edges[i] = EdgeTable(label, t.df.unionByName(df, allowMissingColumns=True), directed)
            break
    else:
        edges.append(EdgeTable(label, df, directed))
    replaced(c, edges=edges)


def insert(c: Compiler, change: Change, t: Table) -> Table:
    """Nodes first, then edges. A pattern's unbound elements are new for each row."""
    width = max(1, t.df.agg(F.max("#row")).first()[0] or 0) + 1
    base = top_id(c.graph) + 1
    new = [x for chain in change.data for x in chain.items if x.var not in t.scope]
    new = list({x.var: x for x in new}.values())
    df, scope = t.df, dict(t.scope)
    for k, x in enumerate(new):
        df = df.withColumn(x.var, F.lit(base + k * width) + col("#row"))
        scope[x.var] = Bound("node" if isinstance(x, NodePattern) else "edge", x.label)
    wide = Table(df, scope, t.carry)
    for x in new:
        if isinstance(x, NodePattern):
            props = [c.expr(e, wide).alias(key) for key, e in x.props]
            add_node_rows(c, labels_of(x.label), wide.df.select(col(x.var).alias("id"), *props))
    for chain in change.data:
        for i in range(1, len(chain.items), 2):
            e = chain.items[i]
            if e.ways not in (frozenset("R"), frozenset("L"), frozenset("U")) or e.quantifier:
                raise GqlError("a new edge points one way, or is undirected")
            labels = labels_of(e.label)
            if len(labels) != 1:
                raise GqlError("a new edge has one label")
            a, b = chain.items[i - 1].var, chain.items[i + 1].var
            if e.ways == frozenset("L"):
                a, b = b, a
            props = [c.expr(x, wide).alias(key) for key, x in e.props]
            add_edge_rows(c, next(iter(labels)), wide.df.select(col(e.var).alias("id"), col(a).alias("src"), col(b).alias("dst"), *props), e.ways != frozenset("U"))
    for x in new:  # what is returned may look at new properties
        for key, e in x.props:
            df = df.withColumn(f"{x.var}.{key}", c.expr(e, wide))
        if isinstance(x, NodePattern):
            df = df.withColumn(f"{x.var}.#labels", F.array(*map(F.lit, sorted(labels_of(x.label)))).cast("array<string>"))
    return Table(df, scope, t.carry)


def bound(t: Table, var: str) -> str:
    kind = t.scope.get(var, Bound("value")).kind
    if kind not in ("node", "edge"):
        raise GqlError(f"{var} is neither a node nor an edge", "42N10")
    return kind


def meant(t: Table, var: str, x: NodeTable | EdgeTable) -> bool:
    """Whether a table can hold what the variable is bound to."""
    return label_fits(t.scope[var].label, x.labels if isinstance(x, NodeTable) else frozenset([x.label]))


def update(c: Compiler, t: Table, var: str, key: str, value: Any) -> None:
    """Set a property; of several rows for one element the last wins."""
    kind = bound(t, var)
    new = t.df.filter(col(var).isNotNull()).groupBy(col(var).alias("#id")).agg(F.max_by(F.struct(value.alias("v")), "#row").alias("#new"))

    def one(df: DataFrame) -> DataFrame:
        old = col(key) if key in df.columns else F.lit(None)
        return df.join(new, F.col("id") == col("#id"), "left").withColumn(key, F.when(col("#id").isNotNull(), F.col("`#new`.v")).otherwise(old)).drop("#id", "#new")

    if kind == "node":
        replaced(c, nodes=[NodeTable(x.labels, one(x.df)) if meant(t, var, x) else x for x in c.graph.nodes])
    else:
        replaced(c, edges=[EdgeTable(x.label, one(x.df), x.directed, x.ends) if meant(t, var, x) else x for x in c.graph.edges])


def relabel(c: Compiler, t: Table, var: str, change) -> None:
    if bound(t, var) != "node":
        raise GqlError("an edge keeps its label")
    hit = t.df.filter(col(var).isNotNull()).select(col(var).alias("id")).distinct()
    tables = c.graph.nodes
    moves = lambda x: meant(t, var, x) and change(x.labels) != x.labels
    replaced(c, nodes=[NodeTable(x.labels, x.df.join(hit, "id", "left_anti")) if moves(x) else x for x in tables])
    for x in tables:
        if moves(x):
            add_node_rows(c, change(x.labels), x.df.join(hit, "id", "left_semi"))


def set_items(c: Compiler, change: Change, t: Table) -> Table:
    for kind, var, key, value in change.data:
        if kind == "label":
            relabel(c, t, var, lambda s, key=key: s | {key})
            t = Table(t.df, {**t.scope, var: Bound("node")}, t.carry)  # what its pattern said may hold no more
        else:
            for k, e in [(key, value)] if kind == "property" else value:
                v = c.expr(e, t)
                update(c, t, var, k, v)
                t = Table(t.df.withColumn(f"{var}.{k}", v), t.scope, t.carry)
    return t


def remove_items(c: Compiler, change: Change, t: Table) -> Table:
    for kind, var, key in change.data:
        if kind == "label":
            relabel(c, t, var, lambda s, key=key: s - {key})
            t = Table(t.df, {**t.scope, var: Bound("node")}, t.carry)
            continue
        name = f"{var}.{key}"
        if name in t.df.columns:
            null = F.lit(None).cast(t.df.schema[name].dataType)
            update(c, t, var, key, null)
            t = Table(t.df.withColumn(name, null), t.scope, t.carry)
    return t


def delete(c: Compiler, change: Change, t: Table) -> Table:
    """Edges, then nodes. A node with an edge that stays is an error, unless DETACH takes its edges along."""
    gone: dict = {"node": [], "edge": []}
    for var in change.data:
        gone[bound(t, var)].append((var, t.df.filter(col(var).isNotNull()).select(col(var).alias("id"))))
    union = lambda parts: written(reduce(lambda a, b: a.union(b), [df for _, df in parts]).distinct(), "deleted")
    hit = lambda x, parts: any(meant(t, var, x) for var, _ in parts)
    edges = list(c.graph.edges)
    if gone["edge"]:
        dead = union(gone["edge"])
        edges = [EdgeTable(x.label, x.df.join(dead, "id", "left_anti"), x.directed, x.ends) if hit(x, gone["edge"]) else x for x in edges]
    if gone["node"]:
        dead = union(gone["node"])
        ends = dead.select(F.col("id").alias("#n"))
        tables = [x for x in c.graph.nodes if hit(x, gone["node"])]
        near = [not all(x.ends) or any(end <= table.labels for end in x.ends for table in tables) for x in edges]
        for x in [x for x, is_near in zip(edges, near, strict=True) if is_near and not change.detach]:
            if not x.df.join(ends, (F.col("src") == col("#n")) | (F.col("dst") == col("#n")), "left_semi").isEmpty():
                raise GqlError(f"a node to delete has a {x.label} edge", "G1001")
        if change.detach:
            edges = [EdgeTable(x.label, x.df.join(ends, F.col("src") == col("#n"), "left_anti").join(ends, F.col("dst") == col("#n"), "left_anti"), x.directed, x.ends) if is_near else x for x, is_near in zip(edges, near, strict=True)]
        replaced(c, nodes=[NodeTable(x.labels, x.df.join(dead, "id", "left_anti")) if x in tables else x for x in c.graph.nodes])
    replaced(c, edges=edges)
    return t


def is_write(tree: Any) -> bool:
    from skein.plans.compiler import trees

    return any(isinstance(x, Change) for x in trees(tree))



