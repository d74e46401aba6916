"""Graph patterns: expansion along edges, and paths with quantifiers, modes and selectors.

A chain grows from an element that is bound already, or from a scan of its
first node, by equi-joins on endpoints. A node is only joined in if something
about it is asked that its edge does not tell. A quantified edge grows a
frontier level by level; each level is one join, and a frontier that may go on
without bound is written out between levels, so plans stay small and lost
executors cost little.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.compiler import Bound, Compiler, Table, col, names_used
from skein.plans.parser import GqlError
from skein.plans.syntax import Chain, EdgePattern, Ex, Match, NodePattern
from skein.sources.durable import written
from skein.sources.graph import PropertyGraph, label_fits

MOST_HOPS = 100
UNROLLED = 6
FLIP = {"R": "L", "L": "R", "U": "U"}


def match_pattern(c: Compiler, m: Match, t: Table, counted: frozenset = frozenset()) -> Table:
    """counted: places of chains that are joined in as numbers of rows, after the others."""
    prior = [x for v, b in t.scope.items() for x in ([v] if b.kind in ("node", "edge") else t.owned(v))]
    edges: list[tuple[str, bool]] = []
    anchored: list[tuple[str, str, str]] = []
    tracked = m.mode != "WALK" or (m.selector is not None and m.selector[0] != "all")
    for k, chain in enumerate(m.chains):
        if k in counted:
            continue
        check_bounds(m, chain)
        t, steps = grow(c, m, chain, t, tracked or chain.path is not None)
        edges += steps
        if tracked or chain.path:
            anchored.append((chain.items[0].var, chain.items[-1].var, f"#p{c.ctx.count}"))
            t, name = keep_path(c, t, chain)
            anchored[-1] = (chain.items[0].var, chain.items[-1].var, name)
    if m.different_edges:
        t = Table(t.df.filter(all_different(edges)), t.scope, t.carry) if len(edges) > 1 or any(many for _, many in edges) else t
    if m.selector is not None and m.selector[0] != "all":
        if m.where is not None:
            t = c.filtered(t, m.where)  # predicates come before selection
        for first, last, path in anchored:
            t = select(t, m.selector, [*t.carry, *prior, first, last], path)
    t = Table(t.df.drop(*[p for *_, p in anchored if p.startswith("#")]), t.scope, t.carry)
    for k in sorted(counted):
        t = count_in(c, m, m.chains[k], t)
    return t


def count_in(c: Compiler, m: Match, chain: Chain, t: Table) -> Table:
    """Multiply how often rows occur by the number of the chain's matches at the node that it shares with them; rows without any go."""
    at = 0 if chain.items[0].var in t.scope else -1
    node = chain.items[at]
    times, label = t.times, t.scope[node.var].label or node.label
    t = refine(c, t, node)
    bare = NodePattern(node.var, label, named=False)
    # it grows from its other end, so that the shared node is an end known by its edges
    items = (*chain.items[:-1], bare) if at else (*(replace(x, ways=frozenset(FLIP[w] for w in x.ways)) if isinstance(x, EdgePattern) else x for x in chain.items[:0:-1]), bare)
    alone, _ = grow(c, m, replace(chain, items=items), Table(None, {}), False)
    name, shared = c.ctx.fresh("times"), c.ctx.fresh("n")
    numbers = alone.df.groupBy(col(node.var).alias(shared)).agg(F.count("*").alias(name))
    df = t.df.join(numbers, col(node.var) == col(shared)).drop(shared)
    if times is not None:
        product = c.ctx.fresh("times")
        df = df.withColumn(product, col(times) * col(name)).drop(times, name)
        name = product
    return Table(df, t.scope, t.carry, times=name)


def check_bounds(m: Match, chain: Chain) -> None:
    """An open quantifier needs a mode or selector that ends the search."""
    for e in chain.items[1::2]:
        if e.quantifier not in (None, "?") and e.quantifier[1] is None:
            if m.mode == "WALK" and not m.different_edges and (m.selector is None or m.selector[0] == "all"):
                raise GqlError("an unbounded quantifier needs a restrictive mode, a selector or DIFFERENT EDGES", "42N11")
        if e.quantifier not in (None, "?") and max(e.quantifier[0], e.quantifier[1] or 0) > MOST_HOPS:
            raise GqlError(f"a quantifier goes up to {MOST_HOPS}", "42N12")


def all_different(edges: list[tuple[str, bool]]) -> Column:
    ids = F.concat(*[F.transform(col(v), lambda x: x["id"]) if many else F.when(col(v).isNull(), F.array().cast("array<long>")).otherwise(F.array(col(v))) for v, many in edges])
    return F.size(F.array_distinct(ids)) == F.size(ids)


def grow(c: Compiler, m: Match, chain: Chain, t: Table, tracked: bool) -> tuple[Table, list]:
    items = chain.items
    bound = [i for i, x in enumerate(items) if i % 2 == 0 and x.var in t.scope]
    start = bound[0] if bound else 0
    node = items[start]
    if bound:
        t = refine(c, t, node)
    else:
        t = scan(c, t, node, chain, m)
    path = Path(c, m, tracked)
    if tracked:
        t = path.begin(t, node.var)
    edges = []
    for i in range(start, len(items) - 1, 2):
        t, one = step(c, m, t, items[i], items[i + 1], items[i + 2], False, path, chain)
        edges.append(one)
    for i in range(start, 0, -2):
        t, one = step(c, m, t, items[i], items[i - 1], items[i - 2], True, path, chain)
        edges.insert(0, one)
    return t, edges


def named_props(c: Compiler) -> set | None:
    return c.ctx.used


def scan_node(c: Compiler, label: Any) -> DataFrame:
    return c.graph.scan_nodes(label, named_props(c))


def prefixed(df: DataFrame, var: str) -> list[Column]:
    return [col(x).alias(var if x == "id" else f"{var}.{x}") for x in df.columns if not x.startswith("#") or x in ("#labels", "#label", "#src", "#dst", "#directed")]


def scan(c: Compiler, t: Table, node: NodePattern, chain: Chain, m: Match) -> Table:
    df = scan_node(c, node.label)
    df = df.select(*prefixed(df, node.var))
    joined = df if t.df is None else t.df.crossJoin(df)
    return restrict(c, Table(joined, {**t.scope, node.var: Bound("node", node.label)}, t.carry, node.var if t.df is None else None), node)


def refine(c: Compiler, t: Table, node: NodePattern) -> Table:
    """A node that is bound already: its pattern filters it. One that only its id is known of is looked up."""
    if t.scope[node.var].kind not in ("node", "value"):
        raise GqlError(f"{node.var} is not a node", "42N10")
    if f"{node.var}.#labels" not in t.df.columns and (node.label is not None or node.props or node.where is not None or node.named):
        df = scan_node(c, node.label)
        df = df.select(*prefixed(df, node.var)).withColumnRenamed(node.var, "#id")
        own = [x for x in t.df.columns if x not in df.columns]
        t = Table(t.df.select(*map(col, own)).join(df, col(node.var) == col("#id")).drop("#id"), {**t.scope, node.var: Bound("node")}, t.carry)
    elif node.label is not None:
        from skein.plans.compiler import label_column

        t = Table(t.df.filter(label_column(node.label, col(f"{node.var}.#labels"), False)), t.scope, t.carry)
    return restrict(c, t, node)


def restrict(c: Compiler, t: Table, x: NodePattern | EdgePattern) -> Table:
    for key, value in x.props:
        t = c.filtered(t, Ex("compare", (Ex("prop", (Ex("var", data=x.var),), key), value), "="))
    return c.filtered(t, x.where)


def known_end(g: PropertyGraph, edge: EdgePattern, ways: frozenset, label: Any) -> bool:
    """Whether every step leads to nodes that fit the label, by what the graph's tables state. ways: as the step is taken."""
    if ways - {"R", "L"}:
        return False
    for table in g.edge_tables(edge.label):
        for way in ways:
            end = table.ends[1 if way == "R" else 0]
            there = [x for x in g.nodes if end <= x.labels]
            if not end or not all(label_fits(label, x.labels) for x in there):
                return False
    return True


class Path:
    """Columns ``#nodes``, ``#edges`` and ``#dirs`` that a tracked chain carries along."""

    def __init__(self, c: Compiler, m: Match, tracked: bool):
        self.c, self.mode, self.tracked = c, m.mode, tracked

    def begin(self, t: Table, var: str) -> Table:
        df = t.df.withColumns({"#nodes": F.array(col(var)), "#edges": F.array().cast("array<long>"), "#dirs": F.array().cast("array<tinyint>")})
        return Table(df, t.scope, t.carry)

    def extend(self, df: DataFrame, node: Column, edge: Column, way: Column, back: bool) -> DataFrame:
        """One step further, kept if the mode allows it. back: the chain grows at its start."""
        nodes, edges = col("#nodes"), col("#edges")
        if self.mode == "TRAIL":
            df = df.filter(~F.array_contains(edges, edge))
        elif self.mode == "ACYCLIC":
            df = df.filter(~F.array_contains(nodes, node))
        elif self.mode == "SIMPLE":
            # a closed path goes no further; a step closes it only at its other end
            other = F.element_at(nodes, -1) if back else F.element_at(nodes, 1)
            here = F.element_at(nodes, 1) if back else F.element_at(nodes, -1)
            df = df.filter(((F.size(nodes) == 1) | (other != here)) & (~F.array_contains(nodes, node) | (node == other)))
        if not self.tracked:
            return df
        turned = F.when(way == 2, way).otherwise(1 - way).cast("tinyint") if back else way
        add = (lambda a, x: F.concat(F.array(x), a)) if back else (lambda a, x: F.concat(a, F.array(x)))
        return df.withColumns({"#nodes": add(nodes, node), "#edges": add(edges, edge), "#dirs": add(col("#dirs"), turned)})


def step(c: Compiler, m: Match, t: Table, here: NodePattern, edge: EdgePattern, there: NodePattern, back: bool, path: Path, chain: Chain) -> tuple[Table, tuple[str, bool]]:
    ways = frozenset(FLIP[w] for w in edge.ways) if back else edge.ways
    if edge.quantifier is not None:
        t = quantified(c, m, t, here, edge, there, ways, back, path)
        return t, (edge.var, edge.quantifier != "?")
    near = meeting(c, edge, ways, t.scope[here.var].label if here.label is None else here.label, there.label)
    hops = near.ways(edge.label, ways, named_props(c))
    again = edge.var in t.scope
    name = c.ctx.fresh("e") if again else edge.var
    end = c.ctx.fresh("n")
    hops = hops.select(*prefixed(hops, name), col("#from").alias("#f"), col("#to").alias(end), col("#dir").alias("#d"))
    closed = there.var in t.scope
    on = col(here.var) == col("#f")
    if closed:
        on = on & (col(there.var) == col(end))
    if again:
        on = on & (col(edge.var) == col(name))
    df = path.extend(t.df.join(hops, on), col(end), col(name), col("#d"), back).drop("#f", "#d")
    if again:
        df = df.drop(*[x for x in df.columns if x == name or x.startswith(name + ".")])
    scope = {**t.scope, edge.var: Bound("edge", edge.label)}
    t = restrict(c, Table(df, scope, t.carry), edge)
    known = known_end(near, edge, ways, there.label)
    return arrive(c, t, there, end, closed, known), (edge.var, False)


def meeting(c: Compiler, edge: EdgePattern, ways: frozenset, here: Any, there: Any) -> PropertyGraph:
    """The graph without edge tables whose ends are known to lie at nodes of other labels."""

    def can(end: frozenset, label: Any) -> bool:
        return not end or label is None or any(end <= x.labels and label_fits(label, x.labels) for x in c.graph.nodes)

    kept = []
    for e in c.graph.edge_tables(edge.label):
        a, b = e.ends
        if not e.directed or "R" in ways and can(a, here) and can(b, there) or "L" in ways and can(b, here) and can(a, there):
            kept.append(e)
    return c.graph.with_tables(edges=kept)


def arrive(c: Compiler, t: Table, there: NodePattern, end: str, closed: bool, known: bool) -> Table:
    """Bind the node at the end of a step. known: its label needs no look."""
    if closed:
        return refine(c, Table(t.df.drop(end), t.scope, t.carry), there)
    if known and not there.props and there.where is None and not properties_of(c, there, named_props(c)):
        return Table(t.df.withColumnRenamed(end, there.var), {**t.scope, there.var: Bound("node", there.label)}, t.carry)
    nodes = scan_node(c, there.label)
    nodes = nodes.select(*prefixed(nodes, there.var))
    df = t.df.join(nodes, col(end) == col(there.var)).drop(end)
    return restrict(c, Table(df, {**t.scope, there.var: Bound("node", there.label)}, t.carry), there)


def properties_of(c: Compiler, node: NodePattern, wanted: set | None) -> bool:
    """Whether the query may look at more of a node than its id."""
    if wanted is None:
        return True
    return node.named and any(set(table.df.columns) & wanted for table in c.graph.node_tables(node.label)) or node.var in c.ctx.extra_vars


def quantified(c: Compiler, m: Match, t: Table, here: NodePattern, edge: EdgePattern, there: NodePattern, ways: frozenset, back: bool, path: Path) -> Table:
    low, high = (0, 1) if edge.quantifier == "?" else edge.quantifier
    hops = c.graph.ways(edge.label, ways, named_props(c))
    props = [x for x in hops.columns if not x.startswith("#")]
    inner = hops.select(*prefixed(hops, edge.var), *[col(x) for x in ("#from", "#to", "#dir")])
    inner = restrict(c, Table(inner, {edge.var: Bound("edge")}, ()), edge).df if not names_used([v for _, v in edge.props] + [edge.where]) - {edge.var} else inner
    outer_where = bool(names_used([v for _, v in edge.props] + [edge.where]) - {edge.var})
    record = F.struct(*[col(edge.var if x == "id" else f"{edge.var}.{x}").alias(x) for x in props])
    hops = inner.select(record.alias("#hop"), col("#from").alias("#f"), col("#to").alias("#t"), col("#dir").alias("#d"))
    kind = hops.schema["#hop"].dataType
    base = t.df.withColumns({"#cur": col(here.var), "#list": F.array().cast(T.ArrayType(kind)), "#len": F.lit(0)})
    if path.mode != "WALK" and not path.tracked:
        raise GqlError("a mode needs a tracked path")
    differs = m.different_edges
    shortest = m.selector if m.selector and m.selector[0].startswith("shortest") and m.mode == "WALK" else None
    free = high is None or high > UNROLLED
    levels, frontier, size = [base] if low == 0 else [], base, 0
    origin = [x for x in t.df.columns if x not in ("#nodes", "#edges", "#dirs")]
    while high is None or size < high:
        if size >= MOST_HOPS:
            raise GqlError(f"a path of more than {MOST_HOPS} edges", "5GQL1")
        size += 1
        moved = frontier.join(hops, col("#cur") == col("#f"))
        if differs:
            moved = moved.filter(~F.exists(col("#list"), lambda x: x["id"] == F.col("`#hop`.id")))
        edge_id = F.col("`#hop`.id")
        moved = path.extend(moved, col("#t"), edge_id, col("#d"), back)
        if outer_where:
            as_edge = {f"{edge.var}": edge_id, **{f"{edge.var}.{x}": F.col(f"`#hop`.`{x}`") for x in props if x != "id"}}
            wide = moved.withColumns(as_edge)
            moved = restrict(c, Table(wide, {**t.scope, edge.var: Bound("edge")}, t.carry), edge).df.drop(*as_edge)
        grown = F.concat(F.array(col("#hop")), col("#list")) if back else F.concat(col("#list"), F.array(col("#hop")))
        frontier = moved.withColumns({"#list": grown, "#cur": col("#t"), "#len": F.lit(size)}).drop("#hop", "#f", "#t", "#d")
        if free:
            if shortest and path.tracked:
                frontier = nearest_only(frontier, levels, shortest, origin)
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
        if size >= low:
            levels.append(frontier)
    if not levels:
        levels = [frontier.limit(0)]
    df = reduce(lambda a, b: a.unionByName(b), levels)
    if edge.quantifier == "?":
        one = F.element_at(F.when(F.size("#list") > 0, col("#list")), 1)
        df = df.withColumns({edge.var: one["id"], **{f"{edge.var}.{x}": one[x] for x in props if x != "id"}}).drop("#list", "#len")
        scope = {**t.scope, edge.var: Bound("edge")}
    else:
        df = df.withColumnRenamed("#list", edge.var).drop("#len")
        scope = {**t.scope, edge.var: Bound("edges")}
    end = c.ctx.fresh("n")
    df = df.withColumnRenamed("#cur", end)
    closed = there.var in t.scope
    if closed:
        df = df.filter(col(end) == col(there.var))
    known = low > 0 and known_end(c.graph, edge, ways, there.label)
    return arrive(c, Table(df, scope, t.carry), there, end, closed, known)


def nearest_only(frontier: DataFrame, levels: list[DataFrame], selector: tuple, origin: list[str]) -> DataFrame:
    """Of walks to one place, those that can still begin a selected one: a selected walk's beginnings are selected to their own ends."""
    kind, n = selector
    key = [*map(col, origin), col("#cur")]
    if kind == "shortest":
        w = Window.partitionBy(*key).orderBy("#nodes", "#edges", "#dirs")
        frontier = frontier.withColumn("#i", F.row_number().over(w)).filter(col("#i") <= n).drop("#i")
    if not levels:
        return frontier
    seen = reduce(lambda a, b: a.union(b), [x.select(*key, F.lit(i).alias("#level")) for i, x in enumerate(levels)])
    seen = seen.groupBy(*[col(x) for x in (*origin, "#cur")]).agg((F.count_distinct("#level") if kind == "shortest_groups" else F.count("*")).alias("#n")).filter(col("#n") >= n)
    seen = seen.select(*[col(x).alias(f"#s{i}") for i, x in enumerate((*origin, "#cur"))])
    on = reduce(lambda a, b: a & b, [col(x).eqNullSafe(col(f"#s{i}")) for i, x in enumerate((*origin, "#cur"))])
    return frontier.join(seen, on, "left_anti")


def keep_path(c: Compiler, t: Table, chain: Chain) -> tuple[Table, str]:
    name = chain.path or c.ctx.fresh("path")
    value = F.struct(col("#nodes").alias("nodes"), col("#edges").alias("edges"), col("#dirs").alias("dirs"))
    df = t.df.withColumn(name, value).drop("#nodes", "#edges", "#dirs")
    return Table(df, {**t.scope, name: Bound("path")} if chain.path else t.scope, t.carry), name


def select(t: Table, selector: tuple, keys: list[str], path: str) -> Table:
    """The first paths, or all of the first lengths, for each pair of ends."""
    kind, n = selector
    part = Window.partitionBy(*map(col, dict.fromkeys(keys)))
    p = lambda f: F.col(f"`{path}`.{f}")
    if kind == "shortest":
        rank = F.row_number().over(part.orderBy(F.size(p("edges")), p("nodes"), p("edges"), p("dirs")))
    else:
        rank = F.dense_rank().over(part.orderBy(F.size(p("edges"))))
    return Table(t.df.withColumn("#rank", rank).filter(col("#rank") <= n).drop("#rank"), t.scope, t.carry)
