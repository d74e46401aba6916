"""Catalog, sessions and transactions: text in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.procedures import ALL, Registry
from skein.operators.writes import apply, is_write
from skein.plans.compiler import Compiler, Context, Table
from skein.plans.parser import GqlError, parse
from skein.plans.syntax import Change, Command, Ex, Explain, Project, Query
from skein.sources.durable import written
from skein.sources.graph import EdgeTable, NodeTable, PropertyGraph


TIME_TYPE = "spark.sql.timeType.enabled"


@dataclass
class Entry:
    graph: PropertyGraph
    version: int = 0
    type: str | None = None


@dataclass
class Catalog:
    """Schemas, graph types and named graphs; a graph's version grows with each commit."""

    spark: SparkSession
    graphs: dict[str, Entry] = field(default_factory=dict)
    types: dict[str, dict] = field(default_factory=dict)
    schemas: set = field(default_factory=lambda: {"main"})

    def graph(self, name: str) -> PropertyGraph:
        if name not in self.graphs:
            raise GqlError(f"there is no graph {name}", "42002")
        return self.graphs[name].graph


@dataclass
class Staged:
    name: str
    graph: PropertyGraph
    version: int
    read_only: bool = False


class Session:
    """Runs statements against a catalog's graph, one transaction at a time."""

    def __init__(self, catalog: Catalog, graph: str = "main"):
        self.catalog, self.spark, self.name = catalog, catalog.spark, graph
        if self.spark.conf.isModifiable(TIME_TYPE):  # the language has times of day; Spark asks for this setting
            self.spark.conf.set(TIME_TYPE, "true")
        self.home = graph
        self.params: dict[str, Any] = {}
        self.staged: Staged | None = None
        self.closed = False

    @staticmethod
    def over(graph: PropertyGraph) -> Session:
        return Session(Catalog(graph.spark, {"main": Entry(graph)}))

    @property
    def graph(self) -> PropertyGraph:
        return self.staged.graph if self.staged else self.catalog.graph(self.name)

    def execute(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        if self.closed:
            raise GqlError("the session is closed", "08000")
        tree = parse(text)
        if isinstance(tree, Command):
            return self.command(tree)
        self.graph.extra["type"] = self.catalog.graphs[self.name].type
        ctx = Context(self.graph, {**self.params, **(params or {})}, procedures=Registry(), catalog=self.catalog)
        compiler = Compiler(ctx)
        if is_write(tree):
            return self.change(compiler, tree)
        if not isinstance(tree, Explain):
            check_returns(tree)
        return compiler.run(tree)

    # changes

    def change(self, c: Compiler, tree: Any) -> DataFrame:
        """Clauses in order; without a transaction the change commits on its own."""
        if not isinstance(tree, Query):
            raise GqlError("a change is a single pipeline")
        if self.staged and self.staged.read_only:
            raise GqlError("the transaction is read only", "25G03")
        start = self.catalog.graphs[self.name].version
        before = c.graph
        c.ctx.used = None
        t = Table(None, {})
        for clause in tree.clauses:
            t = apply(c, clause, t) if isinstance(clause, Change) else c.pipeline((clause,), t)
        self.validate(c.graph, before)
        if isinstance(tree.clauses[-1], Project):
            out = written(c.visible(t), "returned")  # what the change saw, whatever changes next
        else:
            out = self.spark.createDataFrame([], "done boolean").drop("done")
        if self.staged:
            self.staged.graph = c.graph
        else:
            self.publish(self.name, c.graph, start)
        return out

    def publish(self, name: str, graph: PropertyGraph, start: int) -> None:
        entry = self.catalog.graphs[name]
        if entry.version != start:
            raise GqlError("another transaction has committed first", "40000")
        self.catalog.graphs[name] = Entry(settled(graph, entry.graph), start + 1, entry.type)

    def validate(self, g: PropertyGraph, before: PropertyGraph) -> None:
        """What a statement changed in a closed graph against its type: labels, required and unique properties. One pass over each changed table."""
        kind = self.catalog.types.get(self.catalog.graphs[self.name].type or "")
        if kind is None:
            return
        old = {id(x.source) for x in (*before.nodes, *before.edges)}
        for t in [t for t in g.nodes if id(t.source) not in old]:
            spec = kind["nodes"].get(t.labels)
            if spec is None:
                if not t.df.isEmpty():
                    raise GqlError(f"the graph's type has no node {'&'.join(sorted(t.labels)) or 'without labels'}", "G2000")
                continue
            value = lambda p: F.col(p["name"]) if p["name"] in t.df.columns else F.lit(None)  # noqa: B023, E731
            required = [p for p in spec if "required" in p["constraints"]]
            unique = [p for p in spec if "unique" in p["constraints"] and p["name"] in t.df.columns]
            tests = [F.count_if(value(p).isNull()) for p in required] + [F.count(value(p)) - F.count_distinct(value(p)) for p in unique]
            found = t.df.agg(*tests).first() if tests else ()
            for k, (p, bad) in enumerate(zip([*required, *unique], found, strict=True)):
                if bad:
                    raise GqlError(f"{p['name']} is {'required' if k < len(required) else 'unique'}", "G2000")
        for e in [e for e in g.edges if id(e.source) not in old]:
            if e.label not in kind["edges"] and not e.df.isEmpty():
                raise GqlError(f"the graph's type has no edge {e.label}", "G2000")

    # commands

    def command(self, x: Command) -> DataFrame:
        f = getattr(self, f"do_{x.kind}")
        out = f(x.data)
        return out if out is not None else self.spark.createDataFrame([], "done boolean").drop("done")

    def do_start(self, d: dict) -> None:
        if self.staged:
            raise GqlError("a transaction is open", "25G01")
        self.staged = Staged(self.name, self.graph, self.catalog.graphs[self.name].version, d["read_only"])

    def ended(self) -> Staged:
        if not self.staged:
            raise GqlError("no transaction is open", "25G02")
        staged, self.staged = self.staged, None
        return staged

    def do_commit(self, d: dict) -> None:
        s = self.ended()
        if s.graph is not self.catalog.graph(s.name):
            self.publish(s.name, s.graph, s.version)

    def do_rollback(self, d: dict) -> None:
        self.ended()

    def do_session_close(self, d: dict) -> None:
        self.staged, self.closed = None, True

    def do_session_set(self, d: dict) -> None:
        if d["what"] == "zone":
            self.spark.conf.set("spark.sql.session.timeZone", d["value"])
        elif d["what"] == "value":
            self.params[d["name"]] = Compiler(Context(self.graph, self.params)).constant(d["value"])
        elif d["what"] == "graph":
            self.catalog.graph(d["value"].split("/")[-1])
            self.name = d["value"].split("/")[-1]
        elif d["value"].split("/")[-1] not in self.catalog.schemas:
            raise GqlError(f"there is no schema {d['value']}", "42002")

    def do_session_reset(self, d: dict) -> None:
        if d["what"] in ("all", "parameter"):
            self.params = {} if d["what"] == "all" else {k: v for k, v in self.params.items() if k != d["name"]}
        if d["what"] in ("all", "zone"):
            self.spark.conf.unset("spark.sql.session.timeZone")
        if d["what"] in ("all", "graph"):
            self.name = self.home

    def do_show(self, d: dict) -> DataFrame:
        g, what = self.graph, d["what"]
        if what == "procedures":
            rows = [(p.name, "algorithm" if n.startswith("algo.") else "built-in", "write" if p.mutates else "read", p.signature, p.yields) for n, p in sorted(ALL.items())]
            return self.spark.createDataFrame(rows, "name string, tier string, mutability string, signature string, yields string")
        if what == "indexes":
            rows = [(k, label, prop) for k, label, prop in sorted(g.extra.get("indexes", {}))]
            return self.spark.createDataFrame(rows, "kind string, label string, property string")
        if what == "node types":
            return self.spark.createDataFrame([(sorted(t.labels), [c for c in t.df.columns if c != "id"]) for t in g.nodes], "labels array<string>, properties array<string>")
        return self.spark.createDataFrame([(t.label, t.directed, [c for c in t.df.columns if c not in ("id", "src", "dst")]) for t in g.edges], "label string, directed boolean, properties array<string>")

    def store(self, kind: str) -> dict | set:
        return {"graph": self.catalog.graphs, "graph type": self.catalog.types, "schema": self.catalog.schemas}[kind]

    def do_create(self, d: dict) -> None:
        kind, name = d["kind"], d["name"].split("/")[-1]
        if kind == "index":
            for p in d["properties"]:
                self.graph.extra.setdefault("indexes", {})["index", d["label"], p] = (name,)
            return
        if kind in ("node type", "edge type"):
            return self.define(kind, name, d, fresh=True)
        there = self.store(kind)
        if name in there and not d["replace"]:
            if d["if_not_exists"]:
                return
            raise GqlError(f"there is a {kind} {name} already", "42N14")
        if kind == "schema":
            there.add(name)
        elif kind == "graph type":
            there[name] = {"nodes": {}, "edges": {}}
            for x in d.get("elements", []):
                nodes = x["kind"] == "node type"
                there[name]["nodes" if nodes else "edges"][frozenset([x["name"]]) if nodes else x["name"]] = x["properties"]
        else:
            if d.get("type") and d["type"].split("/")[-1] not in self.catalog.types:
                raise GqlError(f"there is no graph type {d['type']}", "42002")
            there[name] = Entry(PropertyGraph(self.spark, name=name), type=d["type"].split("/")[-1] if d.get("type") else None)

    def define(self, kind: str, name: str, d: dict, fresh: bool) -> None:
        """Node and edge types belong to the current graph's type; an open graph has none."""
        entry = self.catalog.graphs[self.name]
        if entry.type is None:
            raise GqlError("an open graph has no types of nodes and edges; create one of a graph type", "0A000")
        there = self.catalog.types[entry.type]["nodes" if kind == "node type" else "edges"]
        key = frozenset([name]) if kind == "node type" else name
        if fresh and key in there and not d["if_not_exists"]:
            raise GqlError(f"there is a {kind} {name} already", "42N14")
        if not fresh and key not in there:
            raise GqlError(f"there is no {kind} {name}", "42002")
        if d.get("extends"):
            parent = frozenset([d["extends"]]) if kind == "node type" else d["extends"]
            if parent not in there:
                raise GqlError(f"there is no {kind} {d['extends']}", "42002")
            there[key] = [*there.get(key, []), *there[parent]]
        have = {p["name"] for p in there.get(key, [])}
        if not fresh and any(p["name"] in have for p in d.get("properties", [])):
            raise GqlError("a type can only grow", "42N15")
        there[key] = [*there.get(key, []), *d.get("properties", [])]

    def do_alter(self, d: dict) -> None:
        self.define(d["kind"], d["name"], d, fresh=False)

    def do_drop(self, d: dict) -> None:
        kind, name = d["kind"], d["name"].split("/")[-1]
        if kind == "index":
            found = self.graph.extra.get("indexes", {})
            for k in [k for k, v in found.items() if v == (name,)]:
                del found[k]
            return
        if kind in ("node type", "edge type"):
            there: Any = self.catalog.types.get(self.catalog.graphs[self.name].type or "", {"nodes": {}, "edges": {}})["nodes" if kind == "node type" else "edges"]
            key: Any = frozenset([name]) if kind == "node type" else name
        else:
            there, key = self.store(kind), name
        if key not in there:
            if d["if_exists"]:
                return
            raise GqlError(f"there is no {kind} {name}", "42002")
        if d.get("cascade") and kind in ("node type", "edge type"):
            self.do_truncate(d)
        if kind == "graph type" and any(e.type == name for e in self.catalog.graphs.values()):
            raise GqlError(f"a graph has the type {name}", "G1002")
        there.discard(key) if isinstance(there, set) else there.pop(key)

    def do_truncate(self, d: dict) -> None:
        """Empty the nodes or edges of a type."""
        name, g = d["name"], self.graph
        if d["kind"] == "node type":
            new = g.with_tables(nodes=[NodeTable(t.labels, t.df.limit(0)) if t.labels == frozenset([name]) else t for t in g.nodes])
        else:
            new = g.with_tables(edges=[replace(t, source=t.df.limit(0)) if t.label == name else t for t in g.edges])
        if self.staged:
            self.staged.graph = new
        else:
            self.publish(self.name, new, self.catalog.graphs[self.name].version)


def check_returns(tree: Any) -> None:
    last = tree.clauses[-1] if isinstance(tree, Query) else None
    if isinstance(last, Query):
        return check_returns(last)
    if last is not None and not any(isinstance(c, Project) and c.final or isinstance(c, Query) for c in tree.clauses) and last.__class__.__name__ == "Match":
        raise GqlError("a query ends with RETURN", "42001")


def settled(graph: PropertyGraph, before: PropertyGraph) -> PropertyGraph:
    """What changed is written out, so that lineage does not grow from commit to commit."""
    old = {id(t.source) for t in (*before.nodes, *before.edges)}
    nodes = [t if id(t.source) in old else NodeTable(t.labels, written(t.df, "nodes")) for t in graph.nodes]
    edges = [t if id(t.source) in old else EdgeTable(t.label, written(t.df, "edges"), t.directed, t.ends) for t in graph.edges]
    return graph.with_tables(nodes=nodes, edges=edges)
