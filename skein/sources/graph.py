"""Property graphs over ordinary tables.

A graph is a list of node tables and a list of edge tables. A node table has
one set of labels, so a label expression picks whole tables before anything is
read; columns that a query does not name are never scanned.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.parser import GqlError


def label_fits(expr: Any, labels: frozenset) -> bool:
    """A label expression (or None) against a set of labels."""
    if expr is None:
        return True
    op, *rest = expr
    if op == "label":
        return rest[0] in labels
    if op == "any":
        return bool(labels)
    if op == "not":
        return not label_fits(rest[0], labels)
    test = (label_fits(r, labels) for r in rest)
    return all(test) if op == "and" else any(test)


class Deferred:
    """``source``: a DataFrame, or a function that reads it when a query first picks the table."""

    source: Any

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source


@dataclass(frozen=True)
class NodeTable(Deferred):
    """df: id (long, unique in the graph) and properties."""

    labels: frozenset
    source: Any


@dataclass(frozen=True)
class EdgeTable(Deferred):
    """df: id, src, dst (long) and properties. ends: the labels that all sources and all targets have, where they are known. sure: each end that is not null is a node of the graph with these labels."""

    label: str
    source: Any
    directed: bool = True
    ends: tuple[frozenset, frozenset] = (frozenset(), frozenset())
    sure: bool = False


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    name: str = "main"
    extra: dict = field(default_factory=dict, compare=False)

    def with_tables(self, nodes: Any = None, edges: Any = None) -> PropertyGraph:
        return replace(self, nodes=self.nodes if nodes is None else tuple(nodes), edges=self.edges if edges is None else tuple(edges))

    def node_tables(self, label: Any) -> list[NodeTable]:
        return [t for t in self.nodes if label_fits(label, t.labels)]

    def edge_tables(self, label: Any) -> list[EdgeTable]:
        return [t for t in self.edges if label_fits(label, frozenset([t.label]))]

    def scan_nodes(self, label: Any = None, used: set | None = None) -> DataFrame:
        """id, ``#labels`` and the used properties of the nodes that fit; each node once, whatever alternatives it fits."""
        parts = []
        for t in self.node_tables(label):
            props = [c for c in t.df.columns if c != "id" and (used is None or c in used)]
            parts.append(t.df.select("id", F.array(*map(F.lit, sorted(t.labels))).cast("array<string>").alias("#labels"), *props))
        if not parts:
            return self.spark.createDataFrame([], "id long, `#labels` array<string>")
        return united(parts)

    def scan_edges(self, label: Any = None, used: set | None = None) -> DataFrame:
        """id, ``#label``, ``#src``, ``#dst``, ``#directed`` and the used properties of the edges that fit."""
        parts = []
        for t in self.edge_tables(label):
            props = [c for c in t.df.columns if c not in ("id", "src", "dst") and (used is None or c in used)]
            parts.append(t.df.select("id", F.lit(t.label).alias("#label"), F.col("src").alias("#src"), F.col("dst").alias("#dst"), F.lit(t.directed).alias("#directed"), *props))
        if not parts:
            return self.spark.createDataFrame([], "id long, `#label` string, `#src` long, `#dst` long, `#directed` boolean")
        return united(parts)

    def ways(self, label: Any, ways: frozenset, used: set | None = None) -> DataFrame:
        """Edges as steps: ``#from``, ``#to`` and ``#dir`` (0 out, 1 in, 2 undirected). A loop is one step, however many ways it fits."""
        tables = self.edge_tables(label)
        sides = []
        directed = self.with_tables(edges=[t for t in tables if t.directed])
        plain = self.with_tables(edges=[t for t in tables if not t.directed])
        step = lambda df, a, b, d: df.select(F.col(a).alias("#from"), F.col(b).alias("#to"), F.lit(d).cast("byte").alias("#dir"), *[f"`{c}`" for c in df.columns])
        if directed.edges and "R" in ways:
            sides.append(step(directed.scan_edges(None, used), "#src", "#dst", 0))
        if directed.edges and "L" in ways:
            back = directed.scan_edges(None, used)
            sides.append(step(back.filter("`#src` <> `#dst`") if "R" in ways else back, "#dst", "#src", 1))
        if plain.edges and "U" in ways:
            both = plain.scan_edges(None, used)
            sides.append(step(both, "#src", "#dst", 2))
            sides.append(step(both.filter("`#src` <> `#dst`"), "#dst", "#src", 2))
        if not sides:
            return step(self.with_tables(edges=()).scan_edges(), "#src", "#dst", 0)
        return united(sides)

    @staticmethod
    def of_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> PropertyGraph:
        """A small graph from rows: nodes {id, labels, ...}, edges {id, label, src, dst, directed, ...}."""

        def table(rows: list[dict], fixed: list[str], drop: set) -> DataFrame:
            props = sorted({k for r in rows for k in r} - drop)
            kinds = [f"`{p}` {ddl_type([r.get(p) for r in rows])}" for p in props]
            return spark.createDataFrame([(*(r[f] for f in fixed), *(r.get(p) for p in props)) for r in rows], ", ".join([f"{f} long" for f in fixed] + kinds))

        by_labels: dict = {}
        for r in nodes:
            by_labels.setdefault(frozenset(r["labels"]), []).append(r)
        by_kind: dict = {}
        for r in edges:
            by_kind.setdefault((r["label"], r.get("directed", True)), []).append(r)
        return PropertyGraph(
            spark,
            tuple(NodeTable(k, table(v, ["id"], {"id", "labels"})) for k, v in by_labels.items()),
            tuple(EdgeTable(k[0], table(v, ["id", "src", "dst"], {"id", "label", "src", "dst", "directed"}), k[1]) for k, v in by_kind.items()),
        )


def ddl_type(values: list) -> str:
    from datetime import date, datetime
    from decimal import Decimal

    v = next((v for v in values if v is not None), None)
    if isinstance(v, list):
        return f"array<{ddl_type(v)}>"
    kinds = ((bool, "boolean"), (int, "long"), (float, "double"), (Decimal, "decimal(38,10)"), (bytes, "binary"), (datetime, "timestamp"), (date, "date"))
    return next((k for t, k in kinds if isinstance(v, t)), "string")


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
