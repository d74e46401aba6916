"""Graphs on disk: a Parquet table for each node and edge table, and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .graph import EdgeTable, NodeTable, PropertyGraph


def save(graph: PropertyGraph, path: str) -> None:
    """Write the graph to an empty folder. The manifest comes last, so a folder without one is not a graph."""
    tables = []
    for i, t in enumerate(graph.nodes):
        t.df.write.parquet(f"{path}/nodes-{i}")
        tables.append({"kind": "node", "path": f"nodes-{i}", "labels": sorted(t.labels)})
    for i, e in enumerate(graph.edges):
        e.df.write.parquet(f"{path}/edges-{i}")
        tables.append({"kind": "edge", "path": f"edges-{i}", "label": e.label, "directed": e.directed, "ends": [sorted(x) for x in e.ends]})
    manifest = json.dumps({"format": 1, "name": graph.name, "tables": tables})
    graph.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> PropertyGraph:
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest["format"] != 1:
        raise ValueError(f"unknown format {manifest['format']}")
    read = lambda t: lambda: spark.read.parquet(f"{path}/{t['path']}")
    nodes = tuple(NodeTable(frozenset(t["labels"]), read(t)) for t in manifest["tables"] if t["kind"] == "node")
    edges = tuple(EdgeTable(t["label"], read(t), t["directed"], tuple(map(frozenset, t["ends"]))) for t in manifest["tables"] if t["kind"] == "edge")
    return PropertyGraph(spark, nodes, edges, manifest["name"])
