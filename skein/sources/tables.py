"""A graph view over star-schema tables of orders and an event log."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import EdgeTable, NodeTable, PropertyGraph

#: Where the ids of each label begin, so that ids are unique in the graph.
OFFSET = {name: i << 40 for i, name in enumerate(("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "Document", "Embedding", "User"))}
#: Label, table and key of node tables.
NODES = (
    ("Region", "region", "r_regionkey"),
    ("Nation", "nation", "n_nationkey"),
    ("Customer", "customer", "c_custkey"),
    ("Supplier", "supplier", "s_suppkey"),
    ("Part", "part", "p_partkey"),
    ("Order", "orders", "o_orderkey"),
    ("Event", "events", "event_id"),
    ("Document", "documents", "doc_id"),
    ("Embedding", "embeddings", "vec_id"),
)


def node_id(label: str, key: str):
    return F.lit(OFFSET[label]) + F.col(key).cast("long")


def orders_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Tables are read when a query picks their label, and only in the columns it names."""
    read = lru_cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def node(label: str, name: str, key: str) -> NodeTable:
        return NodeTable(frozenset([label]), lambda: read(name).select(node_id(label, key).alias("id"), "*"))

    def edge(label: str, table: Callable, source: tuple, target: tuple, number: int, key: Any, *props: Any, sure: bool = False) -> EdgeTable:
        ends = frozenset([source[0]]), frozenset([target[0]])
        first = F.lit(100 + number << 50)
        return EdgeTable(label, lambda: table().select((first + key.cast("long")).alias("id"), node_id(*source).alias("src"), node_id(*target).alias("dst"), *props), True, ends, sure)

    def pairs() -> DataFrame:
        return read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))

    def after() -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return read("events").withColumn("next_id", F.lead("event_id").over(w)).filter("next_id is not null")

    def beside(name: str, key: str, where: str) -> Callable:
        """Rows of a table with those of the next key, where the condition holds between a and b."""
        return lambda: read(name).alias("a").join(read(name).alias("b"), F.expr(f"b.{key} = a.{key} + 1")).filter(where)

    followed = beside("orders", "o_orderkey", "a.o_orderpriority = '1-URGENT'")
    alike = beside("embeddings", "vec_id", "a.label = b.label")
    after_text = beside("documents", "doc_id", "a.lang = b.lang")
    users = NodeTable(frozenset(["User"]), lambda: read("events").select("user_id").distinct().select(node_id("User", "user_id").alias("id"), "user_id"))
    col = F.col
    edges = (
        edge("IN_REGION", lambda: read("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), 0, col("n_nationkey")),
        edge("IN_NATION", lambda: read("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), 1, col("c_custkey")),
        edge("IN_NATION", lambda: read("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), 2, col("s_suppkey")),
        edge("PLACED", lambda: read("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), 3, col("o_orderkey"), col("o_totalprice").alias("totalprice"), col("o_orderdate").alias("orderdate")),
        edge("CONTAINS", lambda: read("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"), 4, col("l_orderkey") * 16 + col("l_linenumber"), col("l_quantity").alias("quantity"), col("l_extendedprice").alias("price"), col("l_discount").alias("discount")),
        edge("SUPPLIED", pairs, ("Supplier", "l_suppkey"), ("Part", "l_partkey"), 5, col("l_suppkey") * (1 << 24) + col("l_partkey"), "weight"),
        edge("NEXT", after, ("Event", "event_id"), ("Event", "next_id"), 6, col("event_id"), sure=True),
        edge("FOLLOWED", followed, ("Customer", "a.o_custkey"), ("Customer", "b.o_custkey"), 7, col("a.o_orderkey")),
        edge("ALIKE", alike, ("Embedding", "a.vec_id"), ("Embedding", "b.vec_id"), 8, col("a.vec_id"), sure=True),
        edge("AFTER", after_text, ("Document", "a.doc_id"), ("Document", "b.doc_id"), 9, col("a.doc_id"), sure=True),
    )
    return PropertyGraph(spark, (*(node(*n) for n in NODES), users), edges)
