"""Connected components by alternating stars, on tables that outlive executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.durable import discard, tidy_shuffles, written


#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node of each one's component, by hooking roots to smaller ones and halving paths."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root = above


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (lo, hi) that connect what the edges (a, b) of a task connect; edges that lie together need no rounds."""

    def stars(a: list, b: list) -> pa.RecordBatch:
        ids, root = rooted(np.concatenate(a), np.concatenate(b))
        leaf = ids != root
        return pa.RecordBatch.from_arrays([pa.array(root[leaf]), pa.array(ids[leaf])], names=["lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= CHUNK:
                yield stars(a, b)
                a, b, held = [], [], 0
        if held:
            yield stars(a, b)

    return edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "lo long, hi long")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def are_stars(pairs: DataFrame) -> bool:
    """Whether each node hangs at one that is smaller than all of its neighbours: none has a smaller neighbour beside another one."""
    near = both_ways(pairs).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    with tidy_shuffles(pairs.sparkSession):
        return near.filter("m < u and n > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b: long) but the roots; a root is its component's smallest node.

    Loops, null ends and repeated edges are ignored; without edges the result
    is empty. First each task contracts the edges that it holds. Then each round connects a node's larger neighbours to its smallest
    one, then all of a node's smaller neighbours to the smallest, until stars
    are left; the number of rounds grows with the logarithm of the size. The
    driver sees one bit for each round, and joins send it nothing.
    """
    pairs = written(contracted(edges).distinct(), name)
    while not are_stars(pairs):
        both = both_ways(pairs)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").filter("m <> v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest.hint("merge"), "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), "hi"), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
        before, pairs = pairs, written(small.select("e.lo", "e.hi").filter("lo <> hi").distinct(), name)
        discard(before)
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
