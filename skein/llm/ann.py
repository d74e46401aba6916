"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs
and a Walsh-Hadamard transform) and assigned to the nearest signed axis; one
or more such axes make the bucket of a table. A query probes, in each table,
the buckets whose axes lie nearest to it. Buckets with one first axis travel
together, as a cell, so that a query goes once to a cell whatever number of its
buckets it probes. Bucket by bucket, queries meet vectors in matrix products in
double precision, and only each query's best leave the task, so rows grow with
queries and not with pairs. Queries whose buckets hold too few vectors meet all.

Equal vectors are indexed once, with the few smallest ids that any query could
need; cells are split into blocks of bounded size on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import written
from .text import tidy


@dataclass(frozen=True)
class PolytopeIndex:
    """tables, probes in each; axes: rotations joined to one bucket key; block: most rows of a side in a task; large: distinct vectors from which ``for_size`` has finer buckets. ``nearest`` takes an index as it is, whatever the table's size."""

    tables: int = 10
    probes: int = 16
    axes: int = 1
    block: int = 4096
    seed: int = 7
    large: int = 1_000_000

    def for_size(self, vectors: int) -> PolytopeIndex:
        """For callers who ask for it: two axes and 512 probes for large tables. Of all vectors a query then meets half of what it does with one axis, in buckets a hundredth as large, and may find others."""
        return replace(self, axes=2, probes=max(self.probes, 512)) if self.axes == 1 and vectors >= self.large else self


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=8)
def signs(index: PolytopeIndex, n: int) -> np.ndarray:
    return np.random.default_rng(index.seed).choice([-1.0, 1.0], (index.tables, index.axes, 3, n))


def axis_scores(unit: np.ndarray, index: PolytopeIndex, table: int, axis: int) -> np.ndarray:
    """Scores of the 2n signed axes for each row."""
    n = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), n))
    x[:, : unit.shape[1]] = unit
    for d in signs(index, n)[table, axis]:
        x = transform(x * d)
    return np.concatenate([x, -x], axis=1)


def buckets(vectors: np.ndarray, index: PolytopeIndex, probes: int) -> np.ndarray:
    """(rows, tables, probes): the nearest buckets of each row, nearest first; fewer if there are fewer."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    for table in range(index.tables):
        keys, cost = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
        for axis in range(index.axes):
            score = axis_scores(unit, index, table, axis)
            near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            lost = (score.max(axis=1, keepdims=True) - np.take_along_axis(score, near, axis=1)) ** 2
            keys = (keys[:, :, None] * score.shape[1] + near[:, None, :]).reshape(len(unit), -1)
            cost = (cost[:, :, None] + lost[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            keys, cost = np.take_along_axis(keys, best, axis=1), np.take_along_axis(cost, best, axis=1)
        out.append(keys)
    return np.stack(out, axis=1)


def bucketed(df: DataFrame, index: PolytopeIndex, probes: int, keep: list[str], kinds: str) -> DataFrame:
    """A row for each cell that holds one of ``probes`` buckets of a table: keep, table, dim, cell, and subs: the buckets in it. Rows of equal dimension only, batch by batch."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec"))
            size = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                part = batch.take(pa.array(at))
                x = part.column(part.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                width = (2 << max(0, int(dim) - 1).bit_length()) ** (index.axes - 1)
                for lo in range(0, len(x), 2048):
                    b = np.sort(buckets(x[lo : lo + 2048], index, probes), axis=2)
                    rows, tables, n = b.shape
                    cell = b // width
                    first = np.ones(b.shape, dtype=bool)
                    first[:, :, 1:] = cell[:, :, 1:] != cell[:, :, :-1]
                    row, table, _ = np.nonzero(first)
                    starts = np.append(np.flatnonzero(first.ravel()), b.size)
                    own = part.slice(lo, rows).take(pa.array(row))
                    subs = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array((b % width).ravel().astype(np.int32)))
                    more = [pa.array(table.astype(np.int32)), pa.array(np.full(len(row), dim, dtype=np.int32)), pa.array(cell[first]), subs]
                    yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in keep), *more], names=[*keep, "table", "dim", "cell", "subs"])

    return df.mapInArrow(tidy(run), f"{kinds}, table int, dim int, cell long, subs array<int>")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def best_of(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n largest in each row, of equals the first ones."""
    edge = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
    above = score > edge
    ties = score == edge
    room = n - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (ties & (np.cumsum(ties, axis=1) <= room)))


def met(one: pa.Table, two: pa.Table, k: int) -> pa.Table:
    """The k best vectors of ``one`` for each query of ``two``, bucket by bucket. A query without a list of buckets meets all."""
    names = ["q", "key", "ids", "score"]
    kinds = pa.schema([("q", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not one.num_rows or not two.num_rows:
        return kinds.empty_table()
    v, q = matrix(one["vec"]), matrix(two["vec"])
    norm_v, norm_q = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
    keys, own = one["key"].to_numpy(), one["subs"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((keys, own))
    asked = two["subs"].combine_chunks()
    sizes = np.diff(asked.offsets.to_numpy())
    if (sizes == 0).any():
        order, own, pairs, subs = np.argsort(keys, kind="stable"), np.zeros(len(keys), np.int32), np.arange(len(q)), np.zeros(len(q), np.int32)
    else:
        pairs, subs = np.repeat(np.arange(len(q)), sizes), asked.flatten().to_numpy()
        by = np.argsort(subs, kind="stable")
        pairs, subs = pairs[by], subs[by]
    own = own[order]
    out_q, out_v, out_s = [], [], []
    for sub in np.intersect1d(own, subs):
        at = order[slice(*np.searchsorted(own, [sub, sub + 1]))]
        who = pairs[slice(*np.searchsorted(subs, [sub, sub + 1]))]
        for lo in range(0, len(who), 256):
            some = who[lo : lo + 256]
            score = (q[some] @ v[at].T) / (norm_q[some, None] * norm_v[None, at])
            r, c = best_of(score, min(k, len(at)))
            out_q.append(some[r])
            out_v.append(at[c])
            out_s.append(score[r, c])
    if not out_q:
        return kinds.empty_table()
    qi, vi, score = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
    by = np.lexsort((keys[vi], -score, qi))
    qi, vi, score = qi[by], vi[by], score[by]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    qi, vi, score = qi[rank < k], vi[rank < k], score[rank < k]
    return pa.Table.from_arrays([two["q"].take(pa.array(qi)), pa.array(keys[vi]), one["ids"].combine_chunks().take(pa.array(vi)), pa.array(score)], names=names).cast(kinds)


def usable(vector: Column) -> Column:
    """Not null, of finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def meetings(indexed: DataFrame, probes: DataFrame, index: PolytopeIndex, k: int) -> DataFrame:
    """(q, key, ids, score): of each cell that queries and vectors share, each query's k best in each pair of blocks."""
    cell = ["table", "dim", "cell"]
    sizes = indexed.groupBy(*cell).agg(F.ceil(F.count("*") / index.block).cast("long").alias("v_blocks"))
    asks = probes.groupBy(*cell).agg(F.ceil(F.count("*") / index.block).cast("long").alias("q_blocks"))
    blocks = written(sizes.join(asks, cell), "ann-blocks")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = indexed.join(blocks, cell).withColumn("v_block", F.pmod(F.xxhash64("key"), F.col("v_blocks"))).withColumn("q_block", to("q_blocks"))
    right = probes.join(blocks, cell).withColumn("q_block", F.pmod(F.xxhash64("q"), F.col("q_blocks"))).withColumn("v_block", to("v_blocks"))
    at = [*cell, "v_block", "q_block"]
    left, right = left.select(*at, "key", "ids", "vec", "subs").groupBy(*at), right.select(*at, "q", "vec", "subs").groupBy(*at)
    return left.cogroup(right).applyInArrow(lambda one, two: met(one, two, k), "q long, key long, ids array<long>, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, index: PolytopeIndex = PolytopeIndex(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, the k nearest others found by cosine, in double precision.

    Ties go to the smaller id; rank starts from 1. Null, zero or non-finite
    vectors take no part, on either side. Vectors are only compared to those of
    equal dimension. Repeated rows (same id and vector) count once; a query's
    own id is never a candidate, whatever vector it carries. A query whose
    buckets hold fewer than k others meets all of them, so it gets k, or all if
    there are fewer. An empty table, or no query, gives no rows. Columns other
    than the two play no part.
    """
    kind = rows.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    all_rows = rows.select(F.col(id_column).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"), is_query.alias("asks")).filter(usable(F.col("vec")) & F.col("id").isNotNull())
    # the k + 1 smallest ids of each distinct vector: a query needs k at most besides itself
    first = Window.partitionBy("vec").orderBy("id")
    few = all_rows.select("id", "vec").distinct().withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1)
    distinct = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.col("ids")[0]), "ann-index")
    asking = all_rows.filter("asks").select("id", "vec").distinct()
    # equal vectors ask once; the key tells both sides apart by their smallest id and vector
    asked = asking.select("vec").distinct().join(distinct.select("vec", "key"), "vec").select(F.col("key").alias("q"), "vec")

    indexed = bucketed(distinct.select("key", "ids", "vec"), index, 1, ["key", "ids", "vec"], f"key long, ids array<long>, vec array<{kind}>")
    probes = bucketed(asked, index, index.probes, ["q", "vec"], f"q long, vec array<{kind}>")
    found = written(meetings(indexed, probes, index, k + 1), "ann-found")
    # a query that met too few goes on to all vectors of its dimension, which one table's cells hold
    there = distinct.groupBy(F.size("vec").alias("dim")).agg(F.sum(F.size("ids")).alias("there"))
    some = found.select("q", "key", F.size("ids").alias("n")).distinct().groupBy("q").agg(F.sum("n").alias("n"))
    few = asked.join(some, "q", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") <= k).withColumn("dim", F.size("vec"))
    few = written(few.join(there, "dim").filter("n < there").select("q", "vec", "dim"), "ann-few")
    if not few.isEmpty():
        cells = written(indexed.filter("table = 0").select("table", "dim", "cell").distinct(), "ann-cells")
        found = found.union(meetings(indexed.filter("table = 0"), few.join(cells, "dim").select("q", "vec", "table", "dim", "cell", F.array().cast("array<int>").alias("subs")), index, k + 1))
    pairs = found.groupBy("q", "key").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    near = pairs.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k + 1)
    lists = near.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    who = asking.join(distinct.select("vec", F.col("key").alias("q")), "vec").select("id", "q")
    each = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("lost"), i.alias("vec_id")))))
    ranked = who.join(lists, "q").select(F.col("id").alias("query_id"), F.slice(F.sort_array(F.filter(each, lambda e: e["vec_id"] != F.col("id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.lost")).alias("score"))
