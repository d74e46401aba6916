"""Similarity join on word n-grams by MinHash banding.

1. Each text gives its word n-grams, a MinHash signature of them cut into
   bands, and a hash of its words. Texts of the same words are one class and
   take part once.
2. Classes are shuffled on band hashes. A bucket links its members to its
   smallest one, which keeps candidates together with as many rows as members;
   connected components of these links are the groups to verify.
3. Groups are verified on full n-gram sets. A large group is split into blocks
   and every pair of blocks meets in one task of bounded size, where a matrix
   product counts common n-grams. Every pair of a group counts, whether it shares a band or not; a
   task returns, for each member, the number of its links and one edge of a
   spanning forest, so rows do not grow with the pairs.
4. Components of the verified links are the classes that are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import written
from .text import Slice, mix, range_hashes, slices, tidy, word_bounds


@dataclass(frozen=True)
class JaccardJoin:
    """Words in an n-gram, least similarity, least recall of a pair at that similarity, most hashes, most members in a block."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9999
    hashes: int = 192
    block: int = 256
    seed: int = 11


def bands_and_rows(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most rows in a band (so the fewest false candidates) for which enough bands fit into ``hashes``."""
    for rows in range(hashes, 0, -1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError(f"{hashes} hashes do not reach a recall of {recall} at {similarity}")


@lru_cache(maxsize=4)
def multipliers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def ngrams(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams in order; first[i]: the first of text i; and a hash of each text's words (0 without words).

    A text of fewer than n words has one, of all its words.
    """
    starts, ends, first = word_bounds(s)
    word = range_hashes(s.data, starts, ends)
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    gram_first = np.concatenate([[0], np.cumsum(grams)])
    begin = np.arange(gram_first[-1]) + np.repeat(first[:-1] - gram_first[:-1], grams)
    length = np.repeat(np.minimum(count, n), grams)
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + np.where(k < length, padded[begin + k], 0).astype(np.uint64))
    place = np.arange(len(word), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64)
    total = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(mix(word + mix(place + np.uint64(1))), out=total[1:])
    whole = mix(total[first[1:]] - total[first[:-1]] + mix(count.astype(np.uint64)))
    return out, gram_first, np.where(count > 0, whole, 0)


def signatures(grams: np.ndarray, first: np.ndarray, spec: JaccardJoin) -> np.ndarray:
    """(texts, bands): a hash of each band of the MinHash signature; for texts with n-grams."""
    bands, rows = bands_and_rows(spec.similarity, spec.recall, spec.hashes)
    a, b = multipliers(spec.seed, bands * rows)
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    out = np.zeros((len(first) - 1, bands), dtype=np.uint64)
    work = np.empty_like(x)
    for i in range(bands * rows):
        np.multiply(x, a[i], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
        np.bitwise_xor(work, b[i], out=work)
        low = np.minimum.reduceat(work, first[:-1]).astype(np.uint64)
        out[:, i // rows] = mix(out[:, i // rows] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(i + 1))
    return out


def long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), long(values))


def signed(picked: DataFrame, spec: JaccardJoin) -> DataFrame:
    """For each row (key, __text) its key, node (a hash of its words; null without words) and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "__text"):
            grams, first, node = ngrams(s, spec.words)
            some = np.flatnonzero(np.diff(first))
            bands = signatures(grams, np.append(first[some], first[-1]), spec) if len(some) else np.zeros((0, 1), np.uint64)
            off = np.zeros(len(s) + 1, dtype=np.int64)
            off[some + 1] = bands.shape[1]
            column = pa.array(node.view(np.int64), mask=np.diff(first) == 0)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), column, lists(bands.ravel(), np.cumsum(off))], names=["key", "doc_id", "node", "bands"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tidy(run), f"key long, doc_id {kind}, node long, bands array<long>")


def gram_sets(rows: DataFrame, spec: JaccardJoin) -> DataFrame:
    """(root, size, node, copies, set) from (root, size, node, copies, __text); texts that are not the node's own are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "__text"):
            grams, first, node = ngrams(s, spec.words)
            own = np.flatnonzero(node.view(np.int64) == s.rows.column(2).to_numpy(zero_copy_only=False))
            if not len(own):
                continue
            sets = [np.unique(grams[first[i] : first[i + 1]]) for i in own]
            rest = s.rows.take(pa.array(own))
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(4)), lists(np.concatenate(sets), off)], names=["root", "size", "node", "copies", "set"])

    return rows.mapInArrow(tidy(run), "root long, size long, node long, copies long, set array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common members, from columns that two sets at least share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), dtype=np.float64)
    step = max(1, (1 << 21) // n)
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, step), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def verify(node: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a group: links, counted with copies, to members of the other side (of any side if there is one); and a spanning forest's root."""
    size = np.array([len(x) for x in sets], dtype=np.float64)
    common = common_counts(sets)
    either = size[:, None] + size[None, :] - common
    linked = common >= similarity * either - 1e-9
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    root = np.arange(len(node))
    for i in np.argsort(node, kind="stable"):
        if root[i] != i:
            continue
        todo = [i]
        while todo:  # what hangs together takes the smallest node as root
            x = todo.pop()
            new = np.flatnonzero(linked[x] & (root == np.arange(len(node))) & (np.arange(len(node)) != i))
            root[new] = i
            todo.extend(new.tolist())
    return (linked * copies[None, :]).sum(axis=1), node[root]


def verified(rows: DataFrame, spec: JaccardJoin) -> DataFrame:
    """(node, links, other): what each task found for its members."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]) if len(key) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and (key[lo] != last).any():
                    yield pa.Table.from_batches(held)
                    held = []
                last = key[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            get = lambda c: table[c].combine_chunks()  # noqa: B023, E731
            node, first = np.unique(get("node").to_numpy(), return_index=True)  # repeated rows bring a class twice
            copies, own = get("copies").to_numpy()[first], get("own").to_numpy()[first]
            i, j = get("i")[0].as_py(), get("j")[0].as_py()
            values = get("set")
            off, flat = values.offsets.to_numpy(), values.values.to_numpy()
            sets = [flat[off[k] : off[k + 1]] for k in first]
            if len(node) < 2:
                continue
            side = (own == j) & (i != j)
            links, other = verify(node, copies, side, sets, spec.similarity)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(other)], names=["node", "links", "other"])

    return rows.mapInArrow(tidy(run), "node long, links long, other long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: a hash of id and text, equal for repeated rows."""
    return F.xxhash64(doc_id, text)


def near_duplicates(docs: DataFrame, spec: JaccardJoin = JaccardJoin(), doc_id: str = "doc_id", text: str = "text", with_keys: bool = False) -> DataFrame:
    """Rows (doc_id, class_id, n_links, n_copies), one for each row of ``docs``; with ``with_keys`` also key (``row_key``) and first_key: that of the class's row with the smallest id (null last, ties to the smaller key), null for texts without words.

    class_id is the smallest doc_id of the texts that links join, directly or
    through others; n_links is the number of other rows whose n-gram sets have
    the least similarity or more, copies included; n_copies the number of rows
    with the same words, itself included.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer words than an n-gram has
    one n-gram of them all. Null and empty texts have none: no links, a class
    of their own, and n_copies 1. Repeated rows are copies. Rows with a null id
    take part; a class of such rows alone has a null class_id. An empty table
    gives no rows; columns other than the two play no part.

    Scale: the one wide thing that is shuffled is the text of rows in groups to
    verify. Nothing is collected; a clash of two texts' 64-bit hashes has a
    chance of n^2 / 2^65 among n different texts.
    """
    keyed = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    rows = written(signed(keyed, spec), "signatures")
    classes = written(rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"), F.count("*").alias("copies")), "text-classes")
    one = rows.filter("node is not null").select("key", "node", "bands").join(classes.select("key", "node"), ["key", "node"])
    buckets = one.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node")
    lowest = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket", "least")
    stars = buckets.join(lowest, "bucket").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    groups = components(stars, "candidates")
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = written(groups.join(sizes, "root").join(classes.select("node", "key", "copies"), "node"), "groups")
    texts = members.hint("shuffle_hash").join(keyed.select("key", "__text"), "key").select("root", "size", "node", "copies", "__text")
    sets = gram_sets(texts, spec)
    blocks = F.ceil(F.col("size") / spec.block)
    own = F.pmod(F.xxhash64("node"), blocks)
    spread = sets.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.select("root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "copies", "set")
    found = written(verified(spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), spec), "links")
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "linked")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "least", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("first"))
    known = known.join(least, "root").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = rows.select("doc_id", "key", "node").join(known, "node", "left")
    keys = ["key", "first_key"] if with_keys else []
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), *keys)
