"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Sorting every suffix is not needed. In each window of ``length`` bytes the
smallest hash of a ``gram`` picks an anchor, by content alone; so two equal
windows have anchors at equal places, and the suffixes from anchors are enough
to find every repeat. Anchors whose gram occurs once are left out.

Each task sorts the suffixes from its anchors into runs and sends them out
front-coded: the length of the prefix shared with the one before, and the rest.
A run goes to the partition of its grams, where a loser tree merges all runs.
The tree keeps, for each loser, the length of the prefix it shares with the
winner; a match compares these numbers first and bytes only beyond them, so no
known prefix is compared again. What it puts out is a suffix array with LCPs.

Suffixes of one gram then form a group. The LCPs give its tree of common right
contexts; merging its branches from the deepest, the smaller into the larger,
each suffix meets its neighbours in the order of left contexts. A pair with L
equal bytes to the left and R to the right, L + R >= length, is a repeat that
covers [anchor - L, anchor + R) on both sides; the neighbours have the largest
L for each R, so all other pairs cover no more.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written
from .text import Slice, mix, slices, tidy


@dataclass(frozen=True)
class RepeatRules:
    """length: bytes of the shortest repeat; gram: bytes that make an anchor; run_bytes: most bytes of a run; partition_entries: suffixes that a partition is meant to hold; words: words that a removed run holds at least; gap: what stands in the text between the parts around a removed run."""

    length: int = 400
    gram: int = 32
    run_bytes: int = 16 << 20
    partition_entries: int = 20_000
    words: int = 0
    gap: str = ""


SLICE = 1 << 18
BLOB = 1 << 20
HEAD = struct.Struct("<HHHHqiB")
LAST = np.iinfo(np.uint64).max


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of 8) from each position that has as many."""
    n = len(data) - gram + 1
    word = data.astype(np.uint64)
    for shift in (1, 2, 4):
        word = word[:-shift] | (word[shift:] << np.uint64(8 * shift))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(0, gram, 8):
        out = (out ^ word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over values[i:i + width] for each i, with ``fill`` beyond the end."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, fill, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = ufunc.accumulate(rows, axis=1).ravel()
    behind = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(s: Slice, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text, and gram hash of every anchor."""
    size = np.diff(s.off)
    if len(s.data) < rules.length or size.max() < rules.length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    width = rules.length - rules.gram + 1
    value = np.full(len(s.data), LAST, dtype=np.uint64)
    value[: len(s.data) - rules.gram + 1] = np.minimum(gram_hashes(s.data, rules.gram), LAST - np.uint64(1)) | np.uint64(1)
    least = sliding(value, width, np.minimum, LAST)
    whole = np.zeros(len(s.data) + 1, dtype=np.int32)  # windows that lie in one text
    long = size >= rules.length
    whole[s.off[:-1][long]] += 1
    np.subtract.at(whole, s.off[1:][long] - rules.length + 1, 1)
    least[np.cumsum(whole[:-1]) == 0] = 0
    # the largest minimum of the windows that hold a position equals its value if it is the smallest of one
    most = sliding(least[::-1], width, np.maximum, 0)[::-1]
    at = np.flatnonzero((value == most) & (most > 0))
    text = np.searchsorted(s.off, at, side="right") - 1
    return text, at - s.off[text], value[at]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, bytes, int, int, int]]) -> Iterator[bytes]:
    """Blobs of sorted entries (right, left reversed, key, place, known)."""
    out, size, right, left = [], 0, b"", b""
    for r, l, key, place, known in entries:  # noqa: E741
        p, q = common(right, r), common(left, l)
        out += (HEAD.pack(p, len(r) - p, q, len(l) - q, key, place, known), r[p:], l[q:])
        size += HEAD.size + len(r) - p + len(l) - q
        right, left = r, l
        if size >= BLOB:
            yield b"".join(out)
            out, size = [], 0
    if out:
        yield b"".join(out)


def decoded(blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """Entries of a run, with the prefix that each shares with the one before."""
    right, left = b"", b""
    for blob in blobs:
        at = 0
        while at < len(blob):
            p, n, q, m, key, place, known = HEAD.unpack_from(blob, at)
            at += HEAD.size
            right = right[:p] + blob[at : at + n]
            left = left[:q] + blob[at + n : at + n + m]
            at += n + m
            yield p, right, left, key, place, known


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple]]:
    """Entries of all runs in order of their right contexts, each with the prefix it shares with the one before, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k  # with the last winner
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if heads[y] is None:
            return x, y
        if heads[x] is None:
            return y, x
        p, q = shared[x], shared[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        a, b = heads[x][1], heads[y][1]
        p += common(a[p:], b[p:])
        if a[p : p + 1] <= b[p : p + 1]:
            shared[y] = p
            return x, y
        shared[x] = p
        return y, x

    winners = [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads[best] is not None:
        yield shared[best], heads[best]
        heads[best] = head = next(runs[best], None)
        shared[best] = head[0] if head else 0
        node = (best + k) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


def covers(group: list[tuple[int, tuple]], length: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) for each suffix of a group that is not known already and lies in a repeat. group: in order, with shared prefixes."""
    n = len(group)
    if n < 2 or all(e[5] for _, e in group):
        return
    left = [e[2] for _, e in group]
    to_left, to_right = [0] * n, [0] * n

    def pair(x: int, y: int, right: int) -> None:
        both = common(left[x], left[y])
        if both + right >= length:
            for z in (x, y):
                to_left[z] = max(to_left[z], both)
                to_right[z] = max(to_right[z], right)

    if n == 2:
        pair(0, 1, group[1][0])
    else:
        by_left = sorted(range(n), key=left.__getitem__)
        rank = [0] * n
        for i, x in enumerate(by_left):
            rank[x] = i
        part = list(range(n))
        members = {x: [rank[x]] for x in range(n)}

        def find(x: int) -> int:
            while part[x] != x:
                part[x] = part[part[x]]
                x = part[x]
            return x

        for i in sorted(range(1, n), key=lambda i: -group[i][0]):
            right = group[i][0]
            a, b = find(i - 1), find(i)
            if len(members[a]) < len(members[b]):
                a, b = b, a
            large = members[a]
            for r in members.pop(b):
                at = bisect_left(large, r)
                if at:
                    pair(by_left[large[at - 1]], by_left[r], right)
                if at < len(large):
                    pair(by_left[large[at]], by_left[r], right)
                large.insert(at, r)
            part[b] = a
    for x, (_, e) in enumerate(group):
        if to_right[x] and not e[5]:
            yield e[3], e[4] - to_left[x], e[4] + to_right[x]


def interval_batch(rows: list[tuple[int, int, int]]) -> list[pa.Array]:
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return [pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)]


def runs_of(asked: DataFrame, rules: RepeatRules, partitions: int) -> DataFrame:
    """Rows (key, __text, wanted: array of (place, gram hash)) to front-coded runs and to covers that a task knows by itself (without a run)."""
    names = ["part", "run", "nth", "blob", "key", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[tuple[int, bytes, bytes], list] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            by_part: dict[int, list] = {}
            for (part, right, left), (key, place, known) in contexts.items():
                by_part.setdefault(part, []).append((right, left, key, place, known))
            name = uuid.uuid4().hex
            for part, entries in by_part.items():
                entries.sort()
                for nth, blob in enumerate(front_coded(entries)):
                    zero = pa.array([0], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([nth], pa.int64()), pa.array([blob], pa.binary()), zero, zero, zero], names=names)
            contexts.clear()

        for s in slices(batches, "__text"):
            found = []
            raw, off = s.raw(), s.off
            keys, wanted = s.rows.column(0).to_pylist(), s.rows.column(2)
            cut = wanted.offsets.to_numpy()
            fields = wanted.values
            places, hashes = fields.field(0).to_numpy(), fields.field(1).to_numpy().view(np.uint64)
            for i, key in enumerate(keys):
                lo, hi = int(off[i]), int(off[i + 1])
                turned = raw[lo:hi][::-1]
                for place, h in zip(places[cut[i] : cut[i + 1]].tolist(), hashes[cut[i] : cut[i + 1]].tolist(), strict=True):
                    right = raw[lo + place : min(hi, lo + place + rules.length)]
                    left = turned[hi - lo - place : hi - lo - place + rules.length]
                    if len(right) + len(left) < rules.length:
                        continue
                    entry = contexts.get(at := (h % partitions, right, left))
                    if entry is None:
                        contexts[at] = [key, place, 0]
                        held += len(right) + len(left)
                        continue
                    if not entry[2]:  # two with equal contexts: nothing covers more
                        found.append((entry[0], entry[1] - len(left), entry[1] + len(right)))
                        entry[2] = 1
                    found.append((key, place - len(left), place + len(right)))
                if held > rules.run_bytes:
                    yield from sent()
                    held = 0
            if found:  # these need no merge, and only pass through one of its partitions
                n = len(found)
                none = pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
                keys, starts, stops = interval_batch(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys.to_numpy() % partitions), *none, keys, starts, stops], names=names)
        yield from sent()

    return asked.mapInArrow(tidy(run), "part long, run string, nth long, blob binary, key long, start long, stop long")


def repeats(runs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(key, start, stop) of what runs have in common, and of what was known before. runs: sorted by part, run and nth in each partition."""

    def of(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        found, group = [], []
        for shared, entry in merged([decoded(b) for b in held.values()]):
            if shared < rules.gram and group:
                found.extend(covers(group, rules.length))
                group = []
            group.append((shared, entry))
            if len(found) > 1 << 16:
                yield pa.RecordBatch.from_arrays(interval_batch(found), names=["key", "start", "stop"])
                found = []
        found.extend(covers(group, rules.length))
        yield pa.RecordBatch.from_arrays(interval_batch(found), names=["key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        last = None
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column(1)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(i) for i in (4, 5, 6)], names=["key", "start", "stop"])
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for part, name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if part != last and held:
                    yield from of(held)
                    held = {}
                last = part
                held.setdefault(name, []).append(blob)
        if held:
            yield from of(held)

    return runs.mapInArrow(tidy(run), "key long, start long, stop long")


def without(raw: bytes, spans: list, words: int = 0) -> tuple[list[bytes], int, int]:
    """The parts outside the maximal runs of the spans, how many bytes were inside, and the number of runs. Runs of fewer than ``words`` words stay."""
    runs = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    if words:
        runs = [r for r in runs if len(raw[r[0] : r[1]].split()) >= words]
    ends = [0, *(r[1] for r in runs)]
    starts = [*(r[0] for r in runs), len(raw)]
    kept = [raw[x:y] for x, y in zip(ends, starts, strict=True) if x < y]
    return kept, len(raw) - sum(map(len, kept)), len(runs)


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Every row's doc_id and ``keep`` columns, n_bytes, n_removed, n_spans, and its text without each byte that a repeat covers.

    A repeat is a string of ``length`` bytes of UTF-8 that also starts anywhere
    else, in this text or another; all its occurrences go, and overlapping ones
    count. With ``words``, a maximal run of removed bytes that holds fewer words
    (cut ones included) stays. Matches never cross texts and are judged on the input. The text that
    is left loses characters that a cut has halved; with ``digests``,
    kept_sha256 of the exact bytes stands in its place.

    A null text counts as empty. Repeated rows (same id and text) are
    occurrences of each other. An empty table gives no rows. Other columns play
    no part.

    Scale: what is sorted is in proportion to repeated text, not to all of it.
    Equal contexts in a task are sent once. Texts are shuffled twice. A gram's
    different contexts meet in one task.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    bare = keyed.select("key", "__text").filter(F.octet_length("__text") >= rules.length)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "__text", SLICE):
            row, place, gram = anchors(s, rules)
            yield pa.RecordBatch.from_arrays([s.rows.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64))], names=["key", "place", "gram"])

    # anchors are cheaper to find twice than to keep
    found = bare.mapInArrow(tidy(anchored), "key long, place int, gram long")
    # written, so that the join meets two plain exchanges and a hot gram can be split
    often = written(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    again = written(found.join(often, "gram").groupBy("key").agg(F.collect_list(F.struct("place", "gram")).alias("wanted")), "repeated-anchors")
    n = again.agg(F.sum(F.size("wanted"))).first()[0] or 0
    asked = bare.join(again.hint("shuffle_hash"), "key").select("key", "__text", "wanted")
    runs = runs_of(asked, rules, 1 + n // rules.partition_entries)
    spans = repeats(runs.repartition("part").sortWithinPartitions("part", "run", "nth"), rules)
    # written, so that what was shuffled to find the spans is gone before the texts are shuffled again
    spans = written(spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    out = keyed.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", *(f"__keep_{c}" for c in keep), "__text", "spans")
    width = 1 + len(keep)
    last = "kept_sha256" if digests else "text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "__text"):
            raw, off, batch = s.raw(), s.off, s.rows
            rows = []
            column = batch.column(width + 1)
            ends = column.offsets.to_numpy()
            starts, stops = (column.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(batch.num_rows):
                lo, hi = ends[i], ends[i + 1]
                mine = list(zip(starts[lo:hi].tolist(), stops[lo:hi].tolist(), strict=True)) if hi > lo else []
                kept, removed, count = without(raw[off[i] : off[i + 1]], mine, rules.words)
                rows.append((removed, count, hashlib.sha256(b"".join(kept)).hexdigest() if digests else rules.gap.join(x.decode("utf-8", "ignore") for x in kept)))
            more = [pa.array(np.diff(off)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), *more], names=["doc_id", *keep, "n_bytes", "n_removed", "n_spans", last])

    head = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(["doc_id", *keep], out.schema.fields, strict=False))
    return out.mapInArrow(tidy(cut), f"{head}, n_bytes long, n_removed long, n_spans long, {last} string")
