"""Packing documents into token windows by non-negative least squares.

A document is cut at multiples of the window; each full cut is a sequence of
its own, so only a remainder below the window is left to pack. What is packed
is the histogram of remainders, whose size the window bounds: shallow
combinations of two or three lengths that fill a window exactly are
enumerated, non-negative least squares finds how often to repeat each, the
counts are rounded down to what there is, and the residual histogram is packed
greedily, the largest length first and then whatever fits best, each such
pattern as often as its lengths last. The plan assigns ranks within a length,
so it is as large for a thousand documents as for a trillion.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .byte_bpe import repeated
from .durable import written
from .pieces import BLANK, LL, NUMBER, QUOTE, SHORT, E, R, V, classes
from .text import numbered, tidy
from .vocabulary import library_tokenizer, vocabulary_path

WINDOW = 4096
END_ID = 2
MOST_COLUMNS = 20_000
SWEEPS = 2000
MOST_KNOWN = 250_000
ROWS = 512


class PieceIds:
    """Ids of texts, piece by piece.

    After normalization the tokenizer splits a text into runs of letters,
    single digits, runs of other signs and English contractions, and encodes
    each alone. So a slice is split at once in NumPy, its distinct pieces are
    found by exact comparison, and the library's model encodes those not met
    before, many in one call: its last token of each piece is marked as such.
    Texts that hold a special string go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(self.model.model.end_of_word_suffix)]] = True
        #: Pieces in use, and those in use before: what overflows is forgotten unless it comes again.
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def normal(self, text: str) -> str | None:
        """The normalized text; None if the library must see it whole."""
        if any(x in text for x in self.special):
            return None
        try:  # Latin-1 has no letters that compose, and keeps to itself in lower case
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            out = self.tokenizer.normalizer.normalize_str(text)
            # Unicode versions differ on the classes of code points that this one has not assigned
            return None if unassigned()[np.frombuffer(out.encode("utf-32-le"), dtype=np.uint32)].any() else out

    def learn(self, pieces: list[bytes]) -> None:
        for lo in range(0, len(pieces), 2000):
            some = pieces[lo : lo + 2000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the last token of each piece")
            raw, cut = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(some, [raw[x:y] for x, y in zip([0, *cut], cut, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > MOST_KNOWN:
            self.known, self.old = {}, self.known
        normal = [self.normal(t) for t in texts]
        odd = {i for i, t in enumerate(normal) if t is None}
        normal = [t or "" for t in normal]
        data = np.frombuffer("".join(normal).encode("utf-8"), dtype=np.uint8)
        starts, ends, first = word_pieces("".join(normal), data, np.cumsum([0, *map(len, normal)]))
        code, distinct = numbered(data, starts, ends)
        values = list(map(self.known.get, distinct))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            asked = [distinct[i] for i in missing]
            before = list(map(self.old.get, asked))
            self.known.update((p, v) for p, v in zip(asked, before, strict=True) if v is not None)
            self.learn([p for p, v in zip(asked, before, strict=True) if v is None])
            for i, p in zip(missing, asked, strict=True):
                values[i] = self.known[p]
        joined, off = repeated(values, code)
        cut = off[first].tolist()
        out = [joined[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        for i in odd:
            out[i] = self.whole(texts[i])
        return out


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Whether a code point has no character."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def word_pieces(text: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of texts that stand end to end at the character offsets ``off``, and the first piece of each."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    kind = classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    group = np.where(kind <= E, 1, np.where(kind == NUMBER, 2, np.where(kind <= BLANK, 0, 3))).astype(np.int8)
    edge = np.zeros(len(kind) + 1, dtype=bool)  # a text begins here
    edge[off] = True
    begins = (group > 0) & ((group == 2) | edge[:-1] | np.concatenate([[True], group[1:] != group[:-1]]))
    quote = np.flatnonzero((kind == QUOTE) & begins)
    for size in (2, 3):  # a quote that is a piece of its own so far, and the letters of a contraction
        q = quote[quote + size <= len(kind)]
        for k in range(1, size):
            q = q[~edge[q + k]]
        one = kind[q + 1]
        q = q[one == SHORT] if size == 2 else q[((one == R) | (one == V)) & (kind[q + 2] == E) | (one == LL) & (kind[q + 2] == LL)]
        begins[q + 1] = False
        after = q + size
        after = after[after < len(kind)]
        begins[after[group[after] == 1]] = True
    stops = (group > 0) & np.concatenate([edge[1:-1] | begins[1:] | (group[1:] == 0), [True]])
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    starts = np.flatnonzero(begins)
    return at[starts], at[np.flatnonzero(stops) + 1], np.searchsorted(starts, off)


_ENCODERS: dict[str, PieceIds] = {}


def cut_documents(docs: DataFrame, window: int, vocabulary: str, folder: str | None, keep: str, text: str, with_ids: bool) -> DataFrame:
    """Pieces of at most ``window`` ids, with ``part`` and ``nth``: the task, and the piece's number among those of its length there."""
    picked = docs.select(F.col(keep).alias("doc_id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary, folder)
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceIds(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * with_ids]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                row, cols = [], {n: [] for n in names}
                for i, ids in enumerate(_ENCODERS[path].encode([t or "" for t in some.column(1).to_pylist()])):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        size = len(piece) // 4
                        row.append(i)
                        for name, x in zip(names[1:], (start, size, zlib.crc32(piece), n, part, seen[size], piece), strict=False):
                            cols[name].append(x)
                        seen[size] += 1
                own = [pa.array(cols[n], pa.int64()) for n in names[1:7]] + [pa.array(cols[n], pa.binary()) for n in names[7:]]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row, pa.int64())), *own], names=names)

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + ", ids binary" * with_ids)


def combinations(lengths: list[int], window: int, most: int = MOST_COLUMNS) -> list[tuple[int, ...]]:
    """Pairs, then triples, of the lengths that fill the window exactly; of triples an even choice if there are more than ``most``."""
    there = set(lengths)
    out = [(a, window - a) for a in lengths if 2 * a >= window and window - a in there]
    small = [a for a in lengths if a <= window // 2]
    stride = max(1, len(lengths) * len(small) // (2 * most))
    for i, a in enumerate(lengths):
        for b in small[i % stride :: stride]:
            c = window - a - b
            if a >= b >= c > 0 and c in there:
                out.append((a, b, c))
    return out


def least_squares(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 with the least |Ax - counts|, by cyclic coordinate descent; column j of A counts the lengths of combination j.

    Every eighth sweep goes over all columns, those between over the ones in
    use. It ends when a whole sweep moves no repeat count by a quarter, that is
    at the optimum but for less than one occurrence of a length.
    """
    x, rest = [0.0] * len(columns), counts.astype(float).tolist()
    parts = [(list(Counter(c).items()), float(sum(m * m for m in Counter(c).values()))) for c in columns]
    every = list(range(len(columns)))
    active = every
    for sweep in range(sweeps):
        whole, moved = sweep % 8 == 0, 0.0
        for j in every if whole else active:
            part, norm = parts[j]
            step = max(-x[j], sum([m * rest[a] for a, m in part]) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, m in part:
                    rest[a] -= m * step
        if whole:
            if moved < 0.25:
                break
            active = [j for j in every if x[j]]
    return np.array(x)


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every count up."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    lengths = np.flatnonzero(left).tolist()
    columns = combinations(lengths, window)
    for combination, x in sorted(zip(columns, least_squares(columns, left), strict=True), key=lambda p: -p[1]):
        need = Counter(combination)
        times = min(int(x), *(int(left[a]) // m for a, m in need.items()))
        if times > 0:
            for a, m in need.items():
                left[a] -= m * times
            out.append((combination, times))
    there = [a for a in lengths if left[a]]
    while there:
        pattern, room, used = [], window, Counter()
        limit = there[-1]
        while room and (i := bisect_right(there, min(limit, room)) - 1) >= 0:
            a = there[i]
            if left[a] > used[a]:
                pattern.append(a)
                used[a] += 1
                room -= a
            else:
                limit = a - 1
        times = min(int(left[a]) // m for a, m in used.items())
        for a, m in used.items():
            left[a] -= m * times
            if not left[a]:
                there.remove(a)
        out.append((tuple(pattern), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of a pattern: its length, the first rank within the length that it takes, first sequence, and offset; sorted by length and rank."""
    rank, sequence, rows = Counter(), 0, []
    for pattern, times in patterns:
        offset = 0
        for a in pattern:
            rows.append((a, rank[a], sequence, offset))
            rank[a] += times
            offset += a
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = "word_bpe_49k.json", folder: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece; with ``with_ids`` also its ids.

    Every document's ids, with the end id, lie in its pieces without gap; the
    pieces of a sequence lie gapless from offset 0. A null or empty text is the
    end id alone. Rows are packed each alone, so repeated rows (and null ids)
    are packed as often as they come. An empty table gives no rows. Columns
    other than the two play no part.

    Scale: texts are read and encoded once and never shuffled. A piece's rank
    within its length is its number in its task plus what earlier tasks have,
    so no length gathers in one task. The driver sees the histogram, of at
    most ``window`` rows; the broadcast plan is bounded by the window too.
    """
    pieces = written(cut_documents(docs, window, vocabulary, folder, doc_id, text, with_ids), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_task = written(per_task, "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, window)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    kept = [c for c in ranked.columns if c not in ("rank", "ids")]
    kept = ["doc_id", *[c for c in ("start", "length", "ids_crc32", "doc_tokens") if c in kept]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t["length"] << 44 | t["rank"]
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            length, rank = col("length").to_numpy(zero_copy_only=False), col("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at]
            own = [col(c) for c in [*kept, *["ids"] * with_ids]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(t["offset"][at])], names=[*kept, *["ids"] * with_ids, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return ranked.mapInArrow(tidy(place), f"{head}, sequence_id long, offset long")
