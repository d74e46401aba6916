"""Byte-level BPE encoding and decoding by reduction over a tree of halves.

Encodings form a monoid: the product of two is the encoding of the joined
bytes. ``join`` finds it without encoding all again: tokens next to the seam
are re-encoded in a window that grows, until the tokens outside provably stay.
The proof rests on the locality of byte-pair encoding: a sequence is the
encoding of its bytes if and only if every two neighbouring tokens are the
encoding of theirs. Inside the left part, the right part and the window this
holds already, so only the two seams around the window need a check.

A piece is encoded by halves, recursively; texts are sequences of pieces that
never merge, so their product is concatenation. Decoding concatenates bytes
up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import piece_starts
from .text import Slice, slices, sums, tidy
from .token_counts import unique_pieces
from .vocabulary import vocabulary_path

NO_RANK = 1 << 60
MOST_KNOWN = 300_000
LEAF = 12


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {i: word for word, i in ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}

    def leaf(self, word: bytes) -> list[int]:
        """By definition: the pair whose joined bytes rank lowest merges first, the leftmost of equals."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        parts, rank_of = [word[i : i + 1] for i in range(len(word))], self.ranks.get
        ranks = [rank_of(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_RANK:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes."""
        found = self.stays.get((a, b))
        if found is None:
            if len(self.stays) > 1_000_000:
                self.stays.clear()
            found = self.stays[a, b] = self.leaf(self.words[a] + self.words[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two encodings."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        i, j, grow_i, grow_j = len(left) - 1, 1, 1, 1
        while True:
            window = self.leaf(b"".join(self.words[t] for t in left[i:] + right[:j]))
            open_left = i > 0 and not self.neighbours(left[i - 1], window[0])
            open_right = j < len(right) and not self.neighbours(window[-1], right[j])
            if not open_left and not open_right:
                return left[:i] + window + right[j:]
            if open_left:
                i, grow_i = max(0, i - grow_i), 2 * grow_i
            if open_right:
                j, grow_j = min(len(right), j + grow_j), 2 * grow_j

    def encode(self, piece: bytes) -> list[int]:
        """Halves first, then their product."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= LEAF:
            return b"".join(self.words[i] for i in ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def both_ways(self, piece: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, their decimal digits with a space after each, and the bytes that they decode to."""
        found = self.known.get(piece)
        if found is None:
            ids = self.encode(piece)
            found = len(ids), b"".join(b"%d " % i for i in ids), self.decode(ids)
            if len(piece) <= 64:
                if len(self.known) > MOST_KNOWN:
                    self.known.clear()
                self.known[piece] = found
        return found


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    with open(path, "rb") as f:
        return TreeEncoder({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f) if word})


def repeated(values: list[bytes], code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values that ``code`` picks, end to end, and their offsets."""
    column = pa.array(values, pa.large_binary()).take(pa.array(code))
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1]
    return column.buffers()[2].to_pybytes() if len(column) and column.buffers()[2] else b"", off


def round_trip(s: Slice, encoder: TreeEncoder) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """For each text: number of ids, their digits joined by spaces, and the decoded bytes."""
    starts, first = piece_starts(s.data, s.off)
    code, distinct = unique_pieces(s.data, starts)
    if not distinct:
        return np.zeros(len(s), np.int64), [b""] * len(s), [b""] * len(s)
    found = [encoder.both_ways(p) for p in distinct]
    n = sums(np.array([f[0] for f in found])[code], first)
    out = []
    for k, gap in ((1, 1), (2, 0)):
        joined, off = repeated([f[k] for f in found], code)
        cut = off[first].tolist()
        out.append([joined[lo : max(lo, hi - gap)] for lo, hi in zip(cut, cut[1:], strict=False)])
    return n, *out


def encode_and_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", digests: bool = False) -> DataFrame:
    """``keep`` columns of every row, n_tokens, and the ids (array) and decoded text of its whole text.

    With ``digests``, SHA-256 of the decimal ids joined by a space and of the
    decoded bytes stand in their place. A null or empty text has no ids and
    decodes to nothing. Rows are encoded each alone: repeated rows repeat,
    an empty table stays empty, other columns play no part.
    """
    picked = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(vocabulary_path(vocabulary, folder))
        for s in slices(batches, "__text"):
            n, ids, decoded = round_trip(s, encoder)
            if digests:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()) for part in (ids, decoded)]
            else:
                last = [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array([x.decode("utf-8") for x in decoded], pa.string())]
            own = [s.rows.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), *last], names=[*keep, "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(tidy(run), f"{head}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")
