"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers stand in series. The first (``pieces``) marks
where the pre-tokenizer's pieces begin; its chunk state maps compose through a
parallel prefix scan. The second reads the bytes of a piece, and each of its
transitions carries the number of tokens that it emits, so a piece's count is
the sum along its path. A piece of ordinary length is one chunk; in a long one
chunks have state maps with counts, which compose in the same way.

Why the second is finite: byte-pair encoding is local. A sequence of tokens is
the encoding of its bytes if and only if every two neighbours are the encoding
of theirs. So each prefix of a piece has one last token, and whether a token t
ends at the next byte depends on the last token at t's start alone. A state
holds, for each earlier boundary from which a token may still grow: the trie
node reached, the last token there, and how many tokens fewer there are up to
it. Tokens are of bounded length, so states are finitely many; they are
compiled when first met, and the tables are emptied when they pass a bound.
Whether two tokens are neighbours follows from the ranks of the merges that
make them, without encoding them again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import piece_starts
from .text import Slice, slices, sums, tidy
from .vocabulary import vocabulary_path


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class CountingTransducer:
    """Counts tokens of byte-level BPE by steps over bytes. Tokens are numbers into ``words``."""

    MOST_STATES = 100_000
    MOST_PIECES = 300_000
    CHUNK, WARM = 256, 64

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.words = list(vocab)
        self.merges = merges
        n, number = len(self.words), {w: i for i, w in enumerate(self.words)}
        #: Rank of the merge of two tokens, by first * n + second.
        self.ranks = {number[a] * n + number[b]: rank for (a, b), rank in merges.items() if a in number and b in number}
        #: The merge that ends a token's own encoding: its rank (-1 for a byte) and the two parts.
        self.birth, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.trie: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, word in enumerate(self.words):
            node = 0
            for b in word:
                after = self.trie[node].get(b)
                if after is None:
                    after = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = after
            parts, last = self.encode(word)
            if parts == [word]:  # a token that merges cannot build never ends an encoding
                self.token[node] = i
                if last:
                    self.birth[i], self.left[i], self.right[i] = merges[last], number[last[0]], number[last[1]]
        self.pairs: dict[int, bool] = {}
        self.counts: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.items: list[tuple] = [start]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, word: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The encoding by its definition (the earliest-ranked pair merges first, the leftmost of equals), and the last pair merged."""
        parts, last = [word[i : i + 1] for i in range(len(word))], None
        while len(parts) > 1:
            rank, i = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def stays(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes: no merge across the boundary comes before the parts at it are merged away from it.

        The merges are followed back in time, from the two tokens to their
        bytes at the boundary; of equal ranks the left one merges first.
        """
        birth, ranks, n = self.birth, self.ranks, len(self.words)
        end_a = end_b = 1 << 60
        while True:
            rank = ranks.get(a * n + b)
            if rank is not None and rank < end_a and rank <= end_b:
                return False
            if birth[a] > birth[b]:
                end_a, a = birth[a], self.right[a]
            elif birth[b] >= 0:
                end_b, b = birth[b], self.left[b]
            else:
                return True

    def adjoin(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = a * len(self.words) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            found = self.pairs[key] = self.stays(a, b)
        return found

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, emitted = [], -1, 0
        trie, token = self.trie, self.token
        for node, before, behind in self.items[state]:
            child = trie[node].get(byte)
            if child is None:
                continue
            word = token[child]
            if last < 0 <= word and self.adjoin(before, word):
                last, emitted = word, behind + 1
            if trie[child]:
                grown.append((child, before, behind))
        if last < 0:
            raise ValueError(f"no token ends after byte {byte}: the vocabulary lacks single bytes")
        after = (*[(node, before, behind - emitted) for node, before, behind in grown], (0, last, 0))
        to = self.states.get(after)
        if to is None:
            to = self.states[after] = len(self.items)
            self.items.append(after)
            self.steps.append({})
        step = self.steps[state][byte] = (to, emitted)
        return step

    def run(self, chunk: bytes, state: int = 0) -> tuple[int, int]:
        """The chunk's state map at one entry: the state after it, and the tokens emitted on the way."""
        steps, total = self.steps, 0
        for byte in chunk:
            step = steps[state].get(byte) or self.compiled(state, byte)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, piece: bytes) -> int:
        if len(self.items) > self.MOST_STATES:
            self.forget()
        return self.run(piece)[1] if len(piece) <= self.CHUNK else self.count_chunks(piece)

    def count_chunks(self, piece: bytes) -> int:
        """A long piece in chunks. Each chunk's map is taken at the entry that the bytes before it suggest; maps whose
        neighbours do not fit are taken again at the entry that they turn out to have, and a prefix scan composes them."""
        cuts = range(0, len(piece), self.CHUNK)
        entry = np.array([0, *(self.run(piece[at - self.WARM : at])[0] for at in cuts[1:])])
        leave, emitted = (np.array(x) for x in zip(*(self.run(piece[at : at + self.CHUNK], int(e)) for at, e in zip(cuts, entry, strict=True)), strict=True))
        while True:
            misfit = np.flatnonzero(entry[1:] != leave[:-1]) + 1
            if not len(misfit):
                return int(np.add.accumulate(emitted)[-1])
            for k in misfit.tolist():
                entry[k] = leave[k - 1]
                leave[k], emitted[k] = self.run(piece[cuts[k] : cuts[k] + self.CHUNK], int(entry[k]))

    def count_all(self, pieces: list[bytes]) -> np.ndarray:
        known = self.counts
        if len(known) > self.MOST_PIECES:
            known.clear()
        out = np.empty(len(pieces), dtype=np.int64)
        for i, piece in enumerate(pieces):
            n = known.get(piece)
            if n is None:
                n = self.count(piece)
                if len(piece) <= 64:
                    known[piece] = n
            out[i] = n
        return out


@lru_cache(maxsize=2)
def compiled_tokenizer(path: str) -> tuple[CountingTransducer, tuple[bytes, ...]]:
    """The transducer of a byte-level BPE file, and the special strings that its library finds in texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only plain byte-level BPE files can be compiled")
    letter = byte_letters()
    as_bytes = lambda word: bytes(letter[c] for c in word)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
    special = tuple(t["content"].encode() for t in spec["added_tokens"])
    vocab = {as_bytes(w): i for w, i in model["vocab"].items() if w.encode() not in special}
    return CountingTransducer(vocab, merges), special


def without_specials(s: Slice, special: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is left of the texts around special strings: bytes, offsets and owner of each part; and the number of special strings in each text."""
    raw, found = s.raw(), np.zeros(len(s), dtype=np.int64)
    if not any(x in raw for x in special):
        return s.data, s.off, np.arange(len(s)), found
    parts, owner = [], []
    for i, (lo, hi) in enumerate(zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)):
        while True:
            hits = [(at, -len(x), x) for x in special if (at := raw.find(x, lo, hi)) >= 0]
            at, _, x = min(hits, default=(hi, 0, b""))
            parts.append(raw[lo:at])
            owner.append(i)
            if not hits:
                break
            found[i] += 1
            lo = at + len(x)
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), off, np.array(owner), found


def unique_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces that begin at ``starts``, as numbers into a list of distinct ones."""
    if not len(starts):
        return np.empty(0, np.int64), []
    ends = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def count_slice(s: Slice, path: str) -> np.ndarray:
    transducer, special = compiled_tokenizer(path)
    data, off, owner, found = without_specials(s, special)
    starts, first = piece_starts(data, off)
    code, distinct = unique_pieces(data, starts)
    emitted = transducer.count_all(distinct)[code] if distinct else code
    np.add.at(found, owner, sums(emitted, first))
    return found


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of every row, n_bytes, n_tokens, and over_limit: more than ``limit`` tokens.

    A null or empty text has 0 tokens. Rows are counted each alone: repeated
    rows give repeated results, an empty table an empty one, other columns
    play no part. Special strings in a text count as one token each.
    """
    picked = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary, folder)
        for s in slices(batches, "__text"):
            n = count_slice(s, path)
            own = [s.rows.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(s.off)), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(tidy(run), f"{head}, n_bytes long, n_tokens long, over_limit boolean")
