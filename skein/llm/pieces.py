"""A transducer that splits text into the pieces that byte-level BPE encodes one by one.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is compiled to a deterministic automaton over 11 classes of characters with
12 states. Each transition says whether a piece begins at this character, at
the one before, or both; that delay stands for the pattern's lookahead.

Texts are cut into chunks of equal length. For each chunk the automaton runs
from every state at once, side by side in NumPy lanes, which gives the chunk's
state map (most chunks forget their entry state after a few characters, and go
on in a single lane). State maps compose associatively, so a parallel prefix
scan over all chunks yields each one's entry state; a second run from there
writes the piece starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, SHORT, R, V, LL, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, PAD = range(12)
BEGIN, IN_L, IN_N, IN_O, SP, SPS, WS, WSS, Q, QR, QV, QL = range(12)
STATES = 12
HERE, BEFORE = 1, 2
CHUNK, PROBE = 128, 8


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            at = np.arange(m.start(), m.end())
            out[np.where(at < 0xD800, at, at + 0x800)] = kind
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", LL), ("e", E), (" ", SPACE), ("'", QUOTE)):
        out[[ord(c) for c in letters]] = kind
    return out


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, both by 16 * state + class."""
    fresh = {LETTER: IN_L, SHORT: IN_L, R: IN_L, V: IN_L, LL: IN_L, E: IN_L, NUMBER: IN_N, SPACE: SP, BLANK: WS, QUOTE: Q, OTHER: IN_O}
    letters = {LETTER, SHORT, R, V, LL, E}
    goes_on = {
        IN_L: dict.fromkeys(letters, IN_L),
        IN_N: {NUMBER: IN_N},
        IN_O: {OTHER: IN_O, QUOTE: IN_O},
        SP: dict.fromkeys(letters, IN_L) | {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O, SPACE: SPS, BLANK: WSS},
        SPS: {SPACE: SPS, BLANK: WSS},
        WS: {SPACE: SPS, BLANK: WSS},
        WSS: {SPACE: SPS, BLANK: WSS},
        Q: {SHORT: BEGIN, R: QR, V: QV, LL: QL, OTHER: IN_O, QUOTE: IN_O},
        QR: {E: BEGIN},
        QV: {E: BEGIN},
        QL: {LL: BEGIN},
    }
    step = np.zeros((STATES, 16), dtype=np.uint8)
    mark = np.zeros((STATES, 16), dtype=np.uint8)
    for state in range(STATES):
        step[state, PAD] = state
        for kind in range(PAD):
            if kind in goes_on.get(state, {}):
                step[state, kind] = goes_on[state][kind]
            elif state == SPS:  # the last space joins what follows
                step[state, kind], mark[state, kind] = goes_on[SP][kind], BEFORE
            elif state in (QR, QV, QL) and kind in letters:  # the quote stands alone, its letter begins a word
                step[state, kind], mark[state, kind] = IN_L, BEFORE
            else:
                step[state, kind] = fresh[kind]
                mark[state, kind] = HERE | (BEFORE if state in (WSS, QR, QV, QL) else 0)
    return step.ravel(), mark.ravel()


def state_maps(chunks: np.ndarray, step: np.ndarray) -> np.ndarray:
    """maps[c, q]: the state after chunk c if it was entered in state q. chunks: classes, (CHUNK, number of chunks)."""
    lanes = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, chunks.shape[1]))

    def run(now: np.ndarray, part: np.ndarray) -> np.ndarray:
        for row in part:
            now = step[(now.astype(np.int16) << 4) + row]
        return now

    lanes = run(lanes, chunks[:PROBE])
    one = (lanes == lanes[0]).all(axis=0)
    lanes[:, one] = run(lanes[0, one], chunks[PROBE:, one])
    lanes[:, ~one] = run(lanes[:, ~one], chunks[PROBE:, ~one])
    return lanes.T


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row c: the composition of the maps 0..c, by doubling strides."""
    maps, stride = maps.copy(), 1
    while stride < len(maps):
        maps[stride:] = np.take_along_axis(maps[stride:], maps[:-stride].astype(np.intp), axis=1)
        stride *= 2
    return maps


def piece_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces of all texts, in order; and first[i]: the first piece of text i. data: UTF-8."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(off), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    char_off = np.searchsorted(at, off)
    length = np.diff(char_off)
    n_chunks = -(-length // CHUNK)
    chunk_off = np.concatenate([[0], np.cumsum(n_chunks)])
    flat = np.full(chunk_off[-1] * CHUNK, PAD, dtype=np.uint8)
    to = np.arange(len(points)) + np.repeat(chunk_off[:-1] * CHUNK - char_off[:-1], length)
    flat[to] = classes()[points]
    chunks = np.ascontiguousarray(flat.reshape(-1, CHUNK).T)
    step, mark = transitions()

    maps = state_maps(chunks, step)
    opens = chunk_off[:-1][length > 0]  # a text's first chunk is entered in BEGIN, whatever came before
    maps[opens] = maps[opens, BEGIN][:, None]
    after = prefix_scan(maps)[:, BEGIN]
    now = np.empty(len(after), dtype=np.uint8)
    now[1:], now[opens] = after[:-1], BEGIN

    marks = np.empty_like(chunks)
    for row, to_row in zip(chunks, marks, strict=True):
        place = (now.astype(np.int16) << 4) + row
        to_row[:] = mark[place]
        now = step[place]
    marks = marks.T.reshape(-1)
    begins = (marks & HERE) > 0
    begins[:-1] |= (marks[1:] & BEFORE) > 0
    begins = begins[to]
    closes = np.flatnonzero(length)
    open_word = np.isin(after[chunk_off[closes + 1] - 1], (QR, QV, QL))  # ended after a quote and a letter: two pieces
    begins[char_off[closes + 1][open_word] - 1] = True
    starts = at[begins]
    return starts, np.searchsorted(starts, off)
