"""Quality rules on repetition inside a text, from a suffix array of its words.

A suffix array over the words of each text, with the longest common prefix
(LCP) of neighbours, gives every maximal repeated substring as an LCP
interval. A suffix's deepest interval is the larger LCP with its two
neighbours; the union of these spans is what repeats. Two limits follow: the
fraction of the text's characters that repeats of a few words or more cover,
and the longest repeat. The base rule looks at repeats of eight words alone;
the limit on coverage also sees texts that turn round shorter phrases.

Arrays of many texts are built at once by prefix doubling in NumPy; groups
never cross texts, and suffixes that are unique already take no further part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Slice, codes, line_bounds, slices, sums, tidy, word_bounds


@dataclass(frozen=True)
class RepetitionRules:
    """Limits. ``window``: words of a repeat that counts for the base rule and as the longest; ``phrase``: words of the shortest repeat whose span counts as covered."""

    window: int = 8
    phrase: int = 4
    least_words: int = 20
    most_repeat_percent: int = 30
    most_covered_fraction: float = 0.30
    longest_repeat_words: int = 50
    longest_repeat_fraction: float = 0.15


RULES = RepetitionRules()

SYMBOLS = b"#*$%&|<>"

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat_words long, base_failed boolean, kept boolean"


def longest_repeats(word: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """For each word position, the length of the longest string of words from there that starts again elsewhere in its text; 0 below ``least``.

    word: numbers, equal for equal words; text i has [first[i], first[i + 1]).
    """
    n = len(word)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[text + 1]
    order = np.argsort(text * (int(word.max()) + 1) + word, kind="stable")
    key = (text * (int(word.max()) + 1) + word)[order]
    # rank: place of the first suffix of a position's group in sorted order; groups agree in their first k words
    place = np.arange(n)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    levels = [(1, rank)]
    suffix = order.copy()  # the suffix array, as far as it is known
    k = 1
    again = ~(head & np.append(head[1:], True))
    active, slot = order[again], place[again]
    deep: np.ndarray | None = None
    while len(active):
        if 2 * k > least and deep is None:
            deep = slot
        ahead = active + k
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[active]
        by = np.lexsort((second, group)) if n >= 1 << 31 else np.argsort(group * (n + 1) + second, kind="stable")
        active, group, second = active[by], group[by], second[by]
        suffix[slot] = active
        # within a group, a suffix that ended is alone with its second key 0 in its text
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(head, slot, 0))
        k *= 2
        levels.append((k, rank))
        again = ~(head & np.append(head[1:], True))
        active, slot = active[again], slot[again]
    if deep is None or len(deep) < 2:
        return out
    # neighbours in the array that agree in their first k words, the most of a level within ``least``
    k, rank = next((k, r) for k, r in levels if 2 * k > least)
    near = deep[:-1][deep[1:] == deep[:-1] + 1]
    a, b = suffix[near], suffix[near + 1]
    same = rank[a] == rank[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for k, rank in reversed(levels):
        x, y = a + common, b + common
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        common += np.where(ok, k, 0)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return np.where(out >= least, out, 0)


def spanned(repeat: np.ndarray) -> np.ndarray:
    """The union of the spans: whether a repeat that begins at or before a word reaches over it."""
    at = np.flatnonzero(repeat)
    turn = np.bincount(at, minlength=len(repeat) + 1) - np.bincount(at + repeat[at], minlength=len(repeat) + 1)
    return np.cumsum(turn[:-1]) > 0


def measures(s: Slice, rules: RepetitionRules) -> dict[str, np.ndarray]:
    data = s.data
    starts, ends, first = word_bounds(s)
    n_words = np.diff(first)
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    width = chars[ends] - chars[starts]
    word_chars = sums(width, first)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = sums(symbol[data], s.off)

    line_starts, line_ends, line_first = line_bounds(s)
    line, n_lines = codes(data, line_starts, line_ends)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    owner = np.repeat(np.arange(len(s)), np.diff(line_first))
    distinct = np.unique((owner * (n_lines + 1) + line)[worded]) // (n_lines + 1)
    n_dup_lines = sums(worded, line_first) - np.bincount(distinct, minlength=len(s))

    word, _ = codes(data, starts, ends)
    repeat = longest_repeats(word, first, min(rules.phrase, rules.window))
    large = np.where(repeat >= rules.window, repeat, 0)
    n_repeat = sums(spanned(large), first)
    longest = np.zeros(len(s), dtype=np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(s)), n_words), large)
    covered = spanned(np.where(repeat >= rules.phrase, repeat, 0))
    fraction = sums(np.where(covered, width, 0), first) / np.maximum(word_chars, 1)

    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeat_percent * n_words)
    too_long = longest > np.maximum(rules.longest_repeat_words, rules.longest_repeat_fraction * n_words)
    kept = ~failed & (fraction <= rules.most_covered_fraction) & ~too_long
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "covered_fraction": fraction,
        "longest_repeat_words": longest,
        "base_failed": failed,
        "kept": kept,
    }


def judge_repetition(docs: DataFrame, rules: RepetitionRules = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of every row and the measures and verdict for its whole text.

    Rows are judged each alone, so equal rows give equal results and there is
    no shuffle. A null or empty text has no words and fails. An empty table
    gives an empty result. Columns not in ``keep`` play no part, whatever
    their names; a kept column named like a measure is an error.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if clash := set(keep) & set(names):
        raise ValueError(f"kept columns clash with measures: {sorted(clash)}")
    column = text if text in keep else "__text"
    picked = docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, column):
            found = measures(s, rules)
            own = [s.rows.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[n]) for n in names)], names=[*keep, *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(tidy(run), f"{head}, {COLUMNS}")
