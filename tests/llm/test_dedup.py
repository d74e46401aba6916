"""Operators that compare rows with each other, against brute force."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import line_dedup
from skein.llm.line_dedup import LineRules, dedup_lines, within
from skein.llm.ngram_join import JaccardJoin, bands_and_rows, near_duplicates
from skein.llm.suffix_dedup import RepeatRules, remove_repeats

KIND = "doc_id long, text string"


def distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def edited(x: str, times: int, letters: str = "abcdé") -> str:
    y = list(x)
    for _ in range(times):
        r = random.random()
        if r < 0.33 and y:
            y.pop(random.randrange(len(y)))
        elif r < 0.66:
            y.insert(random.randint(0, len(y)), random.choice(letters))
        elif y:
            y[random.randrange(len(y))] = random.choice(letters)
    return "".join(y)


def test_banded_distance():
    random.seed(5)
    for _ in range(5000):
        a = "".join(random.choices("abc", k=random.randint(0, 18)))
        b = edited(a, random.randint(0, 5)) if random.random() < 0.7 else "".join(random.choices("abc", k=random.randint(0, 18)))
        limit = random.randint(1, 4)
        assert within(a, b, limit) == (distance(a, b) <= limit)


def lines_by_hand(rows: list, threshold: int = 2, least: int = 24) -> list:
    out, seen = [], []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = []
        for x in t.split("\n"):
            if len(x) < least or not any(x == y or abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold for y in seen):
                kept.append(x)
            if len(x) >= least and x not in seen:
                seen.append(x)
        out.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_line_dedup(spark, block):
    random.seed(7)
    base = ["".join(random.choices("abcdefgh ", k=random.randint(24, 50))) for _ in range(12)]
    rows = [(i, "\n".join(edited(random.choice(base), random.choice([0, 0, 1, 2, 3, 4])) for _ in range(random.randint(0, 4)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n")]
    got = dedup_lines(spark.createDataFrame(rows, KIND), dataclasses.replace(LineRules(), block=block))
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == lines_by_hand(rows)


@pytest.mark.parametrize("block", [16, 512])
def test_line_dedup_by_words(spark, block):
    """Lines of 17 to 24 words, some of which differ in a word or more, against all pairs."""
    random.seed(17)
    words = [f"{a}{b}" for a in "bcdfgk" for b in ("a", "en", "ort", "ing")]
    base = [random.choices(words, k=n) for n in (17, 18, 19, 20, 21, 22, 24)]

    def changed() -> str:
        x = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            r, at = random.random(), random.randrange(len(x))
            x[at : at + (r < 0.6)] = [] if r < 0.2 else [random.choice(words)]
        return (" " if random.random() < 0.9 else "  ").join(x)

    rows = [(i, "\n".join(changed() for _ in range(random.randint(0, 4)))) for i in range(90)]
    want, seen = [], []
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            a = x.split()
            near = lambda y: distance(x, y) <= 2 if max(len(a), len(y.split())) < 20 else distance(a, y.split()) <= 2  # noqa: B023, E731
            if len(x) < 24 or not any(x == y or near(y) for y in seen):
                kept.append(x)
            if len(x) >= 24 and x not in seen:
                seen.append(x)
        want.append((i, "\n".join(kept)))
    got = dedup_lines(spark.createDataFrame(rows, KIND), dataclasses.replace(LineRules(), block=block))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want


def test_large_groups_of_near_lines_ship_few_lines_at_a_time(spark, monkeypatch):
    """A group of many blocks: rows that lie on disk at once grow with its lines, not with their square, and none of them is lost."""
    random.seed(27)
    base = "".join(random.choices("abcdefgh ", k=60))
    rows = [(i, "\n".join(edited(base, random.choice([0, 1, 2, 3, 4])) for _ in range(3))) for i in range(70)]
    rows += rows[:5]
    shipped, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda lines, rules: (shipped.append(lines.count()), verified(lines, rules))[1])
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 1, raising=False)
    got = dedup_lines(spark.createDataFrame(rows, KIND), dataclasses.replace(LineRules(), block=8))
    assert set(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == set(lines_by_hand(rows[:70]))
    n = len({x for _, t in rows for x in t.split("\n")})
    assert shipped[0] <= n and len(shipped) > 2 and max(shipped) <= 4 * n


def test_a_changed_word_in_a_long_line(spark):
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, line), (2, line.replace("word30", "something-quite-different")), (3, line.replace("word3 ", "three ").replace("word50", "fifty")), (4, line.replace("word1 ", "one ").replace("word2 ", "two ").replace("word3 ", "three "))]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}  # three words
    huge = "x" * 200_000 + " " + line
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame([(1, huge), (2, huge.replace("word9 ", "nine ")), (3, None)], KIND)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_line_dedup_edge_cases(spark):
    line = "a line of more than twenty-four characters"
    df = spark.createDataFrame([(1, line, "k"), (1, line, "k"), (None, line, "k"), (2, line + "!", "k")], "doc_id long, text string, key string")
    got = Counter(((r.doc_id, r.text, r.key) for r in dedup_lines(df, keep=("key",)).collect()))
    assert got == Counter({(None, line, "k"): 1, (1, "", "k"): 2, (2, "", "k"): 1})  # the null id comes first
    assert dedup_lines(df.limit(0)).count() == 0


def test_short_lines_go_when_repeated(spark):
    rows = [(1, "Les.\nAll rights reserved.\n\n \nLes."), (2, "All rights reserved!\n\n \nLes.\nx\n\t"), (3, "x\nAll rights reserved.\n\t")]
    got = dedup_lines(spark.createDataFrame(rows, KIND)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    # a near one of under 24 characters stays, as do blank lines
    assert sorted(map(tuple, got)) == [(1, "Les.\nAll rights reserved.\n\n ", 5, 1), (2, "All rights reserved!\n\n \nx\n\t", 6, 1), (3, "\t", 3, 2)]


def jaccard_by_hand(rows: list) -> list:
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(least[find(i)]), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [16, 256])
def test_jaccard_join(spark, block):
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(2):
        base = random.choices(words, k=80)
        for _ in range(50):
            x = list(base)
            for _ in range(random.randint(0, 3)):
                x[random.randrange(len(x))] = random.choice(words)
            texts.append(" ".join(x))
    rows = list(enumerate([*texts, None, "", "a", "a", "a b c d", "a b c d", "a b c d e", texts[0]]))
    got = near_duplicates(spark.createDataFrame(rows, KIND), dataclasses.replace(JaccardJoin(), block=block))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == jaccard_by_hand(rows)


def test_jaccard_join_edge_cases(spark):
    df = spark.createDataFrame([(None, "one two three four five six", 1), (4, "one two three four five six", 1), (4, "one two three four five six", 1), (5, None, 1)], "doc_id long, text string, node long")
    got = Counter(tuple(r) for r in near_duplicates(df).collect())
    assert got == Counter({(None, 4, 2, 3): 1, (4, 4, 2, 3): 2, (5, 5, 0, 1): 1})
    assert near_duplicates(df.limit(0)).count() == 0


def test_verified_links_count_without_a_common_band(spark):
    """Two texts at 0.8 or more without a common band, held together by a third, are linked all the same."""
    spec = dataclasses.replace(JaccardJoin(), recall=0.8)  # fewer bands, so that more pairs share none
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    base = random.choices(words, k=120)
    texts = [" ".join(base)]
    for _ in range(40):
        x = list(base)
        for _ in range(2):
            x[random.randrange(len(x))] = random.choice(words)
        texts.append(" ".join(x))
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, KIND), spec)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == jaccard_by_hand(rows)


def test_bands_reach_their_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = bands_and_rows(similarity, 0.999, 256)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999
        assert bands * rows <= 256


def repeats_by_hand(rows: list, length: int) -> list:
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        inside = np.cumsum(mark)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], inside.astype(int)])) == 1).sum())
        out.append((i, len(b), int(inside.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(b, inside, strict=True) if not y)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rules", [RepeatRules(40, 8, 1 << 20, 100), RepeatRules(40, 16, 3000, 50), RepeatRules(64, 8, 1 << 14, 1000)])
def test_suffix_dedup(spark, rules):
    random.seed(4)
    parts = ["".join(random.choices("abcdef", k=random.randint(30, 160))) for _ in range(12)]
    texts = []
    for _ in range(150):
        t = ""
        for _ in range(random.randint(0, 6)):
            x = random.choice(parts)
            r = random.random()
            t += edited(x, random.randint(1, 3)) if r < 0.4 else x[random.randint(0, 20) :] if r < 0.6 else x
            t += "".join(random.choices("ghié", k=random.randint(0, 60))) if random.random() < 0.5 else ""
        texts.append(t)
    texts += ["a" * 300, "ab" * 200, "a" * 39, "a" * 40, "a" * 41, None, "", texts[3], "abc" * 100, ("q" * 50 + "r") * 5]
    rows = list(enumerate(texts))
    got = remove_repeats(spark.createDataFrame(rows, KIND), rules, digests=True)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == repeats_by_hand(rows, rules.length)


def test_suffix_dedup_edge_cases(spark):
    passage = "".join(random.Random(1).choices("abcdefghij ", k=450))
    df = spark.createDataFrame([(None, "x" + passage, 1), (2, passage + "yé", 1), (3, None, 1)], "doc_id long, text string, spans long")
    got = {(r.doc_id, r.text, r.spans) for r in remove_repeats(df, keep=("spans",)).collect()}
    assert got == {(None, "x", 1), (2, "yé", 1), (3, "", 1)}
    assert remove_repeats(df.limit(0)).count() == 0
