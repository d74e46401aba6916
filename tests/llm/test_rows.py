"""Operators that judge, count or encode each row alone."""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from skein.llm.byte_bpe import encode_and_decode, round_trip, tree_encoder
from skein.llm.pieces import piece_starts
from skein.llm.quality import RULES, judge_repetition, measures
from skein.llm.text import slices
from skein.llm.token_counts import compiled_tokenizer, count_slice, count_tokens
from skein.llm.vocabulary import library_tokenizer, vocabulary_path

PARTS = ["a", "'s", "'", "re", "'re", "'ve", "l", " ", "  ", "\n", "\t", "\xa0", "1", "é", "!", "...", "<|endoftext|>", "中", "🙂", "\x1c", "́", "٣", "aaaa", "ing", "'T", "　", "\x85"]


def texts() -> list:
    random.seed(3)
    out = [None, "", "'", "'r", "x'l ", " ", "  a"] + ["".join(random.choices(PARTS, k=random.randint(0, 200))) for _ in range(300)]
    return out + ["a" * 3000, " " * 2000, "".join(random.choices("abcdefgh", k=5000)), "x " * 200 + "'re", "".join(map(chr, range(1, 0x3000)))]


def cut(values: list, limit: int):
    return slices(iter([pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})]), "text", limit)


def repetition(t: str | None) -> tuple:
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    longest = 0
    for x in range(len(w) if len(w) < 60 else 0):
        for y in range(x):
            n = 0
            while x + n < len(w) and w[x + n] == w[y + n]:
                n += 1
            longest = max(longest, n)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), longest if longest >= 8 else 0


@pytest.mark.parametrize("limit", [500, 1 << 20])
def test_repetition_against_plain_counts(limit):
    random.seed(1)
    values = [None, "", "a", "\n\n", " a\na\n", "é ü " * 20] + ["".join(random.choices("ab c\n#", k=random.randint(0, 300))) for _ in range(100)] + [" ".join(random.choices("ab", k=random.randint(0, 59))) for _ in range(200)]
    got = []
    for s in cut(values, limit):
        m = measures(s, RULES)
        got += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat_words")), strict=True))
    for t, g in zip(values, got, strict=True):
        want = repetition(t)
        assert g[:5] == want[:5]
        if want[0] < 60:
            assert g[5] == want[5]


@pytest.mark.parametrize("phrase", [1, 2, 3, 4, 5, 7, 8])
def test_covered_fraction_and_longest_repeat(phrase):
    """Against all pairs of places, for texts of any length and phrases of any number of words."""
    random.seed(8)
    base = [" ".join(random.choices([f"w{i}" for i in range(400)], k=90)) for _ in range(6)]
    values = [None, "", "a"] + [" ".join(random.choices("abc", k=random.randint(0, 40))) for _ in range(60)]
    values += [f"{x} {x[: random.randint(0, 500)]} {y[:200]} {x[-300:]}" for x in base for y in base]
    rules = dataclasses.replace(RULES, phrase=phrase)
    fraction, longest = [], []
    for s in cut(values, 4000):
        m = measures(s, rules)
        fraction += m["covered_fraction"].tolist()
        longest += m["longest_repeat_words"].tolist()
    for t, f, n in zip(values, fraction, longest, strict=True):
        w = (t or "").split()
        common = [[0] * (len(w) + 1) for _ in range(len(w) + 1)]
        best = [0] * len(w)
        for x in range(len(w) - 1, -1, -1):
            for y in range(len(w) - 1, -1, -1):
                if x != y and w[x] == w[y]:
                    common[x][y] = common[x + 1][y + 1] + 1
                    best[x] = max(best[x], common[x][y])
        inside = {j for x, k in enumerate(best) if k >= phrase for j in range(x, x + k)}
        assert f == sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))
        assert n == max([k for k in best if k >= 8], default=0)


def test_short_phrases_decide(spark):
    """A text that turns round a phrase of five words passes the base rule and not the method's."""
    random.seed(3)
    fresh = iter(f"w{i}" for i in range(10_000))
    loop = " ".join(f"over and over it goes {next(fresh)} {next(fresh)}" for _ in range(40))
    rows = {r.doc_id: (r.base_failed, r.kept) for r in judge_repetition(spark.createDataFrame([(1, loop), (2, " ".join(next(fresh) for _ in range(300)))], "doc_id long, text string")).collect()}
    assert rows == {1: (False, False), 2: (False, True)}


def test_row_operators_on_very_long_texts(spark):
    """Texts of megabytes among nulls and empty ones, through Spark."""
    random.seed(6)
    long = " ".join(random.choices([f"word{i}" for i in range(5000)], k=300_000))
    df = spark.createDataFrame([(None, None), (1, ""), (2, long), (3, None), (4, "a b c")], "doc_id long, text string").coalesce(1)
    judged = {r.doc_id: (r.n_words, r.kept) for r in judge_repetition(df).filter("doc_id is not null").collect()}
    assert judged == {1: (0, False), 2: (300_000, True), 3: (0, False), 4: (3, False)}
    library = library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df).filter("doc_id is not null").collect()}
    assert counted == {1: (0, 0), 2: (len(long), len(library.encode(long, add_special_tokens=False).ids)), 3: (0, 0), 4: (5, 3)}
    assert {r.doc_id: r.decoded for r in encode_and_decode(df).filter("doc_id is not null").collect()} == {1: "", 2: long, 3: "", 4: "a b c"}


def test_repetition_keeps_clean_and_drops_loops(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    loop = "the same eight words come here again now " * 20
    df = spark.createDataFrame([(1, clean, "x"), (2, loop, "x"), (None, None, None), (1, clean, "x")], "doc_id long, text string, kept string")
    rows = [(r.doc_id, r.base_failed, r.kept) for r in judge_repetition(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, False, True), (2, True, False), (None, True, False), (1, False, True)], key=str)
    assert judge_repetition(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        judge_repetition(df, keep=("doc_id", "kept"))


@pytest.mark.parametrize("limit", [700, 1 << 20])
def test_token_counts_equal_the_library(limit):
    path = vocabulary_path("byte_bpe_50k.json")
    library, values = library_tokenizer(path), texts()
    got = [n for s in cut(values, limit) for n in count_slice(s, path).tolist()]
    assert got == [len(library.encode(t or "", add_special_tokens=False).ids) for t in values]


def test_neighbours_follow_from_merge_ranks():
    """Against the encoding by its definition, for pairs of any tokens and of tokens of repeated letters."""
    transducer, _ = compiled_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    random.seed(12)
    known = [i for i in transducer.token if i >= 0]
    alike = [i for i in known if len(set(transducer.words[i])) <= 2 and len(transducer.words[i]) < 20]
    for some in (known, alike):
        for _ in range(4000):
            a, b = random.choice(some), random.choice(some)
            x, y = transducer.words[a], transducer.words[b]
            assert transducer.stays(a, b) == (transducer.encode(x + y)[0] == [x, y])


@pytest.mark.parametrize("chunk", [3, 7, 64])
def test_chunk_maps_compose(chunk):
    transducer, _ = compiled_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    library = library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    random.seed(13)
    before = transducer.CHUNK, transducer.WARM
    try:
        transducer.CHUNK, transducer.WARM = chunk, min(chunk, 5)
        for piece in ["a" * 1000, "ab" * 700, "x" * 999 + "y", *("".join(random.choices("aeinrst", k=random.randint(1, 900))) for _ in range(40))]:
            assert transducer.count_chunks(piece.encode()) == transducer.run(piece.encode())[1] == len(library.encode(piece).ids)
    finally:
        transducer.CHUNK, transducer.WARM = before


@pytest.mark.parametrize("limit", [700, 1 << 20])
def test_encoding_equals_the_library_and_decodes_back(limit):
    import public_tokenizers
    import tiktoken

    path = vocabulary_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    values, got = texts(), []
    for s in cut(values, limit):
        got += zip(*round_trip(s, tree_encoder(path)), strict=True)
    for t, (n, ids, decoded) in zip(values, got, strict=True):
        want = library.encode_ordinary(t or "")
        assert (n, ids.decode()) == (len(want), " ".join(map(str, want)))
        assert decoded == (t or "").encode()


def test_join_is_associative():
    encoder = tree_encoder(vocabulary_path("byte_bpe_50k.tiktoken"))
    random.seed(9)
    for _ in range(200):
        a, b, c = (bytes(random.choices(b"the in ation", k=random.randint(0, 20))) for _ in range(3))
        x, y, z = map(encoder.leaf, (a, b, c))
        assert encoder.join(encoder.join(x, y), z) == encoder.join(x, encoder.join(y, z)) == encoder.leaf(a + b + c)


def test_pieces_do_not_depend_on_chunks():
    import numpy as np
    import public_tokenizers
    import regex

    random.seed(5)
    t = "".join(random.choices(["'re", "'", "r", "e", " ", "\n", "1", "!", "x"], k=3000))
    starts, _ = piece_starts(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]))
    assert starts.tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]


def test_row_operators_on_tables(spark):
    df = spark.createDataFrame([(1, "Hello world", 7), (1, "Hello world", 7), (None, None, 0), (3, "", 0)], "doc_id long, text string, n_tokens long")
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, limit=1).collect()), key=str) == sorted([(1, 11, 2, True), (1, 11, 2, True), (None, 0, 0, False), (3, 0, 0, False)], key=str)
    rows = {(r.doc_id, r.n_tokens, r.decoded) for r in encode_and_decode(df).collect()}
    assert rows == {(1, 2, "Hello world"), (None, 0, ""), (3, 0, "")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in encode_and_decode(df, digests=True).collect() if not r.n_tokens} == {empty}
    assert count_tokens(df.limit(0)).count() == encode_and_decode(df.limit(0)).count() == 0
