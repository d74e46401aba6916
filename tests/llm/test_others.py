"""Packing, URL filters, chat rotation, nearest neighbours and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.ann import PolytopeIndex, nearest, transform
from skein.llm.chat import rotate_perspectives
from skein.llm.packing import PieceIds, combinations, least_squares, pack_documents, plan, slots
from skein.llm.url_filters import RULES, judge_urls
from skein.llm.vocabulary import library_tokenizer, vocabulary_path

VOCABULARY = vocabulary_path("word_bpe_49k.json")


def test_piece_ids_equal_the_library():
    random.seed(3)
    parts = ["a", "'s", "'", "re", "'RE", "ve", "'l", " ", "\n", "\xa0", "23", "é", "!", "<|endoftext|>", "ẞ", "中", "\x1c", "́", "٣", "İ", "Σ", "J̌", "ΑΣ", "\x00", "'LL", "Ⱟ", "\U0001e6c0"]
    texts = ["", "'", "x'l ", "''s"] + ["".join(random.choices(parts, k=random.randint(0, 150))) for _ in range(500)] + ["".join(map(chr, range(1, 0x3000)))]
    library = library_tokenizer(VOCABULARY)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    ids = PieceIds(VOCABULARY)
    assert [x for i in range(0, len(texts), 50) for x in ids.encode(texts[i : i + 50])] == want


def test_least_squares_finds_exact_repeats():
    counts = np.zeros(11)
    counts[[3, 4, 6, 7]] = [5, 2, 2, 5]
    x = least_squares([(7, 3), (6, 4), (4, 3, 3)], counts, 200)
    assert np.allclose(x, [5, 2, 0], atol=0.1)


@pytest.mark.parametrize("scale", [1, 1000])
def test_least_squares_reach_the_optimum(scale):
    """Karush-Kuhn-Tucker: no column can gain by growing, and those in use cannot by shrinking, but for less than an occurrence."""
    rng = np.random.default_rng(4)
    counts = np.zeros(257)
    counts[1:256] = rng.poisson(4 * np.exp(-np.arange(1, 256) / 90)) * scale
    columns = combinations(np.flatnonzero(counts).tolist(), 256)
    x = least_squares(columns, counts)
    rest = -counts
    for c, times in zip(columns, x, strict=True):
        for a in c:
            rest[a] += times
    slope = np.array([sum(rest[a] for a in c) for c in columns])
    assert len(columns) > 1000 and (x >= 0).all()
    assert slope.min() > -1.5 and np.abs(slope[x > 0]).max() < 1.5


def test_plan_uses_every_length_up():
    random.seed(1)
    counts = {random.randint(1, 64): random.randint(1, 50) for _ in range(40)}
    used: dict = defaultdict(int)
    for pattern, times in plan(counts, 64):
        assert sum(pattern) <= 64 and times > 0
        for a in pattern:
            used[a] += times
    assert used == counts
    table = slots(plan(counts, 64))
    assert len(table["length"]) and (np.diff(table["length"]) >= 0).all()


def test_packing_is_gapless_and_whole(spark):
    random.seed(2)
    texts = [" ".join(random.choices(["hello", "world", "packing", "tokens"], k=random.randint(0, 120))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    rows = pack_documents(df, window=64, with_ids=True).collect()
    library = library_tokenizer(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length <= 64 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    padding = 1 - sum(r.length for r in rows) / (64 * len(by_sequence))
    assert padding < 0.1
    assert pack_documents(df.limit(0)).count() == 0


def test_repeated_and_null_ids_are_packed_as_often_as_they_come(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    rows = pack_documents(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert sorted(r.offset for r in rows) == [0, 3, 6]


def test_urls(spark):
    urls = [
        ("http://a.example.net/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("HTTP://X.NET/", "x.net", "/", "net/", "block"),
        ("http://X.NET", "x.net", "", None, "allow"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://example.com/de", "example.com", "/de", None, "allow"),
        ("http://a.org?x=/fr/", "a.org", "", None, "allow"),
        ("http://É.org/fr/a", "É.org", "/fr/a", "org/fr/", "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://" + "a." * 5000 + "net/" + "b/" * 5000, "a." * 5000 + "net", "/" + "b/" * 5000, "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)] + [(1, urls[1][0], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted([(i, *u[1:]) for i, u in enumerate(urls)] + [(1, *urls[1][1:])])
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_rotation_spans_and_ties(spark):
    said = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "ann", None), (1, 2, "ann", None), (2, None, None, "alone"), (None, 0, "ann", "x"), (3, 0, "system", "nobody")]
    said += [(4, i, "ann" if i % 2 else "cy", f"turn {i}") for i in range(200)]
    df = spark.createDataFrame([(*r, 0) for r in said], "conv_id long, turn long, role string, text string, position long")
    rows = rotate_perspectives(df).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r.conv_id, r.participant].append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann"), (4, "ann"), (4, "cy")}
    for (conv, who), parts in whole.items():
        parts.sort(key=lambda r: r.position)
        assert [r.position for r in parts] == list(range(len(parts)))
        text = "".join(r.rendered for r in parts)
        for r in parts:
            assert text[r.start : r.start + len(r.rendered)] == r.rendered
            if r.speaker == who:
                assert text[r.mask_start : r.mask_end].endswith("<|im_end|>") and r.rendered.startswith("<|im_start|>assistant\n")
            else:
                assert r.mask_start is None
    ann = "".join(r.rendered for r in whole[1, "ann"])
    assert ann == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
    assert len(whole[4, "cy"]) == 200
    assert rotate_perspectives(df.limit(0)).count() == 0


def test_rotation_of_many_speakers_and_lone_turns(spark):
    """Three speakers and more, a hundred messages without a turn, long and empty texts: every rendering in full, in the order stated."""
    rng = random.Random(2)
    said = [(1, None if rng.random() < 0.6 else rng.randrange(200), rng.choice(["ann", "bob", "cy", "di", None, "system"]), rng.choice(["", None, "é" * 5000, f"text {rng.randrange(500)}", f"t{rng.randrange(500)}"])) for _ in range(250)]
    rows = rotate_perspectives(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    messages = sorted({(r[1] is None, r[1] or 0, r[2] or "unknown", r[3] or "") for r in said}, key=lambda m: (m[0], m[1], m[2].encode(), m[3].encode()))
    got = defaultdict(list)
    for r in rows:
        got[r.participant].append(r)
    assert set(got) == {"ann", "bob", "cy", "di", "unknown"}
    for who, parts in got.items():
        parts.sort(key=lambda r: r.position)
        head = lambda s: "assistant" if s == who else "system" if s == "system" else f"user name={s}"  # noqa: B023, E731
        assert [r.rendered for r in parts] == [f"<|im_start|>{head(s)}\n{x}<|im_end|>\n" for _, _, s, x in messages]
        assert [r.start for r in parts] == [sum(len(q.rendered) for q in parts[:i]) for i in range(len(parts))]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(transform(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(transform(transform(x)), x)


@pytest.mark.parametrize("axes", [1, 2])
def test_neighbours_recall_and_ties(spark, axes):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[100:140] = v[100]  # one common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0, 2.0]), (1200, []), (7, v[7].tolist())]
    df = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "vec_id long, embedding array<float>, score double")
    index = PolytopeIndex(tables=10, probes=16 if axes == 1 else 80, axes=axes, block=64)
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0, 5, index).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        cos = x @ x[q]
        want = [i for i in np.lexsort((np.arange(400), -np.round(cos, 12))) if i != q][:5]
        hits += len(set(want) & {i for i, _ in got[q]})
        assert all(abs(s - cos[i]) < 1e-12 for i, s in got[q]) and len(got[q]) == 5
    assert hits >= 0.9 * 40
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert set(got) == set(range(0, 400, 50))
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("axes", [1, 2])
def test_neighbours_of_few_vectors_are_all_found(spark, axes):
    """Tables smaller than k, outliers far from one tight group, and lone dimensions: nobody comes back short."""
    rng = np.random.default_rng(5)
    tight = rng.normal(size=64) + 0.001 * rng.normal(size=(300, 64))
    rows = [(1000 + i, x.tolist()) for i, x in enumerate(tight)] + [(50 * i, rng.normal(size=64).tolist()) for i in range(1, 4)] + [(50 * i, rng.normal(size=8).tolist()) for i in range(6, 10)]
    rows += [(950, rng.normal(size=3).tolist())]
    got = defaultdict(list)
    index = PolytopeIndex(tables=2, probes=2, axes=axes)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, index).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    vectors = dict(rows)
    for q in (50, 100, 150, 300, 350, 400, 450):
        others = {i: np.dot(vectors[q], x) / np.linalg.norm(vectors[q]) / np.linalg.norm(x) for i, x in rows if i != q and len(x) == len(vectors[q])}
        assert len(got[q]) == min(5, len(others))
        if q >= 300:
            assert got[q] == sorted(others, key=lambda i: (-others[i], i))[:5]
    assert 950 not in got and len(nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()) == 1


def test_large_tables_take_finer_buckets():
    assert PolytopeIndex().for_size(999_999) == PolytopeIndex()
    assert (PolytopeIndex().for_size(1_000_000).axes, PolytopeIndex().for_size(1_000_000).probes) == (2, 512)


def test_neighbours_do_not_depend_on_a_count(spark):
    """The same index on either side of ``large``: the same rows."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 32)))], "vec_id long, embedding array<double>")
    few = PolytopeIndex(tables=2, probes=2)
    small, large = (sorted(map(tuple, nearest(df, F.col("vec_id") % 10 == 0, 5, replace(few, large=n)).collect())) for n in (601, 600))
    assert small == large and len(small) == 300


@pytest.mark.parametrize(("index", "least"), [(PolytopeIndex(), 0.98), (PolytopeIndex(large=1), 0.9)])
def test_neighbours_recall_on_a_table(spark, index, least):
    """Both settings against brute force on the given vectors; that of large tables finds more as neighbours come closer."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.select("vec_id", "embedding").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in nearest(rows, F.col("vec_id") % 50 == 0, 5, index).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cos = x @ x[i]
        cos[i] = -2
        hits += len(got[ids[i]] & set(ids[np.argsort(-cos)[:5]].tolist()))
    assert hits >= least * 5 * (ids % 50 == 0).sum()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = p.quality_rules(spark, docs, "")
    assert set(first.columns) == set(docs.columns)
    seen = {r.doc_id for r in first.collect()}
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, first, "")
        assert set(out.columns) == set(docs.columns), name
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= seen and len(ids) == len(rows)
        assert all(r.n_chars == len(r.text) for r in rows)
        first, seen = spark.createDataFrame(rows, out.schema), ids
    assert {r.doc_id for r in p.STAGES[-1][1](spark, first, "").collect()} == seen
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows: list):
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], DOCUMENTS)


def test_pipeline_keeps_one_stage_on_disk(spark):
    import corpus_pipeline as p
    from skein.sources.durable import of_application, shared_folder

    folder = Path(of_application(spark, shared_folder(spark)).removeprefix("file://"))
    before = set(folder.glob("stage-*"))
    out = p.run(spark, "/root/testdata/sf0.001")
    assert [x.name.rsplit("-", 1)[0] for x in set(folder.glob("stage-*")) - before] == ["stage-suffix-array-dedup"]
    assert out.count() and spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()  # the input stays


def test_near_duplicates_leave_one_of_each_group(spark):
    import corpus_pipeline as p

    base = " ".join(f"word{i}" for i in range(100))
    near = base.replace("word50", "other")
    rows = [(3, base), (1, near), (2, "quite different text of its own here"), (None, base), (1, "another text under an id that is there already"), (7, "a row that comes twice, word for word"), (7, "a row that comes twice, word for word"), (None, "no id"), (None, "no id"), (9, None), (9, None), (8, " ")]
    got = sorted(((r.doc_id, r.text) for r in p.jaccard_join(spark, documents(spark, rows), "").collect()), key=repr)
    want = [(1, near), rows[2], rows[4], rows[5], rows[7], (9, None), (9, None), (8, " ")]
    assert got == sorted(want, key=repr)
    assert p.jaccard_join(spark, documents(spark, rows[:0]), "").count() == 0


def test_repeated_passages_go(spark):
    """Passages of over 50 short words go, wherever they repeat; what is clean stays as it is."""
    import corpus_pipeline as p

    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "ort", "ing")]
    said = lambda n: " ".join(rng.choices(words, k=n))
    passage, short, clean = said(55), said(30), [(i, said(120)) for i in range(5)]
    rows = [*clean, (10, f"{said(150)} {passage} {said(40)}"), (11, f"{said(80)} {passage}"), (12, passage + " " + said(30)), (13, passage + " few"), (20, f"{said(60)} {short}"), (21, f"{short} {said(60)}"), (30, ""), (31, None)]
    assert 200 < len(passage) < 250 and len(short) < 200
    got = {r.doc_id: r.text for r in p.suffix_dedup(spark, documents(spark, rows), "").collect()}
    assert {i: t for i, t in got.items() if i < 10 or i >= 20} == {i: t or "" for i, t in rows if i < 10 or i >= 20}
    assert passage not in got[10] and passage not in got[11]
    assert got[10].split()[:149] == rows[5][1].split()[:149] and got[10].split()[-39:] == rows[5][1].split()[-39:]
    assert "\n" in got[10] and "\n" not in got[11]
    assert 12 not in got and 13 not in got  # more than half of their bytes are the passage


def test_stages_on_nulls_repeats_and_nothing(spark):
    """Every stage alone and all in a row: null and repeated ids, null, empty and very long texts, clashing columns, an empty table."""
    import corpus_pipeline as p

    rng = random.Random(21)
    fresh = iter(f"w{i}" for i in range(1_000_000))
    own = lambda n: " ".join(next(fresh) for _ in range(n))
    twice = own(40)
    rows = [(1, None), (None, ""), (2, twice), (2, twice), (None, own(50)), (2, own(30)), (3, own(60_000)), (4, own(25) + "\n\n" + own(25)), (None, None)]
    rng.shuffle(rows)
    docs = documents(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumns({"key": F.lit(1), "kept": F.lit("x"), "spans": F.lit(0), "lost": F.lit(0)})
    long = sorted(((i, x) for i, x in rows if x), key=repr)
    first = sorted(((r.doc_id, r.text) for r in p.quality_rules(spark, docs, "").collect()), key=repr)
    assert first == long
    for name, stage in p.STAGES[1:-1]:
        got = sorted(((r.doc_id, r.text or None) for r in stage(spark, docs, "").collect()), key=repr)
        blank = [(1, None), (None, None), (None, None)]
        want = {"line dedup": long, "n-gram Jaccard join": [x for i, x in enumerate(long) if x not in long[:i]], "suffix-array dedup": long}[name]
        if name == "suffix-array dedup":  # the repeated row is a passage of 40 words, which stays
            assert [x for x in got if x[1]] == long
        else:
            assert got == sorted([*want, *blank], key=repr), name
    packed = p.packing(spark, docs, "").select("doc_id", "doc_tokens", "start", "length").collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_tokens == 1) == 3
    whole = docs
    for _, stage in p.STAGES:
        whole = stage(spark, whole, "")
    assert sum(r.length for r in whole.collect()) > 60_000
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_stages_leave_no_shared_passage(spark):
    """After the suffix stage no string of 50 words is in two documents, and only documents that had one have changed."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shingles = lambda t: {tuple(w[i : i + 50]) for w in [(t or "").split()] for i in range(len(w) - 49)}
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in p.suffix_dedup(spark, docs, "").collect()}
    owners = defaultdict(set)
    for i, t in before.items():
        for x in shingles(t):
            owners[x].add(i)
    shared = set().union(*(o for o in owners.values() if len(o) > 1))
    assert len(shared) > 50 and all(i in after and after[i] != before[i] or i not in after for i in shared)
    left = defaultdict(set)
    for i, t in after.items():
        for x in shingles(t):
            left[x].add(i)
    assert all(len(o) == 1 for o in left.values())
