"""Procedures against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from skein.operators.procedures import ALL
from skein.plans.parser import GqlError
from skein.session import Session
from skein.sources.graph import PropertyGraph


@pytest.fixture(scope="module")
def random_graph(spark):
    random.seed(11)
    edges = sorted({(random.randint(1, 24), random.randint(1, 24)) for _ in range(40)})
    graph = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"]} for i in range(1, 31)], [{"id": 100 + k, "label": "E", "src": a, "dst": b, "w": float(k % 5 + 1)} for k, (a, b) in enumerate(edges)])
    s = Session.over(graph)
    s.execute("CALL algo.projection_build('p', NULL, ['E'], 'w')")
    return s, edges


def call(s: Session, text: str, **params) -> list:
    return [tuple(r) for r in s.execute(f"CALL {text}", params).collect()]


def reach(edges, start, ways=1):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in edges:
            for x, y in ((a, b), (b, a))[:ways]:
                if x == v and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


def test_every_procedure_is_there():
    assert len(ALL) == 69 and sum(n.startswith("algo.") for n in ALL) == 19


def test_components(random_graph):
    s, edges = random_graph
    assert call(s, "algo.wcc('p')") == [(v, min(reach(edges, v, 2))) for v in range(1, 31)]
    ahead = {v: reach(edges, v) for v in range(1, 31)}
    assert call(s, "algo.scc('p')") == [(v, min(w for w in ahead[v] if v in ahead[w])) for v in range(1, 31)]


def test_cut_points_and_bridges(random_graph):
    s, edges = random_graph
    count = lambda vs, es: len({frozenset(reach(es, v, 2)) for v in vs})
    nodes = range(1, 31)
    whole = count(nodes, edges)
    cuts = [v for v in nodes if count([x for x in nodes if x != v], [e for e in edges if v not in e]) > whole - (1 if reach(edges, v, 2) == {v} else 0)]
    assert call(s, "algo.articulation_points('p')") == [(v,) for v in cuts]
    bridges = {(min(e), max(e)) for e in edges if e[0] != e[1] and count(nodes, [x for x in edges if x is not e]) > whole}
    assert set(call(s, "algo.bridges('p')")) == bridges


def test_shortest_paths(random_graph):
    s, edges = random_graph
    weight = {e: float(k % 5 + 1) for k, e in enumerate(edges)}
    cost = {1: 0.0}
    for _ in range(30):
        for (a, b), w in weight.items():
            if a in cost and cost[a] + w < cost.get(b, math.inf):
                cost[b] = cost[a] + w
    assert call(s, "algo.sssp('p', 1)") == sorted(cost.items())
    far = max(cost, key=lambda v: (cost[v], v))
    ((total, path, length),) = call(s, f"algo.dijkstra('p', 1, {far})")
    assert total == cost[far] and path[0] == 1 and path[-1] == far and length == len(path) - 1
    assert sum(weight[e] for e in zip(path, path[1:], strict=False)) == total
    assert call(s, "algo.dijkstra('p', 30, 1)") == []
    with pytest.raises(GqlError):
        call(s, "algo.apsp('p', 5)")


def test_centrality(random_graph):
    s, edges = random_graph
    n, score = 30, dict.fromkeys(range(1, 31), 1 / 30)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    for _ in range(4):
        lost = sum(v for k, v in score.items() if not out[k])
        new = {k: 0.15 / n + 0.85 * lost / n for k in score}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * score[a] / len(bs)
        score = new
    got = dict(call(s, "algo.pagerank('p', 0.85, 4, 0.0)"))
    assert all(abs(got[k] - v) < 1e-12 for k, v in score.items())
    assert abs(sum(dict(call(s, "algo.pagerank('p', 0.85, 5, 1.0)")).values()) - 1) < 1e-9
    between = Counter()
    for source in range(1, 31):
        level, paths, order = {source: 0}, Counter({source: 1}), [source]
        for v in order:
            for w in out[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        part = Counter()
        for w in reversed(order):
            for v in order:
                if w in out[v] and level[w] == level[v] + 1:
                    part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != source:
                between[w] += part[w]
    got = dict(call(s, "algo.betweenness('p', NULL, NULL)"))
    assert all(abs(got[v] - between[v]) < 1e-9 for v in range(1, 31))
    assert set(dict(call(s, "algo.betweenness('p', 0, NULL)")).values()) == {0.0}


def test_communities_and_triangles(random_graph):
    s, edges = random_graph
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    near = defaultdict(set)
    for p in pairs:
        a, b = p
        near[a].add(b)
        near[b].add(a)
    triangles = {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a]) for v in range(1, 31)}
    assert dict(call(s, "algo.triangle_count('p', NULL)")) == triangles
    label = {v: v for v in range(1, 31)}
    for _ in range(50):
        before = dict(label)
        for v in range(1, 31):
            votes = Counter(label[b if a == v else a] for a, b in edges if v in (a, b))
            if votes:
                label[v] = min(votes, key=lambda x: (-votes[x], x))  # noqa: B023
        if label == before:
            break
    assert dict(call(s, "algo.label_propagation('p', NULL)")) == label
    communities = call(s, "algo.louvain('p', NULL)")
    assert len(communities) == 30 and {x[2] for x in communities} == {0}


def test_topological_order(spark):
    edges = [(5, 1), (4, 1), (1, 2), (5, 2), (2, 3)]
    g = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"]} for i in range(1, 7)], [{"id": 10 + k, "label": "E", "src": a, "dst": b} for k, (a, b) in enumerate(edges)])
    s = Session.over(g)
    s.execute("CALL algo.projection_build('p')")
    assert call(s, "algo.topological_sort('p')") == [(4, 0), (5, 1), (6, 2), (1, 3), (2, 4), (3, 5)]
    assert call(s, "algo.projection_list()") == [("p", 0, 6, 5)]
    s.execute("INSERT (:N)")
    assert call(s, "algo.projection_get('p')") == [("p", 1, 7, 5)]
    s.execute("CALL algo.projection_drop('p')")
    with pytest.raises(GqlError):
        call(s, "algo.wcc('p')")


def test_large_components_are_searched_by_joins(random_graph, spark, monkeypatch):
    """The same results, whether a task holds a component or it is joined."""
    from skein.operators import algorithms

    s, _ = random_graph
    chain = [(i, i + 1) for i in range(1, 9)] + [(1, 5), (3, 9), (20, 21)]
    g = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"]} for i in (*range(1, 10), 20, 21, 30)], [{"id": 100 + k, "label": "E", "src": a, "dst": b} for k, (a, b) in enumerate(chain)])
    t = Session.over(g)
    t.execute("CALL algo.projection_build('p')")
    calls = [(s, "algo.scc('p')"), (t, "algo.scc('p')"), (t, "algo.topological_sort('p')"), (s, "algo.betweenness('p', NULL, NULL)"), (s, "algo.betweenness('p', 7, NULL)"), (t, "algo.betweenness('p', NULL, NULL)")]
    rounded = lambda rows: sorted((r[0], round(r[1], 9)) for r in rows)
    before = [rounded(call(x, text)) for x, text in calls]
    monkeypatch.setattr(algorithms, "MOST_IN_TASK", 5)
    monkeypatch.setattr(algorithms, "MOST_BROADCAST_EDGES", 0)
    monkeypatch.setattr(algorithms, "RUN", 4)
    assert [rounded(call(x, text)) for x, text in calls] == before
    with pytest.raises(GqlError, match="22G20"):
        call(s, "algo.topological_sort('p')")


@pytest.fixture(scope="module")
def library(spark):
    random.seed(4)
    words = "graph join spark query table node edge path".split()
    nodes = [{"id": i, "labels": ["Doc"], "text": " ".join(random.choices(words, k=random.randint(3, 12))), "v": [random.random(), random.random(), 0.1], "j": f'{{"k": {i % 3}, "l": [{i}, {{"m": {i % 2}}}]}}', "kind": f"k{i % 2}"} for i in range(1, 21)]
    g = PropertyGraph.of_rows(spark, nodes, [{"id": 100 + i, "label": "CITES", "src": i, "dst": i + 1} for i in range(1, 20)])
    g.extra["states"] = {"citing": {"label": "Doc", "require_outgoing": ["CITES"], "exclude_incoming": ["NOPE"]}, "cited": {"label": "Doc", "require_incoming": ["CITES"], "exclude_outgoing": ["CITES"]}}
    return Session.over(g), nodes


def test_vector_procedures(library):
    s, nodes = library
    q = [0.3, 0.9, 0.2]
    dist = {n["id"]: sum((a - b) ** 2 for a, b in zip(n["v"], q, strict=True)) for n in nodes}
    order = sorted(dist, key=lambda i: (dist[i], i))
    ids = lambda rows, at=0: [r[at] for r in rows]
    assert ids(call(s, "db.vector_search_nodes('Doc', 'v', $q, 5, 'l2')", q=q)) == order[:5]
    assert ids(call(s, "db.vector_search_nodes_ann('Doc', 'v', $q, 5, 'l2', 64, 'kind', ['k1'])", q=q)) == [i for i in order if i % 2][:5]
    assert ids(call(s, "db.vector_score_nodes('v', $q, [3, 4, 5], 2, 'l2')", q=q)) == [i for i in order if i in (3, 4, 5)][:2]
    assert ids(call(s, "db.vector_score_neighbors('v', $q, 7, 'CITES', 5, 'both', 'l2')", q=q)) == [i for i in order if i in (6, 8)]
    assert ids(call(s, "db.vector_search_nodes_batch('Doc', 'v', $q, 2, 'l2')", q=[q, q]), 1) == order[:2] * 2
    around = {x for i in order[:2] for x in (i, i + 1)} & set(dist)
    assert ids(call(s, "db.vector_search_expanded_candidates_ann('Doc', 'v', $q, 2, 'CITES', 9, 'outgoing', 'l2')", q=q)) == [i for i in order if i in around]
    assert ids(call(s, "db.vector_score_candidate_state('v', $q, 'citing', 50, 'l2')", q=q)) == [i for i in order if i < 20]
    assert call(s, "db.vector_candidate_states()") == [("cited", 0, 1, "Doc", [], ["CITES"], ["CITES"], []), ("citing", 0, 19, "Doc", ["CITES"], [], [], ["NOPE"])]
    with pytest.raises(Exception):  # noqa: B017
        call(s, "db.vector_search_nodes('Doc', 'v', $q, 5, 'cosine')", q=[0.0, 0.0, 0.0])
    with pytest.raises(GqlError):
        call(s, "db.vector_search_nodes('Doc', 'v', $q, 5, 'nope')", q=q)


def test_text_procedures(library):
    s, nodes = library
    words = {n["id"]: re.findall(r"\w+", n["text"]) for n in nodes}
    mean = sum(map(len, words.values())) / len(words)

    def score(i: int, terms: set) -> float:
        out = 0.0
        for t in terms:
            df = sum(t in w for w in words.values())
            tf = words[i].count(t)
            out += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        return out

    terms = {"graph", "path"}
    want = sorted((i for i in words if score(i, terms) > 0), key=lambda i: (-round(score(i, terms), 9), i))
    got = call(s, "db.text_search_nodes('Doc', 'text', 'Graph path graph', 50)")
    assert [i for i, _ in got] == want and all(abs(x - score(i, terms)) < 1e-9 for i, x in got)
    assert [i for i, _ in call(s, "db.text_score_nodes('Doc', 'text', 'graph path', [1, 2, 3, 4], 9)")] == [i for i in want if i < 5]


def test_json_graph_and_fusion_procedures(library):
    s, nodes = library
    assert call(s, "db.json_contains_nodes('Doc', 'j', '{\"k\": 1}', 3)") == [(1,), (4,), (7,)]
    assert call(s, "db.json_path_contains_nodes('Doc', 'j', '[\"l\", 1]', '{\"m\": 0}', 2)") == [(2,), (4,)]
    assert call(s, "db.json_path_value_candidate_nodes('Doc', 'j', '$.l[0]', [9, 8], 5)") == [(8, "8"), (9, "9")]
    assert call(s, "db.json_path_exists_nodes('Doc', 'j', '$.zz', 5)") == []
    assert call(s, "db.reachable_nodes([3], 'CITES', 10, 2, 'both')") == [(3, 0), (2, 1), (4, 1), (1, 2), (5, 2)]
    got = call(s, "db.reciprocal_rank_fusion([[1, 2], [2, 3, 2]], 3, 60.0, [1.0, 2.0])")
    assert [i for i, _ in got] == [2, 3, 1] and abs(got[0][1] - (1 / 62 + 2 / 61)) < 1e-12
    s.execute("CALL db.create_vector_index('Doc', 'v', 3)")
    assert call(s, "db.vector_index_stats()") == [("Doc_v", "Doc", "v", "exact", 3, 20)]
    assert call(s, "db.rebuild_vector_indexes(1)") == [("Doc_v", "Doc", "v", "exact", 3, 20, 20)]
    s.execute("CALL db.create_index('Doc', 'kind', 'by_kind')")
    assert call(s, "db.property_index_stats()") == [("by_kind", "node", "Doc", "kind", "range", 20, 0, True)]
    s.execute("CALL db.create_text_index('Doc', 'text', 'words')")
    ((name, _, _, n, documents, terms, postings, length),) = call(s, "db.text_index_stats()")
    texts = [n["text"].split() for n in nodes]
    assert (name, n, documents, terms, postings, length) == ("words", 20, 20, len(set(sum(texts, []))), sum(len(set(w)) for w in texts), sum(map(len, texts)))
    assert call(s, "db.compaction_stats()")[0][:4] == (20, 20, 0, 19) and len(call(s, "db.compact()")[0]) == 26
    assert len(call(s, "db.feature_status()")[0]) == 10
    assert call(s, "db.health()") == [("main", 20, 19, False)]
    s.execute("CALL db.drop_vector_index('Doc', 'v')")
    assert call(s, "db.vector_index_stats()") == []


def test_edges_that_lie_together_need_no_rounds(spark, monkeypatch):
    """A chain in one task is contracted there; spread over tasks it gives the same components."""
    from skein.operators import components as C

    random.seed(7)
    ids = random.sample(range(1000), 300)
    edges = [(a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if k % 50 != 49] + [(5, 5)]
    want = {v: min(part) for k in range(0, 300, 50) for part in [ids[k : k + 50]] for v in part if v != min(part)}
    calls = []
    monkeypatch.setattr(C, "written", lambda df, name, real=C.written: calls.append(name) or real(df, name))
    df = spark.createDataFrame(edges, "a long, b long")
    for tasks, chunk in ((1, 1 << 20), (7, 1 << 20), (1, 10)):
        monkeypatch.setattr(C, "CHUNK", chunk)
        calls.clear()
        rows = C.components(df.coalesce(1) if tasks == 1 else df.repartition(tasks)).collect()
        assert dict(map(tuple, rows)) == want and len(rows) == len(want)
        if tasks == 1 and chunk > 300:
            assert len(calls) == 1


def test_projections_join_no_ends_that_are_known(spark):
    from skein.operators.algorithms import project
    from skein.sources.tables import orders_graph

    g = orders_graph(spark, "/root/testdata/sf0.001")
    p = project(g, "g", ["Event"], ["NEXT"], None)
    assert "Join" not in p.edges._jdf.queryExecution().optimizedPlan().toString()
    assert p.edges.count() == p.edges.join(p.vertices, p.edges.src == p.vertices.id, "left_semi").count() > 0
    assert project(g, "g", ["Customer"], ["NEXT"], None).edges.isEmpty()
    assert "LeftSemi" in project(g, "g", ["Customer"], ["FOLLOWED"], None).edges._jdf.queryExecution().optimizedPlan().toString()


def plain_louvain(nodes, edges, rounds):
    total = sum(w / 2 if a == b else w for a, b, w in edges)
    near = {v: [(b if a == v else a, w) for a, b, w in edges if v in (a, b)] for v in nodes}
    home = {v: v for v in nodes}
    degree = {v: sum(w for _, w in near[v]) for v in nodes}
    weight = dict(degree)
    for _ in range(rounds):
        for v in sorted(nodes):
            links, here, k = defaultdict(float), home[v], degree[v]
            for x, w in near[v]:
                links[home[x]] += w
            gain = lambda c, others: links.get(c, 0.0) / total - k * others / (2 * total * total)  # noqa: B023, E731
            stay, best, most = gain(here, weight[here] - k), here, 0.0
            for c in sorted(links):
                if c != here and gain(c, weight[c]) - stay > most:
                    best, most = c, gain(c, weight[c]) - stay
            weight[here] -= k
            weight[best] += k
            home[v] = best
    return home


def test_sweeps_over_files_and_several_components(spark, monkeypatch):
    """The same rows, whether arcs lie in memory or in a file, and one task runs over a component or over many."""
    from skein.operators import algorithms

    random.seed(3)
    edges = [(a, b, float(random.randint(1, 4))) for lo in (1, 41, 81) for a, b in {(random.randint(lo, lo + 29), random.randint(lo, lo + 29)) for _ in range(60)}]
    edges += edges[:3]
    g = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"]} for i in range(1, 121)], [{"id": 1000 + k, "label": "E", "src": a, "dst": b, "w": w} for k, (a, b, w) in enumerate(edges)])
    s = Session.over(g)
    s.execute("CALL algo.projection_build('p', NULL, ['E'], 'w')")
    calls = ["algo.louvain('p', 3)", "algo.label_propagation('p', 4)", "algo.scc('p')", "algo.bridges('p')", "algo.articulation_points('p')"]
    before = [sorted(call(s, x)) for x in calls]
    assert {v: c for v, c, _ in before[0]} == plain_louvain(range(1, 121), edges, 3)
    monkeypatch.setattr(algorithms, "HELD_ARCS", 16)
    monkeypatch.setattr(algorithms, "TASK_ROWS", 40)
    assert [sorted(call(s, x)) for x in calls] == before


def test_a_component_takes_little_memory():
    """A task holds its nodes, not its arcs."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from skein.operators import algorithms

    n, each = 2000, 600
    rng = np.random.default_rng(1)

    def batches():
        for v in range(n):
            dst = pa.array([None, *rng.integers(0, n, each).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(each + 1, v)), dst, pa.array(np.ones(each + 1))], names=["src", "dst", "weight"])

    tracemalloc.start()
    held, algorithms.HELD_ARCS = algorithms.HELD_ARCS, 1 << 14
    try:
        g = algorithms.adjacency(batches())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        algorithms.HELD_ARCS = held
        tracemalloc.stop()
    assert len(g.to) == n * each and peak < 4 * n * each  # bytes, of 16 in two columns


def test_small_components_share_tasks(spark):
    from skein.operators import algorithms
    from skein.sources.tables import orders_graph

    p = algorithms.project(orders_graph(spark, "/root/testdata/sf0.001"), "g", ["Event"], ["NEXT"], None)
    plan = algorithms.scc(p)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_joins_of_rounds_broadcast_nothing(random_graph, monkeypatch):
    """What a round joins does not pass through the driver, whatever its size."""
    from skein.operators import algorithms, components

    plans = []

    def kept(df, name, real=algorithms.written):
        plans.append((name, df._jdf.queryExecution().toString()))
        return real(df, name)

    monkeypatch.setattr(algorithms, "written", kept)
    monkeypatch.setattr(components, "written", kept)
    monkeypatch.setattr(algorithms, "MOST_IN_TASK", 5)
    s, _ = random_graph
    call(s, "algo.scc('p')")
    assert any(name.startswith("scc") for name, _ in plans)
    assert not [name for name, plan in plans if name not in ("large-nodes", "component-rows") and "BroadcastExchange" in plan]  # these two meet the names of large components, few


def test_edges_that_begin_no_triangle_ship_nothing(spark, monkeypatch):
    """A graph of two sides ends with its middle edges, of which there are none; no wedge is built."""
    from skein.operators import algorithms

    names = []
    monkeypatch.setattr(algorithms, "written", lambda df, name, real=algorithms.written: names.append(name) or real(df, name))
    g = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"]} for i in range(1, 41)], [{"id": 100 * a + b, "label": "E", "src": a, "dst": b} for a in range(1, 4) for b in range(4, 41)])
    s = Session.over(g)
    s.execute("CALL algo.projection_build('p')")
    assert {n for _, n in call(s, "algo.triangle_count('p', NULL)")} == {0} and names == ["oriented", "middle"]
