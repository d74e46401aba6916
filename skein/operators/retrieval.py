"""Vector, text and JSON retrieval over nodes, and rank fusion.

Searches are exact: a distance or score is an expression over the property,
and the best are a distributed top-k. A batch of queries is small and stated,
so it joins the nodes as a broadcast table of checked size.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import json_docs
from skein.functions.vectors import metric
from skein.plans.parser import GqlError
from skein.sources.durable import written
from skein.sources.graph import PropertyGraph

#: Most queries of a batch, most ids of a candidate list.
MOST_QUERIES, MOST_IDS = 10_000, 1_000_000
K1, B = 1.2, 0.75
WORDS = r"[\p{L}\p{N}\p{IsAlphabetic}]+"


def positive(k: int) -> int:
    if not isinstance(k, int) or k < 0:
        raise GqlError("a limit is a whole number that is not negative", "22023")
    return k


def of_label(graph: PropertyGraph, label: str | None, prop: str) -> DataFrame:
    """id and ``value`` of the nodes that have the property."""
    df = graph.scan_nodes(("label", label) if label else None, {prop})
    if prop not in df.columns:
        return graph.spark.createDataFrame([], "id long, value string")
    return df.select("id", F.col(prop).alias("value")).filter("value is not null")


def ids(graph: PropertyGraph, nodes: list) -> DataFrame:
    if len(nodes) > MOST_IDS:
        raise GqlError(f"a list holds {MOST_IDS} nodes at most", "22023")
    return graph.spark.createDataFrame([(int(n),) for n in dict.fromkeys(nodes)], "id long")


def among(df: DataFrame, candidates: DataFrame | None) -> DataFrame:
    return df if candidates is None else df.join(candidates.select("id").distinct(), "id", "left_semi")


def filtered(graph: PropertyGraph, df: DataFrame, filter_property: str | None = None, filter_values: list | None = None, edge_label: str | None = None, edge_property: str | None = None, edge_values: list | None = None, endpoint: str | None = None) -> DataFrame:
    """Nodes with one of the values, and nodes that touch an edge with one of the values, at the stated end."""
    if filter_property:
        keep = graph.scan_nodes(None, {filter_property}).filter(F.col(filter_property).isin(list(filter_values or [])))
        df = df.join(keep.select("id"), "id", "left_semi")
    if edge_label:
        edges = graph.scan_edges(("label", edge_label), {edge_property} if edge_property else set())
        if edge_property:
            edges = edges.filter(F.col(edge_property).isin(list(edge_values or [])))
        ends = {"source": ["#src"], "target": ["#dst"]}.get((endpoint or "both").lower(), ["#src", "#dst"])
        touched = edges.select(F.explode(F.array(*[F.col(f"`{e}`") for e in ends])).alias("id")).distinct()
        df = df.join(touched, "id", "left_semi")
    return df


# vectors


def vector_literal(q: list) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def nearest(df: DataFrame, q: list, k: int, name: str | None) -> DataFrame:
    """node_id and distance of the k nearest, ties to the smaller id. Vectors of another dimension take no part."""
    d = metric(name)(F.col("value"), vector_literal(q))
    scored = df.filter(F.size("value") == len(q)).select(F.col("id").alias("node_id"), d.alias("distance"))
    return scored.orderBy("distance", "node_id").limit(positive(k))


def nearest_batch(graph: PropertyGraph, df: DataFrame, queries: list, k: int, name: str | None, by_query: DataFrame | None = None) -> DataFrame:
    """The same for each query, numbered from 0; ``by_query`` (query_index, id) states each one's own candidates."""
    if len(queries) > MOST_QUERIES:
        raise GqlError(f"a batch holds {MOST_QUERIES} queries at most", "22023")
    asked = graph.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query_index long, q array<double>")
    pairs = df.crossJoin(F.broadcast(asked)) if by_query is None else df.join(by_query, "id").join(F.broadcast(asked), "query_index")
    scored = pairs.filter(F.size("value") == F.size("q")).select("query_index", F.col("id").alias("node_id"), metric(name)(F.col("value"), F.col("q")).alias("distance"))
    w = Window.partitionBy("query_index").orderBy("distance", "node_id")
    return scored.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= positive(k)).drop("i").orderBy("query_index", "distance", "node_id")


def neighbours(graph: PropertyGraph, roots: DataFrame, edge_label: str | None, direction: str | None, keep: list[str] | None = None) -> DataFrame:
    """Nodes one step from the roots (column id), distinct; with ``keep`` also these columns of the roots."""
    ways = {"outgoing": "RU", "incoming": "LU", "both": "RLU"}.get((direction or "outgoing").lower())
    if ways is None:
        raise GqlError(f"unknown direction {direction}", "22023")
    hops = graph.ways(("label", edge_label) if edge_label else None, frozenset(ways), set()).select(F.col("#from").alias("f"), F.col("#to").alias("t"))
    return roots.join(hops, F.col("id") == F.col("f")).select(*(keep or []), F.col("t").alias("id")).distinct()


def state(graph: PropertyGraph, name: str) -> DataFrame:
    """Members of a candidate state: nodes of its label with an edge of each required label that way, and none of an excluded one. Undirected edges go both ways."""
    try:
        s = graph.extra["states"][name]
    except KeyError:
        raise GqlError(f"there is no candidate state {name}", "42002") from None
    df = graph.scan_nodes(("label", s["label"]) if s.get("label") else None, set()).select("id")
    for kind, word in (("left_semi", "require"), ("left_anti", "exclude")):
        for side, way in (("outgoing", "R"), ("incoming", "L")):
            for label in s.get(f"{word}_{side}", []):
                touched = graph.ways(("label", label), frozenset({way, "U"}), set()).select(F.col("#from").alias("id"))
                df = df.join(touched, "id", kind)
    return df


def combined(a: DataFrame, b: DataFrame, op: str | None) -> DataFrame:
    """Set operation on candidates."""
    op = (op or "intersection").lower()
    a, b = a.select("id").distinct(), b.select("id").distinct()
    if op in ("intersect", "intersection"):
        return a.join(b, "id", "left_semi")
    if op == "union":
        return a.union(b).distinct()
    if op in ("difference", "except"):
        return a.join(b, "id", "left_anti")
    raise GqlError(f"unknown set operation {op}", "22023")


def reachable(graph: PropertyGraph, roots: list, edge_label: str | None, k: int, max_depth: int | None = None, direction: str | None = None) -> DataFrame:
    """node_id and least depth, breadth first from the roots at depth 0."""
    seen = ids(graph, roots).withColumn("depth", F.lit(0).cast("long"))
    frontier, depth = seen.select("id"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = neighbours(graph, frontier, edge_label, direction).join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        new = written(new, "reached")
        if new.isEmpty():
            break
        seen, frontier = seen.union(new), new.select("id")
        if depth % 8 == 0:  # else the plan grows with the depth
            seen = written(seen, "reached")
    return seen.select(F.col("id").alias("node_id"), "depth").orderBy("depth", "node_id").limit(positive(k))


# text


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lower)


def bm25(graph: PropertyGraph, label: str, prop: str, queries: list[str]) -> DataFrame:
    """(query_index, id, score) of every node that holds a query's term; statistics over all nodes of the label with a text."""
    if len(queries) > MOST_QUERIES:
        raise GqlError(f"a batch holds {MOST_QUERIES} queries at most", "22023")
    corpus = of_label(graph, label, prop).filter(F.col("value").cast("string").isNotNull()).select("id", tokens(F.col("value").cast("string")).alias("words"))
    asked = graph.spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_index long, q string")
    asked = asked.select("query_index", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    terms = asked.select("term").distinct()
    size = corpus.select("id", F.size("words").alias("dl"), "words")
    total = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # a node sends out the terms asked for alone, each once with its count; they are few, as queries are
    wanted = [r["term"] for r in terms.collect()]
    held = F.filter("words", lambda w: w.isin(wanted))
    postings = size.select("id", "dl", held.alias("held")).filter(F.size("held") > 0)
    postings = postings.select("id", "dl", "held", F.explode(F.array_distinct("held")).alias("term"))
    postings = postings.select("term", "id", "dl", F.size(F.filter("held", lambda w: w == F.col("term"))).cast("long").alias("tf")).join(F.broadcast(terms), "term", "left_semi")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = postings.join(frequency, "term").crossJoin(F.broadcast(total)).select("term", "id", part.alias("part"))
    return scored.join(F.broadcast(asked), "term").groupBy("query_index", "id").agg(F.sum("part").alias("score"))


def best_texts(scored: DataFrame, k: int, batch: bool) -> DataFrame:
    if not batch:
        return scored.select(F.col("id").alias("node_id"), "score").orderBy(F.desc("score"), "node_id").limit(positive(k))
    w = Window.partitionBy("query_index").orderBy(F.desc("score"), "id")
    return scored.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= positive(k)).select("query_index", F.col("id").alias("node_id"), "score").orderBy("query_index", F.desc("score"), "node_id")


# JSON


def json_value(graph: PropertyGraph, label: str, prop: str, path: Any) -> DataFrame:
    """id, and the JSON at the path (null if it is absent)."""
    df = of_label(graph, label, prop)
    steps = path if isinstance(path, list) else json.loads(path) if str(path).startswith("[") else [path]
    text = str(path) if str(path).startswith("$") else "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return df.select("id", F.to_json(F.variant_get(F.try_parse_json(F.col("value").cast("string")), F.lit(text), "variant")).alias("json"))


def json_contains(graph: PropertyGraph, label: str, prop: str, candidate: str) -> DataFrame:
    df = of_label(graph, label, prop).filter(F.try_parse_json(F.col("value").cast("string")).isNotNull())
    return df.filter(json_docs.contains_udf(F.col("value").cast("string"), F.lit(candidate))).select("id")


def first_ids(df: DataFrame, k: int, *more: str) -> DataFrame:
    return df.select(F.col("id").alias("node_id"), *more).orderBy("node_id").limit(positive(k))


# fusion


def reciprocal_rank_fusion(graph: PropertyGraph, rankings: list, k: int, rank_constant: float | None = None, weights: list | None = None) -> DataFrame:
    """Sum of weight / (constant + rank) over lists, by first occurrence; best first, ties to the smaller id."""
    c = 60.0 if rank_constant is None else float(rank_constant)
    if c <= 0:
        raise GqlError("the rank constant is positive", "22023")
    w = [1.0] * len(rankings) if weights is None else [float(x) for x in weights]
    if len(w) != len(rankings) or any(x < 0 for x in w):
        raise GqlError("one weight that is not negative for each ranking", "22023")
    if sum(map(len, rankings)) > MOST_IDS:
        raise GqlError(f"rankings hold {MOST_IDS} nodes at most", "22023")
    rows = [(i, r, int(n)) for i, ranking in enumerate(rankings) for r, n in enumerate(ranking, 1)]
    df = graph.spark.createDataFrame(rows, "list long, rank long, id long").groupBy("list", "id").agg(F.min("rank").alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, w or [1.0])), (F.col("list") + 1).cast("int"))
    return df.groupBy("id").agg(F.sum(weight / (c + F.col("rank"))).alias("score")).select(F.col("id").alias("node_id"), "score").orderBy(F.desc("score"), "node_id").limit(positive(k))
