"""The registry of procedures: names, signatures, and what they run.

``algo.*`` are graph algorithms over a named projection. All others are
retrieval, JSON, text, index and maintenance procedures, which answer to their
bare name in any namespace but ``algo``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.parser import GqlError
from skein.sources.graph import PropertyGraph

from . import algorithms as A
from . import retrieval as R


@dataclass(frozen=True)
class Procedure:
    name: str
    run: Callable[..., DataFrame]
    signature: str
    yields: str
    mutates: bool = False


#: Every procedure by its name without namespace (``algo.`` ones with it).
ALL: dict[str, Procedure] = {}


def procedure(name: str, signature: str, yields: str, mutates: bool = False):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ALL[name] = Procedure(name, f, signature, yields, mutates)
        return f

    return add


class Registry:
    """Looks up a procedure by its full name."""

    def __contains__(self, name: str) -> bool:
        return self.key(name) in ALL

    @staticmethod
    def key(name: str) -> str:
        space, _, rest = name.rpartition(".")
        return name if space == "algo" else rest

    def columns(self, name: str) -> list[str]:
        return [c for c in ALL[self.key(name)].yields.split(", ") if c]

    def __getitem__(self, name: str) -> Callable[..., DataFrame]:
        p = ALL[self.key(name)]

        def run(graph: PropertyGraph, *args: Any) -> DataFrame:
            try:
                return p.run(graph, *args)
            except TypeError as e:
                if "argument" in str(e):
                    raise GqlError(f"{name}({p.signature}): {e}", "42N13") from e
                raise

        return run


def nothing(graph: PropertyGraph) -> DataFrame:
    return graph.spark.createDataFrame([], "done boolean").drop("done")


def rows(graph: PropertyGraph, data: list, kind: str) -> DataFrame:
    return graph.spark.createDataFrame(data, kind)


def registry_of(graph: PropertyGraph, name: str) -> dict:
    return graph.extra.setdefault(name, {})


# projections and algorithms


def projection(graph: PropertyGraph, name: str) -> A.Projection:
    """The projection by name, built anew if the graph has changed since."""
    try:
        spec = registry_of(graph, "projections")[name]
    except KeyError:
        raise GqlError(f"there is no projection {name}", "42002") from None
    if spec.get("graph") is not graph:
        spec["graph"], spec["built"] = graph, A.project(graph, name, *spec["args"])
        spec["generation"] = spec.get("generation", -1) + 1
    return spec["built"]


@procedure("algo.projection_build", "name, node_labels?, edge_labels?, weight_property?", "", True)
def projection_build(g: PropertyGraph, name: str, node_labels: list | None = None, edge_labels: list | None = None, weight: str | None = None) -> DataFrame:
    registry_of(g, "projections")[name] = {"args": (node_labels, edge_labels, weight)}
    projection(g, name)
    return nothing(g)


def described(g: PropertyGraph, names: list[str]) -> DataFrame:
    found = []
    for n in names:
        p = projection(g, n)
        found.append((n, registry_of(g, "projections")[n]["generation"], p.vertices.count(), p.edges.count()))
    return rows(g, found, "name string, generation long, node_count long, edge_count long")


procedure("algo.projection_get", "name", "name, generation, node_count, edge_count")(lambda g, name: described(g, [name]))
procedure("algo.projection_list", "", "name, generation, node_count, edge_count")(lambda g: described(g, sorted(registry_of(g, "projections"))))


@procedure("algo.projection_drop", "name", "", True)
def projection_drop(g: PropertyGraph, name: str) -> DataFrame:
    projection(g, name)
    del registry_of(g, "projections")[name]
    return nothing(g)


def over(name: str, f: Callable, signature: str, yields: str) -> None:
    procedure(f"algo.{name}", f"projection_name{signature}", yields)(lambda g, p, *args: f(projection(g, p), *args))


over("wcc", lambda p: A.wcc(p).orderBy("node_id"), "", "node_id, component_id")
over("scc", lambda p: A.scc(p).orderBy("node_id"), "", "node_id, component_id")
over("wcc_count", lambda p: A.wcc(p).agg(F.count_distinct("component_id").alias("count")), "", "count")
over("scc_count", lambda p: A.scc(p).agg(F.count_distinct("component_id").alias("count")), "", "count")
over("topological_sort", A.topological_sort, "", "node_id, topo_position")
over("articulation_points", A.articulation_points, "", "node_id")
over("bridges", A.bridges, "", "from_node, to_node")
over("dijkstra", A.dijkstra, ", from, to", "cost, path, length")
over("sssp", A.sssp, ", source", "target_node, cost")
over("apsp", A.apsp, ", max_nodes, parallelism?", "source_node, target_node, cost")
over("betweenness", A.betweenness, ", sample_size?, parallelism?", "node_id, score")
over("label_propagation", A.label_propagation, ", max_iter?", "node_id, community")
over("louvain", A.louvain, ", max_iter?", "node_id, community, level")
over("triangle_count", A.triangle_count, ", parallelism?", "node_id, triangle_count")


@procedure("algo.pagerank", "projection_name, damping?, max_iterations?, tolerance?, parallelism?, orientation?, personalization?, result_label?, limit?, result_nodes?, edge filter?", "node_id, score")
def pagerank(g: PropertyGraph, name: str, damping: Any = None, rounds: Any = None, tolerance: Any = None, parallelism: Any = None, orientation: Any = None, personalization: Any = None, label: Any = None, limit: Any = None, nodes: Any = None, *edge_filter: Any) -> DataFrame:
    df = A.pagerank(projection(g, name), damping, rounds, tolerance, parallelism, orientation, personalization).withColumnRenamed("node_id", "id")
    if label:
        df = df.join(g.scan_nodes(("label", label), set()).select("id"), "id", "left_semi")
    if nodes is not None:
        df = R.among(df, R.ids(g, nodes))
    if edge_filter:
        df = R.filtered(g, df, None, None, *edge_filter)
    df = A.ranked(df.withColumnRenamed("id", "node_id"), "score")
    return df if limit is None else df.limit(R.positive(limit))


# state of the graph


@procedure("health", "", "graph_id, node_count, edge_count, schema_bound")
def health(g: PropertyGraph) -> DataFrame:
    n = sum(t.df.count() for t in g.nodes)
    return rows(g, [(g.name, n, sum(t.df.count() for t in g.edges), bool(g.extra.get("type")))], "graph_id string, node_count long, edge_count long, schema_bound boolean")


#: Feature, status, rationale, surface.
FEATURES = (
    ("query", "supported", "read and write pipelines", "language"),
    ("paths", "supported", "modes, quantifiers and selectors on single edges", "language"),
    ("subpath_patterns", "unsupported", "grouped and alternating parts of a path", "language"),
    ("set_operations", "supported", "with duplicates and without", "language"),
    ("merge", "unsupported", "rejected with 42N01", "language"),
    ("schema", "supported", "graph types of nodes and edges; one catalog", "language"),
    ("transactions", "supported", "first committer wins", "language"),
    ("algorithms", "supported", "over named projections", "procedures"),
    ("vectors", "supported", "exact searches, under the names of approximate ones too", "procedures"),
    ("text", "supported", "BM25", "procedures"),
    ("json", "supported", "containment, paths and patches", "procedures"),
)
FEATURE_COLUMNS = "feature_id string, status string, rationale string, feature_name string, surface string, profile_relation string, claim_state string, evidence_status string, evidence_count long, profile_hash string"


@procedure("feature_status", "", ", ".join(c.split()[0] for c in FEATURE_COLUMNS.split(", ")))
def feature_status(g: PropertyGraph) -> DataFrame:
    """No conformance is claimed and no evidence registered; the hash is that of this table."""
    digest = hashlib.sha256(repr(FEATURES).encode()).hexdigest()
    known = [(f, status, why, f.replace("_", " "), surface, "extension" if surface == "procedures" else "direct", "unclaimed", "absent", 0, digest) for f, status, why, surface in FEATURES]
    return rows(g, known, FEATURE_COLUMNS)


@procedure("verify", "", "check, label, violations")
def verify(g: PropertyGraph) -> DataFrame:
    """Ids that repeat, and edge ends without a node."""
    nodes = g.scan_nodes(None, set()).select("id")
    out = [nodes.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("duplicate node id").alias("check"), F.lit(None).cast("string").alias("label"), "violations")]
    for t in g.edges:
        ends = t.df.select(F.explode(F.array("src", "dst")).alias("id"))
        bad = ends.join(nodes, "id", "left_anti").agg(F.count("*").alias("violations"))
        out.append(bad.select(F.lit("dangling edge end").alias("check"), F.lit(t.label).alias("label"), "violations"))
    df = out[0]
    for x in out[1:]:
        df = df.union(x)
    return df


# indexes: a registry entry states how a property is meant to be laid out


def index_procedures() -> None:
    for kind, args in (("index", "label, property, kind"), ("vector_index", "label, property, dimension, kind?, name?, metric?, m?, ef?, centroids?"), ("text_index", "label, property, name?")):

        def create(g: PropertyGraph, label: str, prop: str, *rest: Any, kind: str = kind) -> DataFrame:
            if (kind, label, prop) in registry_of(g, "indexes"):
                raise GqlError(f"there is a {kind} on {label}.{prop} already", "42N14")
            registry_of(g, "indexes")[kind, label, prop] = rest
            return nothing(g)

        def drop(g: PropertyGraph, label: str, prop: str, kind: str = kind) -> DataFrame:
            if registry_of(g, "indexes").pop((kind, label, prop), None) is None:
                raise GqlError(f"there is no {kind} on {label}.{prop}", "42002")
            return nothing(g)

        procedure(f"create_{kind}", args, "", True)(create)
        procedure(f"drop_{kind}", "label, property", "", True)(drop)


index_procedures()


def entries(g: PropertyGraph, kind: str) -> list[tuple]:
    """Of each index its name, label, property, the other arguments that made it, and the number of rows with a value."""
    place = {"index": None, "vector_index": 2, "text_index": 0}[kind]
    found = []
    for k, label, prop in sorted(registry_of(g, "indexes")):
        if k == kind:
            rest = registry_of(g, "indexes")[k, label, prop]
            name = rest[place] if place is not None and len(rest) > place and rest[place] else rest[0] if kind == "index" and rest else f"{label}_{prop}"
            found.append((name, label, prop, rest, R.of_label(g, label, prop).count()))
    return found


@procedure("property_index_stats", "", "name, entity, label, properties, kind, indexed_rows, drifted_rows, answers_probes")
def property_index_stats(g: PropertyGraph) -> DataFrame:
    """Rows of another type than the property's cannot be: drifted_rows is 0."""
    found = [(name, "node", label, prop, "range", n, 0, True) for name, label, prop, _, n in entries(g, "index")]
    return rows(g, found, "name string, entity string, label string, properties string, kind string, indexed_rows long, drifted_rows long, answers_probes boolean")


@procedure("vector_index_stats", "", "name, label, property, kind, dimension, indexed_rows")
def vector_index_stats(g: PropertyGraph) -> DataFrame:
    """What other engines say of their layout's bytes and links is not there: vectors lie in the node table."""
    found = [(name, label, prop, "exact", int(rest[0]) if rest and rest[0] is not None else None, n) for name, label, prop, rest, n in entries(g, "vector_index")]
    return rows(g, found, "name string, label string, property string, kind string, dimension long, indexed_rows long")


@procedure("text_index_stats", "", "name, label, property, indexed_rows, documents, distinct_terms, postings, total_document_len")
def text_index_stats(g: PropertyGraph) -> DataFrame:
    found = []
    for name, label, prop, _, n in entries(g, "text_index"):
        words = R.of_label(g, label, prop).select("id", R.tokens(F.col("value").cast("string")).alias("words"))
        size = words.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("total")).first()
        terms = words.select("id", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        count = terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
        found.append((name, label, prop, n, size.documents, count.terms, count.postings, size.total))
    return rows(g, found, "name string, label string, property string, indexed_rows long, documents long, distinct_terms long, postings long, total_document_len long")


def rebuilt(g: PropertyGraph, most: int | None = None) -> DataFrame:
    """Exact searches read the node table, so a rebuilt index holds what it held."""
    found = [(name, label, prop, "exact", int(rest[0]) if rest and rest[0] is not None else None, n, n) for name, label, prop, rest, n in entries(g, "vector_index")][:most]
    return rows(g, found, "name string, label string, property string, kind string, dimension long, before_indexed_rows long, after_indexed_rows long")


REBUILT = "name, label, property, kind, dimension, before_indexed_rows, after_indexed_rows"
procedure("rebuild_vector_indexes", "max_indexes?", REBUILT, True)(rebuilt)
procedure("rebuild_recommended_vector_indexes", "max_indexes?", REBUILT, True)(rebuilt)

ROOM = ("allocated_nodes", "live_nodes", "reclaimable_nodes", "allocated_edges", "live_edges", "reclaimable_edges", "allocated_rows", "live_rows", "reclaimable_rows", "reclaimable_row_basis_points")


def room(g: PropertyGraph) -> list:
    """Tables hold live rows alone, as a change writes what stays."""
    nodes, edges = sum(t.df.count() for t in g.nodes), sum(t.df.count() for t in g.edges)
    return [nodes, nodes, 0, edges, edges, 0, nodes + edges, nodes + edges, 0, 0, False, True]


def room_columns(prefix: str = "") -> str:
    return ", ".join([f"{prefix}{c} long" for c in ROOM] + [f"{prefix}compaction_recommended boolean", f"{prefix}dense boolean"])


@procedure("compaction_stats", "", ", ".join((*ROOM, "compaction_recommended", "dense")))
def compaction_stats(g: PropertyGraph) -> DataFrame:
    return rows(g, [tuple(room(g))], room_columns())


@procedure("compact", "", "before_*, reclaimed_nodes, reclaimed_edges, after_*", True)
def compact(g: PropertyGraph) -> DataFrame:
    """There is nothing to reclaim."""
    now = room(g)
    return rows(g, [(*now, 0, 0, *now)], f"{room_columns('before_')}, reclaimed_nodes long, reclaimed_edges long, {room_columns('after_')}")


# vectors


def search(g: PropertyGraph, label: str, prop: str, *filters: Any) -> DataFrame:
    df = R.of_label(g, label, prop)
    return R.filtered(g, df, *filters) if filters else df


procedure("vector_search_nodes", "label, property, query, k, metric?", "node_id, distance")(lambda g, label, prop, q, k, m=None: R.nearest(search(g, label, prop), q, k, m))
procedure("vector_search_nodes_batch", "label, property, queries, k, metric?", "query_index, node_id, distance")(lambda g, label, prop, qs, k, m=None: R.nearest_batch(g, search(g, label, prop), qs, k, m))
procedure("vector_search_nodes_ann", "label, property, query, k, metric?, ef?, filters?", "node_id, distance")(lambda g, label, prop, q, k, m=None, ef=None, *f: R.nearest(search(g, label, prop, *f), q, k, m))
procedure("vector_search_nodes_ann_batch", "label, property, queries, k, metric?, ef?, filters?", "query_index, node_id, distance")(lambda g, label, prop, qs, k, m=None, ef=None, *f: R.nearest_batch(g, search(g, label, prop, *f), qs, k, m))


@procedure("vector_search_expanded_candidates_ann", "label, property, query, root_k, edge_label, k, direction, metric?, ef?", "node_id, distance")
def expanded(g: PropertyGraph, label: str, prop: str, q: list, root_k: int, edge: str, k: int, direction: str, m: str | None = None, ef: int | None = None) -> DataFrame:
    """The nearest are roots; they and their neighbours are ranked."""
    roots = R.nearest(search(g, label, prop), q, root_k, m).select(F.col("node_id").alias("id"))
    both = roots.union(R.neighbours(g, roots, edge, direction))
    return R.nearest(R.among(R.of_label(g, None, prop), both), q, k, m)


@procedure("vector_search_expanded_candidates_ann_batch", "label, property, queries, root_k, edge_label, k, direction, metric?, ef?", "query_index, node_id, distance")
def expanded_batch(g: PropertyGraph, label: str, prop: str, qs: list, root_k: int, edge: str, k: int, direction: str, m: str | None = None, ef: int | None = None) -> DataFrame:
    roots = R.nearest_batch(g, search(g, label, prop), qs, root_k, m).select("query_index", F.col("node_id").alias("id"))
    both = roots.union(R.neighbours(g, roots, edge, direction, ["query_index"])).distinct()
    return R.nearest_batch(g, R.of_label(g, None, prop), qs, k, m, both)


@procedure("vector_search_candidate_state_expanded_ann", "label, property, query, root_k, edge_label, state_name, k, op?, direction?, metric?, ef?", "node_id, distance")
def state_expanded_ann(g: PropertyGraph, label: str, prop: str, q: list, root_k: int, edge: str, state: str, k: int, op: str | None = None, direction: str | None = None, m: str | None = None, ef: int | None = None) -> DataFrame:
    roots = R.nearest(search(g, label, prop), q, root_k, m).select(F.col("node_id").alias("id"))
    both = roots.union(R.neighbours(g, roots, edge, direction))
    return R.nearest(R.among(R.of_label(g, None, prop), R.combined(R.state(g, state), both, op)), q, k, m)


def each(name: str, signature: str, candidates: Callable) -> None:
    """A score over candidates, for one query and for a batch."""
    procedure(name, f"property, query, {signature}", "node_id, distance")(lambda g, prop, q, *a: R.nearest(R.among(R.of_label(g, None, prop), candidates(g, *a)[0]), q, *candidates(g, *a)[1:]))
    if not name.endswith("_nodes") or name == "vector_score_nodes":
        procedure(f"{name}_batch", f"property, queries, {signature}", "query_index, node_id, distance")(lambda g, prop, qs, *a: R.nearest_batch(g, R.among(R.of_label(g, None, prop), candidates(g, *a)[0]), qs, *candidates(g, *a)[1:]))


each("vector_score_nodes", "nodes, k, metric?", lambda g, nodes, k, m=None: (R.ids(g, nodes), k, m))
each("vector_score_neighbors", "anchor, edge_label, k, direction?, metric?", lambda g, anchor, edge, k, d=None, m=None: (R.neighbours(g, R.ids(g, [anchor]), edge, d), k, m))
each("vector_score_expanded_candidates", "roots, edge_label, k, direction?, metric?", lambda g, roots, edge, k, d=None, m=None: (R.ids(g, roots).union(R.neighbours(g, R.ids(g, roots), edge, d)), k, m))
each("vector_score_candidate_state", "state, k, metric?", lambda g, s, k, m=None: (R.state(g, s), k, m))
each("vector_score_candidate_state_nodes", "state, nodes, k, op?, metric?", lambda g, s, nodes, k, op=None, m=None: (R.combined(R.state(g, s), R.ids(g, nodes), op), k, m))
each("vector_score_candidate_state_expanded", "state, roots, edge_label, k, op?, direction?, metric?", lambda g, s, roots, edge, k, op=None, d=None, m=None: (R.combined(R.state(g, s), R.ids(g, roots).union(R.neighbours(g, R.ids(g, roots), edge, d)), op), k, m))
del ALL["vector_score_candidate_state_batch"]  # not part of the contract


SIDES = ("require_outgoing", "require_incoming", "exclude_outgoing", "exclude_incoming")


@procedure("vector_candidate_states", "", ", ".join(("state_name", "generation", "candidate_count", "required_label", *SIDES)))
def candidate_states(g: PropertyGraph) -> DataFrame:
    """A state is a function of the graph, never out of date; its generation is 0."""
    found = [(n, 0, R.state(g, n).count(), s.get("label"), *(list(s.get(side, [])) for side in SIDES)) for n, s in sorted(registry_of(g, "states").items())]
    return rows(g, found, "state_name string, generation long, candidate_count long, required_label string, " + ", ".join(f"{side} array<string>" for side in SIDES))


procedure("reachable_nodes", "roots, edge_label, k, max_depth?, direction?", "node_id, depth")(R.reachable)


# JSON


def json_procedures() -> None:
    found = {
        "json_contains": ("candidate", lambda g, label, prop, c: (R.json_contains(g, label, prop, c), ())),
        "json_path_exists": ("path", lambda g, label, prop, p: (R.json_value(g, label, prop, p).filter("json is not null"), ())),
        "json_path_contains": ("path, candidate", lambda g, label, prop, p, c: (R.json_value(g, label, prop, p).filter("json is not null").filter(R.json_docs.contains_udf("json", F.lit(c))), ())),
        "json_path_value": ("path", lambda g, label, prop, p: (R.json_value(g, label, prop, p).filter("json is not null").withColumnRenamed("json", "value"), ("value",))),
    }
    for name, (extra, f) in found.items():
        n = len(extra.split(", "))

        def plain(g: PropertyGraph, label: str, prop: str, *args: Any, f: Callable = f, n: int = n) -> DataFrame:
            df, more = f(g, label, prop, *args[:n])
            return R.first_ids(df, args[n], *more)

        def of_candidates(g: PropertyGraph, label: str, prop: str, *args: Any, f: Callable = f, n: int = n) -> DataFrame:
            df, more = f(g, label, prop, *args[:n])
            return R.first_ids(R.among(df, R.ids(g, args[n])), args[n + 1], *more)

        procedure(f"{name}_nodes", f"label, property, {extra}, k", "node_id" + ", value" * (name == "json_path_value"))(plain)
        procedure(f"{name}_candidate_nodes", f"label, property, {extra}, nodes, k", "node_id" + ", value" * (name == "json_path_value"))(of_candidates)


json_procedures()


# text


@procedure("text_search_nodes", "label, property, query, k, filters?", "node_id, score")
def text_search(g: PropertyGraph, label: str, prop: str, q: str, k: int, *filters: Any) -> DataFrame:
    df = R.bm25(g, label, prop, [q])
    return R.best_texts(R.filtered(g, df, *filters) if filters else df, k, False)


procedure("text_score_nodes", "label, property, query, nodes, k", "node_id, score")(lambda g, label, prop, q, nodes, k: R.best_texts(R.among(R.bm25(g, label, prop, [q]), R.ids(g, nodes)), k, False))
procedure("text_score_nodes_batch", "label, property, queries, nodes, k", "query_index, node_id, score")(lambda g, label, prop, qs, nodes, k: R.best_texts(R.among(R.bm25(g, label, prop, qs), R.ids(g, nodes)), k, True))
procedure("text_score_candidate_state", "label, property, query, state, k", "node_id, score")(lambda g, label, prop, q, s, k: R.best_texts(R.among(R.bm25(g, label, prop, [q]), R.state(g, s)), k, False))
procedure("text_score_candidate_state_nodes", "label, property, query, state, nodes, k, op?", "node_id, score")(lambda g, label, prop, q, s, nodes, k, op=None: R.best_texts(R.among(R.bm25(g, label, prop, [q]), R.combined(R.state(g, s), R.ids(g, nodes), op)), k, False))


@procedure("text_score_candidate_state_expanded_batch", "label, property, queries, state, roots, edge_label, k, op?, direction?", "query_index, node_id, score")
def text_expanded(g: PropertyGraph, label: str, prop: str, qs: list, s: str, roots: list, edge: str, k: int, op: str | None = None, d: str | None = None) -> DataFrame:
    around = R.ids(g, roots).union(R.neighbours(g, R.ids(g, roots), edge, d))
    return R.best_texts(R.among(R.bm25(g, label, prop, qs), R.combined(R.state(g, s), around, op)), k, True)


procedure("reciprocal_rank_fusion", "rankings, k, rank_constant?, weights?", "node_id, score")(R.reciprocal_rank_fusion)
