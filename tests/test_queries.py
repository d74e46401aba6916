"""Registered queries against their SQL on the smallest tables, and the import without the optional folder."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from skein import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
SOME = ["match_region_customers", "in_list_3vl", "percentile_disc", "optional_match", "value_subquery", "call_subquery", "otherwise", "path_walk_1_3", "any_shortest", "questioned_edge", "json_get", "text_bm25", "vector_search_l2", "pagerank", "insert_set_delete", "call_per_row", "optional_call", "all_shortest", "scalar_trigonometry", "json_object_keys", "value_first_row", "value_empty", "value_uncorrelated", "temporal_arithmetic", "durations", "times_of_day", "json_documents", "scc_cycles", "triangles", "dijkstra", "typed_graph", "set_map_and_delete_edges", "durable_store", "text_state_nodes", "vector_expanded_ann"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows, names) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


def test_scans_read_what_is_named(spark):
    plan = queries.QUERIES["match_region_customers"](spark, SF)._jdf.queryExecution().toString()
    assert "c_name" not in plan.split("== Physical Plan ==")[1]
    assert "PushedFilters" in plan and "GreaterThan(c_acctbal" in plan


def test_entry_works_without_the_optional_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'wcc' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries() if k[2:3].isdigit()); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.strip() == "fine", out.stderr


@pytest.mark.parametrize("name", sorted(queries.PAIRS))
def test_queries_run_over_whole_tables(name):
    """No comparison with a number keeps some ids only; a start node of a path query and a looked-up row are given by a property map."""
    text, sql = queries.PAIRS[name]
    keys = r"(?:custkey|orderkey|partkey|suppkey|event_id|vec_id|doc_id)"
    assert not re.search(rf"\b\w+\.\w*{keys} *(<|<=|>|>=|%) *\d", text)
    assert not re.search(rf"\w*{keys} *(<|<=|%) *\d", sql)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation), (c:Customer)-[:IN_NATION]->(n) RETURN n.n_name AS name, COUNT(DISTINCT s) AS s, COUNT(*) AS pairs",
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation), (n)<-[:IN_NATION]-(c:Customer WHERE c.c_acctbal > 5000), (n)-[:IN_REGION]->(r:Region {r_regionkey: 1}) WHERE s.s_acctbal > 0 RETURN COUNT(s) AS a, MIN(n.n_name) AS b GROUP BY ()",
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region), (c:Customer)-[:IN_NATION]->(n WHERE n.n_nationkey > 90) RETURN COUNT(*) AS a, COUNT(n) AS b",
    ],
)
def test_chains_that_are_only_counted_join_as_numbers(spark, text, monkeypatch):
    from skein.plans.compiler import Compiler
    from skein.session import Session
    from skein.sources.tables import orders_graph

    got = Session.over(orders_graph(spark, SF)).execute(text)
    assert "#times" in got._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(Compiler, "only_counted", lambda *a: frozenset())
    want = Session.over(orders_graph(spark, SF)).execute(text)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_times_of_day_equal_their_sql_at_whole_seconds(spark, tmp_path):
    """The SQL trims zeros off whole seconds too, and the query does as it says; a cast by itself keeps them."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    stamps = ["2024-01-02 10:20:30", "2024-01-02 10:20:00", "2024-01-02 00:00:00", "2024-01-02 23:59:59.999999", "2024-01-02 12:00:00", "2024-01-02 11:59:59.1", "2024-01-02 10:20:30.000001", "1969-12-31 23:59:50.5", "1960-02-29 01:02:03"]
    values = ", ".join(f"({k}, TIMESTAMP '{x}')" for k, x in enumerate(stamps)) + f", ({len(stamps)}, NULL)"
    con.execute(f"CREATE TABLE events AS SELECT CAST(k AS BIGINT) AS event_id, ts, CAST(1 AS BIGINT) AS user_id, 'view' AS event_type, 0.5::DOUBLE AS value, '{{}}' AS props FROM (VALUES {values}) t(k, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = queries.QUERIES["times_of_day"](spark, str(tmp_path))
    found = con.execute(queries.SQL["times_of_day"])
    names = [d[0] for d in found.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)
    from skein.session import Session
    from skein.sources.tables import orders_graph

    cast = Session.over(orders_graph(spark, str(tmp_path))).execute("MATCH (e:Event) WHERE e.event_id = 0 RETURN CAST(CAST(e.ts AS TIME) AS STRING) AS t")
    assert [tuple(r) for r in cast.collect()] == [("10:20:30",)]
