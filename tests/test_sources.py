"""Stores, lazy tables and refreshes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.session import Session
from skein.sources import store
from skein.sources.graph import PropertyGraph
from skein.sources.tables import orders_graph
from skein.streaming.changes import follow, refreshed


def small(spark) -> PropertyGraph:
    return PropertyGraph.of_rows(spark, [{"id": 1, "labels": ["A", "B"], "x": 1}, {"id": 2, "labels": ["A"], "x": None}], [{"id": 9, "label": "E", "src": 1, "dst": 2, "directed": False, "w": 1.5}])


def test_round_trip_on_disk(spark, tmp_path):
    store.save(small(spark), f"file://{tmp_path}/g")
    s = Session.over(store.load(spark, f"file://{tmp_path}/g"))
    assert [tuple(r) for r in s.execute("MATCH (a:B)~[e:E]~(b) RETURN a.x AS x, e.w AS w, LABELS(b) AS l").collect()] == [(1, 1.5, ["A"])]


def test_tables_are_read_when_picked(spark):
    g = orders_graph(spark, "/nowhere")  # nothing is there, and nothing is read
    assert len(g.nodes) == 10 and len(g.edges) == 10
    assert [t.label for t in g.edge_tables(("label", "PLACED"))] == ["PLACED"]


def test_each_node_comes_once(spark):
    s = Session.over(small(spark))
    assert s.execute("MATCH (n:A|B) RETURN COUNT(*) AS n").collect()[0].n == 2


def test_refresh_and_stream(spark, tmp_path):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    touched = spark.createDataFrame([(2,), (3,), (None,), (2,)], "id long")
    new = refreshed(old, touched, lambda keys: keys.filter("id < 3").withColumn("v", F.lit("new")))
    assert sorted(map(tuple, new.collect())) == [(1, "old"), (2, "new")]
    touched.write.parquet(f"{tmp_path}/log")
    seen = []
    log = spark.readStream.schema("id long").parquet(f"{tmp_path}/log")
    run = follow(log, lambda batch, epoch: seen.extend(r.id for r in batch.collect()), f"{tmp_path}/checkpoint")
    run.processAllAvailable()
    run.stop()
    assert sorted(seen, key=str) == [2, 3, None]


def test_only_a_local_driver_makes_a_folder_of_its_own():
    from skein.sources.durable import own_folder

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            own_folder(master, "app")
    assert own_folder("local[2]", "app") == own_folder("local[2]", "app")
