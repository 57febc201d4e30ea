"""Store semantics and streams on small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import graph
from tracelode.streaming import detection


def test_latest_and_replaced(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted((r["k"], r["v"]) for r in graph.latest(log, ["k"], [F.col("seq")]).collect()) == [("a", "y"), ("b", "z")]
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, t int")
    new = spark.createDataFrame([("a", 9), ("a", 9)], "s string, t int")
    assert sorted(tuple(r) for r in graph.replaced(old, new, ["s"]).collect()) == [("a", 9), ("b", 3)]


def test_stream_fires_once_in_any_order(spark):
    rows = [("p", "TICKET_ERROR", 1, 7), ("p", "ISSUE_ERROR", 5, 7), ("p", "ISSUE_FIX", 5, 3), ("p", "TICKET_ERROR", 2, 8), ("p", "TICKET_ERROR", 1, 7), ("q", "TICKET_ERROR", 1, 7)]
    for order in (rows, rows[::-1]):
        edges = spark.createDataFrame(order, "project string, etype string, a long, b long")
        got = detection.replay(spark, edges, detection.actionable, ["project", "ticket_id"], files=4).collect()
        assert [tuple(r) for r in got] == [("p", 1)]


def test_empty_stream(spark):
    edges = spark.createDataFrame([], "project string, etype string, a long, b long")
    assert detection.replay(spark, edges, detection.actionable, ["project", "ticket_id"]).count() == 0


def test_packet_has_all_types(spark, sf_dir):
    from tracelode.operators import evidence
    from tracelode.plans import catalogue

    rows = catalogue.queries()["debug_packet"](spark, sf_dir).select("project", "ticket_id", "kind", "rank", "evidence").collect()
    assert {e.split(":")[0] for r in rows for e in r["evidence"].split(",")} == {*evidence.WORTH, "doc_penalty"}
    assert max(r["rank"] for r in rows) <= 20 and len({tuple(r)[:4] for r in rows}) == len(rows)


def test_shared_folder_is_asked_for():
    import pytest

    from tracelode.sources import work

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        work.folder(Session())
