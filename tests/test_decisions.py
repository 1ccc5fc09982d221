"""Clusters under constraints, label maps, searches and queues."""

import random

from claimloom.operators import decisions as D


def test_constrained_clusters(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("p", "p"), (None, "z")], "u string, v string")
    blocked = spark.createDataFrame([("c", "b")], "u string, v string")
    isolated = spark.createDataFrame([("x",), (None,)], "label string")
    merged = spark.createDataFrame([("q", "r"), ("r", "q")], "u string, v string")
    got = {r["node"]: r["component"] for r in D.constrained_clusters(links, blocked, isolated, merged).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "p": "p", "q": "p", "r": "p"}
    e = links.limit(0)
    assert D.constrained_clusters(e, e, isolated, e).count() == 0


def test_clusters_of_a_long_chain_in_any_order_settle(spark):
    names = [f"n{i:04d}" for i in range(1000)]
    random.Random(1).shuffle(names)
    merged = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "u string, v string")
    e = merged.limit(0)
    got = D.constrained_clusters(e, e, e.select(e.u.alias("label")), merged)
    assert [tuple(r) for r in got.groupBy("component").count().collect()] == [("n0000", 1000)]


def test_label_map_priority(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "normalized_label string")
    m = lambda rows: spark.createDataFrame(rows, "normalized_label string, concept_id string")
    got = {r["normalized_label"]: (r["concept_id"], r["origin"]) for r in D.label_map(labels, [("one", m([("a", "H2"), ("a", "H1"), ("b", "")])), ("two", m([("a", "H9"), ("b", "H3")]))]).collect()}
    assert got == {"a": ("H1", "one"), "b": ("H3", "two"), "c": (None, "pending"), None: (None, "pending")}


def test_queue_keeps_the_first(spark):
    q = lambda rows: spark.createDataFrame(rows, "u string, v string, score double")
    got = {(r["u"], r["queue"]) for r in D.review_queue([("one", q([("a", "b", 1.0), ("c", "d", 0.5), ("e", "f", 0.1)])), ("two", q([("a", "b", 9.0), ("g", "h", 8.0)]))], 2).collect()}
    assert got == {("a", "one"), ("c", "one"), ("g", "two")}


def test_direct_to_path(spark):
    c = spark.createDataFrame([(2000, "a", "c"), (2001, "a", "b"), (2003, "b", "c"), (2000, "x", "y")], "year int, src string, dst string")
    got = {(r["u"], r["v"]): r["first_path_year"] for r in D.direct_to_path(c, 2001, 3).collect()}
    assert got == {("a", "c"): 2003, ("a", "b"): None, ("x", "y"): None}


def test_oriented_pairs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "a"), ("b", "a"), ("c", "d")], "src string, dst string")
    got = {(r["source"], r["target"], r["forward"], r["reverse"], r["arrow"]) for r in D.oriented_pairs(e).collect()}
    assert got == {("b", "a", 3, 1, "mostly_one_way"), ("c", "d", 1, 0, "one_way")}


def test_fingerprints_count_redeliveries_once(spark):
    cols = "custom_id string, node_id string, label string, countries_json string, end_year_json string, start_year_json string, unit_of_analysis_json string, context_note string"
    n = spark.createDataFrame([("c", "n1", "x", "[]", None, None, None, "NA")] * 2 + [("c", "n2", "y", "[]", None, None, None, "NA"), ("c", "n3", None, "[]", None, None, None, "NA")], cols)
    assert [r["instances"] for r in D.context_fingerprints(n).collect()] == [2]
    assert D.node_strings(n).count() == 2
