import random

import numpy as np

from claimloom.llm.grid_components import components, local_roots, match_groups


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def run(spark, edges, **kw):
    df = spark.createDataFrame(edges, "u string, v string")
    return {r["vertex"]: r["root"] for r in components(df, **kw).collect()}


def test_local_union_find():
    v, r = local_roots(np.array(["c", "e"], dtype=object), np.array(["b", "d"], dtype=object))
    assert dict(zip(v, r, strict=True)) == {"b": "b", "c": "b", "d": "d", "e": "d"}


def test_random_graph_chain_and_hub_on_a_fine_grid(spark):
    rng = random.Random(4)
    edges = [(f"r{rng.randint(0, 150)}", f"r{rng.randint(0, 150)}") for _ in range(90)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    edges += [("hub", f"h{i}") for i in range(60)] + [("hub", "h1")] * 3 + [("x", "x"), (None, "y"), ("z", None)]
    assert run(spark, edges, cell_edges=20) == brute(edges)
    assert run(spark, edges) == brute(edges)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a")]) == {}


def test_runs_and_decisions(spark):
    c = spark.createDataFrame([("b", "H1", "accepted_auto", "r1", 1), ("b", "H1", "rejected", "r1", 2), ("c", "H1", "accepted", "r2", 3), ("d", "H9", "rejected", "r1", 4), (None, "H1", "accepted", "r1", 5), ("e", "", "accepted", "r1", 6), ("n", "H1", "accepted", None, 7), ("q", "H1", None, "r1", 8)], "normalized_label string, candidate_concept_id string, decision_status string, run_id string, u int")
    o = spark.createDataFrame([("merge_pair", "b", "a", "r1"), ("merge_pair", "a", "b", "r1"), ("merge_pair", "a", "a", "r1"), ("block_pair", "a", "z", "r1")], "override_kind string, left_normalized_label string, right_normalized_label string, run_id string")
    got = {tuple(r) for r in match_groups(c, o).collect()}
    assert got == {("r1", "H1", "H1"), ("r1", "a", "H1"), ("r1", "b", "H1"), ("r2", "H1", "H1"), ("r2", "c", "H1"), (None, "H1", "H1"), (None, "n", "H1")}
