"""Interval labels and child rows of nested records."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.operators.shred import children, label_nodes, link, node_tables, shred, unwrap

TREE = st.recursive(st.integers(0, 3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=30)


@given(TREE)
@settings(max_examples=60, deadline=None)
def test_interval_containment_is_ancestry(tree):
    nodes = label_nodes(tree, lambda path, node, place: ("n", "/".join(path), place))
    ivs = [(n[0], n[1]) for n in nodes]
    assert all(a < b for a, b in ivs) and len({x for iv in ivs for x in iv}) == 2 * len(ivs)
    for a in nodes:
        for b in nodes:
            inside = a[0] < b[0] and b[1] < a[1]
            crossing = a[0] < b[0] < a[1] < b[1]
            assert not crossing
            if inside:
                assert b[2] > a[2]
    up = link(nodes, nodes)
    for n, j in zip(nodes, up, strict=True):
        want = [k for k, p in enumerate(nodes) if p[0] < n[0] and n[1] < p[1]]
        assert j == (max(want, key=lambda k: nodes[k][0]) if want else -1)


def kids(source, value, base=None):
    return [x[1:] for x in children(source, value if isinstance(value, str) or value is None else json.dumps(value), base)]


def test_shapes_of_lineage():
    want = [("lineage", -1, 0, "P1"), ("lineage", -1, 1, "P2")]
    for v in (["P1", "P2"], [{"id": "P1", "display_name": "x"}, {"id": "P2"}], {"id": "P1", "parent": {"id": "P2", "parent": None}}, {"lineage": [{"org": {"id": "P1"}}, {"org": {"id": "P2"}}], "depth": 2}, json.dumps(["P1", "P2"])):
        assert kids("lineage", v) == want
    for v in (None, "", " ", "null", "[]", "{}", "{broken", '"[1"'):
        assert kids("lineage", v) == []


def test_shapes_of_topics():
    assert kids("topics", "T1", 2) == [("topic", -1, 2, "T1")]
    assert kids("topics", ["T1", "T2"], 1) == [("topic", -1, 1, "T1"), ("topic", -1, 2, "T2")]
    nested = [{"id": "T1", "subfield": {"id": "S", "field": {"id": "F"}}}, {"id": "T2", "domain": {"id": "D"}}]
    assert kids("topics", nested, 0) == [("topic", -1, 0, "T1"), ("topic", -1, 1, "T2")]


def test_shapes_of_index():
    want = [("token", -1, 0, "a"), ("token", -1, 1, "b"), ("token", -1, 2, "a")]
    for v in ({"a": [0, 2], "b": 1}, [{"token": "a", "positions": [0, 2]}, {"token": "b", "positions": [1]}], {"IndexLength": 3, "InvertedIndex": {"a": [0, 2], "b": [1]}}, json.dumps({"a": [0, 2], "b": [1]})):
        assert sorted(kids("index", v), key=lambda x: x[2]) == want


def test_whole_work():
    work = {"id": "W", "authorships": [{"author": {"id": "A0"}, "institutions": [{"id": "I0", "lineage": ["I9"]}, {"id": "I1"}]}, {"institutions": None, "author": {"id": "A1"}}], "primary_location": {"source": {"id": "S", "host_organization_lineage": ["P"]}}, "topics": None, "abstract_inverted_index": {"x": [0]}}
    got = kids("work", work)
    assert set(got) == {("author", -1, 0, "A0"), ("author", -1, 1, "A1"), ("institution", 0, 0, "I0"), ("institution", 0, 1, "I1"), ("lineage", -1, 0, "P"), ("token", -1, 0, "x")}


def test_deep_nesting_does_not_crash():
    assert unwrap("[" * 200_000) is None
    v = {"id": "P0"}
    for i in range(1, 60):
        v = {"id": f"P{i}", "parent": v}
    assert [k[3] for k in kids("lineage", v)] == [f"P{i}" for i in range(59, -1, -1)]


def test_tables(spark):
    b = spark.createDataFrame([("W1", '["P1"]', 1), ("W1", '["P1"]', 2), (None, None, 3)], "work_id string, source_host_organization_lineage_json string, source int")
    t = spark.createDataFrame([("W1", None, "T1"), ("W1", 3, None)], "work_id string, topic_seq int, topic_id string")
    a = spark.createDataFrame([("W1", "")], "work_id string, abstract_inverted_index_json string")
    r = spark.createDataFrame([(1, None)], "record_id long, payload_json string")
    assert sorted(map(tuple, shred(b, t, a, r).collect())) == [("W1", "lineage", -1, 0, "P1"), ("W1", "topic", -1, 0, "T1")]
    assert node_tables(b, t, a, r).count() == 3
    assert shred(b.limit(0), t.limit(0), a.limit(0), r.limit(0)).count() == 0
