import random

import pytest

from claimloom.llm.canonical import Dictionary, allowed, deletions, distance, map_labels, unresolved_labels

ENTRIES = [("H1", "rural market entry", ["RME", "entry of rural market"], 50), ("H2", "regional market entry", [], 10), ("H3", "rural labor turnover", ["RLT"], 5), ("H4", "pension savings behavior", [], 5), ("H5", None, [], None), ("H6", "", ["x"], 1)]


@pytest.fixture(scope="module")
def index():
    return Dictionary(ENTRIES)


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("Rural Market Entry", "H1"), ("rurla markte entry", "H1"), ("entry in rural market", "H1"), ("market entry, rural", "H1"), ("ruralmarketentry", "H1"), ("rural-market-entry", "H1"), ("level of rural market entrys", "H1"), ("r m e", "H1"), ("R.M.E.", "H1"),
        ("rural market entry (rme)", "H1"), ("(ENTRY (RME) | RURAL MARKET)", "H1"), ("regio market entry", "H2"), ("rural labour turnover", "H3"), ("pension saving behaviour", "H4"), ("ｒｕｒａｌ market entry", "H1"),
        ("rural market entry shock", None), ("pension market entry", None), ("rural savings behavior", None), ("moss colour chart", None), ("", None), (None, None), ("...", None), ("the of", None), ("m" * 20_000, None),
    ],
)
def test_labels(index, label, want):
    got = index.match(label)
    assert (got and got[2]) == want


def reference(a, b):
    """Restricted Damerau-Levenshtein distance."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_and_complete_lookup():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randint(3, 10))) for _ in range(120)]
    for _ in range(400):
        a, b = rng.choice(words), rng.choice(words)
        n, got = reference(a, b), distance(a, b, 2)
        assert (got is None) == (n > 2) and (got is None or got[0] == n)
    for b in words[:60]:  # every word within the bound shares a deletion
        for a in words:
            if reference(a, b) <= allowed(b):
                assert deletions(a, 2) & deletions(b, allowed(b))


def test_tables_and_blocks(spark):
    m = spark.createDataFrame([("c", "n1", "rurla market entry", None, 1), ("c", "n1", "rurla market entry", "", 1), ("c", "n2", None, "", 1), ("c", "n3", None, None, 1), ("c", "n4", "x", "H9", 1)], "custom_id string, node_id string, normalized_label string, concept_id string, label int")
    n = spark.createDataFrame([("c", "n2", "RLT", True), ("c", "n2", None, True)], "custom_id string, node_id string, label string, is_deleted boolean")
    h = spark.createDataFrame([(a, b, "{broken" if a == "H4" else str(c).replace("'", '"'), d) for a, b, c, d in ENTRIES] + [(None, "rural market entry", None, 9)], "concept_id string, preferred_label string, aliases_json string, instance_support long")
    labels = unresolved_labels(m, n)
    want = {("n1", "H1"), ("n2", "H3"), ("n3", "unmatched")}
    for block in (100_000, 2):
        assert {(r["node_id"], r["concept_id"]) for r in map_labels(labels, h, block).collect()} == want
    assert map_labels(labels.limit(0), h).count() == 0
    assert {r["concept_id"] for r in map_labels(labels, h.limit(0)).collect()} == {"unmatched"}


def test_blocks_by_bytes_and_labels_without_length_limits(spark):
    long_word = "inter" * 8 + "linkage"
    heads = spark.createDataFrame([("a", "credit rationing", '["lending squeeze"]', 5), ("b", "one two three four five six", "[]", 3), ("c", "wage", '["salary", "GDP"]', 2), ("d", f"{long_word} index", "[]", 1)], "concept_id string, preferred_label string, aliases_json string, instance_support long")
    labels = [("sixfivefourthreetwoone",), ("salery",), ("GDQ",), (f"index{long_word}",), ("credit rationing (abbreviated-form)",), ("lendin squeeze",), (None,)]
    df = spark.createDataFrame(labels, "label string")
    want = {"sixfivefourthreetwoone": "b", "salery": "c", "GDQ": "unmatched", f"index{long_word}": "d", "credit rationing (abbreviated-form)": "a", "lendin squeeze": "a", None: "unmatched"}
    for options in ({}, {"block_bytes": 1}, {"block_entries": 2}):
        assert {r["label"]: r["concept_id"] for r in map_labels(df, heads, **options).collect()} == want
