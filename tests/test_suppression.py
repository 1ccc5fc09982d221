"""Hard same-family rules and the soft duplicate score."""

import pytest

from claimloom.operators import ontology as O

HEADS = [
    ("c1", "Trade Openness", None), ("c2", "trade openness", "[]"), ("c3", "openness to commerce", '["trade openness"]'), ("c4", "gross domestic product (GDP)", None), ("c5", "gross domestic product", None),
    ("c6", "wages", None), ("c7", "wage", None), ("c8", "bank rate", None), ("c9", "river depth", None), ("d1", "spot price", '["price x"]'), ("d2", "futures price", '["price x"]'), ("d3", "tax rate", None),
]
WANT = {
    ("c1", "c2"): "exact_normalized_label", ("c1", "c3"): "alias_normalized_overlap", ("c4", "c5"): "no_paren_signature_overlap", ("c6", "c7"): "formatting_or_singular_variant", ("c8", "c9"): "manual_same_concept_review",
    ("d1", "d2"): "", ("c8", "d3"): "", ("c6", "c9"): "",
}


def test_true_duplicates_are_blocked_and_the_rest_scored(spark):
    heads = spark.createDataFrame(HEADS, "concept_id string, preferred_label string, aliases_json string")
    near = spark.createDataFrame([], "id string, neighbors array<string>")
    ctx = spark.createDataFrame([("c6", "X"), ("c7", "X")], "id string, value string")
    reviewed = spark.createDataFrame([("bank rate", "river depth", True), ("bank rate", "tax rate", True), ("bank rate", "tax rate", False)], "a string, b string, same boolean")
    pairs = spark.createDataFrame(list(WANT), "u string, v string")
    got = {(r["u"], r["v"]): r for r in O.family_scores(pairs, O.concept_profiles(heads, near, ctx, ctx), reviewed).collect()}
    assert {k: r["reason"] for k, r in got.items()} == WANT
    assert got["c1", "c2"]["duplicate_score"] == pytest.approx(0.22 + 0.15 + 0.10 + 0.03 + 0.15)
    assert got["c6", "c9"]["contradiction"] and not got["c8", "d3"]["contradiction"] and got["d1", "d2"]["protected"]
    assert got["c6", "c7"]["context_overlap"] == 1.0 and got["d1", "d2"]["alias_overlap"] == 1.0
    ranked = spark.createDataFrame([(u, v, 1.0) for u, v in WANT], "u string, v string, score double")
    assert {(r["u"], r["v"]) for r in O.family_ranking(ranked, O.family_scores(pairs, O.concept_profiles(heads, near, ctx, ctx), reviewed)).collect()} == {k for k, r in WANT.items() if not r}


def test_top_of_a_similarity_matrix_breaks_ties_by_id():
    import numpy as np

    rng = np.random.default_rng(3)
    sims, ids = rng.integers(0, 4, (30, 50)) / 4, rng.permutation(50)
    got = O._top(sims, ids, 5)
    for row, cols in zip(sims, got, strict=True):
        assert sorted(ids[cols]) == sorted(ids[i] for i in sorted(range(50), key=lambda i: (-row[i], ids[i]))[:5])
