"""Frames, labels and selections against direct evaluation; panel queries against their SQL."""

import random
from difflib import SequenceMatcher

import pytest
from parity import differences, duck
from pyspark.sql import functions as F

from claimloom import queries_panels as Q
from claimloom.operators import panels as P

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["concept_paper_edges", "concept_edge_stats", "concept_node_frames", "label_concept_support", "family_rollup", "document_sizes", "enriched_papers", "paper_labels", "profile_similarity", "batch_validation"])
def test_queries_equal_their_sql(spark, name):
    assert differences(spark, duck(D), Q.QUERIES[name], Q.ORACLES[name], D) == ""


def test_cluster_support_of_a_long_chain_equals_its_sql(spark, tmp_path):
    names = [f"label {i:03d}" for i in range(600)]
    random.Random(2).shuffle(names)
    tables = {
        "tail_to_head_candidates": ([("label 000", "H1", "accepted_auto"), ("apart", "H2", "accepted_auto"), ("apart", "H1", "rejected")], "normalized_label string, candidate_concept_id string, decision_status string"),
        "manual_overrides": ([("merge_pair", a, b, None) for a, b in zip(names, names[1:], strict=False)], "override_kind string, left_normalized_label string, right_normalized_label string, label string"),
        "head_selection_metrics": ([(x, i, i / 7) for i, x in enumerate([*names, "apart", None])], "normalized_label string, instance_count long, head_rank_score double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert differences(spark, duck(str(tmp_path)), Q.QUERIES["cluster_support"], Q.ORACLES["cluster_support"], str(tmp_path)) == ""


def test_capped_selection_is_greedy_and_fills(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ABCDEF"), rng.choice("GHIJKL"), f"f{rng.randint(0, 5)}", i) for i in range(1, 120)]
    got = P.capped_selection(spark.createDataFrame(rows, "u string, v string, family string, rank int"), 20, 2, 3).orderBy("place").collect()
    fam, end, want = {}, {}, []
    for u, v, f, r in rows:
        if len(want) < 20 and fam.get(f, 0) < 2 and max(end.get(u, 0), end.get(v, 0)) < 3:
            want.append(r)
            fam[f] = fam.get(f, 0) + 1
            end[u], end[v] = end.get(u, 0) + 1, end.get(v, 0) + 1
    rest = [r for *_, r in rows if r not in want][: 20 - len(want)]
    assert [x["rank"] for x in got] == want + rest and [x["filled"] for x in got] == [False] * len(want) + [True] * len(rest)
    assert P.capped_selection(spark.createDataFrame([], "u string, v string, family string, rank int"), 20).count() == 0


def test_lexical_decisions(spark):
    pairs = spark.createDataFrame([("wage", "wages", ["singular_signature"]), ("gdp", "gdp (us)", ["no_paren_signature"]), ("a b", "a-b", ["punctuation_signature"]), ("x", "zzz", ["singular_signature"])], "left_label string, right_label string, kinds array<string>")
    ddl = "label string, papers long, neighbors array<string>, countries array<string>, units array<string>, relations map<string,long>, roles map<string,long>, buckets map<string,long>"
    prof = [("wage", 50, ["n"], ["US"], [], {"r": 2}, {}, {}), ("wages", 60, ["m"], ["US"], [], {"r": 1, "s": 1}, {}, {}), ("gdp", 50, [], [], [], {}, {}, {}), ("gdp (us)", 50, [], [], [], {}, {}, {}), ("a b", 1, ["n"], [], [], {"r": 1}, {}, {}), ("a-b", 1, ["n"], [], [], {"r": 3}, {}, {})]
    got = {r["left_label"]: r for r in P.lexical_decisions(pairs, spark.createDataFrame(prof, ddl)).collect()}
    ratio = SequenceMatcher(None, "wage", "wages").ratio()
    assert got["wage"]["combined_score"] == pytest.approx(0.55 * 0.92 + 0.1 * ratio + 0.1 * 2 / 8**0.5 + 0.05, abs=2e-6)
    assert {k: r["decision"] for k, r in got.items()} == {"wage": "needs_llm_review", "gdp": "candidate_only", "a b": "candidate_only", "x": "candidate_only"}


def test_small_functions(spark):
    df = spark.createDataFrame([([" b", "a", "", None, "b", "c"], {"x": 3, "y": 4}, {"x": 3}), ([], None, {"x": 1})], "v array<string>, a map<string,int>, b map<string,int>")
    got = df.select(P.first_distinct(F.col("v"), 2).alias("f"), P.counter_cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0]["f"] == ["b", "a"] and got[0]["c"] == pytest.approx(0.6) and got[1]["f"] == [] and got[1]["c"] == 0
    x = spark.createDataFrame([("effect_present", "result_only", "certain", "explicit_causal"), (None, None, None, None), ("question_only", "background_claim", "unclear", "unclear")], "claim_status string, explicitness string, tentativeness string, causal_presentation string")
    assert [r[0] for r in x.select(P.stability()).collect()] == [1.0, 0.4, 0.0]
    d = P.dominant(spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "NA"), ("l", None)], "k string, v string"), ["k"], "v", "other")
    assert {tuple(r) for r in d.collect()} == {("k", "a"), ("l", "other")}
