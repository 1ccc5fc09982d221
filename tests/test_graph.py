"""Hand-computed fixtures and metamorphic checks of the graph operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions.scale import min_max, z_score
from claimloom.operators import evaluate as E
from claimloom.operators import features as T
from claimloom.operators import graph as G
from claimloom.operators import ranking as R
from claimloom.plans.claims import with_evidence

CLAIM = "paper_id string, year int, src string, dst string, weight double, is_causal boolean, stability double"


def claims_of(spark, rows):
    return spark.createDataFrame([(f"p{i}", y, a, b, w, c, s) for i, (y, a, b, w, c, s) in enumerate(rows)], CLAIM)


def small(spark):
    return claims_of(spark, [(2020, "A", "B", 1.0, True, 0.9), (2020, "B", "C", 1.0, False, 0.4), (2020, "B", "D", 1.0, True, 0.8)])


def test_score_formula(spark):
    pairs = spark.createDataFrame([("A", "C", 1, 2019, 2020, 0.5), ("B", "D", 2, 2019, 2020, 0.2)], "u string, v string, cooc_count long, first_year_seen int, last_year_seen int, gap_bonus double")
    paths = spark.createDataFrame([("A", "C", 2.0, 1, 0.1), ("B", "D", 0.0, 0, 0.0)], "u string, v string, path_support_raw double, mediator_count long, hub_penalty double")
    motifs = spark.createDataFrame([("A", "C", 2, 1.0), ("B", "D", 0, 0.0)], "u string, v string, motif_count long, motif_bonus_raw double")
    got = {(r["u"], r["v"]): r for r in R.candidate_scores(pairs, paths, motifs).collect()}
    assert got["A", "C"]["score"] == pytest.approx(0.7) and got["A", "C"]["hub_penalty"] == 1.0
    assert set(got) == {("A", "C"), ("C", "A"), ("B", "D"), ("D", "B")}


def test_evidence_filter(spark):
    two = lambda c: {(r["u"], r["v"]) for r in T.path_features(c).collect()}
    assert two(small(spark)) == {("A", "C"), ("A", "D")}
    assert two(with_evidence(small(spark), causal_only=True)) == {("A", "D")}
    assert with_evidence(small(spark), min_stability=0.85).count() == 1


def test_path_support_value(spark):
    p = {(r["u"], r["v"]): r for r in T.path_features(small(spark)).collect()}
    disc = 1 / (1 + math.log(4))
    assert p["A", "C"]["path_support_raw"] == pytest.approx(disc) and p["A", "C"]["hub_penalty"] == pytest.approx(1 - disc) and p["A", "C"]["mediator_count"] == 1


def test_three_hops_add_support_without_mediators(spark):
    c = claims_of(spark, [(2000, "A", "B", 1.0, True, 1.0), (2000, "B", "C", 1.0, True, 1.0), (2000, "C", "D", 2.0, True, 1.0)])
    p = {(r["u"], r["v"]): r for r in T.path_features(c, max_len=3).collect()}
    assert p["A", "D"]["mediator_count"] == 0 and p["A", "D"]["path_support_raw"] > 0


def test_empty_and_null_inputs(spark):
    e = spark.createDataFrame([], CLAIM)
    assert T.path_features(e).count() == 0 and T.underexplored_pairs(e).count() == 0 and T.motif_features(e).count() == 0
    assert G.pagerank(T.edge_aggregate(e)).count() == 0 and G.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v"))).count() == 0
    n = claims_of(spark, [(2000, "A", "B", None, None, None), (None, "A", "B", 1.0, True, None)])
    assert T.edge_aggregate(n).first()["n"] == 2 and with_evidence(n, min_stability=0.1).count() == 0


def test_cooccurrence_is_symmetric_and_monotone(spark):
    rng = random.Random(1)
    rows = [(rng.randint(2000, 2005), *rng.sample("ABCDEF", 2), 1.0, True, 1.0) for _ in range(60)]
    c = claims_of(spark, rows).withColumn("paper_id", F.concat(F.lit("q"), F.pmod(F.hash("paper_id"), F.lit(12)).cast("string")))
    flip = c.select("paper_id", "year", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "is_causal", "stability")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(T.underexplored_pairs(c)) == key(T.underexplored_pairs(flip))
    early = {(r["u"], r["v"]): r["cooc_count"] for r in T.underexplored_pairs(c, cutoff=2002).collect()}
    late = {(r["u"], r["v"]): r["cooc_count"] for r in T.underexplored_pairs(c).collect()}
    assert all(late[k] >= n for k, n in early.items())


def greedy(rows, quota, max_rank):
    """Quota re-ranking, one position at a time."""
    b = [r for r in rows if r[3]]
    o = [r for r in rows if not r[3]]
    out, used = [], 0
    while b or o:
        r = len(out) + 1
        need = r <= max_rank and b and used < math.ceil(quota * r)
        if need or not o or (b and (b[0][2], 1) >= (o[0][2], 0)):
            out.append(b.pop(0))
            used += 1
        else:
            out.append(o.pop(0))
    return [(r[0], r[1]) for r in out]


@pytest.mark.parametrize("quota", [0.2, 0.3])
def test_quota_rerank(spark, quota):
    rng = random.Random(5)
    rows = sorted([(f"u{i}", f"v{i}", round(rng.random(), 2), rng.random() < 0.25) for i in range(40)], key=lambda r: (-r[2], -r[3], r[0], r[1]))
    df = spark.createDataFrame(rows, "u string, v string, score double, boundary_flag boolean")
    got = [(r["u"], r["v"]) for r in R.boundary_rerank(df, 0.0, quota, 25).orderBy("rank").collect()]
    assert got == greedy(rows, quota, 25)


def test_novelty_table(spark):
    df = spark.createDataFrame([("A1", "A2", 3), ("A1", "B2", 1), ("A1", "A2", 0), ("A1", "B2", 0)], "u string, v string, cooc_count int")
    assert [r["novelty_type"] for r in R.novelty(df).collect()] == ["gap_internal", "gap_crossfield", "boundary_internal", "boundary_crossfield"]


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "k string, x double")
    assert [r["y"] for r in min_max(df, {"x": "y"}).orderBy("x").collect()] == [None, 0.0, 0.5, 1.0]
    assert {r["k"]: r["y"] for r in min_max(df.where("k = 'b'"), {"x": "y"}, ["k"]).collect()} == {"b": 1.0}
    assert [r["z"] for r in z_score(df.where("k = 'a'"), {"x": "z"}).orderBy("x").collect()] == [-1.0, 1.0]
    assert min_max(df.limit(0), {"x": "y"}).count() == 0


def test_backtest_windows(spark):
    c = claims_of(spark, [(2000, "A", "B", 1.0, True, 0.8), (2000, "B", "C", 1.0, True, 0.7), (2003, "A", "C", 1.0, True, 0.9)])
    ranked = R.top_ranked(T.path_features(c, 2001), 10, "path_support_raw")
    panel = E.realization(ranked, E.first_appearance(c), 2001, 3).collect()
    assert [(r["u"], r["v"], r["realized"], r["time_to_fill"]) for r in panel] == [("A", "C", 1, 2)]
    assert all(r["leaked"] == 0 for r in E.leakage(E.first_appearance(c), c, [2001, 2003], [1, 3]).collect())


def test_equal_deltas_have_no_effect_size(spark):
    df = spark.createDataFrame([("m", 0.02), ("m", 0.1 - 0.08)], "model string, delta double")
    r = E.power(df, ["model"]).first()
    assert r["mean_delta"] == 0.02 and r["effect"] is None and r["needed"] is None


def test_bootstrap_interval(spark):
    df = spark.range(300).select(F.lit("a").alias("g"), "id", (F.col("id") % 10).cast("double").alias("x"))
    a, b = (E.bootstrap_mean(df, ["g"], "x", 100).first() for _ in range(2))
    assert a == b and a["ci_lo"] < a["mean"] < a["ci_hi"] and a["ci_hi"] - a["ci_lo"] < 1.5


def test_pagerank_and_components(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    pr = {r["node"]: r["pagerank"] for r in G.pagerank(e, 40).collect()}
    assert sum(pr.values()) == pytest.approx(1) and pr["c"] > pr["b"] > pr["a"]
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "u string, v string")
    got = {r["node"]: r["component"] for r in G.components(chain).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z2"] == "z1"


def test_attachment_ranks_by_counting(spark):
    rng = random.Random(2)
    e = sorted({(rng.choice("ABCDEFG"), rng.choice("ABCDEFG")) for _ in range(18)} - {(x, x) for x in "ABCDEFG"})
    edges = spark.createDataFrame(e, "src string, dst string")
    out, inn = {}, {}
    for a, b in e:
        out[a], inn[b] = out.get(a, 0) + 1, inn.get(b, 0) + 1
    missing = {(u, v): out[u] * inn[v] for u in out for v in inn if u != v and (u, v) not in e}
    pos = spark.createDataFrame(list(missing), "u string, v string")
    for r in E.attachment_ranks(edges, pos).collect():
        p = missing[r["u"], r["v"]]
        assert r["p"] == p and r["above"] == sum(x > p for x in missing.values()) and r["free"] == sum(x == p for x in missing.values())
