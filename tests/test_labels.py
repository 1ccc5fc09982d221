from pyspark.sql import functions as F

from claimloom.functions import labels as L
from claimloom.operators import ontology as O
from claimloom.operators import search as S


def sig(spark, x):
    df = spark.createDataFrame([(x,)], "x string")
    return df.select(*[v.alias(k) for k, v in L.signatures(F.col("x")).items()]).first()


def test_signatures(spark):
    assert sig(spark, "Economic Growth")["normalized_label"] == "economic growth"
    assert sig(spark, "carbon—emissions")["normalized_label"] == "carbon-emissions"
    s = sig(spark, "Foreign Direct Investment (FDI)")
    assert (s["no_paren_signature"], s["paren_acronym"], s["initialism_signature"]) == ("foreign direct investment", "fdi", "fdi")
    s = sig(spark, "Eastern Region (China)")
    assert (s["no_paren_signature"], s["paren_acronym"]) == ("eastern region", "")
    assert sig(spark, "Economics")["singular_signature"] == "economics"
    assert sig(spark, "tax policies")["singular_signature"] == "tax policy"
    assert sig(spark, None)["normalized_label"] is None
    assert sig(spark, "")["normalized_label"] == ""


def test_compatibility_folding(spark):
    df = spark.createDataFrame([("ﬁrm ＥＸＩＴ",), ("plain",), (None,)], "x string")
    assert [r[0] for r in df.select(L.normalized(F.col("x"))).collect()] == ["firm exit", "plain", None]


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], "ab", "xaby"), ([], [], "", "")], "a array<string>, b array<string>, s string, t string")
    r = df.select(L.jaccard(F.col("a"), F.col("b")), L.containment(F.col("a"), F.col("b")), L.substring_share(F.col("s"), F.col("t")), L.sequence_ratio("s", "t")).collect()
    assert tuple(r[0])[:3] == (1 / 3, 0.5, 0.5) and tuple(r[1])[:3] == (0.0, 0.0, 0.0)
    c = spark.createDataFrame([(["spot", "price"], ["futures", "price"]), (["spot"], ["spot"])], "a array<string>, b array<string>")
    assert [r[0] for r in c.select(L.contrast(F.col("a"), F.col("b"))).collect()] == [True, False]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in v.select(L.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]


def test_neighbours_in_blocks(spark):
    base = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<float>")
    q = base.where("vec_id % 10 = 0")
    one = sorted(map(tuple, O.vector_neighbors(q, base, 3).collect()))
    many = sorted(map(tuple, O.vector_neighbors(q, base, 3, block=2).collect()))
    assert one == many and len(one) == 12
    assert O.vector_neighbors(q.limit(0), base, 3).count() == 0


def test_title_matches(spark):
    a = spark.createDataFrame([(1, "credit rationing in banks"), (2, "nothing alike"), (3, None)], "id long, title string")
    b = spark.createDataFrame([(7, "bank credit rationing in banks"), (8, "Credit Rationing"), (9, "")], "id long, title string")
    assert [tuple(r) for r in S.title_matches(a, b).collect()] == [(1, 7, 0.8)]


def test_title_matches_of_named_ids(spark):
    a = spark.createDataFrame([("L1", "credit rationing in banks"), ("L2", "nothing alike")], "id string, title string")
    b = spark.createDataFrame([("H9", "credit rationing banks"), ("H10", "in credit rationing banks"), ("H2", "Banks in credit rationing")], "id string, title string")
    assert [tuple(r) for r in S.title_matches(a, b).collect()] == [("L1", "H10", 1.0)]


def test_pools_and_pairs_on_empty(spark):
    e = spark.createDataFrame([], "normalized_label string, preferred_label string, instances long")
    assert O.signature_pairs(e).count() == 0 and O.head_pool(e.select("normalized_label", "instances"), 1, 0.5).count() == 0
