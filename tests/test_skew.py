from pyspark.sql import functions as F

from claimloom.plans.skew import hot_keys, salted_join, topn_per_key


def test_salted_join_equals_plain_join(spark):
    left = spark.range(66_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, v int")
    assert hot_keys(left, "k") == ["hot"]
    for how in ("left", "inner"):
        a = salted_join(left, right, "k", how).groupBy("k", "v").count()
        b = left.join(right, "k", how).groupBy("k", "v").count()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_topn_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), (None, 5, "q")], "k string, s int, n string")
    got = sorted(map(tuple, topn_per_key(df, ["k"], [F.desc("s"), F.asc("n")], 1).select("k", "n").collect()), key=str)
    assert got == [("a", "x"), (None, "q")]
    assert topn_per_key(df.limit(0), ["k"], [F.desc("s")], 1).count() == 0
