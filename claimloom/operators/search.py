"""Search over concepts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L


def relevance(text, query: str):
    """Exact over prefix over containment, plus the share of the query's words found."""
    q = " ".join(query.lower().split())
    t = F.lower(text)
    words = F.array(*[F.lit(w) for w in q.split()])
    covered = F.size(F.filter(words, lambda w: F.contains(t, w))) / F.size(words)
    return F.when(t == q, 100.0).when(t.startswith(q), 60.0).when(F.contains(t, F.lit(q)), 40.0).otherwise(0.0) + 20.0 * covered


def search_concepts(heads: DataFrame, query: str, k: int = 8) -> DataFrame:
    """The best ``k`` concepts by label or alias; support breaks ties."""
    names = F.array_union(F.array("preferred_label"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")))
    score = F.array_max(F.transform(names, lambda n: relevance(n, query)))
    rows = heads.select("concept_id", "preferred_label", "instance_support", F.round(score, 6).alias("score")).where("score > 0")
    order = [F.desc("score"), F.desc("instance_support"), F.asc("concept_id")]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def title_matches(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """For each left title (id, title) the right title of best word overlap, at least ``least``; found through shared words, not all pairs.

    Equal titles have overlap 1.  The prefix rule keeps it linear: two word sets of overlap s share a word among the rarest n - ceil(s n) + 1 of either.
    """
    def rows(df, c):
        return df.select(F.col("id").alias(c), L.tokens(F.col("title")).alias(f"{c}_t")).where(F.size(f"{c}_t") > 0)

    a, b = rows(left, "a"), rows(right, "b")
    df = a.select(F.explode("a_t").alias("w")).unionByName(b.select(F.explode("b_t").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(x, c):
        e = x.select(c, F.size(f"{c}_t").alias("m"), F.explode(f"{c}_t").alias("w")).join(df, "w")
        r = F.row_number().over(Window.partitionBy(c).orderBy("n", "w"))
        return e.withColumn("r", r).where(F.col("r") <= F.col("m") - F.ceil(least * F.col("m")) + 1).select(c, "w")

    cand = prefixes(a, "a").join(prefixes(b, "b"), "w").select("a", "b").distinct()
    scored = cand.join(a, "a").join(b, "b").select("a", "b", F.round(L.jaccard(F.col("a_t"), F.col("b_t")), 6).alias("overlap")).where(F.col("overlap") >= least)
    best = F.min(F.struct((-F.col("overlap")).alias("less"), "b"))  # ids are of any type: of equal overlaps the first id
    return scored.groupBy("a").agg(best.alias("x")).select(F.col("a").alias("left_id"), F.col("x.b").alias("right_id"), (-F.col("x.less")).alias("overlap"))


def question_filter(df: DataFrame, text: str, columns: list[str], cross_only: bool = False) -> DataFrame:
    """Rows with a case-insensitive substring in any of the columns."""
    keep = F.lit(False)
    for c in columns:
        keep = keep | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    out = df.where(keep)
    return out.where("cross_field") if cross_only else out


def enrichment(ranked: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """Hit rate in the top k over the base rate, and mean and median rank of the hits."""
    grid = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    j = ranked.join(hits.select("u", "v").distinct().withColumn("hit", F.lit(1)), ["u", "v"], "left").select("rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    g = j.crossJoin(F.broadcast(grid))
    inside = F.col("rank") <= F.col("k")
    out = g.groupBy("k").agg(F.count_if(inside & (F.col("hit") == 1)).alias("hits"), F.avg("hit").alias("base"), F.round(F.avg(F.when(F.col("hit") == 1, F.col("rank"))), 6).alias("mean_rank"), F.round(F.median(F.when(F.col("hit") == 1, F.col("rank"))), 6).alias("median_rank"))
    return out.select("k", "hits", F.round(F.try_divide(F.col("hits") / F.col("k"), F.col("base")), 6).alias("enrichment"), "mean_rank", "median_rank")
