"""Why a link is ranked: mediators, papers along its paths, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import topn_per_key


def edge_papers(claims: DataFrame) -> DataFrame:
    """Distinct papers per directed edge."""
    return claims.groupBy("src", "dst", "paper_id").agg(F.max("year").alias("year"))


def supporting_papers(links: DataFrame, mediators: DataFrame, claims: DataFrame, top_k: int = 5) -> DataFrame:
    """The newest papers behind each edge of the mediated paths of the given (bounded) list of links."""
    m = mediators.join(links.select("u", "v"), ["u", "v"], "left_semi")
    steps = m.select("u", "v", "w", F.inline(F.array(F.struct(F.col("u").alias("src"), F.col("w").alias("dst")), F.struct(F.col("w").alias("src"), F.col("v").alias("dst")))))
    wanted = steps.select("src", "dst").distinct()
    newest = topn_per_key(edge_papers(claims.join(wanted, ["src", "dst"], "left_semi")), ["src", "dst"], [F.desc("year"), F.asc("paper_id")], top_k, "paper_rank")
    return steps.join(newest, ["src", "dst"]).select("u", "v", "w", "src", "dst", "paper_id", "year", "paper_rank")


def neighborhoods(edges: DataFrame, top_k: int = 5) -> DataFrame:
    """Strongest in- and out-neighbours per node (node, direction, neighbour, weight, rank)."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("neighbor"), "weight")
    inn = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("neighbor"), "weight")
    return topn_per_key(out.unionByName(inn), ["node", "direction"], [F.desc("weight"), F.asc("neighbor")], top_k, "rank")


def merged_neighborhoods(edges: DataFrame, top_k: int = 15) -> DataFrame:
    """Strongest neighbours per node whatever the direction, each neighbour once."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "weight").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "weight"))
    once = both.groupBy("node", "neighbor").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return topn_per_key(once, ["node"], [F.desc("weight"), F.asc("neighbor")], top_k, "rank")


def links_by_concept(ranked: DataFrame, top_k: int = 12) -> DataFrame:
    """The best links of each endpoint."""
    ends = ranked.select(F.explode(F.array("u", "v")).alias("concept"), "u", "v", "score")
    return topn_per_key(ends, ["concept"], [F.desc("score"), F.asc("u"), F.asc("v")], top_k, "rank")


def briefs(ranked: DataFrame, mediators: DataFrame, labels: DataFrame, top_k: int = 3) -> DataFrame:
    """One line of text per link: labels, score and its first mediators."""
    name = lambda c: labels.select(F.col("code").alias(c), F.col("label").alias(f"{c}_label"))
    m = mediators.where(F.col("rank") <= top_k).join(ranked.select("u", "v"), ["u", "v"], "left_semi").join(name("w"), "w", "left")
    via = m.groupBy("u", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w_label"))), lambda x: x["w_label"]), "; ").alias("via"))
    out = ranked.join(name("u"), "u", "left").join(name("v"), "v", "left").join(via, ["u", "v"], "left")
    return out.select("u", "v", F.concat_ws(" ", "u_label", F.lit("->"), "v_label", F.lit("via"), F.coalesce("via", F.lit("no mediator"))).alias("brief"))
