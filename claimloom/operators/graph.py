"""Graph analytics on edge tables: centrality, components, backbone, rings."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import hot_keys, salted_join


def pagerank(edges: DataFrame, iterations: int = 20, alpha: float = 0.85, every: int = 5, tolerance: float | None = None) -> DataFrame:
    """(node, pagerank) by weighted power iteration over (src, dst, weight); dangling mass is spread evenly.

    Lineage is cut by a written table every few rounds; the total of the dangling mass is one row, broadcast.  With a ``tolerance`` the rounds go on,
    whatever ``iterations`` says, until two written tables differ by at most that in sum; the rank is then within alpha^every / (1 - alpha^every) of it.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = e.groupBy("src").agg(F.sum("weight").alias("total"))
    step = scratch.write(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "steps")
    nodes = scratch.write(step.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(step.select(F.col("src").alias("node"), F.lit(1).alias("has_out")).distinct(), "node", "left"), "nodes")
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "node string, pagerank double")
    hubs = hot_keys(step, "src")
    rank = nodes.withColumn("pagerank", F.lit(1.0 / n))
    last = None
    for r in count(1):
        sent = salted_join(step, rank.select(F.col("node").alias("src"), "pagerank"), "src", "inner", hot=hubs).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("has_out").isNull(), F.col("pagerank"))), F.lit(0.0)).alias("loose"))
        rank = nodes.join(sent, "node", "left").crossJoin(F.broadcast(dangling)).select("node", "has_out", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("pagerank"))
        if r % every == 0 or (tolerance is None and r == iterations):
            rank = scratch.write(rank, f"rank-{r}")
            if tolerance is not None and last is not None:
                moved = rank.join(last.select("node", F.col("pagerank").alias("old")), "node").agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
                scratch.drop(f"rank-{r - every}")
                if moved <= tolerance:
                    break
            last = rank
        if tolerance is None and r >= iterations:
            break
    return rank.select("node", "pagerank")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected edge table (u, v): smallest label with hooking and pointer jumping, so rounds follow the logarithm of the longest chain.

    A smaller label that a node hears of goes to the node that gave its label, too; else it walks through a component that has settled on another label
    one edge a round.  Each round is a written table.  Used for graphs of concepts; the matching of records has its own operator.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u is not null and v is not null").distinct()
    both = scratch.write(both, "edges")
    hubs = hot_keys(both, "v")
    label = scratch.write(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "label-0")
    for r in range(1, max_rounds + 1):
        near = salted_join(both, label.select(F.col("node").alias("v"), "component"), "v", "inner", hot=hubs).select(F.col("u").alias("node"), "component", F.lit(None).cast(both.schema["u"].dataType).alias("old"))
        heard = near.unionByName(label.select("node", "component", F.col("component").alias("old"))).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        low = heard.select(F.explode(F.array("node", "old")).alias("node"), "component").groupBy("node").agg(F.min("component").alias("component"))
        giant = hot_keys(label, "component")  # a component that holds most nodes is one key of this join: its rows are salted
        jump = salted_join(low, low.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left", hot=giant).select("node", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = scratch.write(jump, f"label-{r}")
        changed = new.join(label.select("node", F.col("component").alias("old")), "node").where("component <> old").limit(1).count()
        scratch.drop(f"label-{r - 1}")
        label = new
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def centrality(edges: DataFrame) -> DataFrame:
    """Degrees, weighted degrees and distinct neighbours per node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_degree"), F.round(F.sum("weight"), 6).alias("out_weight"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"), F.round(F.sum("weight"), 6).alias("in_weight"))
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("x")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("x"))).groupBy("node").agg(F.count_distinct("x").alias("neighbors"))
    zero = {"out_degree": 0, "out_weight": 0.0, "in_degree": 0, "in_weight": 0.0}
    return near.join(out, "node", "left").join(inn, "node", "left").fillna(zero)


def backbone(edges: DataFrame, most_nodes: int = 650, least_claims: int = 4, most_edges: int = 2200) -> DataFrame:
    """Nodes of the largest connected part of the strongest edges among the strongest nodes (a display report: its limits are the feature)."""
    strength = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.round(F.sum("weight"), 6).alias("s"))
    top = strength.orderBy(F.desc("s"), "node").limit(most_nodes).select("node")
    e = edges.where(F.col("n") >= least_claims).join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    e = e.orderBy(F.desc("weight"), "src", "dst").limit(most_edges)
    label = components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    largest = label.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return label.join(largest, "component").select("node", "component", "size")


def ego_rings(edges: DataFrame, center: str, limits: list[int]) -> DataFrame:
    """Rings around a node: per ring the strongest new neighbours of the ring before, up to its limit."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(center, 0, 0.0)], "node string, ring int, strength double")
    last = seen
    for k, limit in enumerate(limits, 1):
        near = both.join(last.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.round(F.sum("weight"), 6).alias("strength"))
        new = near.join(seen.select("node"), "node", "left_anti").orderBy(F.desc("strength"), "node").limit(limit)
        last = new.select("node", F.lit(k).alias("ring"), "strength")
        seen = seen.unionByName(last)
    return seen
