"""Pairwise matches to groups by a two-dimensional grid (problem 2).

Method.  Vertices are hashed into B blocks, so every edge falls into one cell (block pair) of a B x B grid; B follows the
number of edges.  Each cell runs a local union-find over its edges and reports (vertex, local representative).  The
exchange gathers, per vertex, the representatives of its row and column: the smallest becomes the vertex's parent, and the
other representatives are linked to it.  Those links, among representatives only, are the edges of the next round; vertices
that are nobody's representative drop out, so the graph shrinks every round.  When no links remain, the parents are stable,
and the rounds' parent tables are composed from last to first.

A hub with a third of all edges is one row of the grid, hence spread over B cells; cells above the target size are split
further by a hash of the edge (any partition of the edges is right).  The exchange sees a vertex at most once per cell.
Each round is a written table in the shared folder.  The representative is the smallest vertex, so the final root of a
group is its smallest member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import salted_join


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of one cell and the smallest vertex each is linked with, by union-find with path halving."""
    codes, names = pd.factorize(np.concatenate([u, v]), sort=True)  # code order is vertex order
    parent = list(range(len(names)))
    n = len(u)
    for a, b in zip(codes[:n].tolist(), codes[n:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array(parent, dtype=np.int64)
    while True:  # a parent is never larger than its child, so this ends
        up = root[root]
        if (up == root).all():
            return np.asarray(names), np.asarray(names)[root]
        root = up


def _cells(edges: DataFrame, count: int, cell_edges: int) -> DataFrame:
    blocks = max(1, math.ceil(math.sqrt(2 * count / cell_edges)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = edges.withColumn("i", F.least(block("u"), block("v"))).withColumn("j", F.greatest(block("u"), block("v")))
    if blocks == 1:
        return placed.withColumn("s", F.lit(0))
    sizes = placed.groupBy("i", "j").count().where(F.col("count") > 2 * cell_edges)  # a small table that is joined back: at most count / (2 cell_edges) cells
    split = sizes.select("i", "j", F.ceil(F.col("count") / cell_edges).alias("split"))
    return placed.join(split, ["i", "j"], "left").withColumn("s", F.pmod(F.xxhash64("u", "v", F.lit(1)), F.coalesce("split", F.lit(1))).cast("int")).drop("split")


def components(edges: DataFrame, cell_edges: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v strings); the root is the smallest vertex linked directly or indirectly.

    Edges with a null end or equal ends link nothing; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "grid")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vertex, rep = local_roots(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"vertex": vertex, "rep": rep})

    current = scratch.write(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges-0")
    rounds: list[DataFrame] = []
    for r in range(max_rounds):
        count = current.count()
        if count == 0:
            break
        local = _cells(current, count, cell_edges).groupBy("i", "j", "s").applyInPandas(solve, "vertex string, rep string")
        parent = F.min("rep").over(Window.partitionBy("vertex"))  # at most one row per cell and vertex
        exchanged = scratch.write(local.withColumn("parent", parent), f"exchange-{r}")
        rounds.append(exchanged.select("vertex", "parent").distinct())
        current = scratch.write(exchanged.where("rep <> parent").select(F.col("parent").alias("u"), F.col("rep").alias("v")).distinct(), f"edges-{r + 1}")
        scratch.drop(f"edges-{r}")
    else:
        raise RuntimeError(f"parents did not stabilise in {max_rounds} rounds")
    if not rounds:
        return spark.createDataFrame([], "vertex string, root string")
    found = rounds[-1].select("vertex", F.col("parent").alias("root"))
    for r in range(len(rounds) - 2, -1, -1):
        above = found.select(F.col("vertex").alias("parent"), F.col("root"))
        up = salted_join(rounds[r], above, "parent", "left")
        found = scratch.write(up.select("vertex", F.coalesce("root", "parent").alias("root")), f"roots-{r}")
    return found


def match_groups(candidates: DataFrame, overrides: DataFrame, cell_edges: int = 200_000) -> DataFrame:
    """(run_id, member_key, group_id): accepted label-concept rows and merge pairs, grouped within their run.

    A null run is a run of its own.  Rows with a null or empty end, undecided rows and pairs of a label with itself link nothing.
    """
    sep = "\u0001"
    of_rows = candidates.where("startswith(decision_status, 'accepted')").select("run_id", F.col("normalized_label").alias("a"), F.col("candidate_concept_id").alias("b"))
    of_pairs = overrides.where("override_kind = 'merge_pair'").select("run_id", F.col("left_normalized_label").alias("a"), F.col("right_normalized_label").alias("b"))
    links = of_rows.unionByName(of_pairs).where("a is not null and b is not null and a <> '' and b <> '' and a <> b")
    run = F.coalesce(F.concat(F.lit("r"), "run_id"), F.lit("0"))
    edges = links.select(*[F.concat(run, F.lit(sep), F.col(c)).alias(n) for c, n in (("a", "u"), ("b", "v"))])
    out = components(edges, cell_edges)
    run_of = F.substring_index("vertex", sep, 1)
    return out.select(F.when(run_of != "0", F.expr("substring(substring_index(vertex, '\u0001', 1), 2)")).alias("run_id"), F.expr("substring(vertex, instr(vertex, '\u0001') + 1)").alias("member_key"), F.expr("substring(root, instr(root, '\u0001') + 1)").alias("group_id"))
