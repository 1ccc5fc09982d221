"""Scores and re-ranking of missing links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import min_max
from ..plans.scratch import Scratch
from .features import SUMS

# Blends of the priority presets: column and weight; a leading minus takes 1 - column.
PRESETS = {
    "Balanced": {"score": 0.72, "cross_field_norm": 0.10, "low_contact_norm": 0.08, "-hub_penalty": 0.06, "mediator_norm": 0.04},
    "Bold frontier": {"score": 0.38, "boundary_norm": 0.24, "cross_field_norm": 0.16, "low_contact_norm": 0.12, "-hub_penalty": 0.10},
    "Fast follow": {"path_support_norm": 0.42, "motif_bonus_norm": 0.20, "score": 0.16, "mediator_norm": 0.12, "-low_contact_norm": 0.10},
    "Underexplored": {"score": 0.28, "gap_bonus": 0.26, "low_contact_norm": 0.20, "staleness_norm": 0.14, "-hub_penalty": 0.12},
    "Bridge builder": {"score": 0.34, "cross_field_norm": 0.24, "boundary_norm": 0.18, "path_support_norm": 0.14, "-hub_penalty": 0.10},
}


def candidate_scores(pairs: DataFrame, *links: DataFrame, alpha: float = 0.5, beta: float = 0.2, gamma: float = 0.3, delta: float = 0.2, observed: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Union of all candidate links with normalised features and score.

    ``links``: features per missing link (paths, motifs), or the rows that add up to them (``features.link_rows``).  Both directions of every pair with a gap
    are candidates, observed or not (``observed``: edges (src, dst) to leave out); a pair that never occurred has gap 1.  Ranges are taken after the
    filter on positive evidence, within ``by``.
    """
    seen = {"gap_bonus": "double", "cooc_count": "long", "first_year_seen": "int", "last_year_seen": "int"}

    def part(df: DataFrame, u: str, v: str, linked: int) -> DataFrame:
        have = lambda c, other: F.col(c) if c in df.columns else other
        cols = [have(c, F.lit(z)).alias(c) for c, z in SUMS.items()] + [have(c, F.lit(None)).cast(t).alias(c) for c, t in seen.items()]
        mark = have("observed", F.lit(0)) if linked else F.lit(0)
        return df.select(*by, F.col(u).alias("u"), F.col(v).alias("v"), F.lit(linked).alias("linked"), mark.alias("observed"), *cols)

    # one aggregation over the union stands for the outer joins of the feature tables; pairs enter in both directions
    rows = part(pairs, "u", "v", 0).unionByName(part(pairs, "v", "u", 0))
    for df in links:
        rows = rows.unionByName(part(df, "u", "v", 1))
    rows = rows.groupBy(*by, "u", "v").agg(F.max("linked").alias("linked"), F.max("observed").alias("observed"), *[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in seen])
    missing = F.col("observed") == 0
    rows = rows.where(F.col("u") != F.col("v")).where((missing & (F.col("linked") == 1)) | (F.col("gap_bonus") > 0)).withColumns({c: F.when(missing, F.col(c)).otherwise(F.lit(z)) for c, z in SUMS.items()}).drop("linked", "observed")
    if observed is not None:
        rows = rows.join(observed.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    rows = rows.withColumn("gap_bonus", F.coalesce("gap_bonus", F.lit(1.0))).withColumn("cooc_count", F.coalesce("cooc_count", F.lit(0)).cast("long"))
    rows = rows.where("path_support_raw > 0 or motif_bonus_raw > 0 or gap_bonus > 0").withColumnRenamed("hub_penalty", "hub_penalty_raw")
    return blended(Scratch(rows.sparkSession, "candidates").write(rows, "features"), alpha, beta, gamma, delta, by)  # read twice: for the ranges and for the scores


def blended(rows: DataFrame, alpha: float = 0.5, beta: float = 0.2, gamma: float = 0.3, delta: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """Candidates with features scaled over all of them, or within ``by`` (few values), and their score."""
    rows = min_max(rows, {"path_support_raw": "path_support_norm", "motif_bonus_raw": "motif_bonus_norm", "hub_penalty_raw": "hub_penalty"}, list(by) or None, few=True)
    return rows.withColumn("score", alpha * F.col("path_support_norm") + beta * F.col("gap_bonus") + gamma * F.col("motif_bonus_norm") - delta * F.col("hub_penalty"))


def top_ranked(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best ``k`` with rank; a distributed top-k, then a rank over k rows."""
    best = scored.withColumn(by, F.round(by, 6)).orderBy(F.desc(by), "u", "v").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "u", "v")))


def novelty(df: DataFrame) -> DataFrame:
    """Gap or boundary, within a field or across: the field is the first letter of the code."""
    cross = F.substring("u", 1, 1) != F.substring("v", 1, 1)
    name = F.concat(F.when(F.col("cooc_count") <= 0, "boundary").otherwise("gap"), F.when(cross, "_crossfield").otherwise("_internal"))
    return df.withColumn("cross_field", cross).withColumn("boundary_flag", cross & (F.col("cooc_count") <= 0)).withColumn("novelty_type", name)


def slice_flags(df: DataFrame) -> DataFrame:
    """``df`` with the flags (0 or 1) bridge (across fields), frontier (hardly seen together), fast_follow (seen, and nearly the best path support) and underexplored
    (seen at most twice, and a gap from the 0.85 quantile on); nulls count as 0."""
    cut = df.agg(F.percentile("gap_bonus", 0.85).alias("_gap"))
    x = lambda c: F.coalesce(c, F.lit(0.0))
    flags = {
        "bridge": F.substring("u", 1, 1) != F.substring("v", 1, 1), "frontier": x("cooc_count") <= 1, "fast_follow": (x("cooc_count") > 0) & (x("path_support_norm") >= 0.95),
        "underexplored": (x("cooc_count") <= 2) & (x("gap_bonus") >= F.col("_gap")),
    }
    return df.crossJoin(F.broadcast(cut)).withColumns({k: f.cast("int") for k, f in flags.items()}).drop("_gap")


def enriched(df: DataFrame) -> DataFrame:
    """Novelty and the normalised contact, mediator and staleness features (nulls count as 0)."""
    out = novelty(df).withColumn("_c", F.log1p(F.greatest(F.col("cooc_count"), F.lit(0)))).withColumn("_m", F.log1p(F.greatest(F.col("mediator_count"), F.lit(0)))).withColumn("_l", F.coalesce("last_year_seen", F.lit(0)))
    out = min_max(out, {"_c": "_cn", "_m": "mediator_norm", "_l": "_ln"}, fill_zero=True)
    out = out.withColumn("low_contact_norm", 1 - F.col("_cn")).withColumn("staleness_norm", 1 - F.col("_ln"))
    return out.withColumn("boundary_norm", F.col("boundary_flag").cast("double")).withColumn("cross_field_norm", F.col("cross_field").cast("double")).drop("_c", "_m", "_l", "_cn", "_ln")


def preset_scores(df: DataFrame) -> DataFrame:
    """Long table (u, v, preset, priority) of all presets in one pass."""
    def blend(weights):
        total = F.lit(0.0)
        for c, w in weights.items():
            x = F.coalesce(F.col(c.lstrip("-")), F.lit(0.0))
            total = total + w * ((1 - x) if c[0] == "-" else x)
        return total

    cases = [F.struct(F.lit(p).alias("preset"), F.round(blend(w), 6).alias("priority")) for p, w in PRESETS.items()]
    return df.select("u", "v", F.inline(F.array(*cases)))


def boundary_rerank(df: DataFrame, bonus: float = 0.0, quota: float = 0.2, max_rank: int = 100) -> DataFrame:
    """Ranks in which every first r positions (r <= max_rank) hold at least ceil(quota * r) boundary links, in closed form.

    Boundary link i takes the earlier of its natural position and the position at which the quota forces it; all others fill the free
    positions in order.  Input: u, v, score, boundary_flag, a list cut to at most a few thousand rows beforehand.
    """
    adj = F.col("score") + F.when(F.col("boundary_flag"), bonus).otherwise(0.0)
    rows = df.withColumn("adj", F.round(adj, 9)).withColumn("b", F.col("boundary_flag").cast("int"))
    w = Window.orderBy(F.desc("adj"), F.desc("b"), "u", "v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nb", F.sum("b").over(w)).withColumn("no", F.sum(1 - F.col("b")).over(w))
    forced = F.ceil(F.round((F.col("nb") - 1) / F.lit(quota), 9) + 1e-9) if quota > 0 else F.lit(None)
    forced = F.when(forced <= max_rank, F.greatest(forced, F.lit(1)))
    pos = F.when(F.col("b") == 1, F.least(F.col("nb") + F.col("no"), F.coalesce(forced, F.lit(2**31)))).cast("long")
    rows = rows.withColumn("pos", pos)
    taken = rows.where("b = 1").select("pos")
    n = rows.count()
    free = df.sparkSession.range(1, n + 1).select(F.col("id").alias("pos")).join(F.broadcast(taken), "pos", "left_anti")
    free = free.withColumn("no", F.row_number().over(Window.orderBy("pos")))
    others = rows.where("b = 0").drop("pos").join(free, "no")
    return rows.where("b = 1").unionByName(others.select(*rows.columns)).select("u", "v", "score", "boundary_flag", F.col("pos").alias("rank"))
