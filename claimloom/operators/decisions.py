"""Constrained clusters, label maps in priority order, weight search, locked predictions, queues and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.skew import topn_per_key
from .graph import components


def constrained_clusters(links: DataFrame, blocked: DataFrame, isolated: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, component) of label links (u, v): blocked pairs and every link of an isolated label are dropped, merge pairs are added last."""
    pair = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    kept = pair(links).join(pair(blocked), ["u", "v"], "left_anti")
    for end in ("u", "v"):
        kept = kept.join(isolated.select(F.col("label").alias(end)), end, "left_anti")
    return components(kept.select("u", "v").unionByName(pair(merged)))


def label_map(labels: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each label's concept from the first source (name, (normalized_label, concept_id)) that has it; the rest are pending."""
    out = labels.select("normalized_label").distinct()
    concept, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, df) in enumerate(sources):
        one = df.where("concept_id is not null and concept_id <> ''").groupBy("normalized_label").agg(F.min("concept_id").alias(f"_c{i}"))
        out = out.join(one, "normalized_label", "left")
        origin = F.coalesce(origin, F.when(F.col(f"_c{i}").isNotNull(), name))
        concept = F.coalesce(concept, F.col(f"_c{i}"))
    return out.select("normalized_label", concept.alias("concept_id"), F.coalesce(origin, F.lit("pending")).alias("origin"))


def weight_search(features: DataFrame, positives: DataFrame, trials: list[tuple[int, float, float, float, float]], k: int = 100) -> DataFrame:
    """Hits among the best ``k`` per trial of weights (trial, alpha, beta, gamma, delta).

    All trials are scored in one pass over the features; each keeps its own top k before the shuffle, so a trial costs k rows per task.
    """
    grid = features.sparkSession.createDataFrame(trials, "trial int, a double, b double, c double, d double")
    score = F.col("a") * F.col("path_support_norm") + F.col("b") * F.col("gap_bonus") + F.col("c") * F.col("motif_bonus_norm") - F.col("d") * F.col("hub_penalty")
    rows = features.crossJoin(F.broadcast(grid)).select("trial", "u", "v", F.round(score, 6).alias("score"))
    best = topn_per_key(rows, ["trial"], [F.desc("score"), F.asc("u"), F.asc("v")], k)
    hit = best.join(positives.select("u", "v").distinct().withColumn("hit", F.lit(1)), ["u", "v"], "left")
    return hit.groupBy("trial").agg(F.count("hit").alias("hits"), F.round(F.count("hit") / k, 6).alias("precision"), F.round(F.min("score"), 6).alias("floor"))


def locked_predictions(ranked: DataFrame, anchor: int, horizon: int) -> DataFrame:
    """Predictions under fixed ids, with a digest of each row so that a later change shows."""
    ident = F.concat(F.lit(f"MC-{anchor}-H{horizon:02d}-R"), F.lpad(F.col("rank").cast("string"), 4, "0"))
    return ranked.select(ident.alias("prediction_id"), "u", "v", "rank").withColumn("digest", F.sha2(F.concat_ws("|", "prediction_id", "u", "v"), 256))


def attention_panel(ranked: DataFrame, positives: DataFrame, universe: int, ks: list[int]) -> DataFrame:
    """Per k: precision, the precision of a random list, lift, fields covered and share of cross-field links."""
    grid = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    n_pos = positives.select("u", "v").distinct().agg(F.count(F.lit(1)).alias("npos"))
    j = ranked.join(positives.select("u", "v").distinct().withColumn("hit", F.lit(1)), ["u", "v"], "left").crossJoin(F.broadcast(grid)).where("rank <= k")
    cross = (F.substring("u", 1, 1) != F.substring("v", 1, 1)).cast("double")
    g = j.groupBy("k").agg(F.count("hit").alias("hits"), F.count_distinct(F.substring("u", 1, 1)).alias("fields"), F.round(F.avg(cross), 6).alias("cross_share")).crossJoin(F.broadcast(n_pos))
    p, rnd = F.col("hits") / F.col("k"), F.col("npos") / universe
    return g.select("k", "hits", F.round(p, 6).alias("precision"), F.round(rnd, 6).alias("random_precision"), F.round(F.try_divide(p, rnd), 6).alias("lift"), "fields", "cross_share")


def direct_to_path(claims: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """Directly linked pairs without any mediator up to the cutoff, and the first year a mediator joins them within the horizon (null: none)."""
    edge = claims.groupBy("src", "dst").agg(F.min("year").alias("year"))
    a = edge.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("year").alias("y1"))
    b = edge.select(F.col("src").alias("w"), F.col("dst").alias("v"), F.col("year").alias("y2"))
    direct = edge.where(F.col("year") <= cutoff).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    out, inn = edge.groupBy(F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("o")), edge.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("i"))
    # each link is opened from its end of fewer neighbours, so hubs cost the power 1.5 of the edges at most, not their square
    ends = direct.join(out, "u", "left").join(inn, "v", "left")
    low = ends.where("o <= i").select("u", "v").join(a, "u").join(b, ["w", "v"])
    high = ends.where("o > i").select("u", "v").join(b, "v").join(a, ["u", "w"])
    opened = low.select("u", "v", "y1", "y2").unionByName(high.select("u", "v", "y1", "y2")).groupBy("u", "v").agg(F.min(F.greatest("y1", "y2")).alias("opened"))
    j = direct.join(opened, ["u", "v"], "left").where(F.col("opened").isNull() | (F.col("opened") > cutoff))
    return j.select("u", "v", F.when(F.col("opened") <= cutoff + horizon, F.col("opened")).alias("first_path_year"))


def review_queue(queues: list[tuple[str, DataFrame]], per_queue: int) -> DataFrame:
    """Union of queues (u, v, score) in priority order; a pair stays in the first queue that holds it."""
    rows = None
    for i, (name, df) in enumerate(queues):
        part = df.orderBy(F.desc("score"), "u", "v").limit(per_queue).select("u", "v", F.struct(F.lit(i).alias("p"), F.lit(name).alias("queue"), F.col("score").alias("score")).alias("q"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("u", "v").agg(F.min("q").alias("q")).select("u", "v", "q.queue", "q.score")


def node_strings(nodes: DataFrame) -> DataFrame:
    """Per normalised label: instances, papers and wordings; redelivered rows of one node count once."""
    n = nodes.where("label is not null").select("custom_id", "node_id", "label", L.normalized(F.col("label")).alias("normalized_label")).where("normalized_label <> ''")
    return n.groupBy("normalized_label").agg(F.count_distinct("custom_id", "node_id").alias("instances"), F.count_distinct("custom_id").alias("papers"), F.count_distinct("label").alias("wordings"), F.min("custom_id").alias("first_paper"))


def distinct_partners(edges: DataFrame) -> DataFrame:
    """Distinct partners and papers per concept over both directions (custom_id, src, dst)."""
    both = edges.select("custom_id", F.col("src").alias("concept_id"), F.col("dst").alias("partner")).unionByName(edges.select("custom_id", F.col("dst").alias("concept_id"), F.col("src").alias("partner")))
    return both.groupBy("concept_id").agg(F.count_distinct("partner").alias("partners"), F.count_distinct("custom_id").alias("papers"))


def context_fingerprints(nodes: DataFrame) -> DataFrame:
    """Instances per context: a digest of countries, units, years and note as stored."""
    parts = ["countries_json", "end_year_json", "start_year_json", "unit_of_analysis_json", "context_note"]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in parts])
    n = nodes.where("label is not null").select("custom_id", "node_id", F.sha1(text).alias("fingerprint"))
    return n.groupBy("fingerprint").agg(F.count_distinct("custom_id", "node_id").alias("instances"))


def oriented_pairs(edges: DataFrame) -> DataFrame:
    """One row per unordered pair with the claims of either direction, the pair turned so that the stronger one leads, and an arrow mode."""
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    g = edges.groupBy(u.alias("a"), v.alias("b")).agg(F.count_if(F.col("src") == u).alias("ab"), F.count_if(F.col("src") != u).alias("ba"))
    turn = F.col("ba") > F.col("ab")
    lead, back = F.greatest("ab", "ba"), F.least("ab", "ba")
    mode = F.when(back == 0, "one_way").when(back * 2 >= lead, "two_way").otherwise("mostly_one_way")
    return g.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("target"), lead.alias("forward"), back.alias("reverse"), mode.alias("arrow"))


def topic_texts(topics: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` topic names of a work, in order, as one text."""
    t = topics.where("display_name is not null").groupBy("work_id", "topic_seq").agg(F.min("display_name").alias("name"))
    top = topn_per_key(t, ["work_id"], [F.asc("topic_seq")], k, "r")
    return top.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "|||").alias("topics"))


