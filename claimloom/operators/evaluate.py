"""Rolling temporal back-tests and panels over them.

Positives are the links that first appear in a window after the cutoff.  Baselines over all ordered pairs are never written out: a
positive's rank is counted from degree histograms (pairs with a larger product) and the few exact ties, so the cost follows the degrees,
not the square of the nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import decile
from ..plans.order import running_within
from ..plans.skew import topn_per_key
from . import link_counts as L


def first_appearance(claims: DataFrame) -> DataFrame:
    """First year per directed edge."""
    return claims.groupBy("src", "dst").agg(F.min("year").alias("first_year"))


def future_links(first: DataFrame, cutoffs: list[int], horizons: list[int], gap: int = 0) -> DataFrame:
    """(cutoff, horizon, u, v, first_year): links first seen in [t + gap, t + h].  The grid is a small literal table, joined by broadcast."""
    spark = first.sparkSession
    grid = spark.createDataFrame([(t, h) for t in cutoffs for h in horizons], "cutoff int, horizon int")
    f = first.select(F.col("src").alias("u"), F.col("dst").alias("v"), "first_year")
    return f.join(F.broadcast(grid), (F.col("first_year") >= F.col("cutoff") + gap) & (F.col("first_year") <= F.col("cutoff") + F.col("horizon")))


def leakage(first: DataFrame, claims: DataFrame, cutoffs: list[int], horizons: list[int]) -> DataFrame:
    """Training edges (year <= t - 1) among the positives, per cutoff and horizon: always 0 for a sound split."""
    pos = future_links(first, cutoffs, horizons)
    train = claims.select(F.col("src").alias("u"), F.col("dst").alias("v"), "year").groupBy("u", "v").agg(F.min("year").alias("seen"))
    j = pos.join(train, ["u", "v"], "left")
    return j.groupBy("cutoff", "horizon").agg(F.count(F.lit(1)).alias("positives"), F.count_if(F.col("seen") <= F.col("cutoff") - 1).alias("leaked"))


def ranking_metrics(ranks: DataFrame, by: list[str], ks: list[int], count: str | None = None) -> DataFrame:
    """Hits, precision and recall at k, and mean reciprocal rank per group of positives (rank null: not ranked, counts 0).

    precision divides by k however many were ranked; recall and MRR by at least 1.  ``count`` names a column of counts where rows stand for several positives.
    """
    one = F.col(count) if count else F.lit(1).cast("long")
    n = F.sum(one)
    aggs = [n.alias("positives"), F.round(F.sum(F.coalesce(one / F.col("rank"), F.lit(0.0))) / F.greatest(n, F.lit(1)), 6).alias("mrr")]
    for k in ks:
        hits = F.sum(F.when(F.col("rank") <= k, one).otherwise(F.lit(0).cast("long")))
        aggs += [hits.alias(f"hits_{k}"), F.round(hits / k, 6).alias(f"precision_{k}"), F.round(hits / F.greatest(n, F.lit(1)), 6).alias(f"recall_{k}")]
    return ranks.groupBy(*by).agg(*aggs)


def attachment_ranks(train_edges: DataFrame, positives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(u, v, p, above, free): of each positive link (u, v) with a product p = out-degree(u) x in-degree(v), the missing pairs with a larger product, and with the same.

    Pairs are counted from the two degree histograms; existing edges and loops, which are no candidates, are subtracted.  Zero products stay unranked.
    """
    by = list(by)
    out = train_edges.groupBy(*by, "src").agg(F.count_distinct("dst").alias("o"))
    inn = train_edges.groupBy(*by, "dst").agg(F.count_distinct("src").alias("i"))
    pos = positives.join(out.withColumnRenamed("src", "u"), [*by, "u"]).join(inn.withColumnRenamed("dst", "v"), [*by, "v"]).withColumn("p", F.col("o") * F.col("i"))
    ho, hi = out.groupBy(*by, "o").agg(F.count(F.lit(1)).alias("no")), inn.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("ni"))
    # distinct degrees are few (at most the square root of twice the edges), so this product is bounded by the number of edges
    every = ho.join(hi, by) if by else ho.crossJoin(hi)
    products = every.groupBy(*by, (F.col("o") * F.col("i")).alias("p")).agg(F.sum(F.col("no") * F.col("ni")).alias("pairs"))
    loops = out.withColumnRenamed("src", "node").join(inn.withColumnRenamed("dst", "node"), [*by, "node"]).select(*by, (F.col("o") * F.col("i")).alias("p"))
    known = train_edges.select(*by, "src", "dst").distinct().where("src <> dst").join(out, [*by, "src"]).join(inn, [*by, "dst"]).select(*by, (F.col("o") * F.col("i")).alias("p"))
    taken = loops.unionByName(known).groupBy(*by, "p").agg(F.count(F.lit(1)).alias("gone"))
    free = products.join(taken, [*by, "p"], "left").select(*by, "p", (F.col("pairs") - F.coalesce("gone", F.lit(0))).alias("free"))
    above = running_within(free, by, [F.desc("p")], F.col("free"), "above")
    return pos.join(above, [*by, "p"]).select(*by, "u", "v", "p", "above", "free")


def _mean_rank() -> Column:
    return F.col("above") + (F.col("n") + 1) / 2


def scored_ranks(scored: DataFrame, positives: DataFrame, column: str = "score", by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Rank of each positive (u, v) among scored links by a score of 6 digits, ties at their mean rank; null where it is not scored.

    Counted from a histogram of the distinct scores, cumulated over ranges; only the positives are joined.  A first place for every tied link
    would let a model of few distinct scores look perfect.  ``count`` names a column of counts where rows stand for several links (``features.link_classes``).
    """
    by = list(by)
    s = scored.select(*by, "u", "v", F.round(column, 6).alias("s"), (F.col(count) if count else F.lit(1)).alias("n"))
    above = running_within(s.groupBy(*by, "s").agg(F.sum("n").alias("n")), by, [F.desc("s")], F.col("n"), "above").select(*by, "s", _mean_rank().alias("rank"))
    return positives.join(s.where("u is not null"), [*by, "u", "v"], "left").join(above, [*by, "s"], "left").select(*positives.columns, "rank")


def gap_ranks(pairs: DataFrame, train_edges: DataFrame, positives: DataFrame, n_nodes: int, by: Sequence[str] = ()) -> DataFrame:
    """Rank of each positive (u, v) among all missing ordered pairs of ``n_nodes`` concepts by co-occurrence gap (1 for a pair that never occurred), ties at their mean rank.

    Pairs that never occurred are counted, not written: all ordered pairs less both directions of the occurring ones.  Observed edges, which
    are no candidates, are left out of either class; a positive that is an edge of the training has no rank.
    """
    by = list(by)
    both = pairs.select(*by, "u", "v", "gap_bonus").unionByName(pairs.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), "gap_bonus"))
    known = train_edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("observed")).where("u <> v").distinct()
    return class_gap_ranks(both.join(known, [*by, "u", "v"], "full").withColumn("links", F.lit(1)), positives, n_nodes, by)


def class_gap_ranks(classes: DataFrame, positives: DataFrame, n_nodes: int, by: Sequence[str] = ()) -> DataFrame:
    """``gap_ranks`` from pairs with counts: (u, v, gap_bonus, observed, links), u and v null except for the positives (``features.link_classes``)."""
    by, free = list(by), F.coalesce("observed", F.lit(0)) == 0
    occurring = classes.where("gap_bonus is not null")
    seen = occurring.where(free).groupBy(*by, F.round("gap_bonus", 6).alias("g")).agg(F.sum("links").alias("n"))
    # an observed edge lies within a paper, so it is one of the occurring pairs: missing and never occurred = all - both directions of the occurring
    never = occurring.groupBy(*by).agg((F.lit(n_nodes * (n_nodes - 1)).cast("long") - F.coalesce(F.sum("links"), F.lit(0))).alias("n")).select(*by, F.lit(1.0).alias("g"), "n")
    counts = seen.unionByName(never).groupBy(*by, "g").agg(F.sum("n").alias("n"))
    above = running_within(counts, by, [F.desc("g")], F.col("n"), "above").select(*by, "g", _mean_rank().alias("rank"))
    hits = positives.join(classes.where("u is not null").select(*by, "u", "v", "gap_bonus", "observed"), [*by, "u", "v"], "left").where(free).withColumn("g", F.round(F.coalesce("gap_bonus", F.lit(1.0)), 6))
    ranks = hits.join(F.broadcast(above), [*by, "g"]).select(*by, "u", "v", "rank").distinct()  # a gap per number of papers below tau, so few rows
    return positives.join(ranks, [*by, "u", "v"], "left").select(*positives.columns, "rank")


def count_ranks(counts: DataFrame, grid: DataFrame, n_nodes: int) -> DataFrame:
    """Positives (model, cutoff, horizon, papers, rank, n) of the three models, ``n`` of each kind, for the ``grid`` (cutoff, horizon): from ``link_counts``; tied links share their mean rank."""
    at = lambda kind, *more: counts.where(F.col("kind") == kind).select("cutoff", *more)
    never = at(L.PAIR, "n").groupBy("cutoff").agg(F.sum("n").alias("n")).select("cutoff", F.lit(L.STEPS).cast("long").alias("value"), (F.lit(n_nodes * (n_nodes - 1)).cast("long") - F.col("n")).alias("n"))
    # distinct degrees are few (at most the square root of twice the edges), so this product is bounded by the number of edges
    every = at(L.OUT, F.col("value").alias("o"), F.col("n").alias("no")).join(at(L.IN, F.col("value").alias("i"), F.col("n").alias("ni")), "cutoff").select("cutoff", (F.col("o") * F.col("i")).alias("value"), (F.col("no") * F.col("ni")).alias("n"))
    parts = {"main": [at(L.LINK, "value", "n")], "cooc_gap": [at(L.GAP, "value", "n"), never], "pref_attach": [every, at(L.TAKEN, "value", (-F.col("n")).alias("n"))]}
    links = reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(model)) for model, dfs in parts.items() for df in dfs])
    links = links.groupBy("model", "cutoff", "value").agg(F.sum("n").alias("n"))
    ranks = running_within(links, ["model", "cutoff"], [F.desc("value")], F.col("n"), "above").select("model", "cutoff", "value", _mean_rank().alias("rank"))
    model = F.element_at(F.create_map(*[F.lit(x) for x in (L.MAIN, "main", L.COOC, "cooc_gap", L.ATTACH, "pref_attach")]), F.col("kind"))
    pos = counts.where(F.col("kind").isin(L.MAIN, L.COOC, L.ATTACH)).withColumn("model", model).join(F.broadcast(grid), "cutoff").where(F.col("year") <= F.col("cutoff") + F.col("horizon"))
    pos = pos.groupBy("model", "cutoff", "horizon", "papers", "value").agg(F.sum("n").alias("n"))
    return pos.join(ranks, ["model", "cutoff", "value"], "left").select("model", "cutoff", "horizon", "papers", "rank", "n")


def gap_baseline(pairs: DataFrame, train_edges: DataFrame, k: int) -> DataFrame:
    """The first ``k`` missing ordered pairs that have occurred together, by co-occurrence gap (desc), then name; pairs that never occurred all have gap 1 and are counted in ``gap_ranks``."""
    both = pairs.select("u", "v", "gap_bonus").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "gap_bonus"))
    missing = both.join(train_edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    return missing.orderBy(F.desc("gap_bonus"), "u", "v").limit(k)


def model_summary(metrics: DataFrame, values: list[str]) -> DataFrame:
    """Mean of metrics per model and horizon over the cutoffs, and the number of cutoffs."""
    return metrics.groupBy("model", "horizon").agg(F.count_distinct("cutoff").alias("cutoffs"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in values])


def paired_models(metrics: DataFrame, left: str, right: str, values: list[str]) -> DataFrame:
    """(cutoff, horizon, metric, left, right, delta) of two models on the same cutoffs and horizons."""
    long = lambda m, name: metrics.where(F.col("model") == m).select("cutoff", "horizon", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in values])))
    j = long(left, "left_value").join(long(right, "right_value"), ["cutoff", "horizon", "metric"])
    return j.withColumn("delta", F.round(F.col("left_value") - F.col("right_value"), 9))


def win_rates(metrics: DataFrame, left: str, right: str, first: str, second: str) -> DataFrame:
    """Per horizon, the share of cutoffs where ``left`` is at least as good as ``right`` by one metric, by the other, and by both."""
    p = paired_models(metrics, left, right, [first, second]).groupBy("cutoff", "horizon").agg(*[F.max(F.when(F.col("metric") == m, F.col("delta"))).alias(m) for m in (first, second)])
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    a, b = F.col(first) >= 0, F.col(second) >= 0
    return p.groupBy("horizon").agg(F.count(F.lit(1)).alias("cutoffs"), share(a).alias(f"wins_{first}"), share(b).alias(f"wins_{second}"), share(a & b).alias("wins_both"))


def heterogeneity(claims: DataFrame) -> DataFrame:
    """First-seen edges by source field, decade, causal flag, and field x causal, as grouping sets of one pass."""
    e = claims.groupBy("src", "dst").agg(F.min(F.struct("year", (~F.col("is_causal")).alias("not_causal"))).alias("f"))
    e = e.select(F.substring("src", 1, 1).alias("source_field"), (F.floor(F.col("f.year") / 10) * 10).cast("int").alias("decade"), (~F.col("f.not_causal")).cast("int").alias("causal"))
    sets = [["source_field"], ["decade"], ["causal"], ["source_field", "causal"]]
    return e.groupingSets(sets, "source_field", "decade", "causal").agg(F.count(F.lit(1)).alias("edges"))


def realization(ranked: DataFrame, first: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """Ranked links with decile, whether they came true in t+1..t+h, and the time it took."""
    n = ranked.count()
    f = first.where((F.col("first_year") > cutoff) & (F.col("first_year") <= cutoff + horizon)).select(F.col("src").alias("u"), F.col("dst").alias("v"), "first_year")
    j = ranked.join(f, ["u", "v"], "left")
    return j.select("u", "v", "rank", decile(F.col("rank"), F.lit(n)).alias("decile"), F.col("first_year").isNotNull().cast("int").alias("realized"), (F.col("first_year") - cutoff).alias("time_to_fill"))


def calibration(panel: DataFrame) -> DataFrame:
    """Share that came true per score decile."""
    return panel.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum("realized").alias("realized"), F.round(F.avg("realized"), 6).alias("rate"))


def fill_curve(panel: DataFrame, horizon: int) -> DataFrame:
    """Share of realised links filled within tau years, per decile."""
    taus = panel.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("tau"))
    done = panel.where("realized = 1")
    return done.crossJoin(F.broadcast(taus)).groupBy("decile", "tau").agg(F.round(F.avg((F.col("time_to_fill") <= F.col("tau")).cast("double")), 6).alias("share"))


def gap_boundary(panel: DataFrame) -> DataFrame:
    """Counts, realised and share of total per novelty class."""
    g = panel.groupBy("novelty_type").agg(F.count(F.lit(1)).alias("n"), F.sum("realized").alias("realized"))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("novelty_type", "n", "realized", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def weighted_metrics(ranks: DataFrame, by: list[str], k: int) -> DataFrame:
    """Metrics with impact weights (1 + ln(1 + papers)): weighted MRR and recall, NDCG at k.  ``ranks``: (papers, rank, n), a row for ``n`` positives (``count_ranks``)."""
    g = F.col("gain")
    rows = ranks.withColumn("gain", 1 + F.log1p("papers"))
    single = rows.groupBy(*by, "gain").agg(F.sum("n").alias("n")).select(*by, "gain", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("_i"))  # few gains, at most k of each
    ideal = topn_per_key(single, by, [F.desc("gain"), F.asc("_i")], k, "ideal").groupBy(*by).agg(F.sum(g / F.log2(F.col("ideal") + 1)).alias("best"))
    total = F.sum(g * F.col("n"))
    got = rows.groupBy(*by).agg(
        F.round(F.sum(F.when(F.col("rank").isNotNull(), g * F.col("n") / F.col("rank")).otherwise(0.0)) / total, 6).alias("weighted_mrr"),
        F.round(F.sum(F.when(F.col("rank") <= k, g * F.col("n")).otherwise(0.0)) / total, 6).alias("weighted_recall"),
        F.sum(F.when(F.col("rank") <= k, g * F.col("n") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    return got.join(ideal, by).select(*by, "weighted_mrr", "weighted_recall", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"))


def power(deltas: DataFrame, by: list[str], alpha_z: float = 1.96, power_z: float = 0.84) -> DataFrame:
    """Effect size and sample size that paired differences imply; differences are rounded first, a deviation of 0 gives nulls."""
    d = F.round("delta", 9)
    rows = deltas.groupBy(*by).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(F.lit(1)).alias("pairs"))
    ok = F.coalesce(F.col("sd"), F.lit(0.0)) > 1e-12
    return rows.select(*by, "pairs", F.round("mean", 6).alias("mean_delta"), F.round(F.when(ok, F.col("mean") / F.col("sd")), 6).alias("effect"), F.when(ok & (F.col("mean") != 0), F.ceil(F.round(F.pow((alpha_z + power_z) * F.col("sd") / F.abs("mean"), F.lit(2)), 6))).cast("long").alias("needed"))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """Mean and a 95 % interval from Poisson resampling: every row draws its own count per replicate, so no group is gathered.

    Each row becomes n_boot weighted rows that are summed map-side; the draws come from a hash of the row, the replicate and the seed.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep")
    u = (F.pmod(F.xxhash64("_h", "rep", F.lit(seed)), F.lit(2**31)) + 0.5) / 2**31
    p, w = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015], F.lit(5)
    for k in range(4, -1, -1):
        w = F.when(u <= p[k], k).otherwise(w)
    rows = df.withColumn("_h", F.xxhash64(*df.columns)).select(*by, value, "_h", rep).withColumn("w", w)
    means = rows.groupBy(*by, "rep").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(ci, by).select(*by, "mean", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"))
