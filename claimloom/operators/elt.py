"""Bibliographic ELT, quality checks, series and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import z_score
from ..plans.skew import topn_per_key


def first_delivered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` then by all other columns: an aggregate that is combined map-side, so a key delivered many times is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    led = [c for c in order if c in rest]
    cols = led + [c for c in rest if c not in led]
    return df.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_f")).select(*keys, *[F.col(f"_f.{c}") for c in cols])


def combine_first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of several inputs where the first input that holds a key wins."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("_p", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return first_delivered(out, [key], ["_p"]).drop("_p")


def overlay(works: DataFrame, registry: DataFrame, key: str = "source_id") -> DataFrame:
    """Works of registered sources only (semi-join; the registry's rows are never copied)."""
    return works.join(registry.select(key).distinct(), key, "left_semi")


def rebuilt_abstracts(children: DataFrame) -> DataFrame:
    """(work_id, words, text) from token children (work_id, child_seq, child_key), in the order of their positions; bounded by one abstract."""
    t = children.where("child_kind = 'token'").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("child_seq", "child_key"))).alias("t"))
    return t.select("work_id", F.size("t").cast("long").alias("words"), F.array_join(F.transform("t", lambda x: x["child_key"]), " ").alias("text"))


# What a placeholder, and what a bare metadata line, contains.
PLACEHOLDERS = ["none", "none.", "not available", "n/a"]
PLACEHOLDER_PARTS = ["an abstract is not available", "abstract is not available", "no abstract available", "please use the get access link", "for information on how to access this content", "preview has been provided"]
METADATA_PARTS = ["clinicaltrials.gov identifier", "trial registration", "registration number", "funded by", "supported by"]


def abstract_quality(abstracts: DataFrame) -> DataFrame:
    """(work_id, words, quality, has_abstract, ready): nine ordered rules on words, tokens, semicolons and stock phrases; a null text is missing."""
    text = F.trim(F.regexp_replace(F.coalesce("abstract_text", F.lit("")), r"\s+", " "))
    low, words = F.lower(text), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")
    semis, tokens = F.regexp_count(text, F.lit(";")), F.regexp_count(text, F.lit("[A-Za-z0-9]+"))
    holds = lambda parts: F.greatest(*[low.contains(p) for p in parts])
    bare = (tokens <= 8) & ~text.contains(".") & ~text.contains(":")
    rule = F.when(words == 0, "missing").when(low.isin(PLACEHOLDERS) | holds(PLACEHOLDER_PARTS), "placeholder").when((words < 20) & (holds(METADATA_PARTS) | bare), "metadata_only")
    rule = rule.when((words < 25) & (semis >= 2), "keyword_list").when(words < 20, "too_short").when(words < 30, "borderline_short").when(words < 50, "usable_short").otherwise("usable")
    good = rule.startswith("usable").cast("int")
    return abstracts.select("work_id", words.alias("words"), rule.alias("quality"), good.alias("has_abstract"), good.alias("ready"))


def classify_source(name_col: str = "name", exclude: str = "newsletter|magazine", adjacent: str = "management|policy", core: str = "econom|journal"):
    """Exclude over adjacent over core by pattern, else review."""
    n = F.lower(F.coalesce(F.col(name_col), F.lit("")))
    return F.when(n.rlike(exclude), "exclude").when(n.rlike(adjacent), "adjacent").when(n.rlike(core), "core").otherwise("review")


def source_stats(works: DataFrame, least: int) -> DataFrame:
    """Works, mean impact and citations per source with at least ``least`` works."""
    return works.where("source_id is not null").groupBy("source_id", "corpus_bucket").agg(F.count(F.lit(1)).alias("works"), F.avg("fwci").alias("mean_fwci"), F.avg("cited_by_count").alias("mean_citations")).where(F.col("works") >= least)


def source_ranking(stats: DataFrame) -> DataFrame:
    """Rank of sources per bucket by the sum of two z-scores."""
    z = z_score(stats.fillna({"mean_fwci": 0.0, "mean_citations": 0.0}), {"mean_fwci": "z1", "mean_citations": "z2"}, ["corpus_bucket"])
    z = z.withColumn("quality", F.round(F.col("z1") + F.col("z2"), 6))
    rank = F.row_number().over(Window.partitionBy("corpus_bucket").orderBy(F.desc("quality"), "source_id"))
    return z.select("source_id", "corpus_bucket", "works", "quality", rank.alias("rank"))


def source_summary(works: DataFrame, topics: DataFrame, k: int = 3) -> DataFrame:
    """Per source its works, years and most frequent subfields as one text."""
    from .ontology import top_values

    w = first_delivered(works.select("work_id", "source_id", "publication_year"), ["work_id"], ["source_id"]).where("source_id is not null")
    sub = topics.where("subfield_id is not null").select("work_id", "subfield_id").distinct().join(w.select("work_id", "source_id"), "work_id")
    top = top_values(sub, "source_id", "subfield_id", k).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subfield_id"))), lambda x: x["subfield_id"]), "|").alias("subfields"))
    return w.groupBy("source_id").agg(F.count(F.lit(1)).alias("works"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year")).join(top, "source_id", "left")


def extraction_qa(edges: DataFrame) -> DataFrame:
    """Edges per paper: mean, median and 90th percentile, per ingestion of each record's earliest row."""
    per = edges.select("custom_id", "edge_id").distinct().groupBy("custom_id").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    return per.agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg("n"), 6).alias("mean_edges"), F.round(q[0], 6).alias("median_edges"), F.round(q[1], 6).alias("p90_edges"))


def enum_shares(edges: DataFrame, attributes: list[str]) -> DataFrame:
    """Counts and shares of each value of each attribute (null as NA)."""
    long = edges.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("NA")).alias("value")) for a in attributes])))
    n = long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("attribute").agg(F.sum("n").alias("t"))
    return n.join(total, "attribute").select("attribute", "value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def gate_grid(metrics: DataFrame, supports: list[int], papers: list[int]) -> DataFrame:
    """Labels that pass each pair of thresholds and the instances they cover (a literal grid, joined by broadcast)."""
    grid = metrics.sparkSession.createDataFrame([(s, p) for s in supports for p in papers], "least_support int, least_papers int")
    ok = (F.col("instance_count") >= F.col("least_support")) & (F.col("distinct_papers") >= F.col("least_papers"))
    j = metrics.select("instance_count", "distinct_papers").crossJoin(F.broadcast(grid))
    return j.groupBy("least_support", "least_papers").agg(F.count_if(ok).alias("labels"), F.coalesce(F.sum(F.when(ok, F.col("instance_count"))), F.lit(0)).alias("instances"), F.round(F.coalesce(F.sum(F.when(ok, F.col("instance_count"))), F.lit(0)) / F.sum("instance_count"), 6).alias("share"))


def mention_series(documents: DataFrame, pattern: str, year_from: int, year_to: int) -> DataFrame:
    """Documents per year with a pattern, on a full calendar spine: counts, share, trailing mean over three years and median of the three before.

    The windows run over one row per year.
    """
    spark = documents.sparkSession
    per = documents.groupBy(F.col("publication_year").alias("year")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.lower("text").rlike(pattern)).alias("hits"))
    spine = spark.range(year_from, year_to + 1).select(F.col("id").cast("int").alias("year"))
    s = spine.join(per, "year", "left").fillna({"docs": 0, "hits": 0})
    w = Window.orderBy("year")
    share = F.coalesce(F.try_divide("hits", "docs"), F.lit(0.0))
    s = s.withColumn("share", share).withColumn("rolling", F.avg("share").over(w.rowsBetween(-2, 0))).withColumn("before", F.percentile("hits", 0.5).over(w.rowsBetween(-3, -1)))
    return s.select("year", "docs", "hits", F.round("share", 6).alias("share"), F.round("rolling", 6).alias("rolling"), F.round("before", 6).alias("median_before"))


def stratified_sample(df: DataFrame, strata: str, key: str, per_stratum: int, target: int, seed: int = 7) -> DataFrame:
    """A quota per stratum by a seeded hash, filled up to ``target`` from the rest."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    hashed = df.withColumn("_h", h)
    first = topn_per_key(hashed, [strata], [F.asc("_h"), F.asc(key)], per_stratum).withColumn("stage", F.lit("quota"))
    rest = hashed.join(first.select(key), key, "left_anti").orderBy("_h", key).limit(target).withColumn("stage", F.lit("backfill"))
    return first.unionByName(rest).orderBy(F.when(F.col("stage") == "quota", 0).otherwise(1), "_h", key).limit(target).drop("_h")


def blinded_items(arms: list[tuple[str, DataFrame]], per_arm: int, seed: int = 7) -> DataFrame:
    """Unique picks per arm in priority order (u, v, score), shuffled by a seeded hash into item numbers."""
    picked = None
    for name, df in arms:
        rest = df if picked is None else df.join(picked.select("u", "v"), ["u", "v"], "left_anti")
        take = rest.orderBy(F.desc("score"), "u", "v").limit(per_arm).select("u", "v", F.lit(name).alias("arm"))
        picked = take if picked is None else picked.unionByName(take)
    return picked.withColumn("item", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "u", "v"), "u", "v")))


def regime_overlap(tops: list[tuple[str, DataFrame]]) -> DataFrame:
    """Shared keys and Jaccard of every two top lists (u, v)."""
    rows = None
    for name, df in tops:
        part = df.select(F.lit(name).alias("regime"), F.concat_ws("__", F.least("u", "v"), F.greatest("u", "v")).alias("key")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("regime").agg(F.count(F.lit(1)).alias("size"))
    j = rows.alias("a").join(rows.alias("b"), "key").select(F.col("a.regime").alias("left_regime"), F.col("b.regime").alias("right_regime")).where("left_regime < right_regime").groupBy("left_regime", "right_regime").agg(F.count(F.lit(1)).alias("shared"))
    s = lambda c: sizes.select(F.col("regime").alias(f"{c}_regime"), F.col("size").alias(f"{c}_size"))
    return j.join(s("left"), "left_regime").join(s("right"), "right_regime").select("left_regime", "right_regime", "shared", F.round(F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")), 6).alias("jaccard"))


def freshness(works: DataFrame, years: list[int]) -> DataFrame:
    """Last update and works of given years."""
    return works.agg(F.max("updated_date").alias("last_update"), F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("publication_year") == y).alias(f"works_{y}") for y in years])


def display_labels(mappings: DataFrame, heads: DataFrame, share: float = 0.42) -> DataFrame:
    """The label to show per concept: the most used one if it holds enough of the instances, else the canonical one."""
    n = mappings.where("concept_id <> '' and normalized_label is not null").groupBy("concept_id", "normalized_label").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("concept_id").agg(F.sum("n").alias("t"))
    best = topn_per_key(n, ["concept_id"], [F.desc("n"), F.asc("normalized_label")], 1).join(total, "concept_id")
    j = heads.select("concept_id", "preferred_label").join(best, "concept_id", "left")
    ok = F.col("n") / F.col("t") >= share
    return j.select("concept_id", F.when(F.coalesce(ok, F.lit(False)), F.col("normalized_label")).otherwise(F.col("preferred_label")).alias("display_label"), F.round(F.col("n") / F.col("t"), 6).alias("share"))
