"""Concept frames, decision labels, roll-ups, layouts and bounded selections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.order import running_before
from ..plans.skew import topn_per_key

# Points of a claim's stability by attribute value.
CLAIM_POINTS = {"effect_present": 0.95, "conditional_effect": 0.82, "mixed_or_ambiguous": 0.62, "no_effect": 0.55, "question_only": 0.22, "other": 0.40}
EXPLICITNESS_POINTS = {"result_only": 0.08, "question_and_result": 0.04, "background_claim": -0.18, "implied": -0.05, "question_only": -0.10}
TENTATIVENESS_POINTS = {"certain": 0.05, "tentative": -0.05, "mixed_or_qualified": -0.08, "unclear": -0.10}
CAUSAL_POINTS = {"explicit_causal": 0.05, "implicit_causal": 0.02, "noncausal": 0.0, "unclear": -0.03}


def _points(c: str, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out


def stability() -> Column:
    """Stability of a claim in 0..1 from its status, explicitness, tentativeness and causal wording; unknown and null values take the neutral points."""
    total = _points("claim_status", CLAIM_POINTS, 0.40) + _points("explicitness", EXPLICITNESS_POINTS, 0.0) + _points("tentativeness", TENTATIVENESS_POINTS, 0.0) + _points("causal_presentation", CAUSAL_POINTS, 0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 9)))


def dominant(df: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """The most frequent value per key, nulls, blanks and NA left out; ties go to the smallest value; ``default`` where none is left."""
    v = F.when(~F.col(value).isin("", "NA"), F.col(value))
    n = df.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("a"), F.col("_v").alias("v"))))
    return n.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.coalesce("_b.v", F.lit(default)).alias(value))


def concept_paper_edges(lifted: DataFrame) -> DataFrame:
    """One row per paper and concept pair: dominant relation and method, whether any claim is causal, evidence weight and mean stability."""
    keys = ["custom_id", "src", "dst"]
    causal = F.col("causal_presentation").isin("explicit_causal", "implicit_causal")
    sums = lifted.withColumn("_s", stability()).groupBy(*keys).agg(F.bool_or(F.coalesce(causal, F.lit(False))).alias("is_causal"), evidence_weight().alias("weight"), F.round(F.avg("_s"), 6).alias("stability"))
    return sums.join(dominant(lifted, keys, "relationship_type", "other"), keys).join(dominant(lifted, keys, "evidence_method", "do_not_know"), keys)


def evidence_weight() -> Column:
    """Claims, and bonuses for data, causal wording, significance and a known method (a null method counts as known, as the original has it)."""
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    known = F.coalesce(~F.col("evidence_method").isin("do_not_know", "other"), F.lit(True))
    bonus = 0.25 * any_(F.col("uses_data") >= 1) + 0.25 * any_(F.col("causal_presentation").isin("explicit_causal", "implicit_causal")) + 0.10 * any_(F.col("statistical_significance") == "significant") + 0.10 * any_(known)
    return F.round(F.count(F.lit(1)) + bonus, 6)


def concept_edge_stats(paper_edges: DataFrame) -> DataFrame:
    """Papers, summed weight and mean stability per directed concept pair."""
    return paper_edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("papers"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.avg("stability"), 6).alias("mean_stability"))


def concept_nodes(mappings: DataFrame, low: float = 0.80) -> DataFrame:
    """Instances, papers, mean confidence, share of low confidence (null counts as 0) and number of wordings per concept; each key counts by its earliest row."""
    first = mappings.groupBy("custom_id", "node_id").agg(F.min(F.struct("ingested_at", "concept_id", "normalized_label", "confidence")).alias("f")).select("custom_id", "f.*").where("concept_id <> ''")
    return first.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("custom_id").alias("papers"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg((F.coalesce("confidence", F.lit(0.0)) < low).cast("double")), 6).alias("low_confidence_share"), F.count_distinct("normalized_label").alias("wordings"),
    )


def cluster_summary(members: DataFrame, support: DataFrame) -> DataFrame:
    """Size, summed support (per-label counts are added up) and best score per component; members without support count 0."""
    j = members.join(support, "node", "left")
    return j.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"), F.max("score").alias("best_score"))


def slice_label() -> Column:
    """Slice a candidate is shown in."""
    rows = F.when(F.col("cooc_count") <= 0, "Missing direct link").when(F.col("path_support_norm") >= 0.95, "Ready to follow through")
    return rows.when((F.col("gap_bonus") >= 0.85) & (F.col("cooc_count") <= 2), "Early but promising").when(F.col("cross_field"), "Connect separate literatures").otherwise("Support from nearby literature")


def direct_status() -> Column:
    """How much direct literature a pair has."""
    n = F.col("cooc_count")
    return F.when(n <= 0, "No direct papers yet").when(n == 1, "One direct paper so far").when(n <= 5, "A few direct papers already exist").otherwise("Direct work already exists")


def play() -> Column:
    """The kind of study a candidate suggests."""
    p, g = F.col("path_support_norm"), F.col("gap_bonus")
    across = F.col("novelty_type") == "boundary_crossfield"
    rows = F.when(across & (p >= 0.7), "Bridge paper across literatures").when(across, "Scoping review before a bridge paper").when((g >= 0.4) & (F.col("mediator_count") >= 25), "Direct empirical test").when(g >= 0.4, "Synthesis plus pilot design")
    return rows.when((p >= 0.8) & (F.col("motif_count") >= 100), "Flagship empirical paper").when(p >= 0.7, "Focused empirical test").otherwise("Seminar seed or targeted replication map")


def decision_labels(novel: DataFrame) -> DataFrame:
    """``novel`` (candidates with novelty) with slice label, literature status and suggested play; null features count as 0."""
    x = novel.fillna({"path_support_norm": 0.0, "gap_bonus": 0.0, "mediator_count": 0, "motif_count": 0, "cooc_count": 0})
    return x.withColumns({"slice_label": slice_label(), "direct_status": direct_status(), "play": play()})


def corridors(candidates: DataFrame, by: str = "score") -> DataFrame:
    """Candidates, mean score, share across fields and median score per pair of fields (first letters of the codes)."""
    return candidates.groupBy(F.substring("u", 1, 1).alias("source_field"), F.substring("v", 1, 1).alias("target_field")).agg(
        F.count(F.lit(1)).alias("ideas"), F.round(F.avg(by), 6).alias("mean_score"), F.round(F.avg(F.col("boundary_flag").cast("double")), 6).alias("boundary_share"), F.round(F.median(by), 6).alias("median_score")
    )


def label_concept_support(hard: DataFrame, soft: DataFrame, least: int = 3) -> DataFrame:
    """Instances per wording and concept over both mappings, at least ``least``."""
    rows = hard.select("normalized_label", "concept_id").unionByName(soft.select("normalized_label", "concept_id")).where("normalized_label is not null and concept_id <> ''")
    return rows.groupBy("normalized_label", "concept_id").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def family_rollup(works: DataFrame, names: int = 10) -> DataFrame:
    """Works, citations, first source name and up to ``names`` source names (in order, joined) per host organisation; a work counts by its smallest row."""
    w = works.groupBy("work_id").agg(F.min(F.struct("source_host_organization", "source_display_name", "cited_by_count")).alias("f")).select("f.*").where("source_host_organization is not null")
    top = topn_per_key(w.where("source_display_name is not null").select("source_host_organization", "source_display_name").distinct(), ["source_host_organization"], [F.asc("source_display_name")], names)
    listed = top.groupBy("source_host_organization").agg(F.array_join(F.array_sort(F.collect_list("source_display_name")), "|").alias("sources"))  # at most ``names`` each
    g = w.groupBy("source_host_organization").agg(F.count(F.lit(1)).alias("works"), F.coalesce(F.sum("cited_by_count"), F.lit(0)).alias("citations"), F.min("source_display_name").alias("first_source"))
    return g.join(listed, "source_host_organization", "left")


def head_pool_capped(strings: DataFrame, least_papers: int, coverage: float, most_labels: int) -> DataFrame:
    """(normalized_label, reason): labels of at least ``least_papers`` papers; if these cover less than ``coverage`` of the instances, the most frequent others fill up to ``most_labels``."""
    passed = F.col("papers") >= least_papers
    total = strings.agg(F.count_if(passed).alias("n"), F.coalesce(F.sum(F.when(passed, F.col("instances"))), F.lit(0)).alias("i"), F.coalesce(F.sum("instances"), F.lit(0)).alias("t")).first()
    kept = strings.where(passed).select("normalized_label", F.lit("distinct_papers_threshold").alias("reason"))
    room = most_labels - total["n"]
    if room <= 0 or total["t"] == 0 or total["i"] / total["t"] >= coverage:
        return kept
    rest = strings.where(~passed).orderBy(F.desc("instances"), "normalized_label").limit(room)
    return kept.unionByName(rest.select("normalized_label", F.lit("coverage_mass_capped").alias("reason")))


def document_sizes(documents: DataFrame) -> DataFrame:
    """Documents and estimated tokens (a quarter of the signs, rounded up, per document) by kind."""
    n = F.ceil(F.length(F.trim(F.coalesce("text", F.lit("")))) / 4).cast("long")
    return documents.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.max(n).alias("longest"))


def enriched_papers(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match, kind): papers matched by title and year, else by title alone; titles compare in normal form, the smallest match wins."""
    a = left.select("id", L.normalized(F.col("title")).alias("t"), "year")
    b = right.select("id", L.normalized(F.col("title")).alias("t"), "year").where("t <> ''")
    exact = b.where("year is not null").groupBy("t", "year").agg(F.min("id").alias("exact"))
    loose = b.groupBy("t").agg(F.min("id").alias("loose"))
    j = a.join(exact, ["t", "year"], "left").join(loose, "t", "left")
    kind = F.when(F.col("exact").isNotNull(), "title_year").when(F.col("loose").isNotNull(), "title").otherwise("none")
    return j.select("id", F.coalesce("exact", "loose").alias("match"), kind.alias("kind"))


def boundary_set(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (u, v) across fields that never occurred together."""
    seen = pairs.where("cooc_count > 0").select(F.col("u").alias("lo"), F.col("v").alias("hi"))
    return links.where(F.substring("u", 1, 1) != F.substring("v", 1, 1)).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(seen, ["lo", "hi"], "left_anti").drop("lo", "hi")


def ring_layout(nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """Positions (x, y) of nodes (node, strength) on a ring, strongest first; a display list."""
    placed = running_before(nodes, [F.desc("strength"), F.asc("node")], F.lit(1), "k")
    angle = 2 * math.pi * F.col("k") / F.col("n")
    return placed.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))).select("node", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))


def paper_labels(works: DataFrame) -> DataFrame:
    """Short id, page address and title-year label of works; a row without an id has empty ones."""
    token = F.coalesce(F.regexp_extract("work_id", r"(W\d+)", 1), F.lit(""))
    year = F.when(F.col("publication_year") > 0, F.concat(F.lit(" ("), F.col("publication_year").cast("string"), F.lit(")"))).otherwise("")
    return works.select("work_id", token.alias("short_id"), F.when(token != "", F.concat(F.lit("https://openalex.org/"), token)).otherwise("").alias("url"), F.concat(F.coalesce(F.trim("display_name"), F.lit("")), F.coalesce(year, F.lit(""))).alias("label"))


def counter_cosine(a: Column, b: Column) -> Column:
    """Cosine of two histograms (map of string to number); 0 where one is null or empty."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.coalesce(F.element_at(b, e["key"]).cast("double"), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def value_profiles(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, histogram) over the values of one attribute; the attribute is an enumeration, so a histogram is small."""
    n = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(value, "n"))).alias(name))


def profile_similarity(pairs: DataFrame, profiles: DataFrame, names: list[str]) -> DataFrame:
    """Cosine of each named histogram for pairs (u, v) of keys."""
    side = lambda c: profiles.select(F.col(profiles.columns[0]).alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names])
    j = pairs.select("u", "v").join(side("u"), "u", "left").join(side("v"), "v", "left")
    return j.select("u", "v", *[F.round(counter_cosine(F.col(f"u_{n}"), F.col(f"v_{n}")), 6).alias(n) for n in names])


def capped_selection(ranked: DataFrame, limit: int, family_cap: int = 1, endpoint_cap: int = 2) -> DataFrame:
    """A window of ``limit`` rows picked greedily by rank with at most ``family_cap`` rows per family and ``endpoint_cap`` per end; what the caps leave empty is filled
    by rank.  Input: (u, v, family, rank), a list of at most 2,500 rows (longer ones are refused), so one task holds it."""
    rows = ranked.orderBy("rank", "u", "v").limit(2501)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        if len(pdf) > 2500:
            raise ValueError("capped_selection takes a list of at most 2,500 rows")
        pdf = pdf.sort_values(["rank", "u", "v"], ignore_index=True)
        family: dict = {}
        end: dict = {}
        taken: list[int] = []
        for i, r in enumerate(pdf.itertuples(index=False)):
            if len(taken) < limit and family.get(r.family, 0) < family_cap and max(end.get(r.u, 0), end.get(r.v, 0)) < endpoint_cap:
                taken.append(i)
                family[r.family] = family.get(r.family, 0) + 1
                for e in {r.u, r.v}:
                    end[e] = end.get(e, 0) + 1
        left = [i for i in range(len(pdf)) if i not in set(taken)][: max(0, limit - len(taken))]
        out = pdf.loc[taken + left, ["u", "v", "family", "rank"]].assign(place=range(1, len(taken) + len(left) + 1), filled=[False] * len(taken) + [True] * len(left))
        yield out

    return rows.select("u", "v", "family", F.col("rank").cast("long").alias("rank")).coalesce(1).mapInPandas(pick, "u string, v string, family string, rank long, place long, filled boolean")


def best_per_pair(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The best row (score, then ends) of each wanted unordered pair, in the wanted order (pair_key, place)."""
    key = F.concat_ws("__", F.least("u", "v"), F.greatest("u", "v"))
    best = rows.withColumn("pair_key", key).groupBy("pair_key").agg(F.min(F.struct((-F.col("score")).alias("a"), "u", "v")).alias("b"))
    return wanted.join(best, "pair_key").select("place", "pair_key", "b.u", "b.v", (-F.col("b.a")).alias("score"))


def first_distinct(values: Column, n: int) -> Column:
    """The first ``n`` different values of an array that are not blank, in order."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(clean), 1, n)


def validate_batch(rows: DataFrame, required: list[str], key: str) -> DataFrame:
    """(error, rows): rows per violated rule: a required field that is null or blank, a key that occurs more than once."""
    missing = [F.struct(F.lit(f"missing {c}").alias("error"), (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias("bad")) for c in required]
    out = rows.select(F.inline(F.array(*missing))).where("bad").groupBy("error").agg(F.count(F.lit(1)).alias("rows"))
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).where(F.col("rows") > 0)
    return out.unionByName(twice.select(F.lit(f"repeated {key}").alias("error"), "rows"))


def display_priority(questions: DataFrame) -> DataFrame:
    """Questions (u, v, score, specificity, paths) in display order: score and small bonuses for specificity and paths; ties by score, then pair."""
    p = F.round(F.coalesce("score", F.lit(0.0)) + 0.05 * F.coalesce("specificity", F.lit(0.0)) + 0.01 * F.coalesce("paths", F.lit(0)), 6)
    rows = questions.withColumn("display_priority", p)
    return running_before(rows, [F.desc("display_priority"), F.desc("score"), F.asc("u"), F.asc("v")], F.lit(1), "_k").withColumn("place", (F.col("_k") + 1).cast("long")).drop("_k")


def top_means(ranked: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Rows and means of columns over the first ``k`` of a ranked list."""
    return ranked.where(F.col("rank") <= k).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns])


def lexical_decisions(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Combined score and four-way decision of lexical candidate pairs (left_label, right_label, kinds) from label profiles
    (label, papers, neighbors, countries, units, relations, roles, buckets); labels without a profile have none of its overlaps.

    The score blends the best signature, the sequence ratio, shared neighbours, the histograms of relations and roles, countries, and the better of units and buckets.
    """
    points = {"no_paren_signature": 0.99, "paren_acronym": 0.99, "punctuation_signature": 0.95, "singular_signature": 0.92}  # fixed values
    lexical = F.greatest(*[F.when(F.array_contains("kinds", k), v).otherwise(0.0) for k, v in points.items()])
    side = lambda c: profiles.select(F.col("label").alias(f"{c}_label"), *[F.col(n).alias(f"{c}_{n}") for n in profiles.columns if n != "label"])
    j = pairs.join(side("left"), "left_label", "left").join(side("right"), "right_label", "left")
    none = F.array().cast("array<string>")
    sets = lambda n: L.jaccard(F.coalesce(f"left_{n}", none), F.coalesce(f"right_{n}", none))
    maps = lambda n: counter_cosine(F.col(f"left_{n}"), F.col(f"right_{n}"))
    parts = {"lexical": lexical, "text": L.sequence_ratio(F.col("left_label"), F.col("right_label")), "near": sets("neighbors"), "relation": maps("relations"), "role": maps("roles"), "country": sets("countries"), "unit": sets("units"), "bucket": maps("buckets")}
    for k, c in parts.items():
        j = j.withColumn(k, F.round(c, 6))
    score = 0.55 * F.col("lexical") + 0.10 * F.col("text") + 0.10 * F.col("near") + 0.10 * F.col("relation") + 0.05 * F.col("role") + 0.05 * F.col("country") + 0.05 * F.greatest("unit", "bucket")
    graph, least = F.greatest("near", "relation", "role", "bucket"), F.least(F.coalesce("left_papers", F.lit(0)), F.coalesce("right_papers", F.lit(0)))
    strong = F.array_contains("kinds", "no_paren_signature") | F.array_contains("kinds", "paren_acronym")
    decision = F.when(strong & ((least < 20) | (graph >= 0.05)), "accepted_auto").when((F.col("lexical") >= 0.95) & (F.col("text") >= 0.88) & (graph >= 0.20), "accepted_auto")
    decision = decision.when((F.col("lexical") >= 0.90) & (F.col("text") >= 0.80) & ((graph >= 0.08) | (F.col("country") >= 0.20) | (F.col("unit") >= 0.20)), "needs_llm_review").otherwise("candidate_only")
    return j.select("left_label", "right_label", *parts, F.round(score, 6).alias("combined_score"), decision.alias("decision"))
