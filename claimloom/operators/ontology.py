"""Concept ontology: label pools, candidate pairs, signature maps, vector neighbours, duplicate suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.scale import z_score
from ..plans.order import running_before
from ..plans.skew import salted_join, topn_per_key
from .panels import evidence_weight


def label_counts(instances: DataFrame) -> DataFrame:
    """(normalized_label, raw, n) of instances (label, ...)."""
    raw = instances.where("label is not null").groupBy(F.col("label").alias("raw")).agg(F.count(F.lit(1)).alias("n"))  # each wording is normalised once
    return raw.withColumn("normalized_label", L.normalized(F.col("raw"))).where("normalized_label <> ''").select("normalized_label", "raw", "n")


def preferred_labels(counts: DataFrame) -> DataFrame:
    """The most frequent wording of each label; ties by length, then text."""
    best = F.min(F.struct((-F.col("n")).alias("a"), F.length("raw").alias("b"), "raw"))
    return counts.groupBy("normalized_label").agg(best.alias("m"), F.sum("n").alias("instances")).select("normalized_label", F.col("m.raw").alias("preferred_label"), "instances")


def top_values(rows: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per key (count descending, value ascending), empty values left out."""
    n = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return topn_per_key(n, [key], [F.desc("n"), F.asc(value)], k, "rank")


def head_pool(support: DataFrame, least: int, coverage: float) -> DataFrame:
    """Labels above a support threshold, or before cumulative coverage reaches the target (share counted before the label).

    The running share follows one global order, over a range partitioning: many labels of equal support are spread like any others.
    """
    total = support.agg(F.sum("instances").alias("total"))
    rows = running_before(support, [F.desc("instances"), F.asc("normalized_label")], F.col("instances"), "before").crossJoin(F.broadcast(total))
    share = F.col("before") / F.col("total")
    return rows.where((F.col("instances") >= least) | (share < coverage)).select("normalized_label", "instances", F.round(share, 6).alias("share_before"))


def head_rank_scores(metrics: DataFrame, cols: list[str]) -> DataFrame:
    """Sum of the z-scores of log(1 + x) over the given columns."""
    rows = metrics
    for c in cols:
        rows = rows.withColumn(f"_l_{c}", F.log1p(F.coalesce(F.col(c), F.lit(0))))
    rows = z_score(rows, {f"_l_{c}": f"_z_{c}" for c in cols})
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(f"_z_{c}")
    return rows.withColumn("rank_score", F.round(total, 6)).drop(*[f"_{p}_{c}" for p in ("l", "z") for c in cols])


def signature_pairs(preferred: DataFrame) -> DataFrame:
    """Candidate label pairs: in each signature group the most frequent label with every other, a star instead of all pairs."""
    sig = L.signatures(F.col("preferred_label"))
    names = [k for k in sig if k != "normalized_label"]
    rows = preferred.select("normalized_label", "instances", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), sig[k].alias("signature")) for k in names])))
    rows = rows.where("signature <> '' and signature <> normalized_label")
    anchor = rows.groupBy("kind", "signature").agg(F.min(F.struct((-F.col("instances")).alias("a"), F.col("normalized_label").alias("anchor"))).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    anchor = anchor.select(F.concat_ws("\u0001", "kind", "signature").alias("key"), F.col("m.anchor").alias("anchor"))
    keyed = rows.withColumn("key", F.concat_ws("\u0001", "kind", "signature"))
    pairs = salted_join(keyed, anchor, "key", "inner").where("normalized_label <> anchor")
    return pairs.groupBy(F.least("anchor", "normalized_label").alias("left_label"), F.greatest("anchor", "normalized_label").alias("right_label")).agg(F.count_distinct("kind").alias("signatures"))


def unique_signature_map(labels: DataFrame, heads: DataFrame) -> DataFrame:
    """Labels (normalized_label, preferred_label) whose signatures lead to exactly one concept (concept_id, preferred_label)."""
    sig_of = lambda df: df.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("signature")) for k, v in L.signatures(F.col("preferred_label")).items()]))).where("signature <> ''")
    index = sig_of(heads.select("concept_id", "preferred_label")).groupBy("kind", "signature").agg(F.min("concept_id").alias("concept_id"), F.count_distinct("concept_id").alias("k")).where("k = 1").drop("k")
    hits = sig_of(labels.select("normalized_label", "preferred_label")).join(index, ["kind", "signature"])
    return hits.groupBy("normalized_label").agg(F.min("concept_id").alias("concept_id"), F.count_distinct("concept_id").alias("k")).where("k = 1").drop("k")


def token_shortlist(tail: DataFrame, heads: DataFrame, most_df: int = 500, k: int = 5) -> DataFrame:
    """Head concepts that share a token with a label, best Jaccard first; tokens of too many heads find nothing (a stop list, not a cut of results)."""
    toks = lambda c: F.explode(L.tokens(F.col(c))).alias("token")
    h = heads.select("concept_id", F.col("preferred_label").alias("head_label"))
    h_tok = h.select("concept_id", toks("head_label"))
    rare = h_tok.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most_df).select("token")
    t_tok = tail.select("normalized_label", toks("normalized_label"))
    shared = t_tok.join(h_tok.join(rare, "token", "left_semi"), "token").groupBy("normalized_label", "concept_id").agg(F.count(F.lit(1)).alias("shared"))
    nh = h.select("concept_id", F.size(L.tokens(F.col("head_label"))).alias("nh"))
    nt = tail.select("normalized_label", F.size(L.tokens(F.col("normalized_label"))).alias("nt")).distinct()
    rows = shared.join(nh, "concept_id").join(nt, "normalized_label").withColumn("jaccard", F.round(F.col("shared") / (F.col("nh") + F.col("nt") - F.col("shared")), 6))
    return topn_per_key(rows.select("normalized_label", "concept_id", "shared", "jaccard"), ["normalized_label"], [F.desc("jaccard"), F.asc("concept_id")], k, "rank")


#: Cells of one matrix of similarities: 32 MB of doubles.
MATRIX_CELLS = 4_000_000


def _top(sims: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest values of each row, ties at the border by the smaller id."""
    by_id = np.argsort(ids, kind="stable")  # the earlier column of equal values is that of the smaller id
    s = sims[:, by_id]
    least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
    above = s > least
    room = n - above.sum(axis=1, keepdims=True)
    tied = s == least
    keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
    return by_id[np.nonzero(keep)[1].reshape(len(s), n)]


def vector_neighbors(queries: DataFrame, base: DataFrame, k: int = 3, block: int = 20_000) -> DataFrame:
    """Exact k nearest by cosine: ``queries`` (vec_id, embedding) is a stated query set, broadcast in blocks of at most ``block`` vectors
    against all rows of ``base``; each Arrow batch is one matrix product, each batch keeps its own top k, and a rank per query ends it."""
    spark = base.sparkSession
    out = None

    def one(rows: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            for b in batches:
                if not len(b):
                    continue
                m = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                m, own = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).T, b["vec_id"].to_numpy()
                n = min(k, len(b))
                step = max(1, MATRIX_CELLS // len(b))
                for at in range(0, len(ids), step):  # a product of bounded size, whatever the block and the batch
                    some = ids[at : at + step]
                    sims = q[at : at + step] @ m
                    sims[some[:, None] == own[None, :]] = -2
                    sims = sims.round(6)
                    order = np.lexsort((np.broadcast_to(own, sims.shape), -sims), axis=1)[:, :n] if len(b) <= 4 * n else _top(sims, own, n)
                    rows_, cols = np.repeat(np.arange(len(some)), n), order.ravel()
                    yield pd.DataFrame({"vec_id": some[rows_], "neighbor_id": own[cols], "cosine": sims[rows_, cols]}).query("cosine > -2")

        return base.where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "vec_id long, neighbor_id long, cosine double")

    rows: list = []
    for r in queries.where("embedding is not null").select("vec_id", "embedding").toLocalIterator():
        rows.append(r)
        if len(rows) >= block:
            out, rows = one(rows) if out is None else out.unionByName(one(rows)), []
    if rows or out is None:
        out = (one(rows) if rows else spark.createDataFrame([], "vec_id long, neighbor_id long, cosine double")) if out is None else out.unionByName(one(rows))
    return topn_per_key(out, ["vec_id"], [F.desc("cosine"), F.asc("neighbor_id")], k, "rank")


def margin_decisions(neighbors: DataFrame, labels: DataFrame, accept: float = 0.93, review: float = 0.88, margin: float = 0.03) -> DataFrame:
    """Decision per query from its best neighbour and the margin to the best neighbour of another label."""
    rows = neighbors.join(labels.select(F.col("vec_id").alias("neighbor_id"), "label"), "neighbor_id")
    per = rows.groupBy("vec_id", "label").agg(F.max("cosine").alias("best"))
    ranked = topn_per_key(per, ["vec_id"], [F.desc("best"), F.asc("label")], 2, "r")
    g = ranked.groupBy("vec_id").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("r") == 1, F.col("best"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("best"))).alias("second"))
    m = F.round(F.col("top") - F.coalesce("second", F.lit(0.0)), 6)
    decision = F.when((F.col("top") >= accept) & (m >= margin), "accepted").when((F.col("top") >= review) | (m >= margin), "review").otherwise("rejected")
    return g.select("vec_id", "label", F.col("top").alias("cosine"), m.alias("margin"), decision.alias("decision"))


_SIGNATURES = ("normalized_label", "no_paren_signature", "punctuation_signature", "singular_signature", "paren_acronym", "initialism_signature")
# Labels that are related but never the same concept.
PROTECTED_LABELS = [("inflation", "inflation expectations")]


def concept_profiles(heads: DataFrame, neighbors: DataFrame, countries: DataFrame, units: DataFrame) -> DataFrame:
    """Profiles (id, raw, label, tokens, signature sets, neighbors, countries, units) of concepts (concept_id, preferred_label, aliases_json).

    Signatures and tokens are sets over the preferred label and all aliases; ``countries`` and ``units`` are (id, value) rows.  A null or broken list of
    aliases counts as empty.
    """
    names = F.filter(F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    h = heads.select(F.col("concept_id").alias("id"), F.coalesce("preferred_label", F.lit("")).alias("raw"), names.alias("names"))
    rows = h.select("id", "raw", F.explode(F.array_union(F.array("raw"), F.col("names"))).alias("name"))
    rows = rows.select("id", "raw", L.tokens(F.col("name")).alias("tokens"), *[L.signatures(F.col("name"))[k].alias(k) for k in _SIGNATURES])
    sets = [F.array_remove(F.collect_set(k), "").alias(k) for k in _SIGNATURES]
    out = rows.groupBy("id").agg(F.min("raw").alias("raw"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"), *sets).withColumn("label", L.normalized(F.col("raw")))
    out = out.join(neighbors, "id", "left")
    for name, df in (("countries", countries), ("units", units)):
        out = out.join(df.groupBy("id").agg(F.collect_set("value").alias(name)), "id", "left")
    return out.select(*[c for c in out.columns if c not in ("neighbors", "countries", "units")], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("neighbors", "countries", "units")])


def family_scores(pairs: DataFrame, profiles: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Hard same-family reason and soft duplicate score of concept pairs (u, v) from ``concept_profiles``.

    ``reviewed`` holds (a, b, same): normalised labels with a <= b; a pair that was found different is never blocked.  The rules are ordered; a pair
    with contrasting tokens is protected from all of them.  Similarity of embeddings and of corpus buckets is not among the terms.
    """
    p = lambda c: profiles.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in profiles.columns if x != "id"])
    rows = pairs.select("u", "v").join(p("u"), "u").join(p("v"), "v").withColumn("a", F.least("u_label", "v_label")).withColumn("b", F.greatest("u_label", "v_label"))
    rows = rows.join(reviewed.groupBy("a", "b").agg(F.min(F.col("same").cast("int")).alias("same")), ["a", "b"], "left")
    meet = lambda x, y: F.arrays_overlap(F.col(f"u_{x}"), F.col(f"v_{y}"))
    acronyms = meet("paren_acronym", "paren_acronym") | meet("paren_acronym", "initialism_signature") | meet("initialism_signature", "paren_acronym")
    apart = L.jaccard(L.tokens(F.col("u_raw")), L.tokens(F.col("v_raw"))) < 0.25
    rows = rows.withColumn("_acronyms", acronyms).withColumn("_apart", apart)
    ask = F.col("_acronyms") | F.col("_apart")
    rows = rows.withColumn("_ratio", L.sequence_ratio(F.when(ask, F.col("u_label")), F.when(ask, F.col("v_label"))))
    a, b, shared = F.col("u_tokens"), F.col("v_tokens"), F.size(F.array_intersect("u_tokens", "v_tokens"))
    protected = L.contrast(a, b)
    for x, y in PROTECTED_LABELS:
        protected = protected | ((F.col("a") == x) & (F.col("b") == y))
    alias = F.when(meet("normalized_label", "normalized_label") | meet("no_paren_signature", "no_paren_signature"), 1.0).when(meet("punctuation_signature", "punctuation_signature") | meet("singular_signature", "singular_signature"), 0.8)
    alias = alias.when(meet("paren_acronym", "paren_acronym") | meet("initialism_signature", "initialism_signature"), 0.6).otherwise(0.0)
    parts = {
        "containment": (0.22, L.containment(a, b)), "substring_share": (0.15, L.substring_share(F.col("u_label"), F.col("v_label"))), "lexical_overlap": (0.10, L.jaccard(a, b)),
        "shared_tokens": (0.03, F.when(shared >= 2, shared / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))).otherwise(0.0)), "alias_overlap": (0.15, alias),
        "neighbor_overlap": (0.10, L.jaccard(F.col("u_neighbors"), F.col("v_neighbors"))), "context_overlap": (0.03, 0.5 * L.jaccard(F.col("u_countries"), F.col("v_countries")) + 0.5 * L.jaccard(F.col("u_units"), F.col("v_units"))),
    }
    total = F.lit(0.0)
    for k, (w, c) in parts.items():
        rows = rows.withColumn(k, F.round(c, 6))
        total = total + w * F.col(k)
    rows = rows.withColumn("protected", protected).withColumn("contradiction", F.coalesce(F.col("_apart") & (F.col("_ratio") < 0.55), F.lit(False)))
    reason = F.when((F.col("same") == 0) | F.col("protected"), "").when(F.col("same") == 1, "manual_same_concept_review").when(F.col("u_label") == F.col("v_label"), "exact_normalized_label")
    reason = reason.when(meet("normalized_label", "normalized_label"), "alias_normalized_overlap").when(meet("no_paren_signature", "no_paren_signature"), "no_paren_signature_overlap")
    reason = reason.when(meet("punctuation_signature", "punctuation_signature") | meet("singular_signature", "singular_signature"), "formatting_or_singular_variant")
    reason = reason.when(F.col("_acronyms") & (F.col("_ratio") >= 0.60), "explicit_acronym_equivalence").otherwise("")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total * F.when(F.col("contradiction"), 0.5).otherwise(1.0) * F.when(F.col("protected"), 0.15).otherwise(1.0)))
    return rows.select("u", "v", *parts, "contradiction", "protected", reason.alias("reason"), F.round(score, 6).alias("duplicate_score"))


def family_ranking(ranked: DataFrame, scores: DataFrame, strength: float = 0.5) -> DataFrame:
    """Final rank of scored pairs (u, v, score) after duplicate suppression: pairs with a hard reason are blocked, the rest lose strength x score; shift: places won.

    Both ranks follow a global order over a range partitioning, so all pairs can be ranked.
    """
    j = ranked.join(scores.select("u", "v", "duplicate_score", "reason"), ["u", "v"], "left").fillna({"duplicate_score": 0.0, "reason": ""})
    j = running_before(j, [F.desc("score"), F.asc("u"), F.asc("v")], F.lit(1), "_base")
    kept = j.where("reason = ''").withColumn("final_score", F.round(F.col("score") - strength * F.col("duplicate_score"), 6))
    kept = running_before(kept, [F.desc("final_score"), F.desc("score"), F.asc("u"), F.asc("v")], F.lit(1), "_final")
    return kept.select("u", "v", "score", "duplicate_score", "final_score", (F.col("_final") + 1).alias("final_rank"), (F.col("_base") - F.col("_final")).alias("shift"))


def concept_edges(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """Claims lifted from paper-local nodes to concepts (self-loops dropped); each record counts by its earliest row."""
    first = lambda df, key, at: df.groupBy(*key).agg(F.min(F.struct(at, *[c for c in df.columns if c not in (*key, at)])).alias("f")).select(*key, "f.*")
    m = first(mappings.select("custom_id", "node_id", "ingested_at", "concept_id"), ["custom_id", "node_id"], "ingested_at").where("concept_id <> ''")
    more = [c for c in ("claim_status", "explicitness", "tentativeness") if c in edges.columns]
    e = first(edges.select("custom_id", "edge_id", "ingested_at", "source_node_id", "target_node_id", "relationship_type", "sign", "uses_data", "causal_presentation", "statistical_significance", "evidence_method", *more), ["custom_id", "edge_id"], "ingested_at").drop("ingested_at")
    end = lambda c, n: m.select("custom_id", F.col("node_id").alias(c), F.col("concept_id").alias(n))
    return e.join(end("source_node_id", "src"), ["custom_id", "source_node_id"]).join(end("target_node_id", "dst"), ["custom_id", "target_node_id"]).where("src <> dst")


def edge_profiles(lifted: DataFrame, attributes: list[str]) -> DataFrame:
    """Value counts of each attribute per concept pair, as one long table."""
    long = lifted.select("src", "dst", F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("NA")).alias("value")) for a in attributes])))
    return long.groupBy("src", "dst", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def pair_signs(lifted: DataFrame) -> DataFrame:
    """Claims per unordered concept pair: counts by direction and net sign (positive minus negative over signed)."""
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    pos, neg, none = (F.count_if(F.col("sign") == s) for s in ("increase", "decrease", "no_effect"))
    return lifted.groupBy(u.alias("u"), v.alias("v")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("src") == u).alias("forward"), F.count_distinct("custom_id").alias("papers"), F.round(F.try_divide(pos - neg, pos + neg + none), 6).alias("net_sign"))


def concept_weights(lifted: DataFrame) -> DataFrame:
    """Evidence weight, claims and papers per directed concept pair."""
    return lifted.groupBy("src", "dst").agg(evidence_weight().alias("weight"), F.count(F.lit(1)).alias("n"), F.count_distinct("custom_id").alias("papers"))
